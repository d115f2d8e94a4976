"""The run summary as a stream: keyed state that takes lines late and more than once.

A line counts once, whenever it comes and however often: its run and number are kept, so that state is dealt out by lines and no run, large or small, is a unit of work.
What is new is then added up by run, slice (a hash of a line's block of sequence numbers), node and outcome, of each partition first; ``merged`` adds these up. The first and
last times are those of the least and greatest number, so order of arrival does not matter. State lives in RocksDB, is read and written by built-ins only, and goes on after a restart
from its checkpoint. The lines of a batch cost the same however few of them a run has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, SLICES = 512, 4
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is known of the lines of a run's slice with one node and outcome. Sums of durations and waits are in millionths, so that they are exact.
PARTIAL = (
    "run string, slice int, node string, outcome string, n_events bigint, first_seq bigint, started_ts timestamp, last_seq bigint, finished_ts timestamp, duration_e6 bigint, rag boolean, "
    "calls bigint, api_retries bigint, wait_e6 bigint"
)
_KEY = ("run", "slice", "node", "outcome")


def session(spark: SparkSession) -> SparkSession:
    """A session of one's own with the state store that keyed state needs; the caller's settings stay as they are."""
    s = spark.newSession()
    s.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    s.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    s.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return s


def partials(events: DataFrame, key: str = "run_id", seq: str = "seq", node: str = "node", outcome: Column | str | None = "outcome", duration: Column | str = "duration_ms", ts: str = "ts", rag_node: str = "retrieve", client: str | None = "llm_client") -> DataFrame:
    """A stream's (or a batch's) lines as slices of summaries (``PARTIAL``), each sent again when it changes: for update mode, in a session of ``session``."""
    col = lambda c: F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
    e6 = lambda c: F.round(F.coalesce(c, F.lit(0)).cast("decimal(28,6)") * 1_000_000).cast("bigint")
    part = lambda name: F.col(f"{client}.{name}") if client else F.lit(0)
    lines = events.where(F.col(seq).isNotNull()).select(
        F.col(key).cast("string").alias("run"), F.pmod(F.xxhash64(F.floor(F.col(seq) / BLOCK)), F.lit(SLICES)).cast("int").alias("slice"), F.col(node).cast("string").alias("node"), col(outcome).cast("string").alias("outcome"),
        F.col(seq).cast("bigint").alias("seq"), F.col(ts).cast("timestamp").alias("at"), e6(col(duration)).alias("duration_e6"), F.coalesce(F.col(node) == rag_node, F.lit(False)).alias("rag"),
        F.coalesce(part("calls").cast("bigint"), F.lit(0)).alias("calls"), F.coalesce(part("api_retries").cast("bigint"), F.lit(0)).alias("api_retries"), e6(part("wait_s")).alias("wait_e6"),
    )
    return lines.dropDuplicates(["run", "seq"]).groupBy(*_KEY).agg(
        F.count("*").alias("n_events"), F.min("seq").alias("first_seq"), F.min_by("at", "seq").alias("started_ts"), F.max("seq").alias("last_seq"), F.max_by("at", "seq").alias("finished_ts"),
        F.sum("duration_e6").alias("duration_e6"), F.max("rag").alias("rag"), F.sum("calls").alias("calls"), F.sum("api_retries").alias("api_retries"), F.sum("wait_e6").alias("wait_e6"),
    )


def merged(slices: DataFrame) -> DataFrame:
    """One row per run from its slices, the last word of each (which has the most events): what ``summarize`` gives for the whole log."""
    last = slices.groupBy(*_KEY).agg(F.max_by(F.struct(*[c for c in slices.columns if c not in _KEY]), "n_events").alias("s")).select("run", "node", "outcome", "s.*")
    total = last.groupBy("run").agg(
        F.sum("n_events").alias("n_events"), F.min_by("started_ts", "first_seq").alias("started_ts"), F.max_by("finished_ts", "last_seq").alias("finished_ts"), F.round(F.sum("duration_e6") / 1e6, 1).alias("duration_ms_total"), F.max("rag").alias("rag"),
        F.struct(F.sum("calls").alias("calls"), F.sum("api_retries").alias("api_retries"), F.round(F.sum("wait_e6") / 1e6, 3).alias("wait_s")).alias("llm_client_totals"),
    )
    for what, name in (("node", "node_counts"), ("outcome", "outcomes")):
        each = last.where(F.col(what) != "").groupBy("run", F.col(what).alias("what")).agg(F.sum("n_events").alias("n"))
        total = total.join(each.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("what", "n")))).alias(name)), "run", "left")
    return total


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream of ``partials`` can read now, added to the slices of a folder; what the folder holds of all runs of the stream."""

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")  # a batch that is run again replaces itself

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return stream.sparkSession.read.schema(PARTIAL).parquet(path).select(*[x.split()[0] for x in PARTIAL.split(", ")])
