"""The event log as a stream: the batch summary's measures kept per key, windows with late data, idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.store import ChunkStore


def tail(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of a folder's files; event times are cast for watermarks."""
    raw = spark.readStream.format(fmt).schema(schema).options(**options).load(path)
    ntz = [f.name for f in raw.schema if f.dataType.typeName() == "timestamp_ntz"]
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else raw


def totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_events, total, min_value, max_value): for complete or update mode, and for batches alike."""
    return events.groupBy(key).agg(F.count("*").alias("n_events"), F.round(F.sum(F.col(value).cast("decimal(28,6)")), 4).cast("double").alias("total"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def windowed(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, key, n, total) by event-time window; rows later than the watermark are left out by a stream."""
    w = F.window(ts, width, slide or width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def drain(stream: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that a stream can read now, as a table in memory (for tests and small results)."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    q = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def ingest(stream: DataFrame, store: ChunkStore, seq: str, checkpoint: str):
    """Upsert each micro-batch by id, the last row of an id winning: running a batch again changes nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: store.upsert(df, seq) and None).start()
