"""The run log: redacted writes, tolerant reads, summaries and running totals by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import redact, redact_all
from corvane.operators.scan import running  # noqa: F401

USAGE = "input_tokens bigint, output_tokens bigint, total_tokens bigint, llm_calls bigint, api_retries bigint, estimated_calls bigint, wait_s double"


def event_schema() -> str:
    """The log's schema as DDL."""
    usage = "struct<" + ", ".join(":".join(x.split()) for x in USAGE.split(", ")) + ">"
    return (
        "run_id string, thread_id string, task_id string, node string, attempt int, ts string, duration_ms double, outcome string, detail string, "
        f"usage {usage}, cumulative_usage {usage}, llm_client struct<calls:bigint,api_retries:bigint,wait_s:double>, failure_reason string, error string, error_message string"
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON-lines log; blank and malformed lines are skipped."""
    raw = spark.read.schema(event_schema() + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad is null").drop("_bad")


def write_log(events: DataFrame, path: str, secrets: tuple[str, ...] = ()) -> None:
    """Append events with every text redacted, at any depth."""
    clean = events.select([redact_all(F.col(f"`{f.name}`"), f.dataType, secrets).alias(f.name) for f in events.schema])
    clean.write.mode("append").json(path)


def _counted(df: DataFrame, key: str, what: str, name: str) -> DataFrame:
    """(key, name map<string,bigint>): counts of a column's values that are neither null nor empty."""
    n = df.where((F.col(what) != "") & F.col(what).isNotNull()).groupBy(key, what).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(what, "n")))).alias(name))


def summarize(events: DataFrame, key: str = "run_id", seq: str = "seq", node: str = "node", outcome: str | None = "outcome", duration: str = "duration_ms", ts: str = "ts", rag_node: str = "retrieve") -> DataFrame:
    """One row per run: events, first and last time in the order of the log, total duration, counts by node and outcome."""
    base = events.groupBy(key).agg(
        F.count("*").alias("n_events"), F.min_by(ts, seq).alias("started_ts"), F.max_by(ts, seq).alias("finished_ts"),
        F.round(F.sum(F.coalesce(F.col(duration), F.lit(0))), 1).alias("duration_ms_total"), F.max(F.coalesce((F.col(node) == rag_node), F.lit(False))).alias("rag"),
    )
    out = base.join(_counted(events, key, node, "node_counts"), key, "left")
    return out.join(_counted(events, key, outcome, "outcomes"), key, "left") if outcome else out


def summaries(events: DataFrame, states: DataFrame, seq: str = "ts", secrets: tuple[str, ...] = ()) -> DataFrame:
    """One row per run: what its events add up to, and how its task stands (states: ``loop.STATE``). Texts are redacted before they are cut."""
    client = events.groupBy("run_id").agg(
        F.max("task_id").alias("task_id"), F.coalesce(F.sum("llm_client.calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("llm_client.api_retries"), F.lit(0)).alias("api_retries"), F.round(F.coalesce(F.sum("llm_client.wait_s"), F.lit(0.0)), 3).alias("wait_s")
    )
    waiting = (F.col("node") == "human_review") & F.col("decision").isNull()
    state = states.select(
        "task_id", F.when(waiting, "awaiting_review").otherwise(F.col("status")).alias("status"), redact(F.col("failure_reason"), secrets, 300).alias("failure_reason"), "attempt", "retries_used", "human_rounds",
        F.struct("input_tokens", "output_tokens", "total_tokens", "llm_calls").alias("token_usage"), F.coalesce("doc_ids", F.array().cast("array<string>")).alias("retrieved_doc_ids"), F.col("run.category").alias("final_category"),
    )
    totals = client.select("run_id", "task_id", F.struct("calls", "api_retries", "wait_s").alias("llm_client_totals"))
    return summarize(events, "run_id", seq).join(totals, "run_id").join(state, "task_id", "left")


def write_summaries(summary: DataFrame, path: str) -> None:
    """A folder per run with its summary as JSON; a run written again replaces its own only."""
    summary.withColumn("run", F.col("run_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


def merge_usage(usage: DataFrame, key: str, *counters: str) -> DataFrame:
    """Sums by key: null counts as nothing, and stays null where all are null."""
    return usage.groupBy(key).agg(*[F.sum(c).alias(c) for c in counters])


def add_usage(a: Column, b: Column) -> Column:
    """Two maps of counters, added by key; a null counts as nothing, and a key that is null on both sides is left out."""
    empty = F.create_map().cast("map<string,bigint>")
    both = F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.when(x.isNotNull() | y.isNotNull(), F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def extract_usage(prompt: Column, completion: Column, given_in: Column, given_out: Column, given_total: Column) -> Column:
    """struct of token counts: the provider's where there are any, else estimates of a quarter of the characters."""
    guess = lambda c: F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("bigint")
    known = given_in.isNotNull() | given_out.isNotNull()
    i = F.when(known, F.coalesce(given_in, F.lit(0))).otherwise(guess(prompt))
    o = F.when(known, F.coalesce(given_out, F.lit(0))).otherwise(guess(completion))
    total = F.when(known, F.coalesce(F.nullif(given_total, F.lit(0)), i + o)).otherwise(i + o)
    return F.struct(F.lit(1).alias("llm_calls"), i.alias("input_tokens"), o.alias("output_tokens"), total.alias("total_tokens"), F.when(known, 0).otherwise(1).alias("estimated_calls"))


def new_run_id() -> Column:
    """A run's id: UTC time and eight hexadecimal digits."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))


def format_event(node: Column, attempt: Column, detail: Column) -> Column:
    """One line of at most 160 ASCII characters for an event; detail: a JSON text of its summary."""
    get = lambda k, other="": F.coalesce(F.get_json_object(detail, f"$.{k}"), F.lit(other))
    n = lambda k: F.coalesce(F.json_array_length(F.get_json_object(detail, f"$.{k}")), F.lit(0)).cast("string")
    error = F.coalesce(F.concat(F.lit(" error="), F.get_json_object(detail, "$.error")), F.lit(""))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    top = F.coalesce(F.format_string("%.3f", F.array_max(F.from_json(F.get_json_object(detail, "$.scores"), "array<double>"))), F.lit("-"))
    top = F.when(F.get_json_object(detail, "$.scores").isNull() | (n("scores") == "0"), "-").otherwise(top)
    line = (
        F.when(node == "retrieve", say("[retrieve] mode=", get("mode"), " queries=", n("queries"), " docs=", get("n_docs", "0"), " top=", top, error))
        .when(node.isin("generate", "revise"), say("[", node, "] attempt=", attempt.cast("string"), " code=", get("code_chars", "0"), " chars tests=", get("tests_chars", "0"), " chars", F.when(error != "", say(" FAILED", error)).otherwise("")))
        .when(node == "run_tests", say("[run_tests] attempt=", attempt.cast("string"), " ", F.when(get("passed") == "true", "PASS").otherwise("FAIL"), " category=", get("category"), " tests=", get("tests_total", "0"), " failed=", get("tests_failed", "0")))
        .when(node == "analyze_error", say("[analyze_error] category=", get("category"), " fault=", get("fault"), " needs_docs=", get("needs_docs", "false")))
        .when(node == "human_review", F.when(get("paused") == "true", "[human_review] PAUSED: awaiting human review").otherwise(say("[human_review] decision=", get("decision"), " round=", get("human_rounds", "0"))))
        .when(node == "fail", say("[fail] ", F.substring(get("reason"), 1, 120))).otherwise(say("[", node, "] done"))
    )
    return F.substring(F.regexp_replace(line, r"[^\x20-\x7E]", "?"), 1, 160)


def format_eval_line(task: Column, mode: Column, status: Column, passed: Column, attempts: Column, calls: Column) -> Column:
    """One line of at most 160 ASCII characters for a cell of an evaluation."""
    word = F.when(status == "error", "ERROR").when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL")
    line = F.concat_ws(" ", task.cast("string"), mode, word, F.concat(F.lit("attempts="), attempts.cast("string")), F.concat(F.lit("calls="), calls.cast("string")))
    return F.substring(F.regexp_replace(line, r"[^\x20-\x7E]", "?"), 1, 160)


def stop_reasons(errors: DataFrame, key: str, seq: str, error: str) -> DataFrame:
    """(key, reason): quota or auth by the first of a run's errors, in order, that ends a whole evaluation; null where none does."""
    kind = F.when(F.col(error) == "daily_quota", "quota").when(F.col(error).isin("auth", "model"), "auth")
    return errors.groupBy(key).agg(F.min_by(kind, F.when(kind.isNotNull(), F.col(seq))).alias("reason"))


def sessions(events: DataFrame, ts: str, key: str, value: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n, total): a key's events that follow each other within the gap; end: the last event's time and the gap. One definition for batches and
    streams (append mode); a stream leaves out rows later than the watermark."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def display_status(status: Column, waiting: Column, decision: Column) -> Column:
    """The status to show: a pause and a final rejection come before the stored one."""
    return F.when(waiting, "awaiting_review").when(decision == "reject_final", "rejected").otherwise(status)
