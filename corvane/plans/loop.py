"""The generate, test, revise workflow as supersteps over a table of runs: one row a task, routed by Column rules.

Effects (retrieval, model, sandbox) are injected DataFrame functions; each superstep's rows are written to the shared folder,
so a run can be paused for review and resumed by key from another session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import strip
from corvane.operators.analysis import analyze
from corvane.sources.durable import durable, entries, exists

NODES = ("retrieve", "generate", "run_tests", "analyze_error", "revise", "human_review", "finalize", "fail")
RUN = "struct<passed:boolean,category:string,exit_code:int,timed_out:boolean,duration_s:double,tests_total:int,tests_failed:int,failures:array<struct<test_name:string,error_type:string,message:string,traceback:string>>,stdout:string,stderr:string>"
STATE = (
    "task_id string, task string, provided_tests string, auto_approve boolean, node string, step int, status string, attempt int, retries_used int, human_rounds int, code string, tests string, "
    f"run {RUN}, needs_docs boolean, retrieval_queries array<string>, seen_queries array<string>, doc_ids array<string>, decision string, feedback string, failure_reason string, llm_calls int, nodes array<string>, "
    "input_tokens bigint, output_tokens bigint, total_tokens bigint, api_retries bigint, wait_s double, started_ts timestamp, finished_ts timestamp"
)


#: What a run's calls add up to.
COUNTERS = ("input_tokens", "output_tokens", "total_tokens", "api_retries", "wait_s")
UNREADABLE = "the model's reply could not be read twice: "


@dataclass(frozen=True)
class Limits:
    """Bounds of a run: fixed defaults."""

    retries: int = 3
    human_rounds: int = 2
    llm_calls: int = 10
    steps: int = 100


def after_run_tests(limits: Limits = Limits()) -> Column:
    passed = F.coalesce(F.col("run.passed"), F.lit(False))
    return F.when(F.col("run").isNull(), "fail").when(passed, F.when(F.col("auto_approve"), "finalize").otherwise("human_review")).when(F.col("retries_used") < limits.retries, "analyze_error").otherwise("fail")


def after_model() -> Column:
    return F.when(F.col("status") == "failed", "fail").otherwise("run_tests")


def after_review(limits: Limits = Limits()) -> Column:
    again = F.when(F.col("human_rounds") <= limits.human_rounds, "revise").otherwise("fail")
    return F.when(F.col("decision") == "approve", "finalize").when(F.col("decision") == "edit", "run_tests").when(F.col("decision") == "reject", again).otherwise("fail")


def after_analysis(rag: bool) -> Column:
    fresh = F.exists("retrieval_queries", lambda q: ~F.array_contains(F.coalesce(F.col("seen_queries"), F.array().cast("array<string>")), q))
    return F.when(F.coalesce(F.col("needs_docs"), F.lit(False)) & F.coalesce(fresh, F.lit(False)) & F.lit(rag), "retrieve").otherwise("revise")


def after_retrieve() -> Column:
    return F.when(strip(F.coalesce(F.col("code"), F.lit(""))) == "", "generate").otherwise("revise")


def route(rag: bool, limits: Limits = Limits()) -> Column:
    """The node after the one that a row has just left."""
    at = F.col("node")
    return (
        F.when(at == "retrieve", after_retrieve()).when(at.isin("generate", "revise"), after_model()).when(at == "run_tests", after_run_tests(limits))
        .when(at == "analyze_error", after_analysis(rag)).when(at == "human_review", after_review(limits)).otherwise("end")
    )


Effect = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Effects:
    """model: rows to rows with code, tests, status; sandbox: rows with run; retriever: rows with doc_ids. All keyed by task_id.

    A model may also return ``parse_error`` (why a reply could not be read: it is asked once more, then the run fails) and ``usage``
    struct<input_tokens, output_tokens, total_tokens, api_retries, wait_s> of its calls (without it, tokens are estimated from code and
    tests). ``nodes`` replaces the work of other nodes by name.
    """

    model: Effect
    sandbox: Effect
    retriever: Effect | None = None
    nodes: dict[str, Effect] | None = None


def start(spark: SparkSession, tasks: DataFrame, effects: Effects, auto_approve: bool) -> DataFrame:
    """Initial states of tasks (task_id, task, provided_tests)."""
    first = "retrieve" if effects.retriever else "generate"
    given = {"task_id", "task", "provided_tests"}
    defaults = {"auto_approve": F.lit(auto_approve), "node": F.lit(first), "step": F.lit(0), "status": F.lit("running"), "attempt": F.lit(0), "retries_used": F.lit(0), "human_rounds": F.lit(0), "llm_calls": F.lit(0), **{c: F.lit(0) for c in COUNTERS}, "started_ts": F.current_timestamp(), "nodes": F.array().cast("array<string>"), "seen_queries": F.array().cast("array<string>")}
    schema = spark.createDataFrame([], STATE).schema
    return tasks.select([F.col(f.name) if f.name in given else defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _used(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with what their last call used added to their counters."""
    guess = F.ceil((F.length(F.coalesce("code", F.lit(""))) + F.length(F.coalesce("tests", F.lit("")))) / 4).cast("bigint")
    asked = F.ceil(F.length(F.coalesce("task", F.lit(""))) / 4).cast("bigint")
    if "usage" in df.columns:
        own = {f.name for f in df.schema["usage"].dataType}
        step = {c: F.coalesce(F.col(f"usage.{c}"), F.lit(0)) if c in own else F.lit(0) for c in COUNTERS}
    else:
        step = dict.fromkeys(COUNTERS, F.lit(0)) | {"input_tokens": asked, "output_tokens": guess, "total_tokens": asked + guess}
    return df.withColumns({c: F.col(c) + v for c, v in step.items()}).select(columns)


def _ask(df: DataFrame, effects: Effects) -> DataFrame:
    """Rows with the model's replies; one that cannot be read is asked for once more."""
    columns, out = df.columns, effects.model(df)
    if "parse_error" not in out.columns:
        return _used(out, columns)
    first = durable(_used(out, [*columns, "parse_error"]), "replies")  # written: no reply is asked for twice but those below
    bad = first.where("parse_error is not null").drop("parse_error").withColumn("llm_calls", F.col("llm_calls") + 1)
    second = _used(effects.model(bad), [*columns, "parse_error"])
    failed = F.col("parse_error").isNotNull()
    second = second.withColumns({"status": F.when(failed, "failed").otherwise(F.col("status")), "failure_reason": F.when(failed, F.concat(F.lit(UNREADABLE), "parse_error")).otherwise(F.col("failure_reason"))})
    return first.where("parse_error is null").unionByName(second).select(columns)


def _enter(df: DataFrame, node: str, effects: Effects, limits: Limits) -> DataFrame:
    """Rows after a node's work."""
    if effects.nodes and node in effects.nodes:
        return effects.nodes[node](df)
    if node in ("generate", "revise"):
        df = df.withColumn("retries_used", F.col("retries_used") + (1 if node == "revise" else 0)).withColumn("attempt", F.col("attempt") + 1).withColumn("llm_calls", F.col("llm_calls") + 1)
        over = F.col("llm_calls") > limits.llm_calls
        out = _ask(df, effects)
        return out.withColumn("status", F.when(over, "failed").otherwise(F.col("status"))).withColumn("failure_reason", F.when(over, "LLM call budget exhausted").otherwise(F.col("failure_reason")))
    if node == "run_tests":
        return effects.sandbox(df)
    if node == "retrieve":
        asked = F.coalesce(F.col("retrieval_queries"), F.array("task"))
        return effects.retriever(df).withColumn("seen_queries", F.array_distinct(F.concat("seen_queries", asked)))
    if node == "analyze_error":
        keep = [c for c in df.columns if c not in ("needs_docs", "retrieval_queries")]
        return analyze(df.select(keep)).select(*keep, "needs_docs", "retrieval_queries")
    if node == "human_review":
        return df.withColumn("human_rounds", F.col("human_rounds") + F.when(F.col("decision") == "reject", 1).otherwise(0))
    status = "approved" if node == "finalize" else "failed"
    reason = F.coalesce(F.nullif(F.trim(F.col("failure_reason")), F.lit("")), F.when(F.col("run").isNull(), "no test result").otherwise(F.concat(F.lit("tests failed: "), F.coalesce(F.col("run.category"), F.lit("unknown")))))
    return df.withColumns({"status": F.lit(status), "failure_reason": F.col("failure_reason") if node == "finalize" else reason, "finished_ts": F.current_timestamp()})


def stream(states: DataFrame, effects: Effects, limits: Limits = Limits()) -> Iterator[DataFrame]:
    """The states after each superstep: every row does its node's work and moves on. Rows that have ended or wait for a review stay
    where they are written: only the others are written again."""
    columns, resting = states.columns, []
    for _ in range(limits.steps):
        waiting = (F.col("node") == "human_review") & F.col("decision").isNull()
        still = F.col("node").isin(*NODES) & ~waiting
        counts = {(r["moves"], r["node"]): r["count"] for r in states.groupBy(still.alias("moves"), "node").count().collect()}
        if not any(moves for moves, _ in counts):
            return
        if not all(moves for moves, _ in counts):
            resting.append(states.where(~still))
        moved = None
        for node in (node for moves, node in counts if moves):
            out = _enter(states.where(still & (F.col("node") == node)), node, effects, limits).withColumn("nodes", F.concat("nodes", F.array(F.lit(node)))).withColumn("step", F.col("step") + 1)
            after = out.withColumn("node", route(effects.retriever is not None, limits))
            if node == "human_review":
                after = after.withColumn("decision", F.lit(None).cast("string"))
            moved = after.select(columns) if moved is None else moved.unionByName(after.select(columns))
        states = durable(moved, "superstep")
        yield reduce(DataFrame.unionByName, [*resting, states])


def run(states: DataFrame, effects: Effects, limits: Limits = Limits(), folder: str | None = None) -> DataFrame:
    """The states when every row has ended or waits for a review; with a folder, each superstep is a checkpoint there."""
    for states in stream(states, effects, limits):  # noqa: B020 - the last is the result
        if folder:
            checkpoint(states, folder)
    return states.withColumn("status", F.when(F.col("node") == "human_review", "awaiting_review").otherwise(F.col("status")))


def resume(states: DataFrame, decisions: DataFrame, effects: Effects, limits: Limits = Limits()) -> DataFrame:
    """Go on with decisions (task_id, decision, feedback, code, tests): approve, edit, reject or reject_final; anything else is an error."""
    bad = F.when(~F.col("decision").isin("approve", "edit", "reject", "reject_final"), F.raise_error(F.concat(F.lit("unknown decision: "), F.col("decision"))))
    d = decisions.select("task_id", F.coalesce(bad.cast("string"), F.col("decision")).alias("_d"), F.col("feedback").alias("_f"), F.col("code").alias("_c"), F.col("tests").alias("_t"))
    edit = F.col("_d") == "edit"
    joined = states.join(d, "task_id", "left").withColumns({
        "decision": F.when(F.col("node") == "human_review", F.col("_d")), "feedback": F.coalesce("_f", "feedback"), "status": F.when(F.col("_d").isNotNull(), "running").otherwise(F.col("status")),
        "code": F.when(edit, F.coalesce("_c", "code")).otherwise(F.col("code")), "tests": F.when(edit, F.coalesce("_t", "tests")).otherwise(F.col("tests")),
    }).select(states.columns)
    return run(durable(joined, "resumed"), effects, limits)


def pending_reviews(states: DataFrame) -> DataFrame:
    """What a reviewer is shown of each run that waits: (task_id, attempt, human_rounds, code, tests, category, doc_ids)."""
    waiting = states.where((F.col("node") == "human_review") & F.col("decision").isNull())
    return waiting.select("task_id", "attempt", "human_rounds", "code", "tests", F.col("run.category").alias("category"), "doc_ids")


def rag_enabled(nodes: Column | str = "nodes") -> Column:
    """Whether a run looks documents up: then that is its first node."""
    return F.coalesce(F.get(F.col(nodes) if isinstance(nodes, str) else nodes, F.lit(0)) == "retrieve", F.lit(False))


def responses(states: DataFrame) -> DataFrame:
    """What a caller is told of each run: (task_id, status, final_code, code, tests, attempts, retries_used, retrieval_queries, retrieved_doc_ids, duration_s, failure_reason).

    A run without an id gets one, one without a status is running; final_code is that of an approved run; times are null while a run goes on.
    """
    none = F.array().cast("array<string>")
    status = F.coalesce("status", F.lit("running"))
    return states.select(
        F.coalesce(F.nullif(F.col("task_id"), F.lit("")), F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("task_id"), status.alias("status"), F.when(status == "approved", F.col("code")).alias("final_code"), F.coalesce("code", F.lit("")).alias("code"),
        F.coalesce("tests", F.lit("")).alias("tests"), F.coalesce("attempt", F.lit(0)).alias("attempts"), F.coalesce("retries_used", F.lit(0)).alias("retries_used"), F.coalesce("retrieval_queries", none).alias("retrieval_queries"),
        F.transform(F.coalesce("doc_ids", none), lambda x: F.coalesce(x, F.lit(""))).alias("retrieved_doc_ids"), F.round((F.unix_micros("finished_ts") - F.unix_micros("started_ts")) / 1e6, 3).alias("duration_s"), "failure_reason",
    )


def save(states: DataFrame, path: str) -> None:
    """States for another session: what waits for a review outlives this driver (tables in between do not)."""
    states.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, task_id: str | None = None) -> DataFrame:
    """Saved states, of one task where it is named; no rows for a task that was never saved."""
    found = spark.read.schema(spark.createDataFrame([], STATE).schema).parquet(path)
    return found if task_id is None else found.where(F.col("task_id") == task_id)


def checkpoint(states: DataFrame, folder: str) -> str:
    """States as the next of a folder's numbered checkpoints; earlier ones stay, so what is being read is never replaced."""
    spark = states.sparkSession
    number = max((n for n, _ in entries(spark, folder)), default=0) + 1
    path = f"{folder}/{number:012d}"
    states.write.parquet(path)
    return path


def restore(spark: SparkSession, folder: str, task_id: str | None = None) -> DataFrame:
    """The newest checkpoint that was written whole, of one task where it is named; no rows without any."""
    whole = next((f"{folder}/{name}" for _, name in sorted(entries(spark, folder), reverse=True) if exists(spark, f"{folder}/{name}/_SUCCESS")), None)
    return load(spark, whole, task_id) if whole else spark.createDataFrame([], STATE)


def classify_exit(status: Column, failure_reason: Column) -> Column:
    """5 waiting, 0 approved, 3 out of quota, else 1."""
    return F.when(status == "awaiting_review", 5).when(status == "approved", 0).when(F.lower(F.coalesce(failure_reason, F.lit(""))).contains("quota"), 3).otherwise(1)
