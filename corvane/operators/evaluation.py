"""Evaluation of a task by mode grid: pending cells, records, summaries, paired comparison, report, ranking metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.sources.durable import durable

SCHEMA_VERSION = 1
RECORD = (
    "schema_version int, task_id string, mode string, status string, passed boolean, attempts int, retries_used int, human_rounds int, first_try boolean, llm_calls int, api_retries int, "
    "input_tokens bigint, output_tokens bigint, total_tokens bigint, wait_s double, wall_s double, final_category string, failure_reason string, n_docs int, doc_ids array<string>, "
    "re_retrievals int, final_code string, model string, run_id string, finished_ts string"
)


def is_complete() -> Column:
    return F.coalesce((F.col("schema_version") == SCHEMA_VERSION) & F.col("status").isin("approved", "failed"), F.lit(False))


def pending(tasks: DataFrame, modes: DataFrame, done: DataFrame, limit: int | None = None, force: bool = False) -> DataFrame:
    """(task_id, mode) still to run, by task: the grid without its complete cells. tasks (task_id), modes (mode, mode_no): a few."""
    named = [F.struct(F.lit(r["mode"]).alias("mode"), F.lit(r["mode_no"]).alias("mode_no")) for r in modes.orderBy("mode_no").collect()]
    grid = tasks.select("task_id", F.explode(F.array(*named)).alias("m")).select("task_id", "m.mode", "m.mode_no")
    left = grid if force else grid.join(done.where(is_complete()).select("task_id", "mode"), ["task_id", "mode"], "left_anti")
    out = left.orderBy("task_id", "mode_no").select("task_id", "mode")
    return out if limit is None else out.limit(limit)


def mode_summary(records: DataFrame, by: str = "mode") -> DataFrame:
    """Runs, passes, rates, means and the median time by mode."""
    out = records.groupBy(by).agg(
        F.count("*").alias("runs"), F.count_if(F.col("passed")).alias("n_passed"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("pass_rate"),
        F.count_if(F.col("first_try")).alias("n_first_try"), F.round(F.avg("attempts"), 6).alias("mean_attempts"), F.round(F.avg("llm_calls"), 6).alias("mean_llm_calls"),
        F.round(F.avg("total_tokens"), 6).alias("mean_tokens"),
    )
    middle = medians(records, "wall_s", (by,)).select(F.col(by).alias("_by"), F.round("median", 6).alias("median_wall_s"))
    return out.join(middle, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def paired(records: DataFrame, a: str, b: str, key: str = "task_id", values: tuple[str, ...] = ("llm_calls", "attempts")) -> DataFrame:
    """One row: how often both, only a, only b and neither passed, and mean differences a - b, over tasks that have both modes."""
    cells = records.where(F.col("mode").isin(a, b)).groupBy(key).agg(
        *[F.max(F.when(F.col("mode") == m, F.col(v).cast("double"))).alias(f"{v}_{side}") for side, m in (("a", a), ("b", b)) for v in ("passed", *values)]
    ).where("passed_a is not null and passed_b is not null")
    both, pa, pb = F.count("*"), F.col("passed_a") == 1, F.col("passed_b") == 1
    return cells.agg(
        both.alias("pairs"), F.count_if(pa & pb).alias("both"), F.count_if(pa & ~pb).alias("only_a"), F.count_if(~pa & pb).alias("only_b"), F.count_if(~pa & ~pb).alias("neither"),
        *[F.round(F.avg(F.col(f"{v}_a") - F.col(f"{v}_b")), 6).alias(f"diff_{v}") for v in values],
    )


def cells(tasks: DataFrame, records: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """One row per task with a text per mode: -, error, PASS or FAIL with attempts and calls; an error overrides what else there is."""
    text = F.when(F.col("status") == "error", "error").otherwise(F.format_string("%s a=%d c=%d", F.when(F.col("passed"), "PASS").otherwise("FAIL"), F.col("attempts"), F.col("llm_calls")))
    flat = records.withColumn("cell", text).groupBy("task_id").pivot("mode", list(modes)).agg(F.max_by("cell", (F.col("cell") == "error").cast("int")))
    return tasks.select("task_id").join(flat, "task_id", "left").na.fill("-", list(modes))


def incomplete_pairs(tasks: DataFrame, records: DataFrame, a: str, b: str) -> DataFrame:
    """(task_id) of tasks without a complete record in both modes."""
    full = records.where(is_complete()).where(F.col("mode").isin(a, b)).groupBy("task_id").agg(F.countDistinct("mode").alias("n")).where("n = 2")
    return tasks.select("task_id").join(full, "task_id", "left_anti")


def ranking_metrics(ranks: DataFrame, kind: str = "kind", rank: str = "rank", ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """hit@k and MRR over all queries (a miss counts 0), mean rank over those found; overall (kind null) and by kind."""
    r = F.col(rank)
    return ranks.groupingSets([[], [F.col(kind)]], F.col(kind)).agg(
        F.count("*").alias("queries"), *[F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in ks],
        F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(r), 6).alias("mean_rank"),
    )


def order_statistics(df: DataFrame, value: str, by: tuple[str, ...], at: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, n, one column for each of at): the values at some indexes of each group's sorted values; at: from the number of values to an index. Null values do not
    count, null groups are groups.

    Values lie in ranges, a file each: counts by range tell which ones hold the indexes, and only those are sorted. No group's values
    meet in one task.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    named = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("_v"))
    by_value = named.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    ranged = durable(by_value.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy(*keys)
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_c").alias("_p"))  # as many rows as ranges and groups
    parts = parts.withColumn("n", F.sum("_p").over(w)).withColumn("_before", F.sum("_p").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_p"))
    parts = parts.withColumns({f"_at_{name}": index(F.col("n")).cast("bigint") for name, index in at.items()})
    within = lambda name, before, upto: (F.col(f"_at_{name}") >= before) & (F.col(f"_at_{name}") < upto)
    held = parts.where(reduce(lambda a, b: a | b, [within(name, F.col("_before"), F.col("_before") + F.col("_p")) for name in at]))
    held = held.select(*[F.col(k).alias(f"{k}h") for k in keys], F.col("_part").alias("_ph"), "n", "_before", *[f"_at_{name}" for name in at])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}h")) for k in keys], F.col("_part") == F.col("_ph"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    run = ranged.join(held, same).withColumn("_upto", upto)
    found = run.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(within(name, F.col("_upto") - F.col("_c"), F.col("_upto")), F.col("_v"))).alias(name) for name in at])
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", *at)


def p95(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The value at index min(n - 1, round(0.95 (n - 1))) of the sorted ones, half to even, without interpolation."""
    found = order_statistics(df, value, by, {"p95": lambda n: F.least(n - 1, F.bround(F.lit(0.95) * (n - 1), 0).cast("bigint"))})
    return found.where("n > 0").select(*by, "p95", "n")


def medians(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, median): the middle value, or the mean of the two in the middle."""
    found = order_statistics(df, value, by, {"_lo": lambda n: F.floor((n - 1) / 2), "_hi": lambda n: F.floor(n / 2)})
    return found.select(*by, "n", ((F.col("_lo").cast("double") + F.col("_hi").cast("double")) / 2).alias("median"))


def error_tasks(records: DataFrame) -> DataFrame:
    """(task_id) of tasks with an error, distinct."""
    return records.where("status = 'error'").select("task_id").distinct()


def report_header(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """One row of counts: tasks, complete records, errors, and tasks with errors (their ids: ``error_tasks``)."""
    n = tasks.agg(F.count("*").alias("tasks"))
    r = records.agg(F.count_if(is_complete()).alias("complete"), F.count_if(F.col("status") == "error").alias("errors"), F.countDistinct(F.when(F.col("status") == "error", F.col("task_id"))).cast("int").alias("n_error_tasks"))
    return r.withColumn("tasks", F.lit(n.first()["tasks"]).cast("bigint")).select("tasks", *r.columns)


def report_lines(summary: list, pair: object | None, rows: Iterable, modes: tuple[str, ...], model: str | None = None) -> Iterator[str]:
    """Markdown, line by line, of aggregates (one row per mode, one pair) and of any number of rows, one per task."""
    number = lambda v, form: "-" if v is None else format(v, form)
    yield from ["# Evaluation", ""] + ([f"Model: {model}", ""] if model else [])
    yield "| mode | runs | passed | pass rate | first try | attempts | calls | tokens | median wall s |"
    yield "|---|---|---|---|---|---|---|---|---|"
    for s in summary:
        yield f"| {s['mode']} | {s['runs']} | {s['n_passed']} | {number(s['pass_rate'], '.1%')} | {s['n_first_try']} | {number(s['mean_attempts'], '.2f')} | {number(s['mean_llm_calls'], '.2f')} | {number(s['mean_tokens'], '.0f')} | {number(s['median_wall_s'], '.1f')} |"
    if pair is not None:
        yield ""
        yield f"Pairs: {pair['pairs']}; both {pair['both']}, only {modes[0]} {pair['only_a']}, only {modes[1]} {pair['only_b']}, neither {pair['neither']}; calls {number(pair['diff_llm_calls'], '+.2f')}, attempts {number(pair['diff_attempts'], '+.2f')}"
        if pair["pairs"] < 10:
            yield "Fewer than 10 pairs: read with care."
    yield from ("", "| task | " + " | ".join(modes) + " |", "|---" * (len(modes) + 1) + "|")
    for r in rows:
        yield f"| {r['task_id']} | " + " | ".join(r[m] for m in modes) + " |"


def render_report(summary: list, pair: object | None, rows: Iterable, modes: tuple[str, ...], model: str | None = None) -> str:
    """The lines of a report as one text."""
    return "\n".join(report_lines(summary, pair, rows, modes, model)) + "\n"


def ledger_counts(cells: DataFrame) -> DataFrame:
    """One row: executed, skipped, pending and failed cells of a ledger (status)."""
    return cells.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("executed", "skipped", "pending", "error")])


def verify_references(tasks: DataFrame, sandbox=None) -> DataFrame:
    """(id, passed, category): each task's reference solution against its own tests."""
    from corvane.operators import effects

    src = tasks.select("id", F.col("reference").alias("code"), "tests", F.lit(None).cast("string").alias("run"))
    done = effects.run_tests(src, sandbox or effects.subprocess_sandbox)
    return done.select("id", F.coalesce("run.passed", F.lit(False)).alias("passed"), F.coalesce("run.category", F.lit("sandbox_error")).alias("category"))


def write_report(text: str | Iterable[str], path: str) -> None:
    """A rendered report, or its lines as they come, as a file, replaced as a whole."""
    import os

    with open(f"{path}.new", "w", encoding="utf-8") as f:
        if isinstance(text, str):
            f.write(text)
        else:
            f.writelines(f"{line}\n" for line in text)
    os.replace(f"{path}.new", path)


def probe_metrics(ranks: list[int | None], ks: tuple[int, ...] = (1, 5, 10)) -> dict[str, float]:
    """hit@k, MRR and mean rank of a few probes, in four digits; 0.0 where none was found."""
    found = [r for r in ranks if r]
    share = lambda x: round(x / len(ranks), 4) if ranks else 0.0
    return {f"hit@{k}": share(sum(r <= k for r in found)) for k in ks} | {"mrr": share(sum(1 / r for r in found)), "mean_rank": round(sum(found) / len(found), 4) if found else 0.0}
