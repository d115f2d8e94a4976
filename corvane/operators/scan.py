"""Running sums, steps and runs by key in order, where one key may hold most of the rows: a scan in two levels.

Rows are cut into ranges of (key, order), each sorted and written once; within a range everything is a window of that range alone. What crosses a border is carried: a range
begins with at most one key that an earlier one ended with, so that there are at most two carries a range, whatever the number of keys. They are added up over
the ranges of a key, in order, and joined back. No task holds a key, and the carries are broadcast: their number is bounded by that of the ranges.

Null keys are a key of their own. Rows of equal key and order follow each other in any order, as in any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.sources.durable import durable


def ranged(events: DataFrame, key: str, seq: str, ranges: int | None = None) -> DataFrame:
    """events with the number of their range, _p, and their place in it, _i: ranges follow each other by (key, seq)."""
    n = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = events.repartitionByRange(n, F.col(key), F.col(seq)).sortWithinPartitions(key, seq)
    return durable(cut.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "ranges")


def _crossing(rows: DataFrame, key: str) -> DataFrame:
    """(key): keys that may lie in several ranges: the first and the last of each."""
    ends = rows.groupBy("_p").agg(F.min(F.struct(key)).alias("a"), F.max(F.struct(key)).alias("b"))
    return ends.select(F.explode(F.array("a", "b")).alias("k")).select(F.col(f"k.{key}").alias("_key")).distinct()


def _carries(rows: DataFrame, key: str, *aggs: Column) -> DataFrame:
    """(_cp, _key, aggs): one row for each range and key that may go on into another range."""
    mine = rows.join(F.broadcast(_crossing(rows, key)), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return mine.groupBy(F.col("_p").alias("_cp"), F.col(key).alias("_key")).agg(*aggs)


def _back(rows: DataFrame, carries: DataFrame, key: str) -> DataFrame:
    return rows.join(F.broadcast(carries), (F.col("_p") == F.col("_cp")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_cp", "_key")


def running(events: DataFrame, key: str, seq: str, *values: str, skip: Column | None = None, ranges: int | None = None) -> DataFrame:
    """events with the running sum of each value by key in order (``cum_<value>``) and its step (``delta_<value>``); rows to skip add nothing."""
    added = {v: F.coalesce(F.col(v), F.lit(0)) if skip is None else F.when(skip, F.lit(0)).otherwise(F.coalesce(F.col(v), F.lit(0))) for v in values}
    rows = ranged(events.withColumns({f"_x_{v}": x for v, x in added.items()}), key, seq, ranges)
    sums = _carries(rows, key, *[F.sum(f"_x_{v}").alias(f"_s_{v}") for v in values], F.max_by(F.struct(*values), "_i").alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_cp")
    before = sums.select("_cp", "_key", *[F.sum(f"_s_{v}").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_b_{v}") for v in values], F.lag("_last").over(earlier).alias("_prev"))
    here = Window.partitionBy("_p", key).orderBy("_i")
    out = _back(rows.withColumns({"_n": F.row_number().over(here), **{f"cum_{v}": F.sum(f"_x_{v}").over(here.rowsBetween(Window.unboundedPreceding, 0)) for v in values}, **{f"_l_{v}": F.lag(v).over(here) for v in values}}), before, key)
    for v in values:
        out = out.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.coalesce(f"_b_{v}", F.lit(0)), f"delta_{v}": F.col(v) - F.when(F.col("_n") == 1, F.col(f"_prev.{v}")).otherwise(F.col(f"_l_{v}"))})
    return out.select(*events.columns, *[f"{kind}_{v}" for v in values for kind in ("cum", "delta")])


def run_lengths(events: DataFrame, key: str, seq: str, value: str, ranges: int | None = None) -> DataFrame:
    """(key, run, value, n): lengths of runs of equal values in order; runs are numbered from 1."""
    rows = ranged(events.select(key, seq, value), key, seq, ranges)
    here = Window.partitionBy("_p", key).orderBy("_i")
    # A range's first row of a key begins a run unless the key's last row before it, in an earlier range, has the same value.
    rows = rows.withColumn("_new", F.when(F.row_number().over(here) > 1, (~F.col(value).eqNullSafe(F.lag(value).over(here))).cast("bigint")))
    sums = _carries(rows, key, F.coalesce(F.sum("_new"), F.lit(0)).alias("_s"), F.min_by(F.struct(value), "_i").alias("_first"), F.max_by(F.struct(value), "_i").alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_cp")
    opened = sums.withColumn("_open", F.when(F.lag("_last").over(earlier).isNotNull() & F.col("_first").eqNullSafe(F.lag("_last").over(earlier)), 0).otherwise(1))
    before = opened.select("_cp", "_key", "_open", F.coalesce(F.sum(F.col("_s") + F.col("_open")).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    marked = _back(rows, before, key).withColumn("_new", F.coalesce("_new", "_open", F.lit(1)))
    numbered = marked.withColumn("run", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_b", F.lit(0)))
    return numbered.groupBy(key, "run", value).agg(F.count("*").alias("n"))
