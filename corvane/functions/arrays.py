"""Arrays within rows: what would otherwise be an explode and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, array_col: str, out: str) -> DataFrame:
    """df with out: array<struct<value, n>>, each value of an array with how often it occurs, in order. No shuffle.

    Sorted once, then cut where a value differs from the one before. Each stage is read twice by the next, so that the
    optimizer does not fold it into a lambda, where it would be computed anew for every element.
    """
    s = df.withColumn("__s", F.sort_array(array_col))
    s = s.withColumn("__a", F.expr("if(size(__s) <= 0, cast(array() as array<int>), filter(sequence(0, size(__s) - 1), i -> i = 0 or get(__s, i) <> get(__s, i - 1)))"))
    return s.withColumn(out, F.expr("transform(__a, (a, k) -> named_struct('value', get(__s, a), 'n', cast(coalesce(get(__a, k + 1), size(__s)) - a as bigint)))")).drop("__s", "__a")


def unrolled(df: DataFrame, array_col: str, *keep: str) -> DataFrame:
    """(keep, value, n): the entries of a histogram as rows.

    By the outer form: for the inner one the optimizer would push a test of the array's size below its computation, and there
    fold all stages into one another.
    """
    return df.select(*keep, F.explode_outer(array_col).alias("__x")).select(*keep, F.col("__x.value").alias("value"), F.col("__x.n").alias("n")).where("n is not null")
