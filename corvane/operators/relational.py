"""Small relational programs: category sums, monthly totals, named aggregates, top customers, z-scores, run lengths, dates, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.scan import run_lengths  # noqa: F401

#: Fixed pattern: date, time, level, message of a log line.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}) (\w+) (.*)$"


def sum_by(df: DataFrame, by: str | Column, value: str | Column, digits: int = 2) -> DataFrame:
    by, value = (F.col(c) if isinstance(c, str) else c for c in (by, value))
    return df.groupBy(by.alias("category")).agg(F.round(F.sum(value.cast("decimal(28,6)")), digits).cast("double").alias("total"))


def sum_csv(spark: SparkSession, path: str, by: str, value: str, digits: int = 2) -> DataFrame:
    """(category, total) of CSV files with a header: fields may be quoted, with commas, quotes and line ends inside; blank lines and values that
    are no numbers do not count."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    return sum_by(raw.where(F.col(by).isNotNull()), F.trim(by), F.expr(f"try_cast(trim(`{value}`) as decimal(28,6))"), digits)


def monthly(df: DataFrame, ts: str, value: str) -> DataFrame:
    """(month, total) as yyyy-MM."""
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.round(F.sum(F.col(value).cast("decimal(28,6)")), 2).cast("double").alias("total"))


def named_agg(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, total, n), by total then name; n counts values that are not null."""
    return df.groupBy(by).agg(F.round(F.sum(F.col(value).cast("decimal(28,6)")), 2).cast("double").alias("total"), F.count(value).alias("n")).orderBy(F.desc("total"), by)


def top_n(df: DataFrame, name: str, value: str, n: int) -> DataFrame:
    return named_agg(df, name, value).select(name, "total").limit(n)


def z_scores(df: DataFrame, *values: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns z_<value> by the population's deviation; 0 where there is none. Two passes: one row of moments, then a projection."""
    stats = df.agg(*[x for v in values for x in (F.avg(v).alias(f"m_{v}"), F.stddev_pop(v).alias(f"s_{v}"))]).first()

    def z(v: str) -> Column:
        m, s = stats[f"m_{v}"], stats[f"s_{v}"]
        return F.when(F.col(v).isNotNull(), (F.col(v) - F.lit(m)) / F.lit(s) if s else F.lit(0.0))

    return df.select(*keys, *[F.round(z(v), 6).alias(f"z_{v}") for v in values])


def rle(text: Column) -> Column:
    """Run-length encoding of a text: aaab as a3b1."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.substring(r, 1, 1), F.length(r).cast("string"))), "")


def log_fields(line: Column) -> Column:
    """struct<date, time, level, message>; null for a line of another form."""
    fields = F.struct(*[F.regexp_extract(line, LOG_LINE, i).alias(n) for i, n in enumerate(("date", "time", "level", "message"), 1)])
    return F.when(line.rlike(LOG_LINE), fields)


def business_days(start: Column, end: Column) -> Column:
    """Mondays to Fridays in [start, end), without listing them; 0 where start is not before end."""
    s, e = F.to_date(start), F.to_date(end)
    upto = lambda d: F.floor((F.datediff(d, F.lit("1900-01-01").cast("date"))) / 7) * 5 + F.least(F.pmod(F.datediff(d, F.lit("1900-01-01").cast("date")), F.lit(7)), F.lit(5))
    return F.when(s < e, upto(e) - upto(s)).otherwise(0).cast("bigint")


def utc_iso(epoch: Column) -> Column:
    """Seconds since the epoch as ISO time with Z, fractions dropped."""
    return F.date_format(F.timestamp_seconds(F.floor(epoch)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
