"""Tables written once and read back: cut lineage, survive lost executors, are computed once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Most rows of a small side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Most numbers of rows (8 bytes each, by window or piece) that are broadcast to postings or vectors: these would be shuffled otherwise, for each search.
DEAD_ROWS = 4_000_000
#: Tables whose rows are megabytes each: groups of rows close at 16 MB, looked at row by row. Parquet would look after a hundred rows first, and readers hold a group's values at once.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that all executors share; one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or "file:///tmp/checkpoints"


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, whichever that is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet."""
    p, fs = _path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None without one."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def entries(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, name) of a folder's entries whose names begin with twelve digits."""
    p, fs = _path(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [(int(n[:12]), n) for n in names if n[:12].isdigit() and len(n) >= 12]


def newest(spark: SparkSession, folder: str) -> Iterator[tuple[int, str]]:
    """(number, text) of a folder's numbered files, the highest number first."""
    for number, name in sorted(entries(spark, folder), reverse=True):
        yield number, read_text(spark, f"{folder}/{name}") or ""


def delete(spark: SparkSession, folder: str, chosen: Callable[[str], bool]) -> None:
    """Remove those of a folder's entries whose names are chosen."""
    p, fs = _path(spark, folder)
    if fs.exists(p):
        for f in list(fs.listStatus(p)):
            if chosen(f.getPath().getName()):
                fs.delete(f.getPath(), True)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """A table in between goes with the driver's process."""
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def durable(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table of the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/corvane-{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    gone_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table is small enough to broadcast: counts no further than the bound."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are (one row group is one task); else as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
