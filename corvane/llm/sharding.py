"""Sharding: groups of equal texts go to the least-loaded shard, longest processing time first, through a heap.

Law: ``bytes``. Group sizes come from one aggregation that sums on the map side, so a group of copies that holds a third of
all rows is one partial sum per task. What the heap sees has a proven bound: a group above 1/1024 of a shard's even share is an
item of its own (there can be at most 1024 per shard), and the others ride together in 65,536 fixed hash buckets, whose sums are items.
At most 65,536 + 1024 x shards items reach the driver, at any size of the input. On few documents a bucket holds about one group, so the schedule is the plain
one; in general the fullest and emptiest shards differ by at most one item, unless a single group exceeds a shard's share.

Defined cases: a null text counts as an empty one (size 1) and shares its group; equal rows stay together; an empty table
gives no rows; null ids are ordinary ids; very long texts are one item of their size; no other columns are read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import stash, table

#: Hash buckets for small groups; large groups are those above 1/HEAVY of a shard's even share. Slots are numbered within SLICES.
BUCKETS, HEAVY, SLICES = 65_536, 1024, 4096


def lpt(items: list[tuple[int, object]], n_shards: int) -> tuple[dict, list[int]]:
    """{item: shard} and the loads: largest first (ties by name), each to the least-loaded shard (ties by number)."""
    heap = [(0, s) for s in range(n_shards)]
    loads, put = [0] * n_shards, {}
    for size, name in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        load, s = heapq.heappop(heap)
        put[name] = s
        loads[s] = load + size
        heapq.heappush(heap, (load + size, s))
    return put, loads


def assign(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row's shard by the law of bytes, and its place in it without gaps."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stash(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"),
        ).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).withColumn("slice", F.pmod(F.xxhash64("id", "text_crc32", F.lit(7)), F.lit(SLICES)).cast("int")),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("key", "bucket").agg(F.sum("size").alias("bytes"))
    # A heavy group is an item by its key, the others by their bucket: bounded, see above.
    own = F.when(F.col("bytes") * n_shards * HEAVY > total, F.col("key"))
    items = groups.groupBy(own.alias("key"), F.when(own.isNull(), F.col("bucket")).alias("bucket")).agg(F.sum("bytes").alias("bytes")).collect()
    put, _ = lpt([(r["bytes"], (bytes(r["key"]) if r["key"] else b"", -1 if r["bucket"] is None else r["bucket"])) for r in items], n_shards)
    heavy = spark.createDataFrame([(bytearray(k), s) for (k, b), s in put.items() if b < 0], "key binary, own int")
    light = spark.createDataFrame([(b, s) for (_, b), s in put.items() if b >= 0], "bucket int, rest int")
    placed = rows.join(F.broadcast(heavy), "key", "left").join(F.broadcast(light), "bucket", "left").select("id", "size", "text_crc32", "slice", F.coalesce("own", "rest").alias("shard"))
    # Slots: numbers within small slices by the id's hash, after the rows of earlier slices: SLICES x shards counts at most.
    counts = placed.groupBy("shard", "slice").count()
    before = counts.select("shard", "slice", (F.sum("count").over(Window.partitionBy("shard").orderBy("slice")) - F.col("count")).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "text_crc32", "size")) - 1
    return placed.withColumn("at", at).join(F.broadcast(before), ["shard", "slice"]).select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law of bytes."""
    return assign(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
