"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, and pieces of equal length share a bucket.

A document of n tokens gives n // room pieces of a whole sequence's length, then one piece for each binary digit of the rest, longest first. Each
piece is a sequence of its own: none crosses documents, and none is padded, as its length is a power of two. A bucket holds the sequences
of one length, numbered without gaps, so that a trainer takes batches of equal shape: ``batches`` gives them for any number of tokens.

Tokens are made in one pass over the texts, in which nothing is shuffled; only pieces (eight numbers each) are written. Numbers within a
bucket come from the counts by bucket and partition, one short row each.

Defined cases: a null or empty text is the single end token, a sequence of length 1; equal rows are packed each; an empty table gives no rows; ids may be null or
repeated; very long texts are tokenised whole and cut as often as they need; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import beside, map_arrow, slices, stash, table
from corvane.llm.packing import vocabulary, worker_tokenizer

_PIECES = "id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bucket int, part int, at bigint"


def binary_cuts(n: int, room: int) -> list[int]:
    """Lengths of a document's pieces in order: whole sequences, then the rest's binary digits from the highest."""
    rest = n % room
    return [room] * (n // room) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(docs: DataFrame, path: str, room: int, end_id: int) -> DataFrame:
    """Every piece, with its place among the pieces of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, part, stop = worker_tokenizer(path), TaskContext.get().partitionId(), np.array([end_id], "<u4")
        seen = [0] * room.bit_length()
        for b in batches:
            text = b.column(1)
            for lo, hi in slices(text):
                tok, where = t.batch(text.slice(lo, hi - lo))
                row, cols = [], []
                for i, (x, y) in enumerate(zip(where[:-1].tolist(), where[1:].tolist(), strict=True)):
                    ids, n, a = memoryview(np.append(tok[x:y], stop).astype("<u4", copy=False)).cast("B"), y - x + 1, 0
                    for size in binary_cuts(n, room):
                        k = size.bit_length() - 1
                        row.append(lo + i)
                        cols.append((a, size, zlib.crc32(ids[4 * a : 4 * (a + size)]), n, k, seen[k]))
                        seen[k] += 1
                        a += size
                c = np.array(cols, np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(c[:, j]) for j in range(4)), pa.array(c[:, 4].astype(np.int32)), pa.array(np.full(len(c), part, np.int32)), pa.array(c[:, 5])],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "part", "at"],
                )

    return map_arrow(docs, run, _PIECES.format(id=docs.schema["id"].dataType.simpleString()))


def decompose(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, place): room is a power of two; bucket: the length's exponent;
    place: the sequence's number in its bucket, without gaps."""
    if room < 1 or room & (room - 1):
        raise ValueError(f"a sequence's length must be a power of two, not {room}")
    pieces = stash(_cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizer, room, end_id), "binary-pieces")
    counts = stash(pieces.groupBy("bucket", "part").agg(F.count("*").alias("n")), "binary-counts")
    before = counts.select("bucket", "part", (F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")).alias("before"))
    placed = pieces.join(beside(before, counts.count()), ["bucket", "part"]).withColumn("place", F.col("before") + F.col("at"))
    # A bucket's sequences are numbered from bucket << 56: fewer than 2 ** 56 of one length.
    sequence = F.shiftleft(F.col("bucket").cast("bigint"), 56) + F.col("place")
    return placed.select("id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), "bucket", "place")


def batches(sequences: DataFrame, tokens: int) -> DataFrame:
    """sequences with batch: the number, within its bucket, of the batch of so many tokens (a power of two, a sequence at least) that a sequence is in."""
    each = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(tokens) / F.pow(F.lit(2.0), "bucket")))
    return sequences.withColumn("batch", F.floor(F.col("place") / each))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of binary lengths of at most 4096 tokens."""
    return decompose(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")
