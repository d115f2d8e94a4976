"""Shared helpers: reading tables, durable intermediate tables, vectorised word hashing, components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Fixed odd multipliers for hashing; any odd values do, but they must never change between runs.
_GOLDEN, _MIX1, _MIX2, _POLY = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), 0xD6E8FEB86659FD93
_CHUNK = 1 << 19
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or "file:///tmp/checkpoints"


def stash(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete a table that stash wrote, where nothing reads it any more (before the driver ends)."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    """A table in between goes with the driver's process."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def sized(df: DataFrame, rows: int, per: int = 200_000) -> DataFrame:
    """df in as many partitions as so many rows need: a small table is a few files, a large one many."""
    return df.coalesce(max(1, -(-rows // per)))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of a few megabytes: what a task holds outside the heap, and its Python worker, stays small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Freed memory back to the system: an idle Python worker keeps none of what its last task needed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


# ---- vectorised hashing over Arrow string buffers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * _MIX1
    x = x ^ (x >> U64(27))
    x = x * _MIX2
    return x ^ (x >> U64(31))


_pow = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        m = max(n, _CHUNK + 65536)
        with np.errstate(over="ignore"):
            _pow["p"] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(m, _POLY, U64))])
            _pow["i"] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(m, pow(_POLY, -1, 1 << 64), U64))])
        _pow["n"] = m
    return _pow["p"], _pow["i"]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string array; a null has no bytes."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if len(off) else data, off - (off[0] if len(off) else 0)


def _chunk_words(data: np.ndarray, cuts: np.ndarray, spans: bool) -> tuple[np.ndarray, ...]:
    """Hashes and starts (and ends) of the words of one piece of text; a word ends at each position in cuts."""
    w = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    edge[0] = edge[-1] = True
    before = np.concatenate([[False], w[:-1]]) & ~edge[:-1]
    after = np.concatenate([w[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    h = span_hashes(data, start, end)
    return (h, start, end) if spans else (h, start)


def word_hashes(col: pa.Array, lower: bool = True, spans: bool = False):
    """The words of each text as 64-bit hashes, and where each text's words begin (one more than rows).

    A word is a run of ASCII letters and digits and characters beyond ASCII, in lower case. With spans, also the byte
    start and end of every word in the (lower-cased) joined texts. Works through pieces of bounded size.
    """
    data, off = buffers(pc.utf8_lower(col) if lower else col)
    hs, ss, es, at = [], [], [], 0
    with np.errstate(over="ignore"):
        while at < len(data):
            to = min(len(data), at + _CHUNK)
            while to < len(data):  # no word is cut: back to the last byte that is in none, or else onwards
                back = np.flatnonzero(~_WORD[data[max(at + 1, to - 4096) : to]])
                if len(back):
                    to = max(at + 1, to - 4096) + int(back[-1])
                    break
                to = min(len(data), to + 4096)
            found = _chunk_words(data[at:to], off[np.searchsorted(off, at) : np.searchsorted(off, to, "right")] - at, spans)
            hs.append(found[0])
            ss.append(found[1] + at)
            if spans:
                es.append(found[2] + at)
            at = to
    start = np.concatenate(ss) if ss else np.zeros(0, np.int64)
    ptr = np.searchsorted(start, off)
    out = (np.concatenate(hs) if hs else np.zeros(0, U64), ptr)
    return (*out, start, np.concatenate(es) if es else start, data, off) if spans else out


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, in order and apart from each other, as of words. Works through pieces of bounded size."""
    out, a = np.empty(len(start), U64), 0
    with np.errstate(over="ignore"):
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + _CHUNK, "right")))
            lo, hi = start[a], end[b - 1]
            p, inv = _powers(hi - lo + 1)
            c = np.zeros(hi - lo + 1, U64)
            np.cumsum((data[lo:hi].astype(U64) + U64(1)) * p[: hi - lo], out=c[1:])
            s, e = start[a:b] - lo, end[a:b] - lo
            out[a:b] = mix((c[e] - c[s]) * inv[s] + (e - s).astype(U64) * _GOLDEN)
            a = b
    return out


_SHINGLE = [U64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D, 0xD1B54A32D192ED03)]


def shingle_hashes(words: np.ndarray, ptr: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles of each text, with their texts' numbers; a shorter text with a word is one shingle."""
    count = np.diff(ptr)
    with np.errstate(over="ignore"):
        if len(words) >= n:
            s = np.zeros(len(words) - n + 1, U64)
            for j in range(n):
                s += words[j : len(words) - n + 1 + j] * _SHINGLE[j % 5]
            at = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
            first = np.repeat(ptr[:-1] - np.concatenate([[0], np.cumsum(np.maximum(count - n + 1, 0))[:-1]]), np.maximum(count - n + 1, 0))
            s = mix(s[np.arange(len(at)) + first])
        else:
            s, at = np.zeros(0, U64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            extra = np.array([mix(np.sum(words[ptr[i] : ptr[i + 1]] * np.array(_SHINGLE[: count[i]], U64), keepdims=True) + _GOLDEN * U64(count[i]))[0] for i in short], U64)
            s, at = np.concatenate([s, extra]), np.concatenate([at, short])
            order = np.argsort(at, kind="stable")
            s, at = s[order], at[order]
    return s, at


def units(shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's occurrences as distinct units: the bag of a text as a set. Sorted by text, then hash."""
    order = np.lexsort((shingles, at))
    s, at = shingles[order], at[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1])
    nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    with np.errstate(over="ignore"):
        return np.where(nth == 0, s, mix(s + nth.astype(U64) * _GOLDEN)), at


def slices(col: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes, or one row."""
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size)])
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b


def chunked(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


# ---- connected components


#: Most rows of a side that is broadcast, counted before; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def beside(df: DataFrame, rows: int) -> DataFrame:
    """df as the small side of a join: broadcast if its rows, counted before, are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, comp): the least node of each component; edges: (a, b), a != b, in either direction or both.

    Least labels spread along edges, then each label jumps to its own label, until nothing changes. Each round is
    written to the shared folder, and the one before it deleted. Works with joins and partial aggregates only; sides of few rows are broadcast.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    rows = both.count()
    labels = stash(sized(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), rows), f"{name}-cc")
    while True:
        near = both.join(beside(labels.select(F.col("node").alias("b"), "comp"), rows), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = near.join(beside(labels, rows), "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("c"))
        jump = step.join(beside(labels.select(F.col("node").alias("c"), F.col("comp").alias("cc")), rows), "c").select("node", "old", F.least("c", "cc").alias("comp"))
        done = stash(sized(jump, rows), f"{name}-cc")
        changed = done.where("comp < old").limit(1).count()
        unstash(labels)
        labels = done.select("node", "comp")
        if not changed:
            unstash(both)
            return labels
