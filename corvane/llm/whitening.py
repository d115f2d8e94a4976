"""Whitening of embeddings: a distributed centred scatter, cyclic Jacobi on the driver, the whitening matrix sent to all workers.

Entries become fixed-point integers, floor(64 * entry) + 1,000,000, so that sums and deviations are exact. Statistics are those of the distinct integer
vectors: a vector that fills a third of the table counts once, and is folded into one by each task before anything moves. Vectors
travel as the smallest integers that hold them, without the constant. Mean first, then the scatter of centred vectors: each task sums one symmetric
matrix, Spark adds them entry by entry. What reaches the driver has dim * (dim + 1) / 2 numbers, at any size of the table.

The eigenvectors come from Jacobi rotations of disjoint pairs, a round of a cyclic tournament at a time, until every off-diagonal entry is
below rounding relative to its two diagonal ones: that keeps small eigenvalues accurate. The covariance of the whitened vectors is then measured, in two more passes
over the distinct ones.

Defined cases: rows with a null vector, or a null or non-finite entry, are left out; so are rows of another length than most rows have (of lengths as frequent the greater
one), empty ones among them unless all are empty, when there are no rows; null and repeated ids are ordinary ids; an empty table gives no rows; a component
without variance (one distinct vector, a constant dimension) has whitened null, and does not count for the error; explained is null where nothing varies; other columns
are not read. A deviation beyond a long raises an error instead of a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import map_arrow, stash, table

#: Fixed values of the fixed point: entries are floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Most dimensions: the driver holds a few matrices of dim * dim doubles.
MAX_DIM = 4096
_WIDTHS = [np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8")]


def jacobi(a: np.ndarray, most: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of a symmetric matrix, by cyclic Jacobi rotations.

    A sweep meets every pair of dimensions once, in rounds of disjoint pairs (a round-robin tournament), whose rotations are applied together. It stops when
    no pair's entry is above rounding, relative to the square root of the product of its diagonal entries.
    """
    n = len(a)
    a, v = np.array(a, np.float64), np.eye(n)
    if n < 2:
        return np.diagonal(a).copy(), v
    eps, nothing = np.finfo(np.float64).eps, np.finfo(np.float64).tiny
    ring = list(range(n + n % 2))  # an odd number of dimensions: one sits out in each round
    for _ in range(most):
        moved = False
        for _ in range(len(ring) - 1):
            p, q = np.array([(x, y) for x, y in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if max(x, y) < n]).T
            ring = [ring[0], ring[-1], *ring[1:-1]]
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            go = np.abs(apq) > np.maximum(eps * np.sqrt(np.abs(app * aqq)), nothing)
            if not go.any():
                continue
            moved = True
            p, q, app, aqq, apq = p[go], q[go], app[go], aqq[go], apq[go]
            theta = (aqq - app) / (2 * apq)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(1.0, theta))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            rows_p, rows_q = a[p], a[q]
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            for m in (a, v):
                cols_p, cols_q = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
            a[p, q] = a[q, p] = 0.0
        if not moved:
            break
    e = np.diagonal(a).copy()
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    return e[order], v / np.linalg.norm(v, axis=0)


def _entries(col: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * entry) of clean vectors of dim entries."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    whole = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(col), dim)
    if whole.size and np.abs(whole).max() >= 2.0**62:
        raise OverflowError("an entry's fixed-point value is beyond a long")
    return whole.astype(np.int64)


def _packed(y: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes: each in the smallest width that holds it, so that equal vectors have equal bytes."""
    top = np.maximum(y.max(axis=1), -(y.min(axis=1) + 1))
    for i, t in enumerate(_WIDTHS):
        fits = top <= np.iinfo(t).max
        if i:
            fits &= top > np.iinfo(_WIDTHS[i - 1]).max
        if fits.any():
            raw, size = y[fits].astype(t), y.shape[1] * t.itemsize
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(raw), [None, pa.py_buffer(np.arange(len(raw) + 1, dtype=np.int64) * size), pa.py_buffer(raw.tobytes())]).cast(pa.binary())], ["y"])


def _unpacked(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for b in batches:
        col = b.column(0)
        size = pc.binary_length(col).to_numpy(zero_copy_only=False)
        for t in _WIDTHS:
            rows = col.filter(pa.array(size == dim * t.itemsize))
            if len(rows):
                yield np.frombuffer(b"".join(rows.to_pylist()), t).astype(np.int64).reshape(-1, dim)


def _clean(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has no null and no non-finite entry."""
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return rows.where(F.col(vec_col).isNotNull() & ~bad)


def _sums(fit: DataFrame, dim: int, of=None) -> np.ndarray:
    """Sums of the distinct vectors by dimension: exact integers, or those of of(vectors), doubles."""

    def run(batches):
        total = None
        for y in _unpacked(batches, dim):
            part = (y if of is None else of(y)).sum(axis=0)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    found = map_arrow(fit, run, f"i int, v {'bigint' if of is None else 'double'}").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    return found.column("v").to_numpy()


def _scatter(fit: DataFrame, dim: int, of, k: int) -> np.ndarray:
    """The sum of outer products of of(vectors), k numbers each: a matrix by task, added entry by entry."""
    up = np.triu_indices(k)

    def run(batches):
        total = None
        for y in _unpacked(batches, dim):
            z = of(y)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            for a in range(0, len(up[0]), 50_000):
                i, j = up[0][a : a + 50_000], up[1][a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    found = map_arrow(fit, run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((k, k))
    i, j, v = (found.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v
    return out


@dataclass(frozen=True)
class Whitening:
    """What is known of a table's vectors: n distinct ones, their sums (without OFFSET), eigenvalues and eigenvectors of the covariance, falling,
    the trace, and the largest entry of the whitened covariance minus the identity."""

    dim: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    def matrix(self) -> np.ndarray:
        """Centred vectors times this are whitened; NaN in the columns of components without variance."""
        return _matrix(self.values, self.vectors, self.trace)


def _matrix(values: np.ndarray, vectors: np.ndarray, trace: float) -> np.ndarray:
    varies = values > len(vectors) * np.finfo(np.float64).eps * trace
    return vectors * np.where(varies, 1 / np.sqrt(np.where(varies, values, 1)), np.nan)


def fit(rows: DataFrame, components: int = 16, vec_col: str = "embedding") -> Whitening | None:
    """The whitening of a table's distinct vectors; None where no row has a vector with entries."""
    clean = _clean(rows.select(F.col(vec_col).alias("vec")), "vec")
    most = clean.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None or not most["dim"]:
        return None
    dim = most["dim"]
    if dim > MAX_DIM:
        raise ValueError(f"{dim} dimensions; the driver takes at most {MAX_DIM}")

    def pack(batches):
        for b in batches:
            yield from _packed(_entries(b.column(0), dim))

    distinct = stash(map_arrow(clean.where(F.size("vec") == dim), pack, "y binary").distinct(), "whitening-vectors")
    n, sums = distinct.count(), _sums(distinct, dim)
    mean = sums / n
    v = _scatter(distinct, dim, lambda y: y - mean, dim) / n
    values, vectors = jacobi(v)
    values, vectors, trace = values[:components], vectors[:, :components], float(np.trace(v))
    m = _matrix(values, vectors, trace)
    m = m[:, ~np.isnan(m[0])]
    error = 0.0
    if m.shape[1]:
        middle = _sums(distinct, dim, lambda y: (y - mean) @ m) / n
        error = float(np.abs(_scatter(distinct, dim, lambda y: (y - mean) @ m - middle, m.shape[1]) / n - np.eye(m.shape[1])).max())
    return Whitening(dim, n, sums, values, vectors, trace, error)


_OUT = "id {id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per vector and component."""
    clean = _clean(rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "vec").where(F.size("vec") == model.dim)
    sent = rows.sparkSession.sparkContext.broadcast((model, model.matrix()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = sent.value
        k, mean = w.shape[1], m.sums / m.n
        explained = m.values / m.trace if m.trace > 0 else np.full(k, np.nan)
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                b = whole.slice(a, 4096)
                y = _entries(b.column(1), m.dim)
                r = len(y)
                white, deviation = (y - mean) @ w, _deviations(y, m.n, m.sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(np.arange(r), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, m.n)), pa.array(np.repeat(deviation, k)),
                        pa.array(white.reshape(-1), from_pandas=True), pa.array(np.tile(explained, r), from_pandas=True), pa.array(np.full(r * k, m.error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return map_arrow(clean, run, _OUT.format(id=clean.schema["id"].dataType.simpleString()))


def _deviations(y: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The sum over dimensions of (n * y - sums) ** 2, exact: in longs where they cannot overflow, else in integers of any size."""
    most = float(n) * max(float(np.abs(y).max(initial=0)), 1.0) + float(np.abs(sums).max(initial=0))
    if most**2 * y.shape[1] < 2.0**62:
        return ((n * y - sums) ** 2).sum(axis=1)
    exact = ((n * y.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    if any(x >= 1 << 63 for x in exact):
        raise OverflowError("a deviation is beyond a long")
    return exact.astype(np.int64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened on 16 components."""
    rows = table(spark, sf_dir, "embeddings")
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], _OUT.format(id="bigint")).withColumnRenamed("id", "vec_id")
    return whiten(rows, model).withColumnRenamed("id", "vec_id")
