"""Exact dense search over cells: vectors lie near a cell's centre, and cells that cannot hold one of a query's k nearest are not looked at.

A quantizer is fitted on a bounded sample (``SAMPLE`` vectors, at most ``CELLS`` centres, about the square root of the rows); every vector then goes to its nearest
centre, and a cell is stored in pieces of about ``PIECE`` vectors, one row each. A cell knows how far its farthest vector is from the centre. For a query that bounds all its
similarities from above (by the triangle inequality, and by that of Cauchy and Schwarz) and from below; as many cells as hold k vectors
give a floor, and cells whose upper bound is below it are left out. The result stays exact.

Queries are rows throughout: those of a cell travel together, ``BLOCK`` at most in a row, and are joined to its pieces. A task keeps
the k best of each query it has met, by which more pieces are passed over, and hands on k rows a query.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.lexical import top_k
from corvane.sources.durable import DEAD_ROWS, LARGE_ROWS, durable, gone_at_exit, shared_dir, small

#: Vectors that a quantizer is fitted on; most centres; rounds of fitting; vectors of a piece; queries of a row; (query, vector) results that a task holds.
SAMPLE, CELLS, ROUNDS, PIECE, BLOCK, HELD = 65_536, 4096, 8, 4096, 4096, 2_000_000
#: Most bytes of queries that are broadcast to the pieces.
BROADCAST_BYTES = 32 << 20
#: Cells are left out only where their bound is below the floor by more than rounding.
SLACK = 1e-9


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _nearest_centre(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """By distance; in slices, so that no more than 16 MB of distances are there at once."""
    half, step = (centres**2).sum(axis=1) / 2, max(1, (2 << 20) // len(centres))
    return np.concatenate([np.argmax(m[a : a + step] @ centres.T - half, axis=1) for a in range(0, len(m), step)]) if len(m) else np.zeros(0, np.int64)


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a sample of unit vectors, by a few rounds from vectors spread over it; a centre that loses all its vectors stays where it was."""
    distinct = np.unique(sample, axis=0)
    cells = min(cells, len(distinct))
    centres = distinct[np.random.default_rng(7).permutation(len(distinct))[:cells]].copy()
    for _ in range(ROUNDS):
        at = _nearest_centre(sample, centres)
        order = np.argsort(at, kind="stable")
        has, first = np.unique(at[order], return_index=True)
        centres[has] = np.add.reduceat(sample[order], first) / np.diff(np.append(first, len(at)))[:, None]
    return centres


@dataclass(frozen=True)
class DenseIndex:
    """pieces(cell, piece, ids, vecs, keep_*) and the cells' numbers, counts, centres and radii; dead(piece, n): vectors that count no more."""

    pieces: DataFrame
    cell: np.ndarray
    count: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    dead: DataFrame | None = None

    @staticmethod
    def build(vectors: DataFrame, id_col: str = "id", vec_col: str = "vec", keep: tuple[str, ...] = (), path: str | None = None, cells: int | None = None) -> DenseIndex:
        """Kept under a path where one is given, else until the driver ends."""
        spark = vectors.sparkSession
        folder = path or f"{shared_dir(spark)}/corvane-dense-{uuid.uuid4().hex}"
        write_cells(vectors, id_col, vec_col, keep, folder, cells)
        if path is None:
            gone_at_exit(spark, folder)
        return DenseIndex.load(spark, [folder])

    @staticmethod
    def load(spark: SparkSession, paths: list[str], dead: DataFrame | None = None) -> DenseIndex:
        """The union of what was built under some paths: cells are numbered through."""
        parts, found = [], []
        for i, path in enumerate(paths):
            parts.append(spark.read.parquet(f"{path}/pieces").withColumns({"cell": F.col("cell") + i * CELLS, "piece": piece_number(F.col("piece"), F.lit(i))}))
            found.append(spark.read.parquet(f"{path}/cells").withColumn("cell", F.col("cell") + i * CELLS))
        about = reduce(DataFrame.unionByName, found).orderBy("cell").toArrow()  # at most CELLS rows a path
        return DenseIndex(reduce(DataFrame.unionByName, parts), about.column("cell").to_numpy(), about.column("n").to_numpy(), _matrix(about.column("centre")), about.column("radius").to_numpy(), dead)

    def _reached(self, u: np.ndarray, k: int, known: bool, min_score: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of u, place of a cell) of unit vectors and the cells that can hold one of their k nearest; known: whether all of a cell's vectors count."""
        if not len(self.cell) or not len(u):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if u.shape[1] != self.centre.shape[1]:
            raise ValueError(f"queries have {u.shape[1]} dimensions, the index has {self.centre.shape[1]}")
        near, size = u @ self.centre.T, np.linalg.norm(u, axis=1, keepdims=True)
        apart = np.sqrt(np.maximum(size**2 + (self.centre**2).sum(axis=1) - 2 * near, 0))
        most = np.minimum(near + size * self.radius, 1 - np.maximum(apart - self.radius, 0) ** 2 / 2)
        floor = np.full(len(u), -np.inf if min_score is None else min_score)
        if known:
            least = near - size * self.radius
            order = np.argsort(-least, axis=1)
            enough = np.cumsum(self.count[order], axis=1) >= k
            at = order[np.arange(len(u)), np.argmax(enough, axis=1)]
            floor = np.maximum(floor, np.where(enough.any(axis=1), least[np.arange(len(u)), at], -np.inf))
        return np.nonzero(most >= floor[:, None] - SLACK)

    def routed(self, queries: DataFrame, k: int, known: bool, min_score: float | None) -> DataFrame:
        """(cell, qid, vec): every query (qid, vec) with the cells that can hold one of its k nearest, its vector at unit length."""
        bare = DenseIndex(None, self.cell, self.count, self.centre, self.radius)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, 256):
                    b = whole.slice(a, 256)
                    u = _unit(_matrix(b.column(1)))
                    q, c = bare._reached(u, k, known, min_score)
                    yield pa.RecordBatch.from_arrays([pa.array(bare.cell[c], pa.int32()), b.column(0).take(pa.array(q)), pa.array([x.tobytes() for x in u[q]], pa.binary())], ["cell", "qid", "vec"])

        return queries.mapInArrow(run, "cell int, qid bigint, vec binary")

    def _few(self, spark: SparkSession, head: pa.Table, k: int, known: bool, min_score: float | None) -> DataFrame | None:
        """(cell, qids, qvecs) of at most BLOCK queries; None where that would be more than BROADCAST_BYTES."""
        u, pairs, room = _unit(_matrix(head.column("vec"))), [], BROADCAST_BYTES // (8 * max(1, self.centre.shape[1]))
        for a in range(0, len(u), 256):
            q, c = self._reached(u[a : a + 256], k, known, min_score)
            pairs.append((q + a, c))
            room -= len(q)
            if room < 0:
                return None
        q, c = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(c, kind="stable")
        q, c = q[order], c[order]
        cells, first = np.unique(c, return_index=True)
        qid, rows = head.column("qid").to_numpy(), np.split(q, first[1:])
        columns = [pa.array(self.cell[cells], pa.int32()), pa.array([qid[r].tolist() for r in rows] if len(cells) else [], pa.list_(pa.int64())), pa.array([[x.tobytes() for x in u[r]] for r in rows] if len(cells) else [], pa.list_(pa.binary()))]
        return F.broadcast(spark.createDataFrame(pa.table(columns, names=["cell", "qids", "qvecs"])))

    def search(self, queries: DataFrame, k: int, qid_col: str = "qid", qvec_col: str = "vec", where: dict | None = None, min_score: float | None = None) -> DataFrame:
        """(qid, id, score, rank) of the k nearest by cosine among the vectors whose kept columns equal those of where; ties go to the lower id."""
        spark = queries.sparkSession
        if k < 1 or not len(self.cell):
            return top_k(spark.createDataFrame([], "qid bigint, id bigint, score double"), k)
        asked = queries.where(F.col(qvec_col).isNotNull()).select(F.col(qid_col).cast("bigint").alias("qid"), F.col(qvec_col).alias("vec"))
        known = where is None and self.dead is None
        head = asked.limit(BLOCK + 1).toArrow()
        together = self._few(spark, head, k, known, min_score) if head.num_rows <= BLOCK else None
        if together is None:
            # Rows of about BLOCK queries: blocks are told by the hash of the id, as many as the queries need.
            blocks = max(1, -(-asked.count() // BLOCK))
            found = self.routed(asked, k, known, min_score).groupBy("cell", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("qb")).agg(F.collect_list(F.struct("qid", "vec")).alias("asked"))
            together = found.select("cell", F.col("asked.qid").alias("qids"), F.col("asked.vec").alias("qvecs"))
        pieces = self.pieces
        allowed = F.lit(None).cast("array<int>")
        if where:
            test = lambda i: reduce(lambda a, b: a & b, [F.get(F.col(f"keep_{c}"), i) == F.lit(v) for c, v in where.items()])
            allowed = F.filter(F.sequence(F.lit(0), F.size(f"keep_{next(iter(where))}") - 1), test)
        pieces = pieces.withColumn("allowed", allowed)
        if self.dead is None:
            pieces = pieces.withColumn("gone", F.lit(None).cast("array<bigint>"))
        else:
            gone = self.dead.groupBy("piece").agg(F.collect_list("n").alias("gone"))  # a piece's vectors at most
            pieces = pieces.join(F.broadcast(gone) if small(self.dead, DEAD_ROWS) else gone, "piece", "left")
        shown = pieces.join(together, "cell").select("ids", "vecs", "width", "allowed", "gone", "qids", "qvecs")
        found = shown.mapInArrow(_nearest(k), "qid bigint, id bigint, score double")
        return top_k(found if min_score is None else found.where(F.col("score") >= min_score), k)

    def work(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """How many pairs of a query and a cell there are, and how many of them a search looks at."""
        return queries.count() * len(self.cell), self.routed(queries.select(F.col("qid").cast("bigint"), "vec"), k, True, None).count()


def piece_number(piece: Column, path: Column) -> Column:
    """A piece's number among those of several paths, the first of which is 0."""
    return piece + F.shiftleft(path.cast("bigint") * CELLS, 32)


def write_cells(vectors: DataFrame, id_col: str, vec_col: str, keep: tuple[str, ...], folder: str, cells: int | None = None) -> None:
    """Every vector in a piece of its cell, under a folder: pieces, cells, and homes(n, piece)."""
    spark = vectors.sparkSession
    rows = durable(vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"), *[F.col(c).alias(f"keep_{c}") for c in keep]), "vectors")
    n = rows.count()
    sample = rows.select("vec").sample(min(1.0, 1.2 * SAMPLE / n), 7) if n > SAMPLE else rows.select("vec")
    fitted = _unit(_matrix(sample.limit(SAMPLE).toArrow().column("vec"))) if n else np.zeros((0, 0))
    centres = centres_of(fitted, min(CELLS, cells or max(1, round(n**0.5)))) if n else fitted
    kept = [f for f in rows.schema if f.name.startswith("keep_")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_nearest_centre(_unit(_matrix(b.column(1))), centres).astype(np.int32)), *b.columns], ["cell", *b.schema.names])

    flat = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = durable(rows.mapInArrow(place, f"cell int, {flat}").withColumn("seq", F.monotonically_increasing_id()), "placed")
    parts = placed.groupBy("cell").agg((F.floor(F.count("*") / PIECE) + 1).alias("parts"))  # at most CELLS rows
    cut = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts")))

    def pack(key, t):
        vec = t.column("vec").combine_chunks()
        m, c = _matrix(vec), int(key[0].as_py())
        apart = np.linalg.norm(_unit(m) - centres[c], axis=1)
        raw = np.asarray(vec.flatten())
        columns = [pa.array([c], pa.int32()), pa.array([(c << 32) + int(key[1].as_py())]), pa.array([len(m)]), pa.array([float(apart.max())]), pa.array([t.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([raw.tobytes()], pa.binary()), pa.array([raw.dtype.itemsize], pa.int32())]
        return pa.table([*columns, *[pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), t.column(f.name).combine_chunks()) for f in kept]], names=["cell", "piece", "n", "radius", "ids", "vecs", "width", *[f.name for f in kept]])

    schema = "cell int, piece bigint, n bigint, radius double, ids binary, vecs binary, width int" + "".join(f", `{f.name}` array<{f.dataType.simpleString()}>" for f in kept)
    cut.groupBy("cell", "part").applyInArrow(pack, schema).write.options(**LARGE_ROWS).parquet(f"{folder}/pieces")
    cut.select(F.col("id").alias("n"), (F.shiftleft(F.col("cell").cast("bigint"), 32) + F.col("part")).alias("piece")).write.parquet(f"{folder}/homes")
    about = spark.read.parquet(f"{folder}/pieces").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).orderBy("cell").collect()  # at most CELLS rows
    spark.createDataFrame([(r["cell"], r["n"], r["radius"], centres[r["cell"]].tolist()) for r in about], "cell int, n bigint, radius double, centre array<double>").coalesce(1).write.parquet(f"{folder}/cells")


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", qid_col: str = "qid", qvec_col: str = "vec", where: Column | None = None, min_score: float | None = None) -> DataFrame:
    """(qid, id, score, rank) of the k nearest of a table that has no index: packed as it is read, every query against every vector."""
    src = (vectors if where is None else vectors.where(where)).where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, PIECE):
                one = b.slice(a, PIECE)
                raw = np.asarray(one.column(1).flatten())
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0]), pa.array([one.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([raw.tobytes()], pa.binary()), pa.array([raw.dtype.itemsize], pa.int32())], ["cell", "piece", "ids", "vecs", "width"])

    first = queries.where(F.col(qvec_col).isNotNull()).select(F.size(qvec_col).alias("dim")).first()
    dim = first["dim"] if first else 0
    whole = DenseIndex(src.mapInArrow(pack, "cell int, piece bigint, ids binary, vecs binary, width int"), np.zeros(1, np.int32), np.zeros(1, np.int64), np.zeros((1, dim)), np.full(1, 1.0))
    return whole.search(queries, k, qid_col, qvec_col, None, min_score)


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            qid = np.repeat(np.fromiter(best, np.int64, len(best)), [len(i) for i, _ in best.values()])
            out = pa.RecordBatch.from_arrays([pa.array(qid), pa.array(np.concatenate([i for i, _ in best.values()])), pa.array(np.concatenate([s for _, s in best.values()]))], ["qid", "id", "score"])
            best.clear()
            return out

        for b in batches:
            for ids, vecs, width, allowed, gone, qids, qvecs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, u = np.frombuffer(ids, np.int64), np.frombuffer(b"".join(qvecs), np.float64).reshape(len(qids), -1)
                m = _unit(np.frombuffer(vecs, f"<f{width}").astype(np.float64).reshape(len(ids), -1))
                live = np.ones(len(ids), bool)
                if allowed is not None:
                    live = np.isin(np.arange(len(ids)), np.array(allowed, np.int64))
                if gone:
                    live &= ~np.isin(ids, np.array(gone, np.int64))
                ids, m = ids[live], m[live]
                if not len(ids):
                    continue
                for a in range(0, len(qids), 512):
                    s = np.round(u[a : a + 512] @ m.T, 12)
                    for q, row in zip(qids[a : a + 512], s, strict=True):
                        old_ids, old = best.get(q, (np.zeros(0, np.int64), np.zeros(0)))
                        near = np.flatnonzero(row >= old[-1] - SLACK) if len(old) == k else np.arange(len(row))
                        if not len(near):
                            continue
                        if len(near) > 4 * k:
                            near = near[row[near] >= np.partition(row[near], len(near) - k)[len(near) - k] - SLACK]
                        i, v = np.concatenate([old_ids, ids[near]]), np.concatenate([old, row[near]])
                        order = np.lexsort((i, -np.round(v, 9)))[:k]
                        best[q] = i[order], v[order]
                    if len(best) * k > HELD:
                        yield flush()
        if best:
            yield flush()

    return run
