"""Toxicity: a factorization machine over hashed terms, which learns pairs of terms beside single ones.

Terms are the words of a text and the beginnings of its words (stems of compounds), hashed from bytes; a term's value is
its density in the text, dampened. The machine is trained on the driver from a bounded, stratified sample of labelled rows
(``POSITIVE`` and ``NEGATIVE`` ids at most, those with the least hash, of their different texts as many again, and of these so many as have ``ENTRIES`` terms together, a text
with more than half of these alone being left out) with the terms that tell the classes apart best, and
scores every whole text in one pass without a shuffle. The prior of all labelled rows, not the sample's, sets the intercept.

Defined cases: null and empty texts get the prior's score; labels of ids without a text, or null labels, are not used; of
several labels of one id the largest counts; with no label, or those of one class only, every score is the share of label 1
(0.5 without any label); ties among sampled rows go by id; equal texts get equal scores; very long texts are scored whole; an empty table gives
no rows; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import U64, chunked, give_back, map_arrow, slices, span_hashes, stash, table, word_hashes

POSITIVE, NEGATIVE, TERMS, FACTORS, THRESHOLD = 2500, 4000, 8192, 4, 0.7
#: Most terms of sampled rows, counted by row, that are sent to the driver: half for each class, 8 bytes a term.
ENTRIES = 6_000_000
_PREFIXES = (5, 6, 7)  # bytes
_BITS = 32


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed term) of every word and beginning, repeated as often as it occurs, and the number of words of each text."""
    h, ptr, start, end, data, _ = word_hashes(texts, spans=True)
    n = np.diff(ptr)
    at = np.repeat(np.arange(len(n)), n)
    keys, rows = [h >> U64(64 - _BITS)], [at]
    for size in _PREFIXES:
        long = end - start > size
        keys.append((span_hashes(data, start[long], start[long] + size) ^ U64(size)) >> U64(64 - _BITS))
        rows.append(at[long])
    return np.concatenate(rows), np.concatenate(keys).astype(np.uint32), n


def _counts(row: np.ndarray, col: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, count = np.unique(row.astype(np.int64) * width + col, return_counts=True)
    return key // width, key % width, count


def _value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(100.0 * count / np.maximum(words, 20))


@dataclass
class Machine:
    """Sorted hashed terms, and the machine's intercept, weights and factors."""

    keys: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score_entries(self, row: np.ndarray, col: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        z = self.w0 + np.bincount(row, self.w[col] * x, minlength=n)
        for f in range(self.v.shape[1]):
            vx = self.v[col, f] * x
            z += 0.5 * (np.bincount(row, vx, minlength=n) ** 2 - np.bincount(row, vx * vx, minlength=n))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in slices(texts):
            row, key, words = terms(texts.slice(lo, hi - lo))
            if len(self.keys):
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[i] == key
                row, col, count = _counts(row[ok], i[ok], len(self.keys))
            else:
                row, col, count = (np.zeros(0, np.int64),) * 3
            out.append(self.score_entries(row, col, _value(count, words[row]), hi - lo))
        return np.concatenate(out)


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that calibrate logits: weighted log loss against Platt's smoothed targets, by Newton steps."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    x, theta = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    loss = lambda th: float((weight * (np.logaddexp(0, x @ th) - t * (x @ th))).sum() + 1e-3 * (th[0] - 1) ** 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - t)) + 2e-3 * np.array([theta[0] - 1, 0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), grad)
        rate = 1.0
        while rate > 1e-6 and loss(theta - rate * step) > loss(theta):
            rate /= 2
        theta = theta - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return float(max(theta[0], 0.1)), float(theta[1])


def fit(rows: list, prior: float, **options) -> Machine:
    """A machine of all rows, calibrated (at the prior) by what one of four fifths of the rows says of the last fifth."""
    apart = [r for i, r in enumerate(rows) if i % 5 == 4]
    y = np.array([r[3] for r in apart], np.float64)
    whole = _fit(rows, prior, **options)
    if not len(whole.keys) or len(y) == 0 or y.min() == y.max():
        return whole
    part = _fit([r for i, r in enumerate(rows) if i % 5 != 4], prior, **options)
    z = []
    for k, c, n, _ in apart:
        i = np.minimum(np.searchsorted(part.keys, k), max(len(part.keys) - 1, 0))
        ok = part.keys[i] == k if len(part.keys) else np.zeros(len(k), bool)
        p = part.score_entries(np.zeros(ok.sum(), np.int64), i[ok], _value(c[ok], np.full(ok.sum(), n)), 1)[0]
        z.append(np.log(p / (1 - p)))
    share = min(max(prior, 1e-3), 1 - 1e-3)
    slope, add = _platt(np.array(z), y, np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())))
    return Machine(whole.keys, slope * whole.w0 + add, slope * whole.w, slope**0.5 * whole.v)


def _fit(rows: list[tuple[np.ndarray, np.ndarray, int, int]], prior: float, n_terms: int = TERMS, factors: int = FACTORS, epochs: int = 20, seed: int = 7) -> Machine:
    """rows: (hashed terms, counts, words, label) each. Terms by chi-square; then stochastic descent with Adagrad on the log loss."""
    y = np.array([r[3] for r in rows], np.float64)
    empty = Machine(np.zeros(0, np.uint32), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), np.zeros(0), np.zeros((0, factors)))
    if len(y) == 0 or y.min() == y.max():
        return empty
    # Terms of five rows or more: counted first, so that the rare ones, most of all, are never held with their rows.
    keys, df = np.unique(np.concatenate([r[0] for r in rows]), return_counts=True)
    keys, df = keys[df >= 5], df[df >= 5]
    row, col, x = [], [], []
    for i, (k, c, n, _) in enumerate(rows):
        at = np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0))
        ok = keys[at] == k if len(keys) else np.zeros(len(k), bool)
        row.append(np.full(ok.sum(), i, np.int32))
        col.append(at[ok].astype(np.int32))
        x.append(_value(c[ok], np.full(ok.sum(), n)))
    row, col, x = map(np.concatenate, (row, col, x))
    # The terms whose density is most unlike between the classes.
    s1, s0 = (np.bincount(col, x * (y[row] == k), minlength=len(keys)) / (y == k).sum() for k in (1, 0))
    var = np.bincount(col, x * x, minlength=len(keys)) / len(y)
    z = np.abs(s1 - s0) / np.sqrt(var + 1e-12)
    best = np.sort(np.argsort(-z, kind="stable")[:n_terms])
    place = np.full(len(keys), -1)
    place[best] = np.arange(len(best))
    ok = place[col] >= 0
    row, col, x = row[ok], place[col[ok]], x[ok]
    ptr = np.searchsorted(row, np.arange(len(rows) + 1))
    rng = np.random.default_rng(seed)
    m = Machine(keys[best], float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(best)), rng.normal(0, 0.02, (len(best), factors)))
    gw, gv, g0 = np.full(len(best), 1e-2), np.full((len(best), factors), 1e-2), 1e-2
    l2w, l2v, rate = 1e-4, 1e-3, 0.15
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            size = ptr[batch + 1] - ptr[batch]
            take = np.repeat(ptr[batch] - np.cumsum(size) + size, size) + np.arange(size.sum())
            r, c, xv = np.repeat(np.arange(len(batch)), size), col[take], x[take]
            vx = m.v[c] * xv[:, None]
            sums = np.zeros((len(batch), factors))
            np.add.at(sums, r, vx)
            sq = np.zeros((len(batch), factors))
            np.add.at(sq, r, vx * vx)
            p = 1 / (1 + np.exp(-np.clip(m.w0 + np.bincount(r, m.w[c] * xv, minlength=len(batch)) + 0.5 * (sums**2 - sq).sum(1), -30, 30)))
            err = (p - y[batch]) / len(batch)
            used, back = np.unique(c, return_inverse=True)
            dw = np.bincount(back, err[r] * xv, minlength=len(used)) + l2w * m.w[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, back, (err[r] * xv)[:, None] * (sums[r] - vx))
            dv += l2v * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += err.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.w0 -= rate * err.sum() / np.sqrt(g0)
    share = y.mean()
    m.w0 += float(np.log((prior + 1e-9) / (1 - prior + 1e-9)) - np.log(share / (1 - share)))
    return m


def within(rows: list, group: str, most: int) -> dict:
    """By group, the last spot of those that hold at most so many entries together, in the order of their spots: one at least."""
    last, so_far = {}, {}
    for r in sorted(rows, key=lambda r: (r["spot"], r["entries"])):
        g = r[group]
        so_far[g] = so_far.get(g, 0) + r["entries"]
        if g not in last or so_far[g] <= most:
            last[g] = r["spot"]
    return last


def bucket(id_: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positive: int = POSITIVE, negative: int = NEGATIVE) -> Machine:
    """A machine from the labelled rows given; hold rows out before."""
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    share = named.agg(F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0))).first()[0]
    prior = 0.5 if share is None else float(share)
    picked = None
    for cond, most in (("y > 0", positive), ("y <= 0", negative)):
        part = named.where(cond).orderBy(F.xxhash64("id"), "id").limit(most)
        picked = part if picked is None else picked.union(part)
    ids = [(r["id"], int(r["y"] > 0)) for r in picked.collect()]  # positive + negative at most
    if not ids:
        return fit([], prior)
    sample = docs.sparkSession.createDataFrame(ids, f"id {named.schema['id'].dataType.simpleString()}, y int")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(sample), "id").select("y", F.xxhash64("id", "text").alias("spot"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2)):
                row, key, words = terms(b.column(2).slice(lo, hi - lo))
                r, k, c = _counts(row, key, 1 << _BITS)
                off = pa.array(np.searchsorted(r, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(v.view(np.int32))) for v in (k.astype(np.uint32), c.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *lists, pa.array(words.astype(np.int64))], ["y", "spot", "k", "c", "n"])

    counted = stash(map_arrow(src, run, "y int, spot bigint, k array<int>, c array<int>, n bigint"), "toxicity-sample")
    # Rows alike have one spot and are taken once; of each class so many rows at most reach the driver, and so many entries. A row with more than these alone is left out.
    room = ENTRIES // 2
    fits = counted.where(F.size("k") <= room)
    spots = [r for y, most in ((1, positive), (0, negative)) for r in fits.where(F.col("y") == y).groupBy("y", "spot").agg(F.max(F.size("k")).alias("entries")).orderBy("spot").limit(most).collect()]
    last = within(spots, "y", room)
    chosen = fits.where(" or ".join(f"(y = {y} and spot <= {spot})" for y, spot in last.items()) or "false").dropDuplicates(["y", "spot"])
    cols = [chunked(c) for c in chosen.select("y", "k", "c", "n").toArrow().columns]
    off = np.asarray(cols[1].offsets)
    k, c = cols[1].values.to_numpy().view(np.uint32), cols[2].values.to_numpy()
    rows = [(k[a:b], c[a:b], n, y) for a, b, n, y in zip(off, off[1:], cols[3].to_pylist(), cols[0].to_pylist(), strict=False)]
    # In an order that no partitioning changes.
    rows.sort(key=lambda r: (r[3], r[2], len(r[0]), zlib.crc32(r[0].tobytes())))
    made = fit(rows, prior)
    del rows, cols, k, c
    give_back()  # the driver keeps the machine only
    return made


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(machine.score(b.column(1)))], ["id", "score"])

    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs without the rows that score at the threshold or above. Filtered as it is read: nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pc.less(pa.array(machine.score(b.column(at))), threshold)
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in b.columns], b.schema.names)

    return map_arrow(docs, run, docs.schema)


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine of the query: learned from rows outside the held-out fold."""
    return train(docs, labels.where(bucket(F.col("doc_id"), 3) != 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, with the fold that the machine never saw."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learned(spark, docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), (bucket(F.col("id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
