"""Language identification by families: one-versus-rest machines choose the family, one-versus-one machines the language in it
(one-versus-rest machines in a family of more than ``WIDE`` languages, so that the machines grow with the languages, not their pairs).

Features are counts of pairs and triples of bytes of the lower-cased text, with all but letters as blanks, hashed and scaled as square roots of
shares. All machines are linear support vector machines (squared hinge) trained on the driver from a sample of every language's rows, chosen by a
hash of id and text: about ``SAMPLE`` documents a language, or an equal part of ``ROWS`` where there are more languages than that allows, but ``LEAST``
(or all that there are) in any case, and of these so many as have ``ENTRIES`` features together, an equal part a language. The sample stays sparse; ``BLOCK`` rows at a time are dense. Whole texts are predicted in one pass without a shuffle.

Defined cases: null texts and those without a letter are ``und`` with score 0; without any language to learn from, all
are; with one language, all others get it; rows alike in id, text and language are sampled once; very long texts are counted whole, in pieces; a language whose family is not listed is in the family ``other``; ties go to the first name; equal
texts get equal predictions; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import buffers, chunked, give_back, map_arrow, slices, stash, table
from corvane.llm.toxicity import bucket, within

SAMPLE, ROWS, LEAST = 600, 38_400, 30
#: Most features of sampled rows, counted by row, that are sent to the driver: 6 bytes each there.
ENTRIES = 24_000_000
WIDE, BLOCK, _AT_ONCE = 16, 4096, 64
#: Families by language code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk bg sr hr sl mk bs", "baltic": "lt lv",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "semitic": "ar he am mt", "indo-aryan": "hi bn ur pa mr gu ne si", "dravidian": "ta te kn ml", "cjk": "zh ja ko",
    "austronesian": "id ms tl jv", "celtic": "ga cy gd br", "hellenic": "el",
}
_PAIRS, _TRIPLES = 4096, 8192
WIDTH = _PAIRS + _TRIPLES
_PIECE = 1 << 21
_LETTER = np.full(256, 32, np.uint8)
_LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().replace("_", "-").split("-")[0] in codes.split()), "other")


def counts(texts: pa.Array) -> np.ndarray:
    """(texts, WIDTH) hashed counts of pairs and triples inside each text."""
    data, off = buffers(pc.utf8_lower(texts))
    n = len(texts)
    out = np.zeros(n * WIDTH)
    for begin in range(0, len(data), _PIECE):  # codes that begin in this piece
        b = _LETTER[data[begin : begin + _PIECE + 2]].astype(np.uint32)
        at = np.searchsorted(off, np.arange(begin, begin + len(b)), "right") - 1
        code = b
        for size, base, width in ((2, 0, _PAIRS), (3, _PAIRS, _TRIPLES)):
            if len(b) < size:
                break
            code = code[: len(b) - size + 1] * np.uint32(256) + b[size - 1 :]
            inside = at[: len(code)] == at[size - 1 :]
            inside[_PIECE:] = False
            cell = (((code * np.uint32(2654435761)) >> np.uint32(15)) % np.uint32(width)).astype(np.int64) + base
            out += np.bincount((at[: len(code)] * WIDTH + cell)[inside], minlength=n * WIDTH)
    return out.reshape(n, WIDTH)


def _scaled(c: np.ndarray) -> np.ndarray:
    return np.sqrt(c / np.maximum(c.sum(axis=1, keepdims=True), 1)).astype(np.float32)


@dataclass
class Sparse:
    """Rows of scaled features: where each row's entries begin (one more than rows), their columns and values."""

    off: np.ndarray
    cols: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.off)[rows]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(off[-1]) + np.repeat(self.off[rows] - off[:-1], size)
        return Sparse(off, self.cols[at], self.values[at])

    def dense(self, a: int, b: int) -> np.ndarray:
        out = np.zeros((b - a, WIDTH), np.float32)
        lo, hi = self.off[a], self.off[b]
        out[np.repeat(np.arange(b - a), np.diff(self.off[a : b + 1])), self.cols[lo:hi]] = self.values[lo:hi]
        return out


def svms(x: Sparse, y: np.ndarray, l2: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights (WIDTH x machines) and intercepts of linear machines for the columns of y: squared hinge, both classes of equal weight, accelerated
    gradient steps."""
    share = np.where(y > 0, 0.5 / np.maximum((y > 0).sum(axis=0), 1), 0.5 / np.maximum((y < 0).sum(axis=0), 1)).astype(np.float32)
    cuts = [(a, min(len(x), a + BLOCK)) for a in range(0, len(x), BLOCK)]
    kept = x.dense(*cuts[0]) if len(cuts) == 1 else None
    w = np.zeros((WIDTH + 1, y.shape[1]), np.float32)
    last, rate = w.copy(), np.float32(0.2)
    for t in range(steps):
        look = w + np.float32(t / (t + 3)) * (w - last)
        grad = np.zeros_like(w)
        grad[:-1] = np.float32(l2) * look[:-1]
        for a, b in cuts:
            d = x.dense(a, b) if kept is None else kept
            g = -2 * share[a:b] * np.maximum(0, 1 - y[a:b] * (d @ look[:-1] + look[-1])) * y[a:b]
            grad[:-1] += d.T @ g
            grad[-1] += g.sum(axis=0)
        last = w
        w = look - rate * grad
    return w[:-1], w[-1]


def _rest(x: Sparse, of: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest machines, a column each, of the names."""
    parts = [svms(x, np.stack([np.where(of == f, 1, -1) for f in names[a : a + _AT_ONCE]], axis=1).astype(np.float32)) for a in range(0, len(names), _AT_ONCE)]
    return np.concatenate([w for w, _ in parts], axis=1), np.concatenate([b for _, b in parts])


@dataclass
class Languages:
    """Families with their languages; machines by family, by pair of languages (positive: the first), and of the languages of wide families."""

    members: dict[str, list[str]] = field(default_factory=dict)
    tops: dict[str, tuple[np.ndarray, float]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)
    wide: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        names, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
        if not self.members:
            return names.tolist(), scores
        for lo, hi in slices(texts):
            for a in range(lo, hi, 256):
                b = min(hi, a + 256)
                x = _scaled(counts(texts.slice(a, b - a)))
                got, sc = self._of(x)
                names[a:b], scores[a:b] = got, sc
        return np.where(letter, names, "und").tolist(), np.where(letter, scores, 0.0)

    def _of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sure = lambda z: 1 / (1 + np.exp(-np.clip(3 * z, -30, 30)))
        tops = sorted(self.members)
        z = np.stack([x @ self.tops[f][0] + self.tops[f][1] if f in self.tops else np.ones(len(x)) for f in tops], axis=1)
        best = z.argmax(axis=1)
        names, score = np.full(len(x), "", object), sure(z.max(axis=1))
        for i, f in enumerate(tops):
            mine, langs = np.flatnonzero(best == i), self.members[f]
            if f in self.wide:
                own = x[mine] @ self.wide[f][0] + self.wide[f][1]
                names[mine] = np.array(langs, object)[own.argmax(axis=1)]
                score[mine] *= sure(own.max(axis=1))
                continue
            votes, margin = np.zeros((len(mine), len(langs))), np.zeros((len(mine), len(langs)))
            for (p, a), (q, b) in combinations(enumerate(langs), 2):
                d = x[mine] @ self.pairs[a, b][0] + self.pairs[a, b][1]
                votes[:, p] += d > 0
                votes[:, q] += d <= 0
                margin[:, p] += d
                margin[:, q] -= d
            pick = (votes + 0.4 * np.tanh(margin)).argmax(axis=1) if len(mine) else np.zeros(0, int)
            names[mine] = np.array(langs, object)[pick]
            if len(langs) > 1:
                score[mine] *= sure(margin[np.arange(len(mine)), pick] / (len(langs) - 1))
        return names, score


def fit(x: Sparse, lang: list[str]) -> Languages:
    """Machines from scaled features."""
    out, lang = Languages(), np.array(lang, object)
    for name in sorted(set(lang)):
        out.members.setdefault(family(name), []).append(name)
    families = {name: f for f, names in out.members.items() for name in names}
    of = np.array([families[name] for name in lang], object)
    if len(out.members) > 1:
        w, b = _rest(x, of, list(out.members))
        out.tops = {f: (w[:, i].copy(), float(b[i])) for i, f in enumerate(out.members)}
    for f, names in out.members.items():
        if len(names) > WIDE:
            mine = np.flatnonzero(of == f)
            out.wide[f] = _rest(x.take(mine), lang[mine], names)
            continue
        for a, b in combinations(names, 2):
            two = np.flatnonzero((lang == a) | (lang == b))
            w, c = svms(x.take(two), np.where(lang[two] == a, 1, -1).astype(np.float32)[:, None])
            out.pairs[a, b] = w[:, 0].copy(), float(c[0])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, rows: int = ROWS) -> Languages:
    """Machines of every language from all rows given with a text and a language (hold rows out before); about sample rows of each are read into them,
    or fewer where all together would be more than rows."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    spot = F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(1 << 40)) / float(1 << 40)
    sizes = src.groupBy("lang").agg(F.count("*").alias("count"), F.min(spot).alias("first")).collect()
    if not sizes:
        return Languages()
    each = min(sample, max(LEAST, rows // len(sizes)))
    # The first row of a language is taken in any case: none goes without.
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"]), r["first"]) for r in sizes], "lang string, share double, first double")
    picked = src.withColumn("spot", spot).join(F.broadcast(share), "lang").where("spot < share or spot = first").select("lang", "spot", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                c = counts(b.column(2).slice(a, 64))
                rows, cols = np.nonzero(c)
                off = pa.array(np.searchsorted(rows, np.arange(len(c) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (cols.astype(np.int16), c[rows, cols].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, 64), b.column(1).slice(a, 64), *lists], ["lang", "spot", "k", "c"])

    counted = stash(map_arrow(picked.dropDuplicates(["lang", "spot"]), run, "lang string, spot double, k array<smallint>, c array<int>"), "language-sample")
    last = within(counted.select("lang", "spot", F.size("k").alias("entries")).collect(), "lang", ENTRIES // len(sizes))
    bound = docs.sparkSession.createDataFrame(list(last.items()), "lang string, last double")
    got = counted.join(F.broadcast(bound), "lang").where("spot <= last").select("lang", "k", "c").toArrow()
    lang, k, c = (chunked(got.column(i)) for i in range(3))
    off, count = np.asarray(k.offsets).astype(np.int64), c.values.to_numpy()
    total = np.diff(np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[off])
    x = Sparse(off, k.values.to_numpy(), np.sqrt(count / np.repeat(np.maximum(total, 1), np.diff(off))).astype(np.float32))
    names = lang.to_pylist()
    order = sorted(range(len(names)), key=lambda i: (names[i], int(total[i]), x.cols[off[i] : off[i + 1]].tobytes()[:512], count[off[i] : off[i + 1]].tobytes()[:512]))
    made = fit(x.take(np.array(order, np.int64)), [names[i] for i in order])
    del x, k, c, got
    give_back()  # the driver keeps the machines only
    return made


def predict(docs: DataFrame, machines: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = machines.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, with the fold that the machines never saw."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs.where(bucket(F.col("doc_id"), 5) != 0)))
    return found.select(F.col("id").alias("doc_id"), (bucket(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score")
