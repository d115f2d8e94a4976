"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

An item is held against every window of a text that has as many words as the item. Each window is fingerprinted first: by the
SimHash of its centre, the part that a similar window must still hold. A window of n shingles at the similarity lacks at most
``lost`` of the item's, so ``lost`` words at either end say nothing, and a window whose item has many shingles to lose has
lost // 4 + 1 centres side by side: breaking one costs four shingles at least, so one is whole in every window that reaches the
similarity (a text shorter than the item is a window of its own and may lack a fifth; it has centres of its own). Sizes of
centres are rounded down to a ladder, so a word costs one rolling fingerprint per rung, however many items there are.

A multi-index finds all centres of items within ``RADIUS`` bits of a fingerprint, without fail: of RADIUS + 1 blocks of 16 bits
one agrees. What it finds is verified exactly: weighted Jaccard of the bags of five-word shingles (weighted by how often each
occurs), of every window that holds the centre found, in one pass over that stretch.

Items are held in each worker, in as many rounds over the documents as keep a round's items under ``BLOCK_BYTES``.

Defined cases: null, empty and wordless texts and items match nothing; an item of fewer than five words is one shingle, so it
matches only a text of exactly those words; of equal similarities the first window counts; repeated items and rows are
reported each; very long texts are searched whole, in blocks of ``_BLOCK`` words; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import U64, map_arrow, shingle_hashes, slices, table, word_hashes

SIMILARITY, RADIUS, BITS, BLOCK_BYTES = 0.8, 3, 64, 16 << 20
#: Sizes of fingerprinted centres, in words: each about a quarter more than the one before.
LADDER = (1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 25, 31, 39)
_BLOCK = 1 << 15
_ONES, _HIGH = U64(0x0101010101010101), U64(0x8080808080808080)


def window_prints(words: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, first word, SimHashes of the windows of so many words that start there and after), block by block.

    Bit i is set if more than half of the words' hashes have it. The 64 counts of a window are eight sums of eight byte-wide
    counters, taken as differences of running sums; a size of 128 words or less cannot overflow them.
    """
    most = max(sizes, default=0)
    for a in range(0, len(words), _BLOCK):
        part = words[a : a + _BLOCK + most - 1]
        with np.errstate(over="ignore"):
            sums = np.zeros((8, len(part) + 1), U64)
            for k in range(8):
                np.cumsum((part >> U64(k)) & _ONES, out=sums[k, 1:])
            for size in sizes:
                n = min(len(part) - size + 1, _BLOCK)
                if n <= 0:
                    continue
                out, x, more = np.zeros(n, U64), np.empty(n, U64), U64(127 - size // 2) * _ONES
                for k in range(8):
                    np.subtract(sums[k, size : size + n], sums[k, :n], out=x)
                    x += more
                    x &= _HIGH
                    x >>= U64(7 - k)
                    out |= x
                yield size, a, out


class HammingIndex:
    """Fingerprints found within a radius, without fail: one of radius + 1 blocks of bits must be equal."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        cuts = np.linspace(0, BITS, radius + 2).astype(int)
        self.prints, self.radius, self.blocks = prints, radius, []
        for a, b in zip(cuts, cuts[1:], strict=False):
            value = self._block(prints, a, b)
            order = np.argsort(value, kind="stable")
            seen = np.zeros(1 << min(int(b - a), 16), bool)
            seen[(value & U64(len(seen) - 1)).astype(np.int64)] = True
            self.blocks.append((a, b, order, value[order], seen))

    @staticmethod
    def _block(x: np.ndarray, a: int, b: int) -> np.ndarray:
        return (x >> U64(a)) & U64((1 << int(b - a)) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance) of all items within the radius of each print."""
        rows, items = [], []
        for a, b, order, value, seen in self.blocks:
            mine = self._block(prints, a, b)
            hit = np.flatnonzero(seen[(mine & U64(len(seen) - 1)).astype(np.int64)])
            lo = np.searchsorted(value, mine[hit])
            n = np.searchsorted(value, mine[hit], "right") - lo
            post = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            row, item = np.repeat(hit, n), order[post]
            ok = np.bitwise_count(self.prints[item] ^ prints[row]) <= self.radius
            rows.append(row[ok])
            items.append(item[ok])
        key = np.unique(np.concatenate(rows).astype(np.int64) * max(len(self.prints), 1) + np.concatenate(items))
        row, item = np.divmod(key, max(len(self.prints), 1))
        return row, item, np.bitwise_count(self.prints[item] ^ prints[row]).astype(np.int64)


def centres(words: int, lost: int) -> list[tuple[int, int]]:
    """(offset, size) of the stretches of an item of which one is whole in any window that lacks so many shingles at most."""
    middle, parts = words - 2 * lost, lost // 4 + 1
    size = max((middle - 2 * (parts - 1)) // parts, min(5, words))
    size = max(x for x in LADDER if x <= size)
    room = max(middle - size, 0)
    return [(lost + room // 2, size)] if parts == 1 else [(lost + j * room // (parts - 1), size) for j in range(parts)]


class ItemIndex:
    """Items by the fingerprints of their centres."""

    def __init__(self, texts: list[str | None], radius: int = RADIUS, least: float = SIMILARITY):
        self.least = least
        h, ptr = word_hashes(pa.array(texts, pa.string()))
        self.words = np.diff(ptr)
        self.shingles, at = shingle_hashes(h, ptr)
        self.first = np.searchsorted(at, np.arange(len(texts) + 1))
        n = np.diff(self.first)
        lost, less = (np.floor(n * x + 1e-9).astype(int) for x in ((1 - least) / (1 + least), 1 - least))
        self.bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole, self.short = self._index(h, ptr, lost, radius), self._index(h, ptr, less, radius)

    def _index(self, h: np.ndarray, ptr: np.ndarray, lost: np.ndarray, radius: int) -> dict[int, tuple[HammingIndex, np.ndarray]]:
        """By size: the fingerprints of centres, and their items."""
        of: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero(self.words).tolist():
            for offset, size in centres(int(self.words[i]), int(lost[i])):
                of.setdefault(size, []).append((i, offset))
        prints = {size: np.zeros(len(h), U64) for size in of}
        for size, a, x in window_prints(h, sorted(of)):
            prints[size][a : a + len(x)] = x
        out = {}
        for size, owned in of.items():
            item, offset = np.array(owned).T
            out[size] = (HammingIndex(prints[size][ptr[item] + offset], radius), item)
        return out

    def _found(self, index: dict, h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """(text, item, first and last window start, distance) of all centres that fingerprints find."""
        out = [np.zeros((0, 5), np.int64)]
        for size, a, prints in window_prints(h, sorted(index)):
            near, item = index[size]
            row, k, far = near.near(prints)
            row = row + a
            text = np.searchsorted(ptr, row, "right") - 1
            ok = row + size <= ptr[text + 1]
            at = row - ptr[text]
            out.append(np.stack([text, item[k], at + size - self.words[item[k]], at, far], axis=1)[ok])
        return np.concatenate(out)

    def candidates(self, h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """(text, item, first and last window start, distance), sorted: what is verified. Every window of every text is looked up."""
        words = np.diff(ptr)
        got = self._found(self.whole, h, ptr)
        got = got[words[got[:, 0]] >= self.words[got[:, 1]]]
        less = np.flatnonzero((words > 0) & (words < self.words.max(initial=0)))
        if len(less):  # a text shorter than an item is one window
            own = np.concatenate([[0], np.cumsum(words[less])])
            part = self._found(self.short, h[np.repeat(ptr[less] - own[:-1], words[less]) + np.arange(own[-1])], own)
            part[:, 0] = less[part[:, 0]]
            part = part[words[part[:, 0]] < self.words[part[:, 1]]]
            got = np.concatenate([got, part])
        return got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]

    def _bag(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.bags:
            self.bags[i] = np.unique(self.shingles[self.first[i] : self.first[i + 1]], return_counts=True)
        return self.bags[i]

    def _best(self, s: np.ndarray, words: int, i: int, ranges: np.ndarray) -> tuple[int, float]:
        """The first best window of an item's size in a text's shingles that starts in one of the ranges, by their begins: (first word, similarity)."""
        names, often = self._bag(i)
        size = max(min(int(self.words[i]), words) - 4, 1)
        lo, hi = np.clip(ranges, 0, max(words - int(self.words[i]), 0)).T
        new = np.flatnonzero(np.concatenate([[True], lo[1:] > np.maximum.accumulate(hi)[:-1] + 1]))
        best, where = -1, 0
        for a, b in zip(lo[new].tolist(), np.maximum.reduceat(hi, new).tolist(), strict=True):
            part = s[a : b + size]
            name = np.minimum(np.searchsorted(names, part), len(names) - 1)
            mine = np.flatnonzero(names[name] == part)
            name = name[mine]
            order = np.lexsort((mine, name))
            name, mine = name[order], mine[order]
            # The c-th occurrence before this one: a window that holds both has c others, as many as count.
            nth = np.arange(len(name)) - often[name]
            old = (nth >= 0) & (name[np.maximum(nth, 0)] == name)
            begin = np.maximum(np.where(old, mine[np.maximum(nth, 0)] + 1, 0), mine - size + 1)
            edge = np.zeros(b - a + 2, np.int64)
            ok = (begin <= mine) & (begin <= b - a)
            np.add.at(edge, np.maximum(begin[ok], 0), 1)
            np.add.at(edge, np.minimum(mine[ok], b - a) + 1, -1)
            both = np.cumsum(edge)[: b - a + 1]
            k = int(np.argmax(both))
            if both[k] > best:
                best, where = int(both[k]), a + k
        total = size + int(self.first[i + 1] - self.first[i])
        return where, best / (total - best)

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, float]]:
        """(text, item, first word, words, distance, similarity): the best window of each text and item that reach it.

        The distance is the least of the fingerprints that found the item in the text.
        """
        h, ptr = word_hashes(texts)
        got = self.candidates(h, ptr)
        if not len(got):
            return []
        wanted = np.unique(got[:, 0])
        count = np.diff(ptr)[wanted]
        own = np.concatenate([[0], np.cumsum(count)])
        s, at = shingle_hashes(h[np.repeat(ptr[wanted] - own[:-1], count) + np.arange(own[-1])], own)
        first = np.searchsorted(at, np.arange(len(wanted) + 1))
        cut = np.flatnonzero(np.concatenate([[True], (got[1:, :2] != got[:-1, :2]).any(axis=1), [True]]))
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            t, i = int(got[a, 0]), int(got[a, 1])
            k = int(np.searchsorted(wanted, t))
            where, sim = self._best(s[first[k] : first[k + 1]], int(count[k]), i, got[a:b, 2:4])
            if sim >= self.least:
                out.append((t, i, where, int(min(self.words[i], count[k])), int(got[a:b, 4].min()), sim))
        return out


_BUILT: dict[str, ItemIndex] = {}


def _built(name: str, texts: list, radius: int, least: float) -> ItemIndex:
    """A round's index, built once in each worker process, which holds no other."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = ItemIndex(texts, radius, least)
    return _BUILT[name]


def _rounds(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[str, list]]:
    """The items in lists of a bounded size, each with a name."""
    src = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = src.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = src if n == 1 else src.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield uuid.uuid4().hex, part.orderBy("id", "text").collect()


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, item, start_word, n_words, distance, similarity): every item that a text holds, at its best window."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = f"id {src.schema['id'].dataType.simpleString()}, item {items.schema[item_col].dataType.simpleString()}, start_word bigint, n_words bigint, distance int, similarity double"
    out = None
    for name, rows in _rounds(items, item_col, item_text):
        names, texts = [r["id"] for r in rows], [r["text"] for r in rows]

        def run(batches, name=name, names=names, texts=texts):
            index, kind = _built(name, texts, radius, least), None
            for b in batches:
                for lo, hi in slices(b.column(1)):
                    found = index.search(b.column(1).slice(lo, hi - lo))
                    if found:
                        t, i, a, n, d, s = zip(*found, strict=True)
                        kind = kind or pa.array(names).type
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + x for x in t])), pa.array([names[x] for x in i], kind), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.int32()), pa.array(s, pa.float64())], ["id", "item", "start_word", "n_words", "distance", "similarity"])

        one = map_arrow(src, run, kinds)
        out = one if out is None else out.union(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], kinds)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the rows whose text holds an item. Filtered as it is read: nothing is shuffled."""
    at = docs.columns.index(text_col)
    for name, rows in _rounds(items, item_col, item_text):
        texts = [r["text"] for r in rows]

        def run(batches, name=name, texts=texts):
            index = _built(name, texts, radius, least)
            for b in batches:
                col, keep = b.column(at), np.ones(b.num_rows, bool)
                for lo, hi in slices(col):
                    keep[[lo + x[0] for x in index.search(col.slice(lo, hi - lo))]] = False
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in b.columns], b.schema.names)

        docs = map_arrow(docs, run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start_word", "n_words", "distance", "similarity")
