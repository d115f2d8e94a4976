"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Level 0: each partition tokenises its documents, cuts those longer than a sequence, and packs the pieces best-fit, longest
first. Bins that are nearly full are emitted. The others become items for the next level: groups of partitions meet in a
tree, each packs its underfull bins as whole items, best-fit again, and hands its own underfull bins on. Only bins (two
numbers each) move, never tokens or texts. The tree stops when a task's bins would outgrow ``GROUP_ROWS`` (a best-fit over so many is
as good as one over all), so no task's input grows with the corpus; what is underfull then is opened once and its pieces
are packed anew, which makes up for partitions of few documents.

Defined cases: a null or empty text is the single end token; equal rows are packed each; an empty table gives no rows; a
document of exactly one sequence's length fills a sequence alone; ids may be null or repeated, as rows are told apart by
their place in a bin; very long texts are tokenised whole and cut into as many pieces as they need; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import U64, buffers, give_back, map_arrow, slices, span_hashes, stash, table

#: Bins that lack at most 1/SLACK of their room are emitted; so many partitions meet per level; most bins per task.
SLACK, FAN_IN, GROUP_ROWS = 512, 16, 400_000
#: Fixed value: the pattern by which this vocabulary's file splits normalised text into words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker remembers, at about 40 bytes each.
_SEEN_MOST = 1_000_000
#: Classes of bytes: blank, letter, digit, other. Letters beyond ASCII: the two bytes of U+00C0 to U+00FF.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_CLASS[48:58] = 2
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(9, 14), *range(32, 127), 0xC3, *range(0x80, 0xC0)]] = True


class _Known:
    """Ids of words by the words' 64-bit hashes: sorted arrays, one pool of ids, and one of the words' bytes, so that a hash is never taken for a word."""

    def __init__(self):
        self.key, self.at, self.n, self.byte_at, self.byte_n = np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.bytes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 18, np.uint8)
        self.used = self.bytes_used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes, or -1."""
        if not len(self.key):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where(self.key[i] == h, i, -1)

    def add(self, h: np.ndarray, n: np.ndarray, ids: np.ndarray, words: list[bytes]) -> None:
        raw, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")])
        if self.bytes_used + len(raw) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(max(len(self.bytes), len(raw)), np.uint8)])
        self.pool[self.used : self.used + len(ids)], self.bytes[self.bytes_used : self.bytes_used + len(raw)] = ids, raw
        at, byte_at = self.used + np.cumsum(n) - n, self.bytes_used + np.cumsum(size) - size
        self.used, self.bytes_used = self.used + len(ids), self.bytes_used + len(raw)
        where = np.searchsorted(self.key, h)
        self.key, self.at, self.n, self.byte_at, self.byte_n = (np.insert(a, where, x) for a, x in ((self.key, h), (self.at, at), (self.n, n), (self.byte_at, byte_at), (self.byte_n, size)))

    def others(self, k: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which stretches of bytes are not the words at the places k, for all that their hashes say."""
        size = end - start
        other = self.byte_n[k] != size
        total = np.cumsum(size)
        begin = total - size
        at = np.arange(total[-1] if len(total) else 0)
        unlike = np.flatnonzero(data[at + np.repeat(start - begin, size)] != self.bytes[np.minimum(at + np.repeat(self.byte_at[k] - begin, size), len(self.bytes) - 1)])
        other[np.searchsorted(total, unlike, "right")] = True
        return other


class WordTokenizer:
    """The tokenizer of a file, with the ids of whole words kept: word pieces never cross words.

    For files that split by ``_WORDS`` after NFC, blanks and lower case, texts of ASCII and Latin-1 letters are cut into
    words over whole batches of bytes, and each distinct word is encoded once. All other texts, such as those with a
    special token's string or with other letters, are encoded one by one.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        head = json.load(open(path, encoding="utf-8"))
        steps = [x.get("type") for x in (head.get("normalizer") or {}).get("normalizers", [])]
        self.special = [x["content"] for x in head.get("added_tokens", [])]
        end = head["model"].get("end_of_word_suffix")
        self.fast = steps == ["NFC", "Replace", "Lowercase"] and bool(end) and _WORDS in json.dumps(head.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\")
        self.ends = np.zeros(self.t.get_vocab_size() + 1, bool)
        if self.fast:
            self.ends[[i for w, i in head["model"]["vocab"].items() if w.endswith(end)]] = True
        del head
        give_back()
        self.known = _Known()

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them."""
        lots = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.t.encode_batch_fast(lots, add_special_tokens=False)])
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(words):
            each = [e.ids for e in self.t.encode_batch_fast(words, add_special_tokens=False)]
            return np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], "<u4")
        return np.diff(stop, prepend=0), ids

    def _cut(self, low: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word in the bytes, where each text's words begin, and the bytes."""
        data, off = buffers(low)
        c = _CLASS[data]
        new = np.ones(len(data), bool)
        new[1:] = (c[1:] != c[:-1]) | (c[1:] == 2)
        first = off[:-1][off[:-1] < len(data)]
        new[first] = True
        # 's 't 're 've 'm 'll 'd are words of their own where an apostrophe begins a run of others.
        quote = np.flatnonzero((data == 39) & new)
        if len(quote):
            pad = np.concatenate([data, np.zeros(3, np.uint8)])
            cut = np.concatenate([new, np.ones(3, bool)])
            cut[quote + 1] &= np.isin(quote + 1, first)  # a letter after it is no boundary unless a text begins there
            x, y = pad[quote + 1], pad[quote + 2]
            apart = np.zeros(len(pad) + 1, bool)
            apart[first] = True
            apart[len(data)] = True
            two = np.isin(x, [*b"stmd"]) & ~apart[quote + 1]
            three = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & ~apart[quote + 1] & ~apart[np.minimum(quote + 2, len(data))]
            new[quote[two | three] + 1] = False
            for q, n in ((quote[two], 2), (quote[three & ~two], 3)):
                new[(q + n)[q + n < len(data)]] = True
        edge = np.append(np.flatnonzero(new), len(data))
        word = c[edge[:-1]] != 0
        start, end = edge[:-1][word], edge[1:][word]
        return start, end, np.searchsorted(start, off), data

    def batch(self, texts: pa.Array, slow: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's begin (one more than texts); slow: texts that are encoded one by one, where that is known."""
        n = len(texts)
        if slow is None and not self.fast:
            slow = np.ones(n, bool)
        elif slow is None:
            data, off = buffers(texts)
            odd = ~_PLAIN[data]
            odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            slow = np.diff(np.concatenate([[0], np.cumsum(odd)])[off]) > 0
            for x in self.special:
                slow |= pc.fill_null(pc.match_substring(texts, x), False).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~slow)
        count, ids, parts = np.zeros(n, np.int64), np.zeros(0, "<u4"), {}
        if len(plain):
            start, end, ptr, data = self._cut(pc.utf8_lower(texts.take(pa.array(plain))))
            h = span_hashes(data, start, end)
            uniq, one, back = np.unique(h, return_index=True, return_inverse=True)
            if len(self.known.key) + len(uniq) > _SEEN_MOST:
                self.known = _Known()
            at = self.known.find(uniq)
            miss = np.flatnonzero(at < 0)
            if len(miss):
                raw = data.tobytes()
                words = [raw[start[i] : end[i]] for i in one[miss]]
                self.known.add(uniq[miss], *self._encode([w.decode() for w in words]), words)
                at = self.known.find(uniq)
            other = np.flatnonzero(self.known.others(at[back], data, start, end))
            if len(other):  # two words of one hash: their texts go word by word
                slow[plain[np.searchsorted(ptr, other, "right") - 1]] = True
                return self.batch(texts, slow)
            lens = self.known.n[at][back]
            total = np.concatenate([[0], np.cumsum(lens)])
            ids = self.known.pool[np.repeat(self.known.at[at][back] - total[:-1], lens) + np.arange(total[-1])]
            count[plain] = np.diff(total[ptr])
        for i in np.flatnonzero(slow):
            parts[i] = np.array(self.t.encode(texts[int(i)].as_py() or "", add_special_tokens=False).ids, "<u4")
            count[i] = len(parts[i])
        where = np.concatenate([[0], np.cumsum(count)])
        if parts:
            out = np.zeros(where[-1], "<u4")
            of = np.repeat(~slow, count)
            out[of] = ids
            for i, x in parts.items():
                out[where[i] : where[i + 1]] = x
            ids = out
        return ids, where


@lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks that a Python worker runs, so that known words stay known."""
    return WordTokenizer(path)


def best_fit(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item: longest first, each to the fullest bin that still takes it."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    by_room: dict[int, list[int]] = {}  # open bins by what is left; at most `room` different amounts
    rooms: list[int] = []
    n = 0
    for i in order:
        size = sizes[i]
        k = bisect_left(rooms, size)
        if k < len(rooms):
            left = rooms[k]
            b = by_room[left].pop()
            if not by_room[left]:
                del by_room[left], rooms[k]
        else:
            b, left, n = n, room, n + 1
        out[i] = (b, room - left)
        left -= size
        if left:
            if left not in by_room:
                insort(rooms, left)
                by_room[left] = []
            by_room[left].append(b)
    return out


def _opened(placed: DataFrame, room: int) -> DataFrame:
    """The last underfull bins of each group, opened: their pieces packed anew where that takes fewer bins."""

    def run(key, t):
        old, size = t.column("sequence_id").to_numpy(), t.column("length").to_numpy()
        order = np.lexsort((t.column("offset").to_numpy(), old, t.column("ids_crc32").to_numpy(), -size))
        place = np.zeros((len(size), 2), np.int64)
        place[order] = best_fit(size[order].tolist(), room)
        if place[:, 0].max(initial=-1) + 1 >= len(np.unique(old)):
            return t.drop_columns(["part"])
        names = t.schema.names
        t = t.set_column(names.index("sequence_id"), "sequence_id", pa.array(place[:, 0] + (int(key[0].as_py()) << 32) + (120 << 56)))
        return t.set_column(names.index("offset"), "offset", pa.array(place[:, 1])).drop_columns(["part"])

    return placed.groupBy("part").applyInArrow(run, placed.drop("part").schema)


_PIECES = "id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, at bigint, filled bigint, part int"


def _local(docs: DataFrame, path: str, room: int, end_id: int) -> DataFrame:
    """Every piece with its place in a bin of its own partition."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, part = worker_tokenizer(path), TaskContext.get().partitionId()
        ids, cols, id_arrow, stop = [], [], None, np.array([end_id], "<u4").tobytes()
        for b in batches:
            id_arrow = b.schema.field(0).type
            text = b.column(1)
            for lo, hi in slices(text):
                tok, where = t.batch(text.slice(lo, hi - lo))
                for key, x, y in zip(b.column(0).slice(lo, hi - lo).to_pylist(), where[:-1].tolist(), where[1:].tolist(), strict=True):
                    for p, a in enumerate(range(0, y - x + 1, room)):
                        piece, last = tok[x + a : min(y, x + a + room)].tobytes(), a + room > y - x
                        ids.append(key)
                        cols.append((p, a, len(piece) // 4 + last, zlib.crc32(stop, zlib.crc32(piece)) if last else zlib.crc32(piece)))
        if not ids:
            return
        c = np.array(cols, np.int64)
        place = np.array(best_fit(c[:, 2].tolist(), room), np.int64)
        filled = np.bincount(place[:, 0], c[:, 2]).astype(np.int64)[place[:, 0]]
        arrays = [pa.array(ids, id_arrow), pa.array(c[:, 0].astype(np.int32)), pa.array(c[:, 1]), pa.array(c[:, 2]), pa.array(c[:, 3]), pa.array(place[:, 0] + (part << 32)), pa.array(place[:, 1]), pa.array(filled), pa.array(np.full(len(c), part, np.int32))]
        whole = pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "bin", "at", "filled", "part"])
        for a in range(0, len(c), 50_000):
            yield whole.slice(a, 50_000)

    return map_arrow(docs, run, _PIECES.format(id=id_type))


def _merge(bins: DataFrame, level: int, room: int) -> DataFrame:
    """(bin, to, base, filled, part): each underfull bin's place in a bin of the next level; part: bigint group."""

    def run(key, b):
        size = b.column("filled").to_numpy()
        order = np.lexsort((b.column("bin").to_numpy(), -size))
        place = np.array(best_fit(size[order].tolist(), room), np.int64).reshape(-1, 2)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        place = place[back]
        filled = np.bincount(place[:, 0], size).astype(np.int64)[place[:, 0]]
        part = int(key[0].as_py())
        return pa.table([b.column("bin"), pa.array(place[:, 0] + (part << 32) + (level << 56)), pa.array(place[:, 1]), pa.array(filled), pa.array(np.full(len(size), part, np.int32))], ["bin", "to", "base", "filled", "part"])

    return bins.groupBy("part").applyInArrow(run, "bin bigint, to bigint, base bigint, filled bigint, part int")


def pack(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place in a sequence of at most room tokens."""
    pieces = stash(_local(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), tokenizer, room, end_id), "pack-pieces")
    open_ = F.col("filled") < room - room // SLACK
    bins = pieces.where(open_).groupBy("bin").agg(F.first("filled").alias("filled"), F.first("part").alias("part"))
    moves, level = None, 0
    n = pieces.where(open_).agg(F.countDistinct("bin"), F.countDistinct("part"), F.max("part")).first()
    left, groups, top = n[0], n[1], (n[2] or 0) + 1
    while left and level < 64:
        # As many groups as keep each under GROUP_ROWS bins, one where all fit; groups shrink by FAN_IN a level at most.
        least = -(-left // GROUP_ROWS)
        to = max(least, -(-top // FAN_IN))
        level += 1
        step = stash(_merge(bins.withColumn("part", F.pmod("part", F.lit(to)).cast("int")), level, room), "pack-level")
        moves = step.select("bin", "to", "base") if moves is None else moves.alias("m").join(step.select(F.col("bin").alias("to"), F.col("to").alias("next"), F.col("base").alias("more")), "to", "left").select("bin", F.coalesce("next", "to").alias("to"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        bins = step.where(open_).groupBy(F.col("to").alias("bin")).agg(F.first("filled").alias("filled"), F.first("part").alias("part"))
        top = to
        before, left = left, bins.count()
        if to <= least or left < 2 or to == 1:
            break
    columns = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if moves is None:
        return pieces.withColumnsRenamed({"bin": "sequence_id", "at": "offset"}).select(columns)
    placed = pieces.drop("part", "filled").join(moves, "bin", "left").withColumns({"sequence_id": F.coalesce("to", "bin"), "offset": F.col("at") + F.coalesce("base", F.lit(0))}).select(columns)
    last = bins.select(F.col("bin").alias("sequence_id"), "part")
    return placed.join(last, "sequence_id", "left_anti").select(columns).union(_opened(placed.join(last, "sequence_id"), room).select(columns))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of an installed tokenizer's file, the same on every node."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary()).withColumnRenamed("id", "doc_id")
