"""Lexical search: BM25+ over postings that are packed by windows of documents, with upper bounds by block, so that most postings are never read.

A window is one row: up to ``WINDOW`` documents, ordered by the kept columns and then by length, cut into blocks of ``BLOCK``. By term it holds the
documents' places with their counts, and by term and block the largest count and the shortest length: from these follows the most that a term can add to a document of the
block, whatever the corpus' mean length is by then. Numbers are as narrow as a window's allow, since a search reads all windows. Windows are written as documents come and never move afterwards; a collection in several
segments is the union of its windows.

A search sends its terms to all windows, twice. The first pass sums the ``PROBE`` most promising blocks of each window by their bounds: the k-th best score
that this finds is a threshold which no result is below. The second leaves out every block whose bound is below it, and takes the others' terms in rounds, from the
heaviest on, until no document of a block can reach the threshold any more: no result can change by that. Only k rows a query leave a task. Queries go in blocks
of ``QUERY_ROWS`` (query, term) rows, each block's result written before the next is sent. Statistics are those of the whole corpus, also where a filter holds for a search.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.bags import bags, lots
from corvane.functions.bags import ranges as _ranges
from corvane.functions.bags import strings
from corvane.functions.text import blank_if_null, tokenize
from corvane.sources.durable import DEAD_ROWS, LARGE_ROWS, durable, gone_at_exit, read_text, shared_dir, small, spread, write_new

K1, B, DELTA = 1.5, 0.75, 1.0
#: Documents of a window and of a block; postings after which a window is closed early; (query, term) rows of one block of queries.
WINDOW, BLOCK, WINDOW_POSTINGS, QUERY_ROWS = 4096, 8, 2_000_000, 1_000_000
#: A block is left out only where its bound is below the k-th score by more than rounding.
SLACK = 1e-6
#: Blocks of a window that are summed first, beside those that k documents need; rounds of terms of the others.
PROBE, ROUNDS = 2, 8
_BLOBS = ("ids", "lengths", "terms", "term_ends", "entry_ends", "entry_block", "entry_tf", "entry_dl", "posting_ends", "places", "tfs")


@dataclass(frozen=True)
class LexicalIndex:
    """Windows of postings, terms(tok, df) and the corpus' size and mean length; dead(w, n): documents that count no more."""

    windows: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    dead: DataFrame | None = None

    @staticmethod
    def build(chunks: DataFrame, id_col: str = "id", text: Column | str = "text", keep: tuple[str, ...] = (), path: str | None = None, window: int = WINDOW) -> LexicalIndex:
        """One pass for tokens and their counts within rows; nothing is shuffled but the terms' counts. Kept under a path where one is given, else until the driver ends."""
        spark = chunks.sparkSession
        folder = path or f"{shared_dir(spark)}/corvane-postings-{uuid.uuid4().hex}"
        facts = write_segment(chunks, id_col, text, keep, folder, window)
        write_new(spark, f"{folder}/index.json", json.dumps(facts))
        if path is None:
            gone_at_exit(spark, folder)
        return LexicalIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        """An index that was built under a path, also by another session."""
        about = read_text(spark, f"{path}/index.json")
        if about is None:
            raise FileNotFoundError(f"no index under {path}")
        facts = json.loads(about)
        return LexicalIndex(spark.read.parquet(f"{path}/windows"), spark.read.parquet(f"{path}/terms"), facts["docs"], facts["length"] / facts["docs"] if facts["docs"] else 0.0)

    def weighed(self, queries: DataFrame) -> DataFrame:
        """(qid, tok, w) of the query tokens that are known; repeated query tokens count each time."""
        q = queries.select("qid", F.explode(tokenize("text")).alias("tok")).groupBy("qid", "tok").agg(F.count("*").alias("qf"))
        return q.join(self.terms, "tok").select("qid", "tok", (F.col("qf") * F.log((F.lit(self.n) + 1) / F.col("df"))).alias("w"))

    def _hits(self, queries: DataFrame, k: int, where: dict | None, work: bool) -> DataFrame:
        spark = queries.sparkSession
        rows = f"qid {queries.schema['qid'].dataType.simpleString()}, id bigint, score double"
        schema = "met bigint, scored bigint" if work else rows
        weighed, source = self.weighed(queries), self._filtered(where)

        def found(block: pa.Table) -> DataFrame:
            first = source.mapInArrow(_nearest(block, k, self.avgdl), rows).groupBy("qid", "id").agg(F.max("score").alias("score"))
            least = top_k(first, k).where(F.col("rank") == k).select("qid", "score").toArrow()  # a row a query of the block
            return source.mapInArrow(_nearest(block, k, self.avgdl, least, work), schema)

        head = weighed.limit(QUERY_ROWS + 1).toArrow()
        if head.num_rows <= QUERY_ROWS:
            return found(head) if head.num_rows and k > 0 else spark.createDataFrame([], schema)
        weighed = durable(weighed, "query-terms")
        blocks = -(-weighed.count() // QUERY_ROWS)
        parts = (weighed.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow() for b in range(blocks))
        return reduce(DataFrame.union, [durable(found(p), "lexical-block") for p in parts if p.num_rows])

    def _filtered(self, where: dict | None) -> DataFrame:
        """Windows with `allowed`, the places that a filter leaves (null for all), and `gone`, the documents that count no more."""
        source = self.windows
        allowed = F.lit(None).cast("array<int>")
        if where:
            test = lambda i: reduce(lambda a, b: a & b, [F.get(F.col(f"keep_{c}"), i) == F.lit(v) for c, v in where.items()])
            first = F.col(f"keep_{next(iter(where))}")
            allowed = F.filter(F.sequence(F.lit(0), F.size(first) - 1), test)
        source = source.withColumn("allowed", allowed)
        if self.dead is None:
            return source.select("allowed", F.lit(None).cast("array<bigint>").alias("gone"), *_BLOBS)
        gone = self.dead.groupBy("w").agg(F.collect_list("n").alias("gone"))  # a window's documents at most
        return source.join(F.broadcast(gone) if small(self.dead, DEAD_ROWS) else gone, "w", "left").select("allowed", "gone", *_BLOBS)

    def search(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
        """(qid, id, score, rank): the k best of each query (qid, text) among the documents whose kept columns equal those of where; ties go to the lower id."""
        return top_k(self._hits(queries, max(k, 0), where, False), k)

    def work(self, queries: DataFrame, k: int, where: dict | None = None) -> tuple[int, int]:
        """How many postings of the queries' terms there are, counted once for each query, and how many of them a search sums."""
        met, scored = self._hits(queries, k, where, True).agg(F.sum("met"), F.sum("scored")).first()
        return met or 0, scored or 0


def write_segment(chunks: DataFrame, id_col: str, text: Column | str, keep: tuple[str, ...], folder: str, window: int = WINDOW, aligned: bool = False) -> dict:
    """Windows and term counts of some documents under a folder; how many they are and their length in all. aligned: a window holds ids of one
    multiple of ``WINDOW`` only, by which documents can be told dead later."""
    docs = spread(chunks) if not aligned else chunks
    rows = _lowered(docs, id_col, text, keep)
    kept = [f for f in rows.schema if f.name.startswith("keep_")]
    schema = "w bigint, docs bigint, total bigint, " + ", ".join(f"{b} binary" for b in _BLOBS) + "".join(f", `{f.name}` array<{f.dataType.simpleString()}>" for f in kept)
    rows.mapInArrow(_windows(window, aligned), schema).write.options(**LARGE_ROWS).parquet(f"{folder}/windows")
    written = chunks.sparkSession.read.schema(schema).parquet(f"{folder}/windows")
    written.select("terms", "term_ends", "entry_ends", "posting_ends", F.octet_length("entry_block").alias("size")).mapInArrow(_counts, "tok string, df bigint").groupBy("tok").agg(F.sum("df").alias("df")).write.parquet(f"{folder}/terms")
    docs, total = written.agg(F.sum("docs"), F.sum("total")).first()
    return {"docs": docs or 0, "length": total or 0}


def _lowered(docs: DataFrame, id_col: str, text: Column | str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.lower(blank_if_null(text)).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])


def distinct_words(docs: DataFrame, id_col: str, text: Column | str, *keep: str) -> DataFrame:
    """(id, toks, dl, kept columns): the distinct words of each text, as an index counts them, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _bagged(batches):
            toks = pa.ListArray.from_arrays(b.column(2).offsets, b.column(2).values.dictionary_decode().cast(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), toks, b.column(1), *b.columns[4:]], ["id", "toks", "dl", *keep])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return _lowered(docs, id_col, text, keep).mapInArrow(run, f"id bigint, toks array<string>, dl bigint{kinds}")


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of documents (id, text, kept columns) as (id, dl, tok, tf, kept columns): a text's length, its distinct words, as numbers in a batch's dictionary, and how often it holds each."""
    for whole in batches:
        for at, n in lots(whole.column(1)):
            b = whole.slice(at, n)
            words, code, place, tf = bags(b.column(1))
            off = pa.array(np.searchsorted(place, np.arange(n + 1)).astype(np.int32))
            tok = pa.ListArray.from_arrays(off, pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), words))
            dl = np.bincount(place, tf, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dl), tok, pa.ListArray.from_arrays(off, pa.array(tf.astype(np.int32))), *b.columns[2:]], ["id", "dl", "tok", "tf", *b.schema.names[2:]])


def _windows(window: int, aligned: bool):
    """Batches of documents (id, text, kept columns) to windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            packed = _packed(waiting)
            waiting.clear()
            return packed

        rows = postings = 0
        last = None
        for b in _bagged(batches):
            sizes = np.diff(_flat_offsets(b.column(2)))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            at = 0
            while at < b.num_rows:
                most = min(b.num_rows - at, window - rows)
                if aligned:
                    home = int(ids[at]) // WINDOW
                    if last is not None and home != last and rows:
                        yield close()
                        rows, postings, most = 0, 0, min(b.num_rows - at, window)
                    last = home
                    other = np.flatnonzero(ids[at : at + most] // WINDOW != home)
                    most = int(other[0]) if len(other) else most
                inside = int(np.searchsorted(np.cumsum(sizes[at : at + most]), WINDOW_POSTINGS - postings, "right"))
                take = max(1, min(most, inside)) if not rows else min(most, inside)
                if take:
                    waiting.append(b.slice(at, take))
                    rows, postings, at = rows + take, postings + int(sizes[at : at + take].sum()), at + take
                if not take or rows >= window or postings >= WINDOW_POSTINGS:
                    yield close()
                    rows = postings = 0
        if waiting:
            yield close()

    return run


def _flat_offsets(col: pa.Array) -> np.ndarray:
    return np.asarray(col.offsets.to_numpy(), np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers from 0 on, as narrow as the largest allows."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    """n numbers of any width."""
    return np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.zeros(0, np.uint8)


def _ends(raw: bytes, total: int) -> np.ndarray:
    """Where some stretches end, the last of them at total: in four bytes each, or in eight, as windows were written once."""
    return np.frombuffer(raw, np.uint32 if len(raw) and np.frombuffer(raw, np.uint32)[-1] == total else np.int64).astype(np.int64)


def _posting_ends(raw: bytes, n: int) -> np.ndarray:
    """Where the postings of n entries end: written as how many each has, once as the ends in eight bytes."""
    return np.frombuffer(raw, np.int64) if len(raw) == 8 * n else np.cumsum(_wide(raw, n), dtype=np.int64)


def _coded(toks: list[pa.ListArray]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of some batches and the number of each in turn: only the batches' dictionaries are compared, not every word."""
    parts = [x.flatten() for x in toks]
    every = pa.concat_arrays([x.dictionary for x in parts]).dictionary_encode()
    begin = np.cumsum([0, *(len(x.dictionary) for x in parts)])
    code = every.indices.to_numpy(zero_copy_only=False)[np.concatenate([x.indices.to_numpy(zero_copy_only=False).astype(np.int64) + a for x, a in zip(parts, begin, strict=False)])]
    used = np.bincount(code, minlength=len(every.dictionary)) > 0  # a batch's other rows may lie in another window
    return every.dictionary.filter(pa.array(used)), (np.cumsum(used) - 1)[code]


def _packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One window: documents by kept columns and length, postings by term and place, bounds by term and block."""
    words, code = _coded([b.column("tok") for b in batches])
    sizes = np.concatenate([np.diff(_flat_offsets(b.column("tok"))) for b in batches])
    t = pa.Table.from_batches([b.select([c for c in b.schema.names if c != "tok"]) for b in batches]).combine_chunks()
    dl = t.column("dl").to_numpy().astype(np.int64)
    codes = [t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in t.column_names if c.startswith("keep_")]
    by = np.lexsort((dl, *reversed(codes)))
    to = np.empty(len(by), np.int64)  # where each document goes
    to[by] = np.arange(len(by))
    tf, place = t.column("tf").combine_chunks().flatten().to_numpy().astype(np.int32), np.repeat(to, sizes)
    t = t.select([c for c in t.column_names if c != "tf"]).take(pa.array(by)).combine_chunks()
    dl, ids = t.column("dl").to_numpy().astype(np.int32), t.column("id").to_numpy().astype(np.int64)
    order = np.argsort(code * len(dl) + place)  # a document holds a word once here
    code, place, tf = code[order], place[order], tf[order]
    first = np.flatnonzero(np.diff(code * len(dl) + place // BLOCK, prepend=-1) != 0) if len(code) else np.zeros(0, np.int64)
    entry_tf = np.maximum.reduceat(tf, first) if len(first) else tf
    entry_dl = np.minimum.reduceat(dl[place], first) if len(first) else tf
    raw, off = words.buffers()[2], np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    parts = {
        "ids": ids.tobytes(), "lengths": _narrow(dl), "terms": raw.to_pybytes()[off[0] : off[-1]] if raw and len(words) else b"", "term_ends": (off[1:] - off[0]).astype(np.uint32).tobytes(),
        "entry_ends": np.cumsum(np.bincount(code[first], minlength=len(words))).astype(np.uint32).tobytes(), "entry_block": (place[first] // BLOCK).astype(np.uint16).tobytes(), "entry_tf": _narrow(entry_tf),
        "entry_dl": _narrow(entry_dl), "posting_ends": _narrow(np.diff(np.append(first, len(code)))[: len(first)]), "places": place.astype(np.uint16).tobytes(), "tfs": _narrow(tf),
    }
    head = [pa.array([int(ids[0]) // WINDOW]), pa.array([len(ids)]), pa.array([int(dl.astype(np.int64).sum())])]
    blobs = [pa.array([x], pa.binary()) for x in parts.values()]
    kept = [(c, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), t.column(c).combine_chunks())) for c in t.column_names if c.startswith("keep_")]
    return pa.RecordBatch.from_arrays([*head, *blobs, *(x for _, x in kept)], ["w", "docs", "total", *parts, *(c for c, _ in kept)])


def _strings(data: bytes, ends: bytes) -> pa.Array:
    return strings(data, _ends(ends, len(data)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tok, df): how many documents of a window hold each of its terms."""
    for b in batches:
        for data, ends, entries, posts, size in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            upto = np.append(0, _posting_ends(posts, size // 2))[_ends(entries, size // 2)]
            yield pa.RecordBatch.from_arrays([_strings(data, ends).cast(pa.string()), pa.array(np.diff(upto, prepend=0))], ["tok", "df"])


def _found(vocabulary: pa.Array, terms: pa.Array) -> np.ndarray:
    """Where each word of a vocabulary is among a window's terms, else -1: the longer side is looked up in the shorter one."""
    if len(terms) <= len(vocabulary):
        return pc.index_in(vocabulary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    at = pc.index_in(terms, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    out, has = np.full(len(vocabulary), -1), np.flatnonzero(at >= 0)
    out[at[has]] = has
    return out


class _Window:
    """One window's arrays, read in place."""

    def __init__(self, row: tuple, vocabulary: pa.Array, avgdl: float):
        allowed, gone, *blobs = row
        v = dict(zip(_BLOBS, blobs, strict=True))
        self.ids, self.block, self.place = np.frombuffer(v["ids"], np.int64), np.frombuffer(v["entry_block"], np.uint16), np.frombuffer(v["places"], np.uint16)
        self.lengths, self.tf = _wide(v["lengths"], len(self.ids)), _wide(v["tfs"], len(self.place))
        self.entry_end, self.post_end = _ends(v["entry_ends"], len(self.block)), _posting_ends(v["posting_ends"], len(self.block))
        self.entry_begin, self.post_begin = np.append(0, self.entry_end[:-1]), np.append(0, self.post_end[:-1])
        self.avgdl, self.blocks = avgdl or 1.0, -(-len(self.ids) // BLOCK)
        self.bound = self.part(_wide(v["entry_tf"], len(self.block)), _wide(v["entry_dl"], len(self.block)))
        self.term = _found(vocabulary, _strings(v["terms"], v["term_ends"]))
        self.open = None
        if allowed is not None or gone:
            self.open = np.full(len(self.ids), allowed is None)
            if allowed is not None:
                self.open[np.array(allowed, np.int64)] = True
            if gone:
                self.open &= ~np.isin(self.ids, np.array(gone, np.int64))

    def part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (K1 * (1 - B + B * dl / self.avgdl) + tf)

    def reaching(self, chosen: np.ndarray, block: np.ndarray, entries: np.ndarray, w: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of some blocks' documents that reach a score, their sums, and how many postings that took. Terms are taken from the one with the highest bound on: what the later ones can add
        to a block's documents is known, so that a block is looked at further only while one of its documents can reach the score."""
        mine = np.zeros(self.blocks, bool)
        mine[chosen] = True
        mine = mine[block]
        entries, w, block, term = entries[mine], w[mine], block[mine], term[mine]
        most = self.bound[entries] * w
        top = np.zeros(term.max() + 1)
        np.maximum.at(top, term, most)
        rank = np.empty(len(top), np.int64)
        rank[np.argsort(-top, kind="stable")] = np.arange(len(top))
        total, hit, n = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool), 0
        rest = np.bincount(block, most, minlength=self.blocks)
        alive = np.zeros(self.blocks, bool)
        alive[chosen] = True
        of = np.arange(len(self.ids)) // BLOCK
        cut = 0
        while cut < len(top):
            to = len(top) if least == -np.inf else min(len(top), cut + max(1, len(top) // ROUNDS))
            now = (rank[term] >= cut) & (rank[term] < to) & alive[block]
            begin, end = self.post_begin[entries[now]], self.post_end[entries[now]]
            at = _ranges(begin, end)
            place = self.place[at]
            n += len(at)
            total += np.bincount(place, self.part(self.tf[at], self.lengths[place]) * np.repeat(w[now], end - begin), minlength=len(self.ids))
            hit[place] = True
            rest -= np.bincount(block[now], most[now], minlength=self.blocks)
            cut = to
            can = total + rest[of] >= least
            if self.open is not None:
                can &= self.open
            alive &= np.bincount(of[can], minlength=self.blocks) > 0
        out = np.flatnonzero(hit & alive[of] & (total >= least) & (True if self.open is None else self.open))
        return out, total[out], n


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:  # what is below the k-th score by more than rounding is not sorted
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - SLACK
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -np.round(scores, 9)))[:k]
    return scores[order], ids[order]


def _nearest(weighed: pa.Table, k: int, avgdl: float, least: pa.Table | None = None, work: bool = False):
    """The k best of each query in each task: among the most promising blocks only, or, with least (qid, score: what the k-th best has at least), among all
    documents; work: only how many postings there are and how many are summed by both."""
    vocabulary = weighed.column("tok").combine_chunks().cast(pa.large_string()).dictionary_encode()
    query = weighed.column("qid").combine_chunks().dictionary_encode()
    names, of = query.dictionary, query.indices.to_numpy()
    order = np.argsort(of, kind="stable")
    code, weight, first = vocabulary.indices.to_numpy()[order], weighed.column("w").to_numpy()[order], np.searchsorted(of[order], np.arange(len(names) + 1))
    floor = np.add.reduceat(weight, first[:-1]) * DELTA
    lowest = np.full(len(names), -np.inf)
    if least is not None and least.num_rows:
        at = pc.index_in(least.column("qid"), value_set=names).to_numpy()
        lowest[at] = least.column("score").to_numpy() - floor[at] - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
        met = scored = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                win = _Window(row, vocabulary.dictionary, avgdl)
                free = None if win.open is None else np.bincount(np.flatnonzero(win.open) // BLOCK, minlength=win.blocks) > 0
                for q in range(len(names)):
                    term = win.term[code[first[q] : first[q + 1]]]
                    has = term >= 0
                    term, w = term[has], weight[first[q] : first[q + 1]][has]
                    begin, end = win.entry_begin[term], win.entry_end[term]
                    entries, w, nth = _ranges(begin, end), np.repeat(w, end - begin), np.repeat(np.arange(len(term)), end - begin)
                    block = win.block[entries]
                    bound = np.bincount(block, win.bound[entries] * w, minlength=win.blocks)
                    met += int((win.post_end[entries] - win.post_begin[entries]).sum()) if work else 0
                    scores, ids = best[q]
                    floor_now = max(lowest[q], scores[-1] - SLACK if len(scores) == k else -np.inf)
                    todo = np.flatnonzero((bound > 0) & (bound >= floor_now) & (True if free is None else free))
                    todo = todo[np.argsort(-bound[todo], kind="stable")]
                    probe = todo[: -(-k // BLOCK) + PROBE]
                    for now, floor_of in ((probe, -np.inf),) if least is None else ((todo, floor_now),):
                        if len(now):
                            place, got, n = win.reaching(now, block, entries, w, nth, floor_of)
                            scored += n
                            scores, ids = _best(np.concatenate([scores, got]), np.concatenate([ids, win.ids[place]]), k)
                    if work and len(probe):
                        mine = np.isin(block, probe)
                        scored += int((win.post_end[entries[mine]] - win.post_begin[entries[mine]]).sum())
                    best[q] = scores, ids
        if work:
            yield pa.RecordBatch.from_arrays([pa.array([met]), pa.array([scored])], ["met", "scored"])
            return
        sizes = [len(x) for x, _ in best]
        if sum(sizes):
            of = np.repeat(np.arange(len(names)), sizes)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]) + floor[of])], ["qid", "id", "score"])

    return run


def top_k(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k best rows of each qid by score, then id. Spark cuts each partition to k before the shuffle."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", digits)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0))
