"""Ranked lexical search: postings in fixed windows of documents, scored by scatter-add into small arrays, harvested into heaps.

Documents are read once. Each task numbers its documents in the order it reads them and closes a window after ``WINDOW`` of them, or after ``WINDOW_BYTES`` of text:
a row per window holds the documents' ids and lengths and, by term, the places of its documents in the window with their
counts. Postings so never move, whatever a word's frequency; document counts come from one short row per window and term, summed before they are shuffled.

A search takes a window at a time. The contribution of each posting is computed once; for each item, those of its terms are added to an array with one
cell per document of the window, which fits a core's cache, while a mask keeps which cells were met; the cells that are met and reach the item's k-th best score so far
go to its heap. k rows an item leave a task, and Spark ranks them. Work grows with postings and items' terms, never with pairs of documents, and nothing is cut off: every
document with a term of the item is summed.

Items are taken in blocks of ``ITEM_TERMS`` (item, term) rows at most by their expected size, each written before the next is sent, so that neither the driver nor a task holds more
than a block; the postings are read again for each. Up to ``VOCABULARY`` different terms in all items, terms that no item has are not kept (nothing asks them);
beyond it all are, and the results are the same.

Defined cases: a null text has no terms; a document without terms counts in no statistic and is never returned; each row is a document, so that repeated rows rank each; null
ids are ordinary ids, last among equal scores; items with equal id and text are one item, those of one id with different texts are searched as one item each; an item without
known terms has no rows; empty tables give no rows; very long texts are counted whole, in a window of their own; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import _WORD, buffers, map_arrow, slices, stash, table

#: Documents of a window (their sums take 128 KB), and bytes of text after which it is closed early.
WINDOW, WINDOW_BYTES = 1 << 14, 24 << 20
#: Terms of all items up to which only these are kept; rows of a block of items.
VOCABULARY, ITEM_TERMS = 200_000, 500_000
#: The term pattern, and the letters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32

_POSTINGS = "docs bigint, terms_total bigint, ids binary, known binary, lengths binary, term_bytes binary, term_ends binary, post_ends binary, places binary, tfs binary"


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and where each text's begin (one more than texts)."""
    data, off = buffers(texts)
    is_word = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | edge[1:-1]
    at = np.flatnonzero(start)
    kept = np.concatenate([[0], np.cumsum(is_word)])
    ends = np.append(kept[at], kept[-1]).astype(np.int64)
    out = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(_LOW[data[is_word]].tobytes())])
    return out, np.searchsorted(at, off)


def _strings(data: bytes, ends: bytes) -> pa.Array:
    n = len(ends) // 8
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.concatenate([[0], np.frombuffer(ends, np.int64)]).astype(np.int64).tobytes()), pa.py_buffer(data)])


class _Open:
    """A window that is still being filled."""

    def __init__(self):
        self.ids, self.known, self.lengths, self.rows, self.terms, self.size = [], [], [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array, asked: pa.Array | None) -> None:
        """Documents and their texts; asked: the only terms that are kept, or all."""
        word, ptr = terms(texts)
        count = np.diff(ptr)
        place = np.repeat(np.arange(len(texts)) + sum(map(len, self.ids)), count)
        if asked is not None:
            hit = pc.is_in(word, value_set=asked)
            word, place = word.filter(hit), place[hit.to_numpy(zero_copy_only=False)]
        # Each text's terms with their counts, at once: what waits in an open window is as short as its postings.
        coded = pc.dictionary_encode(word)
        code, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(coded.dictionary), 1)
        pair, tf = np.unique(place * n + code, return_counts=True)
        self.ids.append(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.known.append(pc.is_valid(ids).to_numpy(zero_copy_only=False))
        self.lengths.append(count.astype(np.int64))
        self.rows.append((pair // n, tf))
        self.terms.append(coded.dictionary.take(pa.array(pair % n)))
        self.size += sum(pc.fill_null(pc.binary_length(texts), 0).to_pylist())

    def __len__(self) -> int:
        return sum(map(len, self.ids))

    def closed(self) -> pa.RecordBatch:
        ids, known, lengths = np.concatenate(self.ids), np.concatenate(self.known), np.concatenate(self.lengths)
        coded = pc.dictionary_encode(pa.concat_arrays(self.terms))
        code = coded.indices.to_numpy(zero_copy_only=False)
        place, tf = (np.concatenate([r[i] for r in self.rows]) for i in (0, 1))
        order = np.lexsort((place, code))
        data, off = buffers(coded.dictionary)
        row = [
            int((lengths > 0).sum()), int(lengths.sum()), ids.tobytes(), known.tobytes(), lengths.tobytes(), data.tobytes(), off[1:].astype(np.int64).tobytes(),
            np.cumsum(np.bincount(code, minlength=len(coded.dictionary))).astype(np.int64).tobytes(), place[order].astype(np.uint16).tobytes(), tf[order].astype(np.uint32).tobytes(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], _POSTINGS.replace(" bigint", "").replace(" binary", "").split(", "))


def postings(docs: DataFrame, asked: list[str] | None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per window of documents, in the order in which tasks read them; asked: the only terms to keep, or None for all."""
    only = None if asked is None else pa.array(sorted(asked), pa.large_string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = _Open()
        for b in batches:
            ids, text = b.column(0), b.column(1)
            for lo, hi in slices(text):
                while lo < hi:
                    to = min(hi, lo + window - len(open_))
                    open_.add(ids.slice(lo, to - lo), text.slice(lo, to - lo), only)
                    lo = to
                    if len(open_) >= window or open_.size >= WINDOW_BYTES:
                        yield open_.closed()
                        open_ = _Open()
        if len(open_):
            yield open_.closed()

    return stash(map_arrow(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")), run, _POSTINGS), "ranked-postings")


def document_counts(index: DataFrame) -> DataFrame:
    """(term, df): how many documents hold each term that the index keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, ends, posts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                word, n = _strings(data, ends), np.diff(np.frombuffer(posts, np.int64), prepend=0)
                for a in range(0, len(word), 50_000):
                    yield pa.RecordBatch.from_arrays([word.slice(a, 50_000).cast(pa.string()), pa.array(n[a : a + 50_000])], ["term", "df"])

    return map_arrow(index.select("term_bytes", "term_ends", "post_ends"), run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def _nearest(block: pa.Table, n_docs: int, n_terms: int, k: int):
    """The best k documents of each item of a block in each task. block: (item int, term, w bigint), w as often as the item has the term."""
    uniq = pc.unique(block.column("term").combine_chunks().cast(pa.large_string()))
    items, code, weight = block.column("item").to_numpy(), pc.index_in(block.column("term").cast(pa.large_string()), value_set=uniq).to_numpy(), block.column("w").to_numpy()
    order = np.lexsort((code, items))
    items, code, weight = items[order], code[order], weight[order]
    names, first = np.unique(items, return_index=True)
    last = np.append(first[1:], len(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple]] = [[] for _ in names]
        for b in batches:
            for ids, known, lengths, data, ends, posts, places, tfs in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                ids, known, lengths = np.frombuffer(ids, np.int64), np.frombuffer(known, bool), np.frombuffer(lengths, np.int64)
                here = pc.index_in(uniq, value_set=_strings(data, ends)).to_numpy(zero_copy_only=False) if len(ends) else np.full(len(uniq), np.nan)
                here = np.where(np.isnan(here), -1, here).astype(np.int64)
                end, place, tf = np.frombuffer(posts, np.int64), np.frombuffer(places, np.uint16), np.frombuffer(tfs, np.uint32).astype(np.int64)
                begin = np.append(0, end[:-1])
                m = 75 + (25 * lengths * n_docs) // n_terms
                part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[place])
                sums, met = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                for j, heap in enumerate(heaps):
                    own = here[code[first[j] : last[j]]]
                    found = np.flatnonzero(own >= 0)
                    if not len(found):
                        continue
                    for t, w in zip(own[found].tolist(), weight[first[j] : last[j]][found].tolist(), strict=True):
                        at = place[begin[t] : end[t]]  # a document is there once
                        sums[at] += w * part[begin[t] : end[t]]
                        met[at] = True
                    least = heap[0][0] if len(heap) == k else 1
                    best = np.flatnonzero(met & (sums >= max(least, 1)))
                    if len(best) > k:
                        # Equal scores by id, null ids last: what is beyond the k-th of a window is beyond the k-th of all.
                        best = best[np.lexsort((ids[best], ~known[best], -sums[best]))[:k]]
                    for x in best.tolist():
                        entry = (int(sums[x]), bool(known[x]), -int(ids[x]))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                    sums[met] = 0
                    met[:] = False
        rows = [(int(names[j]), -e[2] if e[1] else None, e[0]) for j, heap in enumerate(heaps) for e in heap]
        for a in range(0, len(rows), 50_000):
            item, doc, score = zip(*rows[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, vocabulary: int = VOCABULARY, item_terms: int = ITEM_TERMS) -> DataFrame:
    """(item_id, item, rank, doc_id, score): the k documents of the highest scores above 0 of each item; item: its number, one for each id and text."""
    if not 1 <= window <= 1 << 16:
        raise ValueError("a window holds 1 to 65,536 documents")
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    named = stash(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "ranked-items")
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    asked = stash(named.select("item", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("qf")), "ranked-terms")
    few = asked.select("term").distinct().limit(vocabulary + 1).toArrow().column("term").to_pylist()
    index = postings(docs, few if len(few) <= vocabulary else None, id_col, text_col, window)
    n_docs, n_terms = index.agg(F.sum("docs"), F.sum("terms_total")).first()
    if k < 1 or not few or not n_terms:
        ranked = empty
    else:
        w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
        weighed = stash(asked.join(document_counts(index), "term").withColumn("w", w * F.col("qf")).where("w > 0").select("item", "term", "w"), "ranked-weights")
        blocks = max(1, -(-weighed.count() // item_terms))
        found = []
        for b in range(blocks):
            block = weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow()
            if block.num_rows:
                near = map_arrow(index.select("ids", "known", "lengths", "term_bytes", "term_ends", "post_ends", "places", "tfs"), _nearest(block, n_docs, n_terms, k), "item bigint, doc_id bigint, score bigint")
                found.append(stash(near, "ranked-block"))
        ranked = reduce(DataFrame.union, found) if found else empty
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "item", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


ORACLE = rf"""with d as materialized (select row_number() over () rid, doc_id, text from documents), toks as (select rid, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) term from d),
post as (select rid, term, count(*) tf from toks group by all), dl as (select rid, count(*) n from toks group by 1), st as (select count(*) big_n, sum(n)::bigint big_l from dl),
df as (select term, count(*) df from post group by 1), q as (select item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) term from benchmark),
qw as (select item_id, term, count(*) * floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * any_value(df) + 1)))::bigint w from q join df using (term), st group by all),
sc as (select item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::bigint score from qw join post using (term) join dl using (rid), st group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from sc join d using (rid) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20"""
