"""Windows of postings: as few bytes as their numbers need, at any size of a number, and as they were written once."""

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corvane.operators import lexical
from corvane.operators.lexical import LexicalIndex
from test_lexical import found, ranked

# One document repeats a word beyond two bytes, one beyond one byte; some are empty, and fill windows of their own.
DOCS = [(0, "often " * 70_000 + "a b", None), (1, "often " * 300, None), *((i, "", None) for i in range(2, 12)), *((i, f"a w{i} w{i // 3}", None) for i in range(12, 60))]
ASKED = [(1, "often a"), (2, "w4 w20 b"), (3, "unheard a")]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(ASKED, "qid long, text string")


def made(spark, window):
    return LexicalIndex.build(spark.createDataFrame(DOCS, "id long, text string, lang string").coalesce(1), window=window)


def want(k):
    every = {q: [(i, round(s, 8)) for i, s in ranked(DOCS, t, k)] for q, t in ASKED}
    return {q: v for q, v in every.items() if v}


@pytest.mark.parametrize("window", [1, 2, 7, 4096])
def test_numbers_of_any_size(spark, queries, window):
    index = made(spark, window)
    assert found(index, queries, 5) == want(5)
    assert {r["tok"]: r["df"] for r in index.terms.where("tok in ('often', 'a', 'w4', 'w20')").collect()} == {"often": 2, "a": 49, "w4": 3, "w20": 1}


def test_windows_take_the_bytes_that_their_numbers_need(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = {c: F.sum(F.octet_length(c)) for c in lexical._BLOBS}
    n = LexicalIndex.build(docs, "doc_id").windows.agg(*[v.alias(c) for c, v in sizes.items()]).first()
    entries, postings = n["entry_block"] / 2, n["places"] / 2
    assert n["posting_ends"] == entries and n["tfs"] <= 2 * postings and n["entry_tf"] <= 2 * entries and n["entry_dl"] <= 2 * entries
    assert sum(n[c] for c in lexical._BLOBS if c != "terms") < 14 * postings


def test_words_are_not_compared_again_when_a_window_is_packed():
    text = pa.array(["a b a"] * 500 + ["c"])
    batch = next(lexical._bagged(iter([pa.RecordBatch.from_arrays([pa.array(range(501)), text], ["id", "text"])])))
    words, code = lexical._coded([batch.column("tok").slice(0, 2), batch.column("tok").slice(2, 3)])
    assert words.to_pylist() == ["a", "b"] and code.tolist() == [0, 1] * 5
    assert pa.types.is_dictionary(batch.column("tok").type.value_type)


def test_windows_that_were_written_wider_are_read(spark, queries):
    index = made(spark, 7)

    def widened(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                n, m, posts = len(r["entry_block"]) // 2, len(r["ids"]) // 8, len(r["places"]) // 2
                r["term_ends"] = lexical._ends(r["term_ends"], len(r["terms"])).tobytes()
                r["entry_ends"] = lexical._ends(r["entry_ends"], n).tobytes()
                r["posting_ends"] = lexical._posting_ends(r["posting_ends"], n).tobytes()
                for c, size in (("lengths", m), ("entry_tf", n), ("entry_dl", n), ("tfs", posts)):
                    r[c] = lexical._wide(r[c], size).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_pylist(rows, b.schema)

    wide = LexicalIndex(index.windows.mapInArrow(widened, index.windows.schema), index.terms, index.n, index.avgdl)
    assert found(wide, queries, 5) == want(5)


def test_readers_hold_few_windows_at_once(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").coalesce(1)
    monkeypatch.setitem(lexical.LARGE_ROWS, "parquet.block.size", str(64 << 10))
    lexical.write_segment(docs, "doc_id", "text", (), str(tmp_path), 40)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/windows/*.parquet")]
    assert sum(m.num_rows for m in files) >= 25 and max(m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)) < max(m.num_rows for m in files)
