"""Bags cut in Arrow's bytes against the built-ins and the patterns, a text at a time."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import bags as B
from corvane.functions import text as X
from corvane.functions.vectors import embed_dense, hash_embed
from corvane.operators.lexical import LexicalIndex
from corvane.operators.store import ChunkStore


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    fixed = ["", None, ".", "..", "a", ".a", "a.", "a.b", "a..b", ".a.b.c.", "İstanbul K.x ß_1", "x.y z", "a" * 300, "日本.a_b.é.c", "_._", "A.B.C a.b.c b"]
    return fixed + ["".join(rng.choice("ab.._9 \n-éXİ") for _ in range(rng.randrange(0, 40))) for _ in range(500)] + ["b", ".c", "d."]


@pytest.mark.parametrize("lot", [1, 100, 8 << 20])
def test_the_tokens_of_the_patterns(texts, lot, monkeypatch):
    monkeypatch.setattr(B, "LOT", lot)
    lower = pa.array([None if t is None else t.lower() for t in texts]).slice(3)
    for dotted, pattern in ((True, X.TOKEN), (False, X.HASH_TOKEN)):
        got = []
        for at, n in B.lots(lower):
            words, code, place, many = B.bags(lower.slice(at, n), dotted)
            rows = [Counter() for _ in range(n)]
            for w, p, m in zip(words.take(pa.array(code)).to_pylist(), place.tolist(), many.tolist(), strict=True):
                assert w not in rows[p]
                rows[p][w] = m
            got += rows
        found = [re.findall(pattern, t or "") for t in lower.to_pylist()]
        assert got == [Counter(w for x in f for w in ([x, *x.split(".")] if dotted and "." in x else [x])) for f in found]


def test_index_and_vectors_are_those_of_the_built_ins(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    index = LexicalIndex.build(df)
    toks = df.select("id", F.explode(X.tokenize("text")).alias("tok"))
    assert {r["tok"]: r["df"] for r in index.terms.collect()} == {r["tok"]: r["df"] for r in toks.groupBy("tok").agg(F.count_distinct("id").alias("df")).collect()}
    assert index.n == len(texts) and index.avgdl == toks.count() / len(texts)
    want = np.zeros((len(texts), 64))
    for r in hash_embed(df, "id", "text").collect():
        want[r["id"], r["cell"]] = r["weight"]
    got = np.array([r["vec"] for r in embed_dense(df, "id", "text").orderBy("id").collect()])
    assert (got == want).all()


def test_neither_index_nor_vectors_sort_words_in_rows_or_shuffle_texts(spark, texts, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    plan = embed_dense(df, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "sort_array" not in plan and "regexp_extract_all" not in plan
    monkeypatch.setattr(X.F, "regexp_extract_all", lambda *_: pytest.fail("a pattern a row"))
    LexicalIndex.build(df)


def test_replaced_rows_are_counted_off_without_a_pattern_a_row(spark, tmp_path, monkeypatch):
    s = ChunkStore(spark, "bury", root=str(tmp_path), embed=lambda rows: embed_dense(rows, "n", "text"), words=F.col("text"))
    row = "id string, text string, library string, seq long"
    s.upsert(spark.createDataFrame([(f"i{i}", f"a.b w{i} w{i}", "l", i) for i in range(40)], row), "seq")
    with monkeypatch.context() as m:
        m.setattr(X.F, "regexp_extract_all", lambda *_: pytest.fail("a pattern a row"))
        s.upsert(spark.createDataFrame([(f"i{i}", "new", "l", i) for i in range(5)], row), "seq")
    dead = {tuple(sorted(r["toks"])): (r["dl"], r["w"], r["seg"] == r["piece"]["seg"]) for r in s._dead().collect()}
    assert dead == {("a", "a.b", "b", f"w{i}"): (5, 0, True) for i in range(5)}
    assert {r["tok"]: r["df"] for r in s.lexical().terms.where("tok in ('a.b', 'new', 'w3', 'w9')").collect()} == {"a.b": 35, "new": 5, "w9": 1}
