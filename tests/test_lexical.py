"""Lexical search against the formula, with and without what it leaves out."""

import math
import random
import re
from collections import Counter

import pytest

from corvane.operators import lexical
from corvane.operators.lexical import LexicalIndex


def ranked(docs, query, k, lang=None):
    """(id, score) of the k best by the formula, one document at a time; docs: (id, text, lang)."""
    bags = [(i, Counter(re.findall("[a-z0-9_]+", (t or "").lower())), g) for i, t, g in docs]
    n, avg = len(bags), sum(sum(b.values()) for _, b, _ in bags) / len(bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = Counter(t for t in re.findall("[a-z0-9_]+", (query or "").lower()) if t in df)
    out = []
    for i, b, g in bags:
        if (lang is None or g == lang) and any(t in b for t in asked):
            size = sum(b.values())
            out.append((i, sum(c * math.log((n + 1) / df[t]) * (1 + b[t] * 2.5 / (1.5 * (0.25 + 0.75 * size / avg) + b[t])) for t, c in asked.items())))
    return sorted(out, key=lambda x: (-round(x[1], 9), x[0]))[:k]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(11)
    docs = []
    for i in range(600):
        lang = rng.choice(["a", "b", None])
        docs.append((i, " ".join(f"{lang or 'c'}{min(int(rng.paretovariate(0.6)), 300)}" for _ in range(rng.randrange(0, 80))), lang))
    docs += [(1000 + i, "same text for many rows a1 a2", "a") for i in range(300)] + [(2000, None, "a"), (2001, "", None)]
    asked = [(i, " ".join(f"{rng.choice('abc')}{min(int(rng.paretovariate(0.6)), 300)}" for _ in range(rng.randrange(1, 25)))) for i in range(20)] + [(50, "same text"), (51, None), (52, "a1 a1 a2"), (53, "unheard")]
    return docs, asked, spark.createDataFrame(docs, "id long, text string, lang string").repartition(3), spark.createDataFrame(asked, "qid long, text string")


def found(index, queries, k, where=None):
    out = {}
    for r in sorted(index.search(queries, k, where).collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["id"], round(r["score"], 8)))
    return out


@pytest.mark.parametrize("window", [40, 4096])
def test_equal_at_every_k(spark, made, window):
    docs, asked, df, queries = made
    index = LexicalIndex.build(df, keep=("lang",), window=window)
    for k in (1, 3, 16, 301, 1000):
        for where in (None, {"lang": "a"}):
            want = {q: [(i, round(s, 8)) for i, s in ranked(docs, t, k, where and "a")] for q, t in asked}
            assert found(index, queries, k, where) == {q: v for q, v in want.items() if v}
    assert index.search(queries, 0).count() == 0 and index.search(queries, 5, {"lang": "none"}).count() == 0


def test_most_postings_are_left_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    asked = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/benchmark.parquet").selectExpr("item_id as qid", "text")
    met, scored = LexicalIndex.build(docs, "doc_id", keep=("lang",)).work(asked, 1)
    assert 0 < scored < met / 2


def test_queries_in_blocks(spark, made, monkeypatch):
    _, _, df, queries = made
    index = LexicalIndex.build(df)
    want = found(index, queries, 9)
    monkeypatch.setattr(lexical, "QUERY_ROWS", 25)
    assert found(index, queries, 9) == want and len(want) > 15


def test_postings_are_not_shuffled(spark, made):
    _, _, df, queries = made
    index = LexicalIndex.build(df)
    plan = index.search(queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan and plan.count("MapInArrow") == 1


def test_windows_of_huge_and_empty_documents(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WINDOW_POSTINGS", 50)
    docs = [(i, " ".join(f"w{j}" for j in range(i % 130)), None) for i in range(140)]
    index = LexicalIndex.build(spark.createDataFrame(docs, "id long, text string, lang string").coalesce(1))
    assert index.windows.agg({"docs": "sum"}).first()[0] == 140 and index.windows.count() > 30
    assert found(index, spark.createDataFrame([(1, "w0 w100 w77")], "qid long, text string"), 10)[1] == [(i, round(s, 8)) for i, s in ranked(docs, "w0 w100 w77", 10)]
    none = LexicalIndex.build(spark.createDataFrame([], "id long, text string"))
    assert none.search(spark.createDataFrame([(1, "w")], "qid long, text string"), 3).count() == 0
