"""Ranked search against every document's score, summed plainly."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from llm_helpers import words

from corvane.llm import queries, ranked

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def split(text):
    return re.findall(ranked.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """Rows (item_id, rank, doc_id, score) by the definition, one document at a time."""
    bags = [(i, Counter(split(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total, df = len(bags), sum(x[2] for x in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        asked = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in split(text) if df[t]]
        scored = [(sum(w * (10**9 * b[t] // (1000 * b[t] + 12 * (75 + 25 * size * n // total))) for t, w in asked), i) for i, b, size in bags]
        best = sorted(((s, i) for s, i in scored if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, **how):
    d, q = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)
    return sorted(map(tuple, ranked.search(d, q, k, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    docs = [(rng.randrange(-(10**6), 10**12), " ".join(words(rng, rng.randrange(0, 60), 90))) for _ in range(300)]
    docs += [(None, "w1 w2 W3"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), (-7, "w1 w2 w3"), (8, None), (9, ""), (10, " ".join(words(rng, 30_000, 90)))]
    items = [(i, " ".join(words(rng, rng.randrange(1, 12), 110))) for i in range(25)] + [(30, "W1 w1 w2;w3"), (31, None), (32, "none of these"), (33, ""), (None, "w4 w5")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"window": 16}, {"vocabulary": 3}, {"item_terms": 20}, {"k": 1}, {"k": 400, "window": 7}], ids=str)
def test_equals_every_documents_score(spark, made, how):
    docs, items = made
    assert found(spark, docs, items, **how) == brute(docs, items, how.get("k", 20))


def test_only_ascii_capitals_are_lowered_and_terms_end_at_any_other_sign(spark):
    docs = [(1, "Ärger ÄRGER straße_STRASSE a.b"), (2, "ärger 日本語\U0001f600x"), (3, "ZÉRO zÉro"), (4, "nul\x00mid nul\x7f")]
    items = [(1, "ärger"), (2, "Ärger"), (3, "straße"), (4, "B"), (5, "日本語\U0001f600X"), (6, "ZÉRO"), (7, "mid"), (8, "zéro")]
    assert found(spark, docs, items) == brute(docs, items, 20)


def test_one_text_for_a_third_of_all_rows_and_one_word_in_every_document(spark):
    rng = random.Random(6)
    docs = [(i, "every same text here") for i in range(400)] + [(1000 + i, "every " + " ".join(words(rng, 20, 200))) for i in range(800)]
    items = [(1, "same text"), (2, "every"), (3, "w1 w2 w3 every")]
    assert found(spark, docs, items, window=64) == brute(docs, items, 20)


def test_repeated_items_extra_columns_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(5, "same text"), (5, "same text"), (5, "few words")], ITEMS)
    got = ranked.search(odd_docs, items).orderBy("item", "rank").collect()
    assert len({r["item"] for r in got}) == 2 and [r["doc_id"] for r in got if r["rank"] <= 3] == [5, 5, 6] * 2
    assert ranked.search(no_docs, items).count() == 0 and ranked.search(odd_docs, items.limit(0)).count() == 0 and ranked.search(odd_docs, items, k=0).count() == 0
    clash = odd_docs.withColumnsRenamed({"lang": "item", "node": "term"}).withColumnsRenamed({"id": "score"})
    assert ranked.search(clash, items).count() == len(got)


def test_the_sql_twin_agrees(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    columns = "item_id, rank, doc_id, score"
    want = sorted(c.execute(f"select {columns} from ({queries.ORACLE_SQL['op12_ranked_search']})").fetchall())
    assert sorted(map(tuple, queries.QUERIES["op12_ranked_search"](spark, sf_dir).select(*columns.split(", ")).collect())) == want and len(want) > 100


def test_postings_do_not_move(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = ranked.postings(docs, None, window=32)
    assert index.count() >= docs.count() // 32 and index.agg({"docs": "sum"}).first()[0] == docs.where("length(text) > 0").count()
    with pytest.raises(ValueError, match="window"):
        ranked.search(docs, docs.limit(0), window=1 << 17, item_col="doc_id")
