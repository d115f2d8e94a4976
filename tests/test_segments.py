"""A store that is searched as it stands: segments, dead rows and merges against an index built anew."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.config import Options
from corvane.engine import Engine
from corvane.functions.vectors import embed_dense
from corvane.operators import store
from corvane.operators.dense import DenseIndex
from corvane.operators.lexical import LexicalIndex

ROW = "id string, text string, library string, seq long"


class Counting:
    """Hashed vectors, and how many texts each call was given."""

    def __init__(self):
        self.seen = []

    def __call__(self, df, id_col, text_col, dim=64):
        self.seen.append(df.count())
        return embed_dense(df, id_col, text_col, dim)


def rows(rng, ids, part):
    return [(f"k{i}", " ".join(f"{rng.choice('xyz')}{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(1, 40))) + f" part{part}", rng.choice(["a", "b", None]), n) for n, i in enumerate(ids)]


def same(spark, s, asked):
    """What the store finds, against indexes built anew over its rows."""
    now = s.numbered().select("n", "id", "text", "library")
    keys = {r["n"]: r["id"] for r in now.collect()}
    fresh = LexicalIndex.build(now, "n", "text", keep=("library",))
    lexical = s.lexical()
    assert (lexical.n, round(lexical.avgdl, 9)) == (fresh.n, round(fresh.avgdl, 9)) and {tuple(r) for r in lexical.terms.collect()} == {tuple(r) for r in fresh.terms.collect()}
    vectors = embed_dense(now, "n", "text").join(now.select(F.col("n").alias("id"), "library"), "id")
    queries = asked.join(embed_dense(asked, "qid", "text").withColumnRenamed("id", "qid"), "qid")
    for where in (None, {"library": "a"}):
        pairs = [(lexical.search(asked, 9, where), fresh.search(asked, 9, where)), (s.dense().search(queries, 9, where=where), DenseIndex.build(vectors, keep=("library",)).search(queries, 9, where=where))]
        for got, want in pairs:
            plain = lambda df: sorted((r["qid"], r["rank"], round(r["score"], 7), keys[r["id"]]) for r in df.collect())
            found = plain(got)
            assert found == plain(want) and len(found) > 20


def test_writes_touch_what_they_write(spark, tmp_path, monkeypatch):
    rng, count = random.Random(4), Counting()
    make = lambda: store.ChunkStore(spark, "v", root=f"file://{tmp_path}", embed=lambda r: count(r.select("n", F.col("text").alias("e")), "n", "e"), words=F.col("text"))
    s = make()
    asked = spark.createDataFrame([(i, f"x{i} y1 z{i * 2} y{i}") for i in range(6)], "qid long, text string")
    assert s.upsert(spark.createDataFrame(rows(rng, range(300), 0), ROW).repartition(3), "seq") == 300
    for part in range(1, 4):
        assert s.upsert(spark.createDataFrame(rows(rng, rng.sample(range(320), 6), part), ROW), "seq") == 6
    assert count.seen == [300, 6, 6, 6] and len(s.about["segments"]) == 4 and s.about["n_dead"] > 8
    same(spark, make(), asked)
    monkeypatch.setattr(store, "SEGMENTS", 4)
    assert s.upsert(spark.createDataFrame(rows(rng, [1, 2, 400], 9), ROW), "seq") == 3
    assert len(s.about["segments"]) == 2 and count.seen[4:] == [3] and s.about["segments"][0]["rows"] == 300  # the small ones are one now, and not embedded again
    same(spark, make(), asked)
    s.upsert(spark.createDataFrame(rows(rng, range(0, 300, 2), 10), ROW), "seq")  # more than a third of the largest is dead
    assert len(s.about["segments"]) == 1 and s.about["n_dead"] == 0 and s.about["dead"] == []
    before = s.count()
    s.vacuum()
    assert make().count() == before == s.lexical().n
    same(spark, make(), asked)


def test_a_new_engine_searches_without_building(spark, tmp_path):
    count = Counting()
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(12):
        (docs / f"f{i}.md").write_text(f"# Part {i}\nabout subject{i} and tea")
    e = Engine(spark, "n", Options(min_score=2.0), root=f"file://{tmp_path}/root", embedder=count)
    e.ingest(docs={"notes": str(docs)})
    (docs / "f3.md").write_text("# Part 3\nabout coffee")
    assert count.seen == [12]
    again = Engine(spark, "n", Options(min_score=2.0), root=f"file://{tmp_path}/root", embedder=count)
    q = spark.createDataFrame([(0, 0, "subject3.tea"), (1, 1, "subject5.tea")], "qset long, qid long, text string")
    first = again.search(q, 2).where("rank = 1").orderBy("qset").collect()
    assert [r["text"][:8] for r in first] == ["# Part 3", "# Part 5"] and count.seen == [12, 2]
    again.ingest(docs={"notes": str(docs)})
    e.refresh()
    assert "coffee" in {w for r in e.search(spark.createDataFrame([(0, 0, "coffee.bean")], "qset long, qid long, text string"), 1).collect() for w in r["text"].split()}


@pytest.mark.parametrize("embed", [None, lambda r: r.select(F.col("n").alias("id"), F.lit(None).cast("array<double>").alias("vec"))])
def test_without_vectors_or_words(spark, tmp_path, embed):
    s = store.ChunkStore(spark, "w", root=f"file://{tmp_path}", embed=embed)
    s.upsert(spark.createDataFrame([("a", "t", "x", 1)], ROW), "seq")
    s.upsert(spark.createDataFrame([("a", "u", "x", 1)], ROW), "seq")
    assert s.count() == 1 and s.lexical() is None and (s.dense() is None) == (embed is None)
    if embed:
        assert s.dense().search(spark.createDataFrame([(1, [1.0])], "qid long, vec array<double>"), 3).count() == 0
