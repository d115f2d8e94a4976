"""The collection and its index outlive their session's objects."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import fusion, store
from corvane.operators.lexical import LexicalIndex
from corvane.sources.durable import newest, write_new
from corvane.streaming.events import ingest, tail

ROW = "id string, text string, library string, seq long"


def test_a_store_is_reopened(spark, tmp_path):
    root = f"file://{tmp_path}"
    first = store.ChunkStore(spark, "s", root=root)
    first.upsert(spark.createDataFrame([(f"k{i}", "old", "x", i) for i in range(40)], ROW), "seq")
    again = store.ChunkStore(spark, "s", root=root)
    assert again.count() == 40
    before = list(again.about["segments"])
    assert again.upsert(spark.createDataFrame([("k1", "new", "y", 1)], ROW), "seq") == 1 and again.count() == 40 and again.count(library="y") == 1
    assert again.about["segments"][:1] == before and again.about["segments"][1]["rows"] == again.about["n_dead"] == 1  # what was there is not written again
    assert first.read().where("text = 'new'").count() == 0  # a reader of the version before is not disturbed
    first.refresh()
    assert first.read().where("text = 'new'").count() == 1
    assert again.upsert(spark.createDataFrame([], ROW), "seq") == 0
    again.vacuum()
    assert store.ChunkStore(spark, "s", root=root).count() == 40 and len(list(newest(spark, f"{root}/store-s/manifest"))) == 1


def test_a_write_that_fails_or_comes_second_changes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    s = store.ChunkStore(spark, "s", root=root)
    s.upsert(spark.createDataFrame([("a", "t", "x", 1)], ROW), "seq")
    write_new(spark, f"{root}/store-s/manifest/000000000002.json", "{cut o")
    other = store.ChunkStore(spark, "s", root=root)
    assert other.count() == 1 and other.upsert(spark.createDataFrame([("b", "t", "x", 1)], ROW), "seq") == 1 and store.ChunkStore(spark, "s", root=root).count() == 2
    with pytest.raises(Exception, match="already exists"):
        write_new(spark, f"{root}/store-s/manifest/000000000003.json", json.dumps({}))


def test_a_stream_that_restarts_loses_nothing(spark, tmp_path):
    root, src, check = f"file://{tmp_path}", str(tmp_path / "in"), str(tmp_path / "check")
    for part in range(3):
        spark.createDataFrame([(f"k{i}", f"v{part}", "x", part * 100 + i) for i in range(part * 5, part * 5 + 10)], ROW).coalesce(1).write.mode("append").parquet(src)
        q = ingest(tail(spark, src, ROW), store.ChunkStore(spark, "st", root=root), "seq", check)  # a new object each time, as after a restart
        q.awaitTermination()
    got = {r["id"]: r["text"] for r in store.ChunkStore(spark, "st", root=root).read().collect()}
    assert got == {f"k{i}": f"v{min(i // 5, 2)}" for i in range(20)}


def test_an_index_is_saved_and_loaded(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"file://{tmp_path}/index"
    built = LexicalIndex.build(docs, "doc_id", keep=("lang",), path=path)
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("item_id as qid", "text")
    want = sorted(map(tuple, built.search(asked, 5).collect()))
    loaded = LexicalIndex.load(spark, path)
    assert sorted(map(tuple, loaded.search(asked, 5).collect())) == want and len(want) > 10 and (loaded.n, loaded.avgdl) == (built.n, built.avgdl)
    with pytest.raises(FileNotFoundError):
        LexicalIndex.load(spark, f"file://{tmp_path}/none")


def test_context_without_texts_and_nulls(spark):
    rows = [("k", i, "x" * 8) for i in range(10)] + [("k", 10, None), ("m", 1, "y" * 100)]
    df = spark.createDataFrame(rows, "key string, pos int, text string")
    got = fusion.context_prefix(df, 35).orderBy("pos").collect()
    assert [(r["key"], r["pos"], r["total"]) for r in got] == [("k", 0, 10), ("k", 1, 20), ("k", 2, 30)]
    assert fusion.context_prefix(df.select("key", "pos", F.lit(None).cast("string").alias("text")), 5).count() == 3
