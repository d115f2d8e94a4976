"""Toxicity and language: held-out quality, defined cases; the pipeline."""

import random

import numpy as np
import pyarrow as pa
from llm_helpers import words

from corvane.llm import language, packing, toxicity


def test_machine_learns_a_pair_that_single_weights_miss():
    """Toxic only where an insult meets a group: either alone is clean."""
    rng = random.Random(1)
    rows, texts, y = [], [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(words(rng, 20, 500) + ["insulting"] * a + ["groupname"] * b))
        y.append(int(a and b))
    for t, label in zip(texts, y, strict=True):
        row, key, n = toxicity.terms(pa.array([t]))
        k, c = np.unique(key, return_counts=True)
        rows.append((k, c, int(n[0]), label))
    m = toxicity.fit(rows[:1000], 0.25)
    s = m.score(pa.array(texts[1000:]))
    truth = np.array(y[1000:])
    assert ((s >= 0.7) == truth).mean() > 0.95


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    got = toxicity.query(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    import zlib

    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all() and got.score.between(0, 1).all()
    m = got.merge(labels, on="doc_id")
    m = m[m.held_out]
    pos, neg = m[m.toxic == 1].score.values, m[m.toxic == 0].score.values
    assert (pos[:, None] > neg[None, :]).mean() > 0.8
    machine = toxicity.train(odd_docs, odd_docs.selectExpr("doc_id", "0 as toxic").limit(0))
    assert {r["score"] for r in toxicity.score(odd_docs, machine).collect()} == {0.5} and toxicity.score(no_docs, machine).count() == 0
    kept = toxicity.drop_toxic(odd_docs, machine)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()


def test_training_does_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(7), labels)
    assert np.array_equal(a.keys, b.keys) and np.allclose(a.w, b.w)


def test_language_on_held_out_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    got = language.query(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    machines = language.train(odd_docs)
    out = {r["id"]: r for r in language.predict(odd_docs, machines).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[4]["lang_pred"] == out[11]["lang_pred"] == "und" and out[2]["score"] == 0
    assert out[5]["lang_pred"] in ("en", "de") and language.predict(no_docs, machines).count() == 0
    assert {r["lang_pred"] for r in language.predict(odd_docs, language.train(no_docs)).collect()} == {"und"}
    assert language.family("en-GB") == "germanic" and language.family("xx") == "other"


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "doc_id as id", "'x' as node")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] and sizes[3] == sizes[4]
    assert docs.where("n_chars <> length(text)").count() == 0
    out = P.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    assert P.run(spark, sf).count() == out.count()


def test_pipeline_of_odd_and_no_rows(spark, odd_docs, no_docs):
    import corpus_pipeline as P

    for docs, n in ((odd_docs, 9), (no_docs, 0)):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.select("doc_id").where("piece = 0").count() == n
    assert packing.vocabulary().endswith(".json")
