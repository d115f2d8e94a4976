"""Dense search over cells against numpy."""

import numpy as np
import pytest

from corvane.operators import dense
from corvane.operators.dense import DenseIndex


def plain(m, ids, u, k, live=None):
    unit = lambda x: x / np.where(np.linalg.norm(x, axis=-1, keepdims=True) > 0, np.linalg.norm(x, axis=-1, keepdims=True), 1)
    s = np.round(unit(m) @ unit(u), 12)
    order = [i for i in np.lexsort((ids, -np.round(s, 9))) if live is None or live[i]][:k]
    return [(int(ids[i]), round(float(s[i]), 8)) for i in order]


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 10)) * 4
    m = np.concatenate([centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 10)) * 0.2, np.tile(centres[0], (300, 1)), np.zeros((3, 10))])
    label = rng.integers(0, 3, len(m))
    rows = [(i, v.tolist(), int(x)) for i, (v, x) in enumerate(zip(m, label, strict=True))]
    df = spark.createDataFrame([*rows, (5000, None, 1)], "id long, vec array<double>, label int").repartition(5)
    asked = [0, 17, 350, 699, 700, 1001]
    return m, label, df, asked, spark.createDataFrame([(i, m[i].tolist()) for i in asked] + [(9, None)], "qid long, vec array<double>")


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["id"], round(r["score"], 8)))
    return out


@pytest.mark.parametrize("bytes_", [0, 1 << 20])
def test_the_same_as_every_vector(spark, made, monkeypatch, bytes_):
    m, label, df, asked, queries = made
    monkeypatch.setattr(dense, "BROADCAST_BYTES", bytes_)  # queries that are routed by a stage of their own, and here
    monkeypatch.setattr(dense, "PIECE", 60)
    index = DenseIndex.build(df, keep=("label",))
    ids = np.arange(len(m))
    for k in (1, 7, 400):
        assert found(index.search(queries, k)) == {q: plain(m, ids, m[q], k) for q in asked}
        assert found(index.search(queries, k, where={"label": 2})) == {q: plain(m, ids, m[q], k, label == 2) for q in asked}
    assert found(index.search(queries, 5, min_score=0.9)) == {q: v for q in asked if (v := [x for x in plain(m, ids, m[q], 5) if x[1] >= 0.9])}
    assert found(dense.search(df, queries, 7)) == {q: plain(m, ids, m[q], 7) for q in asked}


def test_cells_are_skipped_where_vectors_cluster(spark, made):
    _, _, df, _, queries = made
    pairs, looked = DenseIndex.build(df).work(queries.where("qid <> 1001 and vec is not null"), 5)
    assert looked < pairs / 2


def test_saved_joined_and_empty(spark, made, tmp_path):
    m, _, df, asked, queries = made
    paths = [f"file://{tmp_path}/{i}" for i in range(2)]
    for i, p in enumerate(paths):
        DenseIndex.build(df.where(f"id % 2 = {i}"), path=p)
    assert found(DenseIndex.load(spark, paths).search(queries, 6)) == {q: plain(m, np.arange(len(m)), m[q], 6) for q in asked}
    none = DenseIndex.build(spark.createDataFrame([], "id long, vec array<double>"))
    assert none.search(queries, 3).count() == 0 and dense.search(df, queries.limit(0), 3).count() == 0 and dense.search(df, queries, 0).count() == 0
