"""Whitening against a dense eigen-decomposition and exact integer arithmetic."""

import math

import numpy as np
import pytest

from corvane.llm import whitening

ROW = "vec_id long, embedding array<float>, label int, id long, n int"


def plain(vectors):
    """n, sums, covariance of the distinct integer vectors, in Python's own integers and doubles."""
    distinct = sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors})
    n, s = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    z = np.array(distinct, np.float64) - np.array(s, np.float64) / n
    return n, s, z.T @ z / n


def answers(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], ROW).repartition(3)
    model = whitening.fit(df, **how)
    return model, [r.asDict() for r in whitening.whiten(df, model).collect()]


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(3)
    basis = rng.normal(size=(24, 24)) * np.geomspace(4, 1e-2, 24)
    vectors = (rng.normal(size=(700, 24)) @ basis).astype(np.float32).tolist()
    return [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0])] * 400 + [(None, vectors[1]), (-3, vectors[2])]


def test_against_a_dense_decomposition(spark, made):
    n, s, v = plain([x for _, x in made])
    model, got = answers(spark, made)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    assert len(got) == 16 * len(made) and model.n == n == 700 and {r["n"] for r in got} == {n}
    assert np.allclose(model.values, values, rtol=1e-9) and model.error < 1e-9
    by_id = {(r["id"], r["component"]): r for r in got}
    for key, vec in made[:50] + made[-2:]:
        x = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vec]
        white = (np.array(x) - np.array(s) / n) @ vectors / np.sqrt(values)
        for j in range(16):
            r = by_id[key, j + 1]
            assert r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
            assert abs(abs(r["whitened"]) - abs(white[j])) < 1e-6 and abs(r["explained"] / (values[j] / np.trace(v)) - 1) < 1e-9


def test_signs_are_the_same_for_all_rows(spark, made):
    _, got = answers(spark, made)
    value = {(r["id"], r["component"]): r["whitened"] for r in got}
    w = np.array([[value[i, j] for j in range(1, 17)] for i in range(700)])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(16)).max() < 1e-6


def test_what_is_left_out_and_what_does_not_vary(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (2, [0.5, 2.0, -3.0]), (2, [0.5, 2.0, -3.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 0.0, 0.0]), (6, [0.0, -inf, 0.0]), (7, []), (8, [1.0]), (None, [-1.0, 2.0, 0.25])]
    model, got = answers(spark, rows)
    assert (model.n, model.dim) == (3, 3) and len(got) == 4 * 3 and {r["id"] for r in got} == {1, 2, None}
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got) and model.error < 1e-12  # the second dimension is constant
    one, same = answers(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert one.n == 1 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same) and len(same) == 4


def test_widths_empty_tables_and_overflow(spark):
    big = [(i, [float(i), 300.0 * i, 1e6 * i, 2.0**40 * i]) for i in range(1, 6)]
    model = whitening.fit(spark.createDataFrame([(*r, 1, 2, 3) for r in big], ROW))
    _, s, _ = plain([v for _, v in big])
    assert (model.sums + 5 * 1_000_000).tolist() == s
    y = np.array([[2**40, -(2**31)], [5, 7]])
    with pytest.raises(OverflowError):
        whitening._deviations(y, 2, y.sum(axis=0))
    small = np.array([[2**31, -(2**30)], [5, 7]])
    assert whitening._deviations(small, 1, np.zeros(2, np.int64)).tolist() == [2**62 + 2**60, 74]
    assert whitening.fit(spark.createDataFrame([], ROW)) is None and whitening.fit(spark.createDataFrame([(1, [], 1, 2, 3), (2, None, 1, 2, 3)], ROW)) is None


def test_the_query_on_a_table_without_vectors(spark, tmp_path):
    spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.query(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33])
def test_rotations_give_small_eigenvalues_to_full_precision(n):
    """A graded matrix: its eigenvalues fall over 30 orders of magnitude, and each is found to relative rounding, which a dense solver does not reach."""
    from fractions import Fraction

    rng = np.random.default_rng(n)
    scale = 10.0 ** -np.linspace(0, 15, n)
    core = np.eye(n) + 0.1 * (lambda m: (m + m.T) / 2)(rng.uniform(-1, 1, (n, n)) / n)
    values, vectors = whitening.jacobi(core * np.outer(scale, scale))
    assert (np.diff(values) <= 0).all() and np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    det = math.prod(map(float, values))
    m = [[Fraction(float(x)) for x in row] for row in core * np.outer(scale, scale)]
    exact = Fraction(1)
    for i in range(n):  # Gauss, exactly
        exact *= m[i][i]
        for j in range(i + 1, n):
            f = m[j][i] / m[i][i]
            m[j] = [a - f * b for a, b in zip(m[j], m[i], strict=True)]
    if det > 1e-290:
        assert abs(det / float(exact) - 1) < 1e-11
