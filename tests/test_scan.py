"""Running sums and runs by key, also where one key holds all rows."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import scan


def plain_running(rows, skipped):
    out, last = {}, {}
    for k, s, v, kind in sorted(rows, key=lambda r: r[1]):
        total, before = last.get(k, (0, None))
        total += 0 if v is None or kind in skipped else v
        out[s] = (total, None if v is None or before is None else v - before)
        last[k] = (total, v)
    return out


def plain_runs(rows):
    runs = {}
    for k, _, _, kind in sorted(rows, key=lambda r: r[1]):
        mine = runs.setdefault(k, [])
        if mine and mine[-1][0] == kind:
            mine[-1][1] += 1
        else:
            mine.append([kind, 1])
    return sorted(((k, i + 1, kind, n) for k, mine in runs.items() for i, (kind, n) in enumerate(mine)), key=repr)


def made(keys, n, seed):
    rng, kind = random.Random(seed), "a"
    rows = []
    for s in rng.sample(range(10**6), n):
        kind = kind if rng.random() < 0.7 else rng.choice(["a", "b", None])
        rows.append((rng.choice(keys), s, rng.choice([None, *range(20)]), kind))
    return rows


@pytest.mark.parametrize(("keys", "n"), [([1], 3000), ([1, 2, 3, None], 2000), (list(range(500)), 1500), ([1] * 30 + list(range(40)), 2000), ([5], 1)])
def test_scans(spark, keys, n):
    rows = made(keys, n, len(keys))
    df = spark.createDataFrame(rows, "k int, s long, v long, kind string").repartition(3)
    got = {r["s"]: (r["cum_v"], r["delta_v"]) for r in scan.running(df, "k", "s", "v", skip=F.col("kind") == "b", ranges=7).collect()}
    assert got == plain_running(rows, {"b"})
    assert sorted(map(tuple, scan.run_lengths(df, "k", "s", "kind", ranges=7).select("k", "run", "kind", "n").collect()), key=repr) == plain_runs(rows)


def test_no_task_holds_a_key(spark):
    df = spark.range(20_000).selectExpr("1 as k", "id as s", "id % 3 as v", "'same' as kind")
    rows = scan.ranged(df, "k", "s", ranges=8)
    sizes = [r["count"] for r in rows.groupBy("_p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 20_000 / 4
    assert scan.run_lengths(df, "k", "s", "kind", ranges=8).collect()[0].asDict() == {"k": 1, "run": 1, "kind": "same", "n": 20_000}
    last = scan.running(df, "k", "s", "v", ranges=8).where("s = 19999").first()
    assert last["cum_v"] == sum(i % 3 for i in range(20_000)) and last["delta_v"] == 1


def test_no_rows_and_columns_of_their_own(spark):
    df = spark.createDataFrame([], "k int, s long, v long, kind string")
    assert scan.running(df, "k", "s", "v").count() == 0 and scan.run_lengths(df, "k", "s", "kind").count() == 0
    assert scan.running(df, "k", "s", "v").columns == ["k", "s", "v", "kind", "cum_v", "delta_v"]
