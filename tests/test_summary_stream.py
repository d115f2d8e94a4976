"""Summaries and sessions as streams: restarts, repeated and late lines."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corvane.operators import events as L
from corvane.streaming import events as S
from corvane.streaming import summary as Y

LINE = "run_id string, seq long, node string, outcome string, duration_ms double, ts timestamp, llm_client struct<calls: bigint, api_retries: bigint, wait_s: double>"


def lines(rng, n):
    start = datetime(2024, 5, 1)
    return [(rng.choice(["r1", "r1", "r1", "r2", None]), i, rng.choice(["retrieve", "generate", "", None]), rng.choice(["ok", "error", None]), rng.choice([None, round(rng.random() * 100, 3)]), start + timedelta(seconds=i), rng.choice([None, (1, 0, 0.5)])) for i in range(n)]


def test_a_restart_in_the_middle_gives_the_batch_summary(spark, tmp_path):
    rng = random.Random(8)
    rows = lines(rng, 1500)
    rng.shuffle(rows)  # late: any order of arrival
    sent = [rows[:400], rows[300:900], rows[850:] + rows[:100]]  # repeated: lines come again, with and after a restart
    own = Y.session(spark)
    for part in sent:
        spark.createDataFrame(part, LINE).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        slices = Y.drained(Y.partials(S.tail(own, str(tmp_path / "in"), LINE)), str(tmp_path / "out"), str(tmp_path / "check"))  # a new query each time
    got = {r["run"]: r for r in Y.merged(slices).collect()}
    whole = spark.createDataFrame(rows, LINE)
    want = L.summarize(whole, "run_id", "seq").collect()
    totals = {r["run_id"]: r for r in whole.groupBy("run_id").agg(F.coalesce(F.sum("llm_client.calls"), F.lit(0)).alias("calls"), F.round(F.coalesce(F.sum("llm_client.wait_s"), F.lit(0.0)), 3).alias("wait_s")).collect()}
    assert set(got) == {"r1", "r2", None} and len(want) == 3
    for w in want:
        g = got[w["run_id"]]
        assert all(g[c] == w[c] for c in ("n_events", "started_ts", "finished_ts", "duration_ms_total", "rag"))
        if w["run_id"] is not None:  # the batch's join by run leaves the counts of a null run out
            assert g["node_counts"] == w["node_counts"] and g["outcomes"] == w["outcomes"]
        assert (g["llm_client_totals"]["calls"], g["llm_client_totals"]["wait_s"]) == (totals[w["run_id"]]["calls"], totals[w["run_id"]]["wait_s"])
    assert slices.where("run = 'r1'").select("slice").distinct().count() > 1  # a large run is shared between tasks
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != Y.PROVIDER  # the caller's settings stay


def test_sessions_in_a_stream(spark, tmp_path):
    at = lambda h, m=0: datetime(2024, 5, 1) + timedelta(hours=h, minutes=m)
    row = "user long, ts timestamp, value long"
    sent = [[(1, at(0), 1), (1, at(0, 20), 2), (2, at(0), 5)], [(1, at(3), 4)], [(1, at(0, 30), 100), (1, at(2, 50), 8)], [(9, at(30), 0)], [(9, at(60), 0)]]
    name = f"s{time.time_ns()}"
    for i, part in enumerate(sent):
        spark.createDataFrame(part, row).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = L.sessions(S.tail(spark, str(tmp_path / "in"), row), "ts", "user", "value", "30 minutes", "1 hour")
        out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).start().awaitTermination()
    got = sorted((r["user"], r["start"], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # The row of 0:30 came when the watermark was at 2:00: left out. That of 2:50 came late too, but before the watermark's time, and opens the session of 3:00.
    assert got[:3] == [(1, at(0), 2, 3), (1, at(2, 50), 2, 12), (2, at(0), 1, 5)], name
    batch = sorted((r["user"], r["start"], r["n"], r["total"]) for r in L.sessions(spark.read.schema(row).parquet(str(tmp_path / "in")), "ts", "user", "value", "30 minutes").collect())
    assert batch[:2] == [(1, at(0), 3, 103), (1, at(2, 50), 2, 12)]  # a batch has no late rows


def test_many_small_runs_take_no_python(spark, tmp_path):
    start = datetime(2024, 5, 1)
    rows = [(f"r{i % 3000}", i * 600, ("retrieve", "generate", "")[i % 3], None, 1.0, start + timedelta(seconds=i), None) for i in range(12_000)]  # each number in a block of its own
    spark.createDataFrame(rows + rows[:50], LINE).repartition(3).write.parquet(str(tmp_path / "in"))
    own = Y.session(spark)
    plan = Y.partials(own.read.schema(LINE).parquet(str(tmp_path / "in")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan  # a run's lines went to a worker of its own, with several calls a block
    slices = Y.drained(Y.partials(S.tail(own, str(tmp_path / "in"), LINE)), str(tmp_path / "out"), str(tmp_path / "check"))
    columns = ["n_events", "started_ts", "finished_ts", "duration_ms_total", "rag", "node_counts"]
    got = {r["run"]: r for r in Y.merged(slices).select("run", *columns).collect()}
    want = L.summarize(spark.createDataFrame(rows, LINE), "run_id", "seq").collect()
    assert len(got) == len(want) == 3000 and all(got[w["run_id"]][c] == w[c] for w in want for c in columns)
