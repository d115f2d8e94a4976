"""Streams give what batches give; running a micro-batch again changes nothing."""

import time

from pyspark.sql import functions as F

from corvane.operators import evaluation
from corvane.operators.store import ChunkStore
from corvane.plans import prompts
from corvane.streaming import events as S


def test_stream_totals_equal_the_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.tail(spark, str(tmp_path / "in"), e.schema)
    got = S.drain(S.totals(stream, "event_type", "value"), f"t{time.time_ns()}", "complete", str(tmp_path / "c"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, S.totals(e, "event_type", "value").collect()))
    w = S.drain(S.windowed(S.tail(spark, str(tmp_path / "in"), e.schema), "ts", "event_type", "value", "1 day"), f"w{time.time_ns()}", "append", str(tmp_path / "d"))
    assert 0 < w.agg(F.sum("n")).first()[0] <= e.count()


def test_ingest_is_idempotent(spark, tmp_path):
    s = ChunkStore(spark, "s", root=f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("a", "3", 3)], "id string, text string, seq long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in (1, 2):  # a new checkpoint reads all again
        S.ingest(S.tail(spark, str(tmp_path / "in"), rows.schema), s, "seq", str(tmp_path / f"c{k}")).awaitTermination()
        assert {r["id"]: r["text"] for r in s.read().collect()} == {"a": "3", "b": "2"}


def test_references_and_report(spark, tmp_path):
    tasks = spark.createDataFrame([("good", "def f(): return 1", "from solution import f\ndef test_f(): assert f() == 1"), ("bad", "x = (", "def test_x(): pass\nimport solution")], "id string, reference string, tests string")
    got = {r["id"]: (r["passed"], r["category"]) for r in evaluation.verify_references(tasks).collect()}
    assert got == {"good": (True, "pass"), "bad": (False, "syntax_error")}
    evaluation.write_report("# x\n", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == "# x\n"


def test_prompts(spark):
    docs = F.array(*[F.struct(F.lit(str(i)).alias("id"), F.lit("d" * 10).alias("text")) for i in range(4)])
    r = spark.range(1).select(prompts.context(docs, 25).alias("c"), prompts.revise(F.lit("t"), F.lit("c"), F.lit(""), F.lit("s"), F.lit(None).cast("string"), F.array(*map(F.lit, "abcde")), docs, 0)["human"].alias("h")).first()
    assert r["c"] == "[0] dddddddddd\n\n[1] dddddddddd"
    assert r["h"] == "Task:\nt\n\nCode:\nc\n\nWhat failed:\ns\n\nEarlier failures:\nc\nd\ne\n\nGive the whole corrected module and tests."
