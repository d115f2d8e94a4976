"""Runs from end to end: records, reports, summaries, second tries; what texts of failed runs say."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from corvane.config import Options
from corvane.engine import Engine
from corvane.operators import analysis as A
from corvane.operators import effects as X
from corvane.operators import evaluation as E
from corvane.operators import events as L
from corvane.plans import loop
from corvane.sources import introspect
from corvane.sources.records import read_records, write_records


def scripted(passes_at, **more):
    def sandbox(df):
        good = F.col("attempt") >= passes_at
        full = [F.when(good, "pass").otherwise("runtime_error").alias(f.name) if f.name == "category" else (good if f.name == "passed" else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema["run"].dataType]
        return df.withColumn("run", F.struct(*full))

    return loop.Effects(more.pop("model", lambda df: df.withColumns({"code": F.lit("c" * 40), "tests": F.lit("t" * 8)})), sandbox, **more)


TASKS = "task_id string, task string, provided_tests string"


def test_report_of_what_was_evaluated(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "do it", ""), ("b", "do it", "")], TASKS)
    e = Engine(spark, "rep", root=f"file://{tmp_path}")
    none = spark.createDataFrame([], E.RECORD)
    got = e.evaluate(tasks, {"rag": scripted(1), "norag": scripted(2)}, none, model="m1")
    assert got.schema == none.schema and got.columns == [x.split()[0] for x in E.RECORD.split(", ")]
    r = {(x["task_id"], x["mode"]): x for x in got.collect()}
    assert r["a", "norag"]["total_tokens"] == 2 * (2 + 12) and r["a", "rag"]["output_tokens"] == 12 and r["b", "rag"]["model"] == "m1" and r["b", "rag"]["wall_s"] >= 0
    assert len({x["run_id"] for x in r.values()}) == 4 and all(x["finished_ts"].endswith("Z") for x in r.values())
    text = e.report(tasks, got, ("rag", "norag"), "m1")
    assert "| rag | 2 | 2 | 100.0% | 2 | 1.00 | 1.00 | 14 |" in text and "| b | PASS a=1 c=1 | PASS a=2 c=2 |" in text and "Pairs: 2; both 2" in text
    e.write_report(tasks, got, ("rag", "norag"), str(tmp_path / "report.md"), "m1")
    assert (tmp_path / "report.md").read_text() == text
    write_records(got, str(tmp_path / "rec"))
    assert read_records(spark, str(tmp_path / "rec")).count() == 4 and e.evaluate(tasks, {"rag": scripted(1), "norag": scripted(2)}, read_records(spark, str(tmp_path / "rec"))).count() == 0
    assert E.error_tasks(got).count() == 0 and E.report_header(tasks, got).first()["n_error_tasks"] == 0


def test_an_unreadable_reply_is_asked_for_once_more(spark):
    def model(df):
        bad = (F.col("task_id") == "never") | ((F.col("task_id") == "second") & (F.col("llm_calls") == 1))
        return df.withColumns({"code": F.lit("c"), "tests": F.lit("t"), "parse_error": F.when(bad, "no code found"), "usage": F.struct(F.lit(3).cast("bigint").alias("input_tokens"), F.lit(0.5).alias("wait_s"))})

    tasks = spark.createDataFrame([(t, "do", "") for t in ("first", "second", "never")], TASKS)
    fx = scripted(1, model=model)
    got = {r["task_id"]: r for r in loop.run(loop.start(spark, tasks, fx, True), fx).collect()}
    assert [(got[t]["status"], got[t]["llm_calls"], got[t]["attempt"], got[t]["input_tokens"], got[t]["wait_s"]) for t in ("first", "second", "never")] == [("approved", 1, 1, 3, 0.5), ("approved", 2, 1, 6, 1.0), ("failed", 2, 1, 6, 1.0)]
    assert got["never"]["failure_reason"] == loop.UNREADABLE + "no code found" and got["never"]["nodes"] == ["generate", "fail"]


def test_reviews_that_wait_and_nodes_of_ones_own(spark):
    tasks = spark.createDataFrame([("a", "do", ""), ("b", "do", "")], TASKS)
    fx = scripted(1, nodes={"generate": lambda df: df.withColumns({"code": F.lit("own"), "tests": F.lit("t"), "attempt": F.lit(1)})})
    states = loop.run(loop.start(spark, tasks, fx, False), fx)
    shown = {r["task_id"]: r for r in loop.pending_reviews(states).collect()}
    assert set(shown) == {"a", "b"} and shown["a"]["code"] == "own" and shown["a"]["category"] == "pass"
    steps = list(loop.stream(loop.start(spark, tasks, scripted(2), True), scripted(2)))
    assert all(s.count() == 2 for s in steps) and {r["status"] for r in steps[-1].collect()} == {"approved"}


def test_summaries_of_runs(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "do", ""), ("b", "do", "")], TASKS)
    states = loop.run(loop.start(spark, tasks, scripted(9), True), scripted(9)).withColumn("failure_reason", F.lit("key sk-" + "a" * 30))
    ev = [{"run_id": f"r{t}", "task_id": t, "node": n, "ts": f"{i}", "duration_ms": 1.5, "outcome": "ok", "llm_client": {"calls": 1, "api_retries": i, "wait_s": 0.25}} for t in ("a", "b") for i, n in enumerate(("retrieve", "generate"))]
    got = L.summaries(spark.createDataFrame(ev, L.event_schema()), states)
    L.write_summaries(got, str(tmp_path / "s"))
    L.write_summaries(got.where("run_id = 'ra'"), str(tmp_path / "s"))
    back = [json.loads(line) for f in (tmp_path / "s").glob("run=*/part*.json") for line in f.read_text().splitlines()]
    assert len(back) == 2
    s = next(x for x in back if x["run_id"] == "ra")
    assert (s["status"], s["failure_reason"], s["n_events"], s["rag"], s["final_category"], s["duration_ms_total"]) == ("failed", "key ***", 2, True, "runtime_error", 3.0)
    assert s["llm_client_totals"] == {"calls": 2, "api_retries": 1, "wait_s": 0.5} and s["token_usage"]["llm_calls"] == 4 and s["node_counts"] == {"retrieve": 1, "generate": 1}


def test_what_texts_say(spark):
    def of(value, make, kind="string"):
        r = spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("r")).first()["r"]
        return (r["type"], r["message"])

    for text, want in (
        ("Traceback (most recent call last):\n  File \"x.py\", line 1\n    f()\nKeyError: 'a: b'", ("KeyError", "'a: b'")), ("a.b.Odd", ("a.b.Odd", "")), ("before: x\nTraceback (most recent call last):\n  File \"x\"", ("before", "x")),
        ("(1 + 2)", ("(1 + 2)", "")), ("", ("Exception", "")), (None, ("Exception", "")), ("E: 1\n  File \"y\"", ("E", "1")),
    ):
        assert of(text, A.last_exception_line) == want, text
    run = "struct<failures:array<struct<message:string,traceback:string>>,stdout:string,stderr:string>"
    for value, want in (
        (([("m", "solution.py:3: KeyError: k")], "ValueError: out", ""), ("KeyError", "k")), (([("TypeError: m", "")], "ValueError: out", ""), ("TypeError", "m")), (([("", ""), ("IndexError: i", "")], "", ""), ("IndexError", "i")),
        (([], "ValueError: out", "OSError: err"), ("ValueError", "out")), ((None, " ", "OSError: err"), ("OSError", "err")), ((None, None, None), ("Exception", "")), (None, ("Exception", "")),
    ):
        assert of(value, A.extract_exception, run) == want, value


def test_plans_and_causes_name_what_is_known(spark):
    run = "struct<passed:boolean,category:string,failures:array<struct<message:string,traceback:string>>,stdout:string,stderr:string>"
    rows = [((False, c, [("", t)] if t else [], "", ""), p) for c, t, p in (
        ("runtime_error", "AttributeError: module 'math' has no attribute 'sqroot'", ""), ("no_tests", "", ""), ("sandbox_error", "", "x"), ("runtime_error", "ZeroDivisionError: division by zero", ""), ("odd", "", ""),
    )]
    got = A.analyze(spark.createDataFrame(rows, f"run {run}, provided_tests string")).collect()
    assert [(r["root_cause"], r["fix_plan"]) for r in got] == [
        ("AttributeError: module 'math' has no attribute 'sqroot' - see math.sqroot", "code: call math.sqroot the way its documentation says"), ("pytest found nothing to run", "tests: write tests that pytest collects"),
        ("the sandbox itself gave up", "code: run within the sandbox's limits"), ("ZeroDivisionError: division by zero", "code: keep what failed from raising"), ("no output to explain unknown", "code: look into what failed"),
    ]


def test_waits_that_servers_ask_for():
    now = datetime(2024, 5, 1, 12, 0, tzinfo=UTC).timestamp()
    assert X.asked_wait({"retry-after": "Wed, 01 May 2024 12:01:30 GMT"}, now) == 90
    assert X.asked_wait({"Retry-After": "5", "X-RateLimit-Reset": str(int((now + 40) * 1000))}, now) == pytest.approx(40)
    assert X.asked_wait({"Retry-After": "50", "X-RateLimit-Reset": str(int(now + 40))}, now) == 50
    assert X.asked_wait({"retry-after": "Wed, 01 May 2024 11:00:00 GMT"}, now) == 0 and X.asked_wait({"retry-after": "soon"}, now) is None and X.asked_wait({}, now) is None


def test_introspection_of_odd_libraries(spark):
    import types

    got = {r["qualname"]: r for r in introspect.rows("numpy")}
    assert "numpy.add" in got and "numpy.ndarray.sum" in got and got["numpy.add"]["kind"] == "function" and "numpy.pi" not in got
    assert {r["library"] for r in introspect.introspection_chunks(spark, ["json", "no_such_lib_z"]).collect()} == {"json"}
    assert not any("__" in r["qualname"].rsplit(".", 1)[-1][:2] for r in introspect.rows("json", include_private=True))
    m = types.ModuleType("odd_lib_z")

    class Bad:
        def fine(self):
            """Says something."""

        def __init_subclass__(cls):
            raise ValueError

    class Trap:
        @property
        def __wrapped__(self):
            raise RuntimeError

        __func__ = __wrapped__

        def __call__(self):
            """Called."""

    Bad.trap = Trap()
    m.Bad, m.const, m.Caller = Bad, 3, Trap
    import sys

    sys.modules["odd_lib_z"] = m
    assert {"odd_lib_z.Bad", "odd_lib_z.Bad.fine"} <= {r["qualname"] for r in introspect.rows("odd_lib_z")}


def test_own_embedders_indexes_and_empty_stores(spark, tmp_path):
    def embedder(df, id_col, text_col, dim):
        return df.select(F.col(id_col).alias("id"), F.array(F.length(F.coalesce(text_col, F.lit(""))).cast("double"), F.lit(1.0)).alias("vec"))

    def no_index(chunks):
        raise ImportError("none here")

    q = spark.createDataFrame([(0, 0, "json.loads")], "qset long, qid long, text string")
    e = Engine(spark, "own", Options(min_score=0.0), root=f"file://{tmp_path}", embedder=embedder, index_factory=no_index)
    assert e.search(q).count() == 0
    e.ingest(["json"])
    found = e.search(q, 3).collect()
    assert len(found) == 3 and {r["route"] for r in found} == {"dense"}
    again = Engine(spark, "own", Options(min_score=0.0, hybrid=False), root=f"file://{tmp_path}", embedder=embedder)
    assert again.store.count() == e.store.count() and {r["route"] for r in again.search(q, 3).collect()} == {"dense"} and again._index is None
    with pytest.raises(ValueError, match="dimensions"):  # the store holds the vectors of the embedder that it was filled with
        Engine(spark, "own", Options(min_score=0.0), root=f"file://{tmp_path}").search(q, 3)


def test_checkpoints_are_restored(spark, tmp_path):
    tasks, folder = spark.createDataFrame([("a", "do", ""), ("b", "do", "")], TASKS), f"file://{tmp_path}/states"
    assert loop.restore(spark, folder).count() == 0
    loop.run(loop.start(spark, tasks, scripted(1), False), scripted(1), folder=folder)
    (tmp_path / "states" / "000000000099").mkdir()  # a checkpoint whose writer failed
    waiting = loop.restore(spark, folder)
    assert {r["node"] for r in waiting.collect()} == {"human_review"} and loop.restore(spark, folder, "a").count() == 1
    say = spark.createDataFrame([("a", "approve", None, None, None), ("b", "reject_final", None, None, None)], "task_id string, decision string, feedback string, code string, tests string")
    ended = loop.resume(waiting, say, scripted(1))
    loop.checkpoint(ended, folder)
    assert {r["task_id"]: r["status"] for r in loop.restore(spark, folder).collect()} == {"a": "approved", "b": "failed"}


def test_options_from_a_file(tmp_path):
    (tmp_path / ".env").write_text("# a comment\nexport CORVANE_TOP_K=7\nCORVANE_API_KEY='k # 1' # why\nCORVANE_MIN_SCORE=\nno line\nCORVANE_RRF_K=9 # more\n")
    o = Options.load({"CORVANE_RRF_K": "11"}, env_file=str(tmp_path / ".env"))
    assert (o.top_k, o.api_key, o.min_score, o.rrf_k) == (7, "k # 1", 0.2, 11)
    assert Options.load({}, env_file=str(tmp_path / "none")).top_k == 5


def test_sums_of_a_csv(spark, tmp_path):
    from corvane.operators.relational import sum_csv

    (tmp_path / "a.csv").write_text('category,amount,note\n"food, drink",1.25,"a\nb"\n\n"food, drink",2,"say ""x"""\nrent, 10.5,\nrent,none,\n\n')
    assert {r["category"]: r["total"] for r in sum_csv(spark, str(tmp_path / "a.csv"), "category", "amount").collect()} == {"food, drink": 3.25, "rent": 10.5}


def test_probe_metrics():
    assert E.probe_metrics([1, None, 4]) == {"hit@1": 0.3333, "hit@5": 0.6667, "hit@10": 0.6667, "mrr": 0.4167, "mean_rank": 2.5} and E.probe_metrics([None])["mean_rank"] == 0.0 == E.probe_metrics([])["mrr"]
