"""The engine's operators against hand-made cases and plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.config import Options
from corvane.engine import Engine
from corvane.functions import text as X
from corvane.functions.chunking import sections, split_markdown
from corvane.operators import analysis as A
from corvane.operators import dense, effects, evaluation, fusion, store
from corvane.operators.events import read_log, running, summarize, write_log
from corvane.operators.lexical import LexicalIndex
from corvane.plans import loop
from corvane.sources.introspect import rows
from corvane.sources.records import invalid_tasks, load_tasks, parse_junit, read_records, write_records


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(make(F.col("t")).alias("r")).first()["r"]


def test_tokens(spark):
    def plain(t):
        out = []
        for m in re.findall(r"[a-z0-9_]+(?:\.[a-z0-9_]+)*", t.lower()):
            out += [m, *m.split(".")] if "." in m else [m]
        return out

    for t in ("json.loads(a_b) x..y Z9", "", "a.b.c a.b", "ÄÖ é.f"):
        assert one(spark, t, X.tokenize) == plain(t)
    assert one(spark, None, X.tokenize) == []


@pytest.mark.parametrize(("q", "want"), [("json.loads", True), ("collections.OrderedDict.move_to_end", True), ("move_to_end", True), ("Counter", True), ("  Counter ", True), ("replace all matches of a pattern", False), ("parse a JSON string", False), ("", False)])
def test_symbol_gate(spark, q, want):
    assert one(spark, q, X.is_symbol_query) is want


def test_truncation_and_ids(spark):
    assert one(spark, "One. Two three four", lambda c: X.truncate(c, 12)) == "One.…"
    assert one(spark, "abcdefgh ijkl", lambda c: X.truncate(c, 11)) == "abcdefgh…"
    assert one(spark, "short", lambda c: X.truncate(c, 0)) == "short"
    long = "é" * 3000 + "x" * 3000
    cut = one(spark, long, lambda c: X.truncate_output(c, 2000))
    assert len(cut.encode()) <= 2000 and cut.startswith("é" * 490) and cut.endswith("x" * 980) and "�" not in cut
    assert one(spark, "a", lambda c: X.stable_id(c, F.lit("b"))) != one(spark, "ab", lambda c: X.stable_id(c, F.lit("")))


def test_redaction_comes_before_the_cut(spark):
    key = "sk-" + "a" * 30
    got = one(spark, "x" * 10 + key, lambda c: X.redact(c, ("longsecret",), 20))
    assert got == "x" * 10 + "***" and "a" * 5 not in got
    assert one(spark, "my longsecret tiny", lambda c: X.redact(c, ("longsecret", "tiny"))) == "my *** tiny"


def test_bundles(spark):
    b = one(spark, "<think>x</think><explanation>why</explanation><code>```python\na = 1\n```</code><tests>t()</tests><docs_used>p, q\nr</docs_used>", X.parse_bundle)
    assert (b.explanation, b.code, b.tests, b.docs_used, b.error) == ("why", "a = 1", "t()", ["p", "q", "r"], None)
    b = one(spark, "<code>a = 1 <tests> t()", X.parse_bundle)
    assert (b.code, b.tests) == ("a = 1", "t()")
    assert one(spark, "nothing", X.parse_bundle).error == "no code found" and one(spark, " ", X.parse_bundle).error == "empty model response"
    assert one(spark, "a</think>b</think> c", X.strip_reasoning) == "c" and one(spark, "a <think> b", X.strip_reasoning) == "a"


def test_markdown_pieces():
    text = "intro\n# A\nbody a\n```\n# no heading\n```\n## B\n" + " ".join(f"w{i}" for i in range(200))
    assert [h for h, _ in sections(text)] == ["", "# A", "## B"]
    parts = split_markdown(text, 120, 40)
    assert all(len(p) <= 120 for p in parts) and sum(p.startswith("## B\n\n") for p in parts) > 5
    tokens = set(re.findall(r"w\d+", " ".join(parts)))
    assert len(tokens) == 200
    plain = split_markdown(text, 120, 0)
    assert sum(len(p) for p in plain) < sum(len(p) for p in parts)
    assert split_markdown("") == split_markdown(" \n ") == [] and split_markdown("# only") == ["# only"]
    assert split_markdown("x" * 500, 100, 10) == ["x" * 500]


def bm25(docs, query, k1=1.5, b=0.75, delta=1.0):
    toks = [re.findall(r"[a-z0-9_]+", d.lower()) for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for d in toks for t in set(d))
    q = [t for t in re.findall(r"[a-z0-9_]+", query.lower()) if t in df]
    return [sum(math.log((n + 1) / df[t]) * (delta + d.count(t) * (k1 + 1) / (k1 * (1 - b + b * len(d) / avg) + d.count(t))) for t in q) for d in toks]


def test_bm25_against_the_formula(spark):
    docs = ["the cat sat", "the dog sat on the dog", "birds fly", "", "cat cat cat dog"]
    idx = LexicalIndex.build(spark.createDataFrame(list(enumerate(docs)), "id long, text string"))
    got = {r["id"]: r["score"] for r in idx.search(spark.createDataFrame([(1, "cat dog dog zebra")], "qid long, text string"), 10).collect()}
    want = bm25(docs, "cat dog dog zebra")
    assert set(got) == {0, 1, 4} and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert idx.search(spark.createDataFrame([(1, "zebra"), (2, None)], "qid long, text string"), 3).count() == 0


def test_dense_search_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "id long, vec array<double>").repartition(5)
    got = dense.search(df, df.where("id % 50 = 0").selectExpr("id as qid", "vec"), 7).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        want = np.argsort(-(u @ u[q]), kind="stable")[:7].tolist()
        assert [r["id"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == want


def test_fusion_and_gate(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.5]), (3, [0.0, 1.0])], "id long, vec array<double>")
    idx = LexicalIndex.build(spark.createDataFrame([(1, "plain words"), (2, "json.loads here"), (3, "json.loads json.loads")], "id long, text string"))
    q = spark.createDataFrame([(0, 1, "json.loads", [1.0, 0.0]), (1, 2, "plain prose", [1.0, 0.0])], "qset long, qid long, text string, vec array<double>")
    got = fusion.hybrid(vec, idx, q, k=3, min_score=0.2).orderBy("qset", "rank").collect()
    by = {s: [(r["id"], r["route"]) for r in got if r["qset"] == s] for s in (0, 1)}
    assert by[0][0] == (2, "hybrid") and {i for i, _ in by[0]} == {1, 2, 3} and by[1] == [(1, "dense"), (2, "dense")]
    assert all(0 < r["score"] <= 2 / 61 for r in got)


def test_prior_documents_fill_up(spark):
    new = spark.createDataFrame([("k", "p1", 0.99, 1), ("k", "n1", 0.95, 2), ("k", "n3", 0.85, 3)], "key string, id string, score double, pos int")
    prior = spark.createDataFrame([("k", "p1", 0.7, 1), ("k", "p2", 0.6, 2), ("k", "p3", 0.5, 3)], "key string, id string, score double, pos int")
    assert [r["id"] for r in fusion.merge_prior(new, prior, 4).orderBy("pos").collect()] == ["p1", "n1", "n3", "p2"]


def test_store_upserts_and_filters(spark, tmp_path):
    s = store.ChunkStore(spark, "t", root=f"file://{tmp_path}")
    assert s.count() == 0
    batch = spark.createDataFrame([("a", "old", "x", 1), ("b", "b", "y", 2), ("a", "new", None, 3)], "id string, text string, library string, seq long")
    assert s.upsert(batch, "seq") == 2 and s.upsert(batch, "seq") == 2 and s.count() == 2
    assert {r["id"]: r["text"] for r in s.read().collect()} == {"a": "new", "b": "b"} and s.count(library="y") == 1
    assert {r["library"]: r["n"] for r in s.libraries().collect()} == {"": 1, "y": 1}
    s.reset()
    assert s.count() == 0


def test_engine_ingests_and_searches(spark, tmp_path):
    folder = tmp_path / "docs" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("﻿# Tea\r\nBoil water, then steep the leaves.", encoding="utf-8")
    (tmp_path / "docs" / "B.TXT").write_bytes(b"Bread needs flour \xff and yeast")
    (tmp_path / "docs" / "c.py").write_text("no")
    e = Engine(spark, f"e{tmp_path.name}", Options(min_score=0.0))
    got = e.ingest(["json"], {"notes": str(tmp_path / "docs")})
    assert got["counts"]["notes"] == 2 and got["counts"]["json"] > 5 and got["written"] == sum(got["counts"].values())
    assert e.ingest(["json"], {"notes": str(tmp_path / "docs")})["written"] == got["written"] and e.store.count() == got["written"]
    assert {r["source_path"] for r in e.store.read(library="notes").collect()} == {"sub/a.md", "B.TXT"}
    q = spark.createDataFrame([(0, 0, "json.loads"), (1, 1, "steep leaves in boiling water")], "qset long, qid long, text string")
    found = e.search(q, 3).orderBy("qset", "rank").collect()
    assert found[0]["qualname"] == "json.loads" and found[0]["route"] == "hybrid"
    assert next(r for r in found if r["qset"] == 1)["library"] == "notes"
    assert {r["library"] for r in e.search(q, 3, library="json").collect()} == {"json"}
    assert len({r["id"] for r in rows("json")}) == len(list(rows("json")))


@pytest.mark.parametrize(("out", "code", "want"), [("SyntaxError: x", 1, "syntax_error"), ("E   ImportError: y", 2, "import_error"), ("ModuleNotFoundError", 1, "import_error"), ("DID NOT RAISE", 1, "assertion_failure"), ("timed out", 1, "timeout"), ("collected 0 items", 1, "no_tests"), ("some Exception", 1, "runtime_error"), ("odd", 1, "sandbox_error"), ("E   KeyError: z", 2, "runtime_error")])
def test_categories(spark, out, code, want):
    assert one(spark, out, lambda c: A.classify(F.lit(""), c, F.lit(""), F.lit(0), F.lit(code))) == want


def test_analysis_of_a_failed_run(spark):
    run = "struct<passed:boolean,category:string,failures:array<struct<message:string,traceback:string>>,stdout:string,stderr:string>"
    trace = "solution.py:3: in f\n    math.sqroot(2)\nE   AttributeError: module 'math' has no attribute 'sqroot'\nsolution.py:3: AttributeError"
    df = spark.createDataFrame([((False, "runtime_error", [("", trace)], "", ""), ""), ((True, "pass", [], "", ""), ""), (None, ""), ((False, "timeout", [], "", ""), "given")], f"run {run}, provided_tests string")
    a, b, c, d = A.analyze(df).collect()
    assert (a["category"], a["fault"], a["suspect_symbols"], a["exception_type"], a["needs_docs"]) == ("api_misuse", "code", ["math.sqroot"], "AttributeError", True)
    assert a["retrieval_queries"][0] == "math sqroot" and "math.sqroot" in a["fix_plan"]
    assert (b["category"], b["fix_plan"]) == ("pass", "nothing to do") and c["category"] == "unknown"
    assert (d["category"], d["fault"]) == ("timeout", "code") and "time limit" in d["root_cause"]
    exc = one(spark, "Traceback\n  File x\nValueError: bad: worse", A.exception_of)
    assert (exc["type"], exc["message"]) == ("ValueError", "bad: worse")


def test_junit(spark):
    r = one(spark, '<testsuites><testsuite><testcase name="a"/><testcase name="b"><failure message="m &amp; n">tb</failure></testcase><testcase name="c"><error/></testcase></testsuite></testsuites>', parse_junit)
    assert (r["total"], r["failed"], r["errors"]) == (3, 1, 1) and r["failures"][0]["message"] == "m & n" and r["failures"][0]["test_name"] == "b"
    assert one(spark, "broken", parse_junit)["total"] == 0 and one(spark, None, parse_junit)["failures"] in ([], None)


def test_log_roundtrip_and_summary(spark, tmp_path):
    from corvane.operators.events import event_schema

    ev = spark.createDataFrame([{"run_id": "r", "node": n, "ts": f"t{i}", "duration_ms": 60.0, "outcome": "ok", "detail": "sk-" + "b" * 24} for i, n in enumerate(("generate", "run_tests", "retrieve"))], event_schema())
    write_log(ev.coalesce(1), str(tmp_path / "log"))
    (tmp_path / "log" / "other.json").write_text("\n{broken\n")
    back = read_log(spark, str(tmp_path / "log")).withColumn("seq", F.substring("ts", 2, 5).cast("int"))
    s = summarize(back, "run_id", "seq").first()
    assert s["n_events"] == 3 and s["node_counts"] == {"generate": 1, "run_tests": 1, "retrieve": 1} and s["outcomes"] == {"ok": 3} and s["duration_ms_total"] == 180.0 and s["rag"]
    assert (s["started_ts"], s["finished_ts"]) == ("t0", "t2") and {r["detail"] for r in back.collect()} == {"***"}
    run = running(back, "run_id", "seq", "duration_ms").orderBy("seq").collect()
    assert [r["cum_duration_ms"] for r in run] == [60, 120, 180] and [r["delta_duration_ms"] for r in run] == [None, 0, 0]


def test_evaluation_report(spark, tmp_path):
    rec = [(1, f"t{i}", m, "approved" if p else "failed", p, a, p and a == 1, c, 100 * a, 5.0, m) for i, (m, p, a, c) in enumerate([("rag", True, 1, 2), ("rag", False, 3, 6), ("norag", True, 1, 1)])]
    rec = [(v, t if m == "rag" else "t0", m, *r) for v, t, m, *r in rec]
    df = spark.createDataFrame(rec, "schema_version int, task_id string, mode string, status string, passed boolean, attempts int, first_try boolean, llm_calls int, total_tokens long, wall_s double, model string")
    tasks = spark.createDataFrame([("t0",), ("t1",), ("t2",)], "task_id string")
    text = Engine(spark, "x").report(tasks, df, ("rag", "norag"))
    assert "| rag | 2 | 1 | 50.0% | 1 | 2.00 | 4.00 | 200 | 5.0 |" in text and "| t0 | PASS a=1 c=2 | PASS a=1 c=1 |" in text and "| t2 | - | - |" in text and "Fewer than 10" in text
    modes = spark.createDataFrame([("rag", 0), ("norag", 1)], "mode string, mode_no int")
    left = [tuple(r) for r in evaluation.pending(tasks, modes, df).collect()]
    assert left == [("t1", "norag"), ("t2", "rag"), ("t2", "norag")] and evaluation.pending(tasks, modes, df, 1).count() == 1 and evaluation.pending(tasks, modes, df, force=True).count() == 6
    assert {r["task_id"] for r in evaluation.incomplete_pairs(tasks, df, "rag", "norag").collect()} == {"t1", "t2"}
    write_records(df, str(tmp_path / "rec"))
    write_records(df.limit(1), str(tmp_path / "rec"))
    assert read_records(spark, str(tmp_path / "rec")).count() == 3


def test_percentile_rule(spark):
    for n in (1, 2, 15, 60, 101):
        v = [float((i * 37) % n) for i in range(n)]
        got = evaluation.p95(spark.createDataFrame([(x,) for x in v], "x double"), "x").first()["p95"]
        assert got == sorted(v)[min(n - 1, int(round(0.95 * (n - 1))))]


def test_tasks(spark, tmp_path):
    (tmp_path / "b_two.yaml").write_text("id: b_two\ntitle: t\nlibraries: [json]\ndifficulty: 1\ntask: x\ntests: y\nreference: z\n")
    (tmp_path / "a_one.yaml").write_text("id: a_one\ntitle: ' '\nlibraries: []\ndifficulty: 9\ntask: x\ntests: y\nreference: z\n")
    assert [r["id"] for r in load_tasks(spark, str(tmp_path)).orderBy("at").collect()] == ["a_one", "b_two"]
    assert [r["id"] for r in load_tasks(spark, str(tmp_path), ["b_two"]).collect()] == ["b_two"]
    assert {(r["id"], r["problem"]) for r in invalid_tasks(load_tasks(spark, str(tmp_path))).collect()} == {("a_one", "title"), ("a_one", "libraries"), ("a_one", "difficulty")}
    with pytest.raises(ValueError, match="no such tasks: zzz"):
        load_tasks(spark, str(tmp_path), ["zzz"])


def scripted(passes_at):
    def model(df):
        return df.withColumns({"code": F.concat(F.lit("v"), F.col("attempt").cast("string")), "tests": F.lit("t")})

    def sandbox(df):
        good = F.col("attempt") >= passes_at
        run = F.struct(good.alias("passed"), F.when(good, "pass").otherwise("runtime_error").alias("category"))
        full = [run[f.name].cast(f.dataType).alias(f.name) if f.name in ("passed", "category") else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema["run"].dataType]
        return df.withColumn("run", F.struct(*full))

    return loop.Effects(model, sandbox)


def test_loop_retries_pauses_and_resumes(spark):
    tasks = spark.createDataFrame([("a", "do", ""), ("b", "do", "")], "task_id string, task string, provided_tests string")
    done = loop.run(loop.start(spark, tasks, scripted(3), True), scripted(3)).collect()
    assert {(r["status"], r["attempt"], r["retries_used"]) for r in done} == {("approved", 3, 2)}
    assert done[0]["nodes"] == ["generate", "run_tests", "analyze_error", "revise", "run_tests", "analyze_error", "revise", "run_tests", "finalize"]
    failed = loop.run(loop.start(spark, tasks, scripted(99), True), scripted(99)).first()
    assert failed["status"] == "failed" and failed["retries_used"] == 3 and failed["failure_reason"] == "tests failed: runtime_error"
    wait = loop.run(loop.start(spark, tasks, scripted(1), False), scripted(1))
    assert {r["status"] for r in wait.collect()} == {"awaiting_review"}
    say = spark.createDataFrame([("a", "approve", None, None, None), ("b", "reject", "no", None, None)], "task_id string, decision string, feedback string, code string, tests string")
    loop.save(wait, "/tmp/checkpoints/test-states")
    wait = loop.load(spark, "/tmp/checkpoints/test-states")
    assert loop.load(spark, "/tmp/checkpoints/test-states", "zzz").count() == 0
    after = {r["task_id"]: r for r in loop.resume(wait, say, scripted(1)).collect()}
    assert after["a"]["status"] == "approved" and (after["b"]["status"], after["b"]["human_rounds"], after["b"]["feedback"]) == ("awaiting_review", 1, "no")
    with pytest.raises(Exception, match="unknown decision"):
        loop.resume(wait, say.withColumn("decision", F.lit("maybe")), scripted(1)).collect()


def test_client():
    waits, replies = [], iter([ConnectionError("x"), "", "fine"])

    def call(_):
        r = next(replies)
        if isinstance(r, Exception):
            raise r
        return r

    c = effects.Client(call, sleep=waits.append)
    assert c.text("p") == "fine" and waits == [2.0, 4.0] and (c.calls, c.api_retries) == (1, 2)
    with pytest.raises(effects.CallError) as e:
        effects.Client(lambda _: "x", budget=0).text("p")
    assert e.value.kind == "budget"
    assert [effects.error_kind(s) for s in (401, 404, 400, 429, 503, None)] == ["auth", "model", "request", None, None, None]
    assert effects.error_kind(429, "quota per day") == "daily_quota" and effects.asked_wait({"Retry-After": "7"}, 0) == 7


def test_code_checks_and_sandbox(spark):
    assert effects.imports("import a.b\nfrom c import d\ndef f():\n import e") == ["a", "c", "e"] and effects.imports("import a\ndef f():\n import e", True) == ["a"] and effects.imports("x =") is None
    assert effects.preflight("import no_such_module_x") == "import_error" and effects.preflight("import json") is None
    df = spark.createDataFrame([("def f(): return 1", "from solution import f\ndef test_f(): assert f() == 1"), ("def f(): return 2", "from solution import f\ndef test_f(): assert f() == 1"), ("x", "import nothing_here_z")], "code string, tests string")
    got = [r["run"] for r in effects.run_tests(df).collect()]
    assert [r["category"] for r in got] == ["pass", "assertion_failure", "import_error"] and got[0]["passed"] and got[1]["tests_failed"] == 1


def test_options():
    o = Options.load({"CORVANE_TOP_K": "9", "CORVANE_HYBRID": "no", "CORVANE_MIN_SCORE": " "}, api_key="k")
    assert (o.top_k, o.hybrid, o.min_score, o.shown()["api_key"]) == (9, False, 0.2, "***")
    with pytest.raises(ValueError, match="rrf_k"):
        Options(rrf_k=0)


def test_engine_evaluates_what_is_pending(spark):
    tasks = spark.createDataFrame([("a", "do", ""), ("b", "do", "")], "task_id string, task string, provided_tests string")
    none = spark.createDataFrame([], "schema_version int, task_id string, mode string, status string")
    e = Engine(spark, "ev")
    modes = {"rag": scripted(1), "norag": scripted(2)}
    first = e.evaluate(tasks, modes, none).cache()
    assert {(r["task_id"], r["mode"], r["attempts"], r["first_try"]) for r in first.collect()} == {("a", "rag", 1, True), ("b", "rag", 1, True), ("a", "norag", 2, False), ("b", "norag", 2, False)}
    again = e.evaluate(tasks, modes, first.where("not (task_id = 'b' and mode = 'norag')"))
    assert [(r["task_id"], r["mode"]) for r in again.collect()] == [("b", "norag")]
    assert e.evaluate(tasks, modes, none, limit=1).count() == 1
