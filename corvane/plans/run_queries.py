"""Registered queries on runs: the loop, its records and routes, the store, and what texts of failed runs say."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.catalog import register, table
from corvane.functions import text as X
from corvane.operators import analysis as A
from corvane.operators import evaluation as E
from corvane.operators import events as L
from corvane.operators import store
from corvane.plans import loop


def _tasks(spark, sf):
    """The benchmark items as tasks."""
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("task_id"), F.col("text").alias("task"), F.lit("").alias("provided_tests"))


def _effects(every: int, retriever=None):
    """A scripted model and sandbox: a task's tests pass at an attempt that its id gives."""

    def model(df):
        return df.withColumns({"code": F.concat(F.lit("attempt "), F.col("attempt").cast("string")), "tests": F.lit("assert True")})

    def sandbox(df):
        good = F.col("attempt") >= 1 + F.pmod(F.col("task_id").cast("int"), F.lit(every))
        run = F.struct(
            good.alias("passed"), F.when(good, "pass").otherwise("runtime_error").alias("category"), F.when(good, 0).otherwise(1).alias("exit_code"), F.lit(False).alias("timed_out"), F.lit(0.1).cast("double").alias("duration_s"),
            F.lit(1).alias("tests_total"), F.when(good, 0).otherwise(1).alias("tests_failed"),
            F.when(~good, F.array(F.struct(F.lit("t").alias("test_name"), F.lit("failure").alias("error_type"), F.lit("").alias("message"), F.lit("solution.py:5: AttributeError: module 'math' has no attribute 'sqroot'").alias("traceback")))).alias("failures"),
            F.lit("").alias("stdout"), F.lit("").alias("stderr"),
        )
        return df.withColumn("run", run.cast(df.schema["run"].dataType))

    return loop.Effects(model, sandbox, retriever)


@register("workflow_run", """select item_id::varchar task_id, 'approved' status, (1 + item_id % 3)::int attempt, (item_id % 3)::int retries_used, (case item_id % 3 when 0 then 4 when 1 then 8 else 11 end)::int step,
 'retrieve>generate>run_tests' || case when item_id % 3 > 0 then '>analyze_error>retrieve>revise>run_tests' else '' end || case when item_id % 3 = 2 then '>analyze_error>revise>run_tests' else '' end || '>finalize' path from benchmark""")
def workflow_run(spark, sf):
    """The whole loop over all tasks: what a run needs documentation for is looked up once, the third attempt passes at the latest."""
    effects = _effects(3, lambda df: df.withColumn("doc_ids", F.array(F.lit("math.sqrt"))))
    done = loop.run(loop.start(spark, _tasks(spark, sf), effects, True), effects)
    return done.select("task_id", "status", "attempt", "retries_used", "step", F.array_join("nodes", ">").alias("path"))


@register("eval_records", """select item_id::varchar task_id, m.mode, 'approved' status, true passed, (1 + item_id % m.k)::int attempts, item_id % m.k = 0 first_try, (1 + item_id % m.k)::int llm_calls, ((1 + item_id % m.k) * (5 + ceil(length(text) / 4.0)))::bigint total_tokens, 'pass' final_category,
 'attempt ' || (1 + item_id % m.k) final_code from benchmark, (values ('rag', 3), ('norag', 2)) m(mode, k)""")
def eval_records(spark, sf):
    """Records of all tasks in two modes."""
    from corvane.engine import Engine

    done = spark.createDataFrame([], E.RECORD)
    got = Engine(spark, f"eval-{uuid.uuid4().hex}").evaluate(_tasks(spark, sf), {"rag": _effects(3), "norag": _effects(2)}, done)
    return got.select("task_id", "mode", "status", "passed", "attempts", "first_try", "llm_calls", "total_tokens", "final_category", "final_code")


@register("store_upserts", """with a as (select source id, arg_max(lang, doc_id) lang from documents group by 1), d as (select distinct source id from documents where lang = 'de')
select a.id, case when d.id is null then lang else 'again' end as text, case when d.id is null then lang else 'de' end library from a left join d using (id)""")
def store_upserts(spark, sf):
    """What a collection holds after two batches, read by a second object from its files."""
    from corvane.sources.durable import gone_at_exit

    name, d = f"upserts-{uuid.uuid4().hex}", table(spark, sf, "documents")
    s = store.ChunkStore(spark, name)
    gone_at_exit(spark, s.root)
    s.upsert(d.select(F.col("source").alias("id"), F.col("lang").alias("text"), F.col("lang").alias("library"), F.col("doc_id").alias("seq")), "seq")
    s.upsert(d.where("lang = 'de'").select(F.col("source").alias("id"), F.lit("again").alias("text"), F.col("lang").alias("library"), F.col("doc_id").alias("seq")), "seq")
    return store.ChunkStore(spark, name).read().select("id", "text", "library")


@register("exit_codes", "select doc_id, (case when toxic = 1 then 5 when quality = 1 then 0 when lang = 'de' then 3 else 1 end)::int code, case when toxic = 1 then 'awaiting_review' when lang = 'fr' then 'rejected' when quality = 1 then 'approved' else 'failed' end shown from documents join labels using (doc_id)")
def exit_codes(spark, sf):
    """How runs end for a caller, and the status that is shown."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    status = F.when(F.col("quality") == 1, "approved").otherwise("failed")
    waiting = F.col("toxic") == 1
    reason = F.when(F.col("lang") == "de", "daily Quota is used up").otherwise(F.col("lang"))
    decision = F.when(F.col("lang") == "fr", "reject_final")
    return d.select("doc_id", loop.classify_exit(F.when(waiting, "awaiting_review").otherwise(status), reason).alias("code"), L.display_status(status, waiting, decision).alias("shown"))


@register("final_categories", """with e as (select event_id, event_type = 'error' late, (user_id % 3)::int code, (event_id % 4)::int total, (event_id % 2)::int failed, event_type <> 'view' report, case when event_type = 'click' then 'odd' when event_type = 'purchase' then 'pass' else 'runtime_error' end ruled from events),
f as (select *, case when late then 'timeout' when not report then ruled when code = 2 then ruled when total = 0 then 'no_tests' when failed > 0 then ruled else 'pass' end found from e)
select event_id, case when found = 'pass' and code <> 0 then 'sandbox_error' when found = 'odd' then 'sandbox_error' else found end category from f""")
def final_categories(spark, sf):
    """Categories of finished runs by report, exit code and rules."""
    t = F.col("event_type")
    ruled = F.when(t == "click", "odd").when(t == "purchase", "pass").otherwise("runtime_error")
    cat = A.finalize(F.when(t == "error", "timeout"), (F.col("user_id") % 3).cast("int"), (F.col("event_id") % 4).cast("int"), (F.col("event_id") % 2).cast("int"), t != "view", ruled)
    return table(spark, sf, "events").select("event_id", cat.alias("category"))


@register("exception_lines", r"""with l as (select conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') l from conversations),
k as (select conv_id, turn, l, list_filter(l, lambda x: regexp_matches(x, '[A-Za-z_][A-Za-z0-9_.]*(?::\s*(?:.*))?$')) k from l)
select conv_id, turn, case when len(k) > 0 then regexp_extract(k[-1], '([A-Za-z_][A-Za-z0-9_.]*)(?::\s*(.*))?$', 1) when len(l) > 0 then substr(l[-1], 1, 120) else 'Exception' end as type,
 case when len(k) > 0 then trim(regexp_extract(k[-1], '([A-Za-z_][A-Za-z0-9_.]*)(?::\s*(.*))?$', 2)) else '' end message from k""")
def exception_lines(spark, sf):
    """Turns read as tracebacks: the last line that ends in a name, or a name and a text."""
    return table(spark, sf, "conversations").select("conv_id", "turn", A.last_exception_line(F.col("text")).alias("x")).select("conv_id", "turn", "x.type", "x.message")


@register("run_exceptions", """with l as (select conv_id, turn, role, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') l from conversations)
select conv_id, turn, case when role = 'user' then 'KeyError' else 'Exception' end as type, case when role = 'user' then role when len(l) > 0 then substr(l[-1], 1, 120) else '' end message from l""")
def run_exceptions(spark, sf):
    """Exceptions of runs: from a failure's traceback where there is one, else from what was printed."""
    failures = F.when(F.col("role") == "user", F.array(F.struct(F.lit("m").alias("message"), F.concat(F.lit("solution.py:3: KeyError: "), "role").alias("traceback"))))
    run = F.struct(failures.alias("failures"), F.col("text").alias("stdout"), F.lit("").alias("stderr"))
    d = table(spark, sf, "conversations").select("conv_id", "turn", run.alias("run"))
    return d.select("conv_id", "turn", A.extract_exception(F.col("run")).alias("x")).select("conv_id", "turn", "x.type", "x.message")


@register("index_texts", "select doc_id, coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || coalesce(text, '') as document from documents")
def index_texts(spark, sf):
    """What the lexical index reads of each chunk."""
    return table(spark, sf, "documents").select("doc_id", X.index_text("text", "source", "lang").alias("document"))


@register("route_others", "select doc_id, case when quality = 1 then 'run_tests' else 'fail' end after_model, case when toxic = 1 and lang <> 'de' then 'retrieve' else 'revise' end after_analysis, case when lang = 'fr' then 'generate' else 'revise' end after_retrieve from documents join labels using (doc_id)")
def route_others(spark, sf):
    """Where runs go after a reply, an analysis and a lookup; a query that was asked before is not fresh."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    d = d.select(
        "doc_id", F.when(F.col("quality") == 1, "running").otherwise("failed").alias("status"), (F.col("toxic") == 1).alias("needs_docs"), F.array("lang").alias("retrieval_queries"), F.array(F.lit("de")).alias("seen_queries"),
        F.when(F.col("lang") == "fr", " \n ").otherwise("x = 1").alias("code"),
    )
    return d.select("doc_id", loop.after_model().alias("after_model"), loop.after_analysis(True).alias("after_analysis"), loop.after_retrieve().alias("after_retrieve"))


@register("eval_lines", "select doc_id, doc_id || ' ' || lang || ' ' || case when toxic = 1 then 'ERROR' when quality = 1 then 'PASS' else 'FAIL' end || ' attempts=' || (quality + 1) || ' calls=' || (quality + 1) line from documents join labels using (doc_id)")
def eval_lines(spark, sf):
    """Cells of an evaluation as progress lines."""
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    calls = F.col("quality") + 1
    return d.select("doc_id", L.format_eval_line(F.col("doc_id"), F.col("lang"), F.when(F.col("toxic") == 1, "error").otherwise("approved"), F.col("quality") == 1, calls, calls).alias("line"))
