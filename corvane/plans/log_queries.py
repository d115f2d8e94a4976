"""Registered queries on logs: the event table as a run log, by user as run."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import register, table
from corvane.functions import text as X
from corvane.operators import analysis as A
from corvane.operators import events as L
from corvane.sources.records import latest_state, parse_junit
from corvane.streaming import events as S


def _events(spark, sf):
    return table(spark, sf, "events")


@register("event_summary", "select user_id, count(*) n_events, arg_min(ts, event_id) started_ts, arg_max(ts, event_id) finished_ts, round(sum(value::decimal(28,6)), 1)::double duration_ms_total, bool_or(event_type = 'error') rag from events group by 1")
def event_summary(spark, sf):
    """One row per run: events, times in log order, duration, and whether a node ran."""
    e = _events(spark, sf).withColumn("value", F.col("value").cast("decimal(28,6)"))
    out = L.summarize(e, "user_id", "event_id", "event_type", None, "value", "ts", "error")
    return out.drop("node_counts").withColumn("duration_ms_total", F.col("duration_ms_total").cast("double"))


@register("node_counts", "select user_id, event_type node, count(*) n from events where event_type <> '' group by all")
def node_counts(spark, sf):
    """The summary's map of counts by node, flattened."""
    out = L.summarize(_events(spark, sf), "user_id", "event_id", "event_type", None, "value", "ts", "error")
    return out.select("user_id", F.explode("node_counts").alias("node", "n"))


@register("running_usage", "select event_id, round(sum(case when event_type = 'error' then 0 else value::decimal(28,6) end) over (partition by user_id order by event_id), 4)::double cum_value, round(value::decimal(28,6) - lag(value::decimal(28,6)) over (partition by user_id order by event_id), 4)::double delta_value from events")
def running_usage(spark, sf):
    """Running totals and steps by run; failed steps add nothing."""
    e = _events(spark, sf).withColumn("value", F.col("value").cast("decimal(28,6)"))
    out = L.running(e, "user_id", "event_id", "value", skip=F.col("event_type") == "error")
    return out.select("event_id", F.round("cum_value", 4).cast("double").alias("cum_value"), F.round("delta_value", 4).cast("double").alias("delta_value"))


@register("merge_usage", "select user_id, sum(case when event_id % 3 = 0 then (value * 100)::int end)::bigint input_tokens, sum(case when user_id % 2 = 0 then 1 end)::bigint llm_calls from events group by 1")
def merge_usage(spark, sf):
    """Counters by run; null where no part has one."""
    e = _events(spark, sf).select("user_id", F.when(F.col("event_id") % 3 == 0, F.round(F.col("value") * 100).cast("int")).alias("input_tokens"), F.when(F.col("user_id") % 2 == 0, 1).alias("llm_calls"))
    return L.merge_usage(e, "user_id", "input_tokens", "llm_calls")


@register("props_json", "select event_type, count(*) n, sum((props->>'$.k')::bigint)::bigint total from events group by 1")
def props_json(spark, sf):
    """Sums over a field of JSON details."""
    parsed = _events(spark, sf).select("event_type", F.from_json("props", "k bigint").getField("k").alias("k"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@register("valid_lines", "select event_type node, count(*) n, round(sum(value::decimal(28,6)), 4)::double total from events where event_id % 10 <> 0 group by 1")
def valid_lines(spark, sf):
    """A log of all events, every tenth line of which is cut off and every hundredth followed by a blank one, written and read back: what of it is valid."""
    import uuid

    from corvane.sources.durable import gone_at_exit, shared_dir

    whole = F.to_json(F.struct(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("node"), F.col("value").alias("duration_ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")))
    line = F.concat(F.when(F.col("event_id") % 10 == 0, F.substring(whole, 1, 20)).otherwise(whole), F.when(F.col("event_id") % 100 == 1, "\n  ").otherwise(""))
    folder = f"{shared_dir(spark)}/corvane-log-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)
    _events(spark, sf).select(line.alias("value")).write.text(folder)
    return L.read_log(spark, folder).groupBy("node").agg(F.count("*").alias("n"), F.round(F.sum(F.col("duration_ms").cast("decimal(28,6)")), 4).cast("double").alias("total"))


@register("event_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value::decimal(28,6)), 4)::double total from events group by all")
def event_windows(spark, sf):
    """Hourly counts and totals by type."""
    e = _events(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "value": F.col("value").cast("decimal(28,6)")})
    return S.windowed(e, "ts", "event_type", "value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).cast("double").alias("total"))


@register("stream_totals", "select event_type, count(*) n_events, round(sum(value::decimal(28,6)), 4)::double total, min(value) min_value, max(value) max_value from events group by 1")
def stream_totals(spark, sf):
    """The totals by type, read as a stream of files to its end."""
    import uuid

    from corvane.sources.durable import shared_dir

    schema = _events(spark, sf).schema
    stream = S.tail(spark, f"{sf}/events.parquet" if _is_folder(spark, f"{sf}/events.parquet") else f"{sf}/events*.parquet", schema)
    return S.drain(S.totals(stream, "event_type", "value"), f"totals_{uuid.uuid4().hex[:8]}", "complete", f"{shared_dir(spark)}/corvane-stream-{uuid.uuid4().hex}")


def _is_folder(spark, path: str) -> bool:
    """Whether a table is a folder of files (a stream reads folders or patterns, not one file)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@register("latest_state", "select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type from events group by 1")
def latest_state_query(spark, sf):
    """The last checkpoint of each run."""
    return latest_state(_events(spark, sf), "user_id", "event_id").select("user_id", "event_id", "event_type")


@register("redact", "select conv_id, turn, case when length(r) > 120 then substr(r, 1, 120) || '...[truncated]' else r end as text from (select conv_id, turn, regexp_replace(regexp_replace(replace('AIza' || repeat('b', 32) || ' pass-word-1 ' || coalesce(text, '') || ' sk-' || repeat('a', 24), 'pass-word-1', '***'), 'AIza[0-9A-Za-z_-]{30,}', '***', 'g'), 'sk-[A-Za-z0-9_-]{20,}', '***', 'g') r from conversations)")
def redact(spark, sf):
    """Secrets out before texts are cut."""
    text = F.concat(F.lit("AIza" + "b" * 32 + " pass-word-1 "), F.coalesce("text", F.lit("")), F.lit(" sk-" + "a" * 24))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.redact(text, ("pass-word-1",), 120).alias("text"))


@register("usage_estimate", "select conv_id, turn, case when turn % 2 = 0 then turn + 1 else ceil(length(coalesce(text, '')) / 4.0)::bigint end input_tokens, case when turn % 2 = 0 then 2 else ceil(length(role) / 4.0)::bigint end output_tokens, case when turn % 2 = 0 then turn + 3 else (ceil(length(coalesce(text, '')) / 4.0) + ceil(length(role) / 4.0))::bigint end total_tokens, (turn % 2)::int estimated_calls from conversations")
def usage_estimate(spark, sf):
    """Token counts as given, else estimated."""
    given = F.when(F.col("turn") % 2 == 0, F.col("turn") + 1)
    u = L.extract_usage(F.col("text"), F.col("role"), given, F.when(given.isNotNull(), F.lit(2).cast("bigint")), F.lit(None).cast("bigint"))
    return table(spark, sf, "conversations").select("conv_id", "turn", u.alias("u")).select("conv_id", "turn", "u.input_tokens", "u.output_tokens", "u.total_tokens", "u.estimated_calls")


_OUT = ("E   ImportError: no", "SyntaxError: bad", "AssertionError", "it timed out", "collected 0 items", "RuntimeError: x", "quiet", "Failed: DID NOT RAISE", "collection failed")


@register("classify_runs", "with t as (select event_id, ['import_error', 'syntax_error', 'assertion_failure', 'timeout', 'no_tests', 'runtime_error', 'sandbox_error', 'assertion_failure', 'runtime_error'] c, ['import_error', 'runtime_error', 'runtime_error', 'runtime_error', 'runtime_error', 'runtime_error', 'runtime_error', 'runtime_error', 'runtime_error'] c2 from events) select event_id, case when event_id % 4 = 3 and event_id % 9 = 1 then 'syntax_error' when event_id % 4 = 3 then c2[event_id % 9 + 1] else c[event_id % 9 + 1] end category from t")
def classify_runs(spark, sf):
    """Categories of runs by their output."""
    out = F.get(F.array(*map(F.lit, _OUT)), (F.col("event_id") % 9).cast("int"))
    code = F.when(F.col("event_id") % 4 == 3, 2).otherwise(1)
    return _events(spark, sf).select("event_id", A.classify(F.lit(""), out, F.lit(""), F.lit(0), code).alias("category"))


#: Runs by kind: the category they came with, their traceback, and what the analysis says of them. {a} and {b} are words of a turn's text.
_RUNS = (
    ("runtime_error", "solution.py:5: AttributeError: module '{a}' has no attribute '{b}'", "api_misuse", "code", "{a}.{b}", " - see {a}.{b}", "{a} {b}"),
    ("import_error", "ImportError: cannot import name '{b}' from '{a}'", "api_misuse", "unknown", "{a}.{b}", "", "{a} {b}"),
    ("import_error", "ImportError: cannot import name '{b}' from 'solution'", "import_error", "code", "solution.{b}", "", ""),
    ("runtime_error", "test_solution.py:9: TypeError: {a}() got an unexpected keyword argument '{b}'", "api_misuse", "unknown", "{a}, {a}() kwarg:{b}", "", "{a};{a} {b}"),
    ("runtime_error", "TypeError: {a}() missing 1 required positional argument: '{b}'", "api_misuse", "unknown", "{a}, {a}() signature", "", "{a};{a} signature"),
    ("import_error", "ModuleNotFoundError: No module named '{a}'", "import_error", "code", "{a}", "", ""),
    ("runtime_error", "AttributeError: '{a}' object has no attribute '{b}'", "runtime_error", "unknown", "{a}.{b}", "", ""),
    ("assertion_failure", "AssertionError: {a} != {b}", "assertion_failure", "unknown", "", "", ""),
    ("timeout", "", "timeout", "code", "", "", ""),
    ("no_tests", "", "no_tests", "tests", "", "", ""),
    ("runtime_error", "solution.py:2: TypeError: {a}() got multiple values for argument '{b}'", "api_misuse", "code", "kwarg:{b}", "", "{b}"),
    ("runtime_error", "TypeError: {a}() got an invalid keyword argument '{b}'", "api_misuse", "unknown", "{a}, {a}() kwarg:{b}", "", "{a};{a} {b}"),
)
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_RUN_VALUES = ", ".join(
    f"({k}, {_quoted(said.partition('.py:')[2].partition(': ')[2] or said)}, {_quoted(cat)}, {_quoted(fault)}, {_quoted(names)}, {_quoted(see)}, {_quoted(asked)}, {_quoted(A.MEANING.get(cat, ''))}, "
    f"{_quoted(('tests: ' if fault == 'tests' else 'code: ') + A.TODO[cat].replace('{}', names or 'what failed'))})"
    for k, (_, said, cat, fault, names, see, asked) in enumerate(_RUNS)
)
_WORDS_OF = "'m' || lower(regexp_extract(coalesce(text, ''), '[A-Za-z]{2,}')) a, 'n' || lower(regexp_extract(coalesce(text, ''), '[A-Za-z]{2,}[^A-Za-z]+([A-Za-z]+)', 1)) b"


@register("analyze_runs", f"""with t as (select conv_id, turn, {_WORDS_OF}, (conv_id + turn) % {len(_RUNS)} k from conversations), v(k, said, category, fault, names, see, asked, silent, plan) as (values {_RUN_VALUES}),
f as (select conv_id, turn, category, fault, silent, {", ".join(f"replace(replace({c}, '{{a}}', a), '{{b}}', b) {c}" for c in ("said", "names", "see", "asked", "plan"))} from t join v using (k))
select conv_id, turn, category, fault, names suspects, case when said = '' then silent else substr(said || see, 1, 200) end root_cause, substr(plan, 1, 240) fix_plan,
case when category = 'api_misuse' then asked || ';' || substr(regexp_extract(said, ': (.*)', 1), 1, 80) else '' end queries, category = 'api_misuse' needs_docs from f""")
def analyze_runs(spark, sf):
    """The analysis of failed runs, every family of messages with words of the texts: category, fault, suspects, cause, plan, what to look up."""
    text = F.coalesce("text", F.lit(""))
    a = F.concat(F.lit("m"), F.lower(F.regexp_extract(text, "[A-Za-z]{2,}", 0)))
    b = F.concat(F.lit("n"), F.lower(F.regexp_extract(text, "[A-Za-z]{2,}[^A-Za-z]+([A-Za-z]+)", 1)))
    kind = ((F.col("conv_id") + F.col("turn")) % len(_RUNS)).cast("int")
    of = lambda i: F.get(F.array(*[F.lit(r[i]) for r in _RUNS]), kind)
    said = F.replace(F.replace(of(1), F.lit("{a}"), a), F.lit("{b}"), b)
    failures = F.filter(F.array(F.struct(F.lit("").alias("message"), said.alias("traceback"))), lambda f: f["traceback"] != "")
    run = F.struct(F.lit(False).alias("passed"), of(0).alias("category"), failures.alias("failures"), F.lit("").alias("stdout"), F.lit("").alias("stderr"))
    out = A.analyze(table(spark, sf, "conversations").select("conv_id", "turn", run.alias("run"), F.lit("").alias("provided_tests")))
    return out.select("conv_id", "turn", "category", "fault", F.array_join("suspect_symbols", ", ").alias("suspects"), "root_cause", "fix_plan", F.array_join("retrieval_queries", ";").alias("queries"), "needs_docs")


_REPORTS = """with p as (select page_id, coalesce(html, '') html, coalesce(url, '') url, page_id % 7 = 3 broken from pages)
select page_id, case when broken then 0 else 4 end::bigint total, case when broken then 0 else 2 end::bigint failed, case when broken then 0 else 1 end::bigint errors,
case when broken then null else url || ' > "q"' end first_name, case when broken then null else 'a < b' || chr(10) || url end message, case when broken then null else right(trim(html, ' ' || chr(9) || chr(10) || chr(13)), 2000) end traceback from p"""


@register("junit_reports", _REPORTS)
def junit_reports(spark, sf):
    """Test reports parsed: pages as tracebacks in CDATA, their addresses in attributes of either quote, nested suites; every seventh report is cut off."""
    p = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"), F.coalesce("url", F.lit("")).alias("url"))
    url = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#60;"))
    body = F.concat(F.lit("<![CDATA["), F.replace(F.col("html"), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<!-- a <testcase> in a comment --><testsuites><testsuite name="s"><testcase name=\''), url, F.lit(' > "q"\'><failure message="a &lt; b&#10;'), url, F.lit('">'), body, F.lit("</failure><system-out>out</system-out></testcase>"),
        F.lit('<testcase name="fine"/><testsuite><testcase><failure/></testcase><testcase name="e"><error message="x"/></testcase></testsuite>'), F.when(F.col("page_id") % 7 == 3, "").otherwise("</testsuite></testsuites>"),
    )
    r = p.select("page_id", parse_junit(xml).alias("r"))
    first = F.get(F.col("r.failures"), F.lit(0))
    return r.select("page_id", *[F.col(f"r.{c}").cast("bigint").alias(c) for c in ("total", "failed", "errors")], first["test_name"].alias("first_name"), first["message"].alias("message"), first["traceback"].alias("traceback"))


@register("format_events", """select event_id, substr(case event_type when 'click' then '[retrieve] mode=m queries=2 docs=' || (event_id % 5) || ' top=0.500' when 'view' then '[generate] attempt=' || user_id || ' code=' || event_id || ' chars tests=0 chars'
 when 'error' then '[fail] ' || substr(repeat('ab', 100), 1, 120) else '[' || event_type || '] done' end, 1, 160) line from events""")
def format_events(spark, sf):
    """Events as lines."""
    t = F.col("event_type")
    node = F.when(t == "click", "retrieve").when(t == "view", "generate").when(t == "error", "fail").otherwise(t)
    detail = (
        F.when(t == "click", F.concat(F.lit('{"mode":"m","queries":["a","b"],"scores":[0.25,0.5],"n_docs":'), (F.col("event_id") % 5).cast("string"), F.lit("}")))
        .when(t == "view", F.concat(F.lit('{"code_chars":'), F.col("event_id").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"reason":"'), F.repeat(F.lit("ab"), 100), F.lit('"}')))
    )
    return _events(spark, sf).select("event_id", L.format_event(node, F.col("user_id"), detail).alias("line"))


@register("stop_reasons", "select user_id, case when min(event_id) filter (event_type = 'error') is not null and (min(event_id) filter (event_type = 'error') < coalesce(min(event_id) filter (event_type = 'purchase'), 1000000000)) then 'quota' when min(event_id) filter (event_type = 'purchase') is not null then 'auth' end reason from events group by 1")
def stop_reasons(spark, sf):
    """Why a run would end an evaluation: the first decisive error in order."""
    kind = F.when(F.col("event_type") == "error", "daily_quota").when(F.col("event_type") == "purchase", "auth").otherwise("unavailable")
    return L.stop_reasons(_events(spark, sf).select("user_id", "event_id", kind.alias("error")), "user_id", "event_id", "error")


@register("event_sessions", """with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end opens from events where ts is not null),
s as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) nth from e)
select user_id, min(ts) as start, max(ts) + interval 6 hour as "end", count(*) n, round(sum(value::decimal(28,6)), 4)::double total from s group by user_id, nth""")
def event_sessions(spark, sf):
    """What a user did without a pause of six hours."""
    e = _events(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "value": F.col("value").cast("decimal(28,6)")})
    out = L.sessions(e, "ts", "user_id", "value", "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).cast("double").alias("total"))


@register("stream_summary", """with c as (select user_id, event_type, count(*) n from events where event_type <> '' group by all), m as (select user_id, string_agg(event_type || '=' || n, ',' order by event_type) nodes from c group by 1)
select user_id::varchar user_id, count(*) n_events, arg_min(ts, event_id) started_ts, arg_max(ts, event_id) finished_ts, round(sum(value::decimal(28,6)), 1)::double duration_ms_total, bool_or(event_type = 'error') rag, any_value(nodes) nodes from events left join m using (user_id) group by 1""")
def stream_summary(spark, sf):
    """The summaries of all runs by a stream with keyed state, read to its end."""
    import uuid

    from corvane.sources.durable import gone_at_exit, shared_dir
    from corvane.streaming import summary as Y

    folder = f"{shared_dir(spark)}/corvane-summary-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)
    own = Y.session(spark)
    stream = S.tail(own, f"{sf}/events.parquet" if _is_folder(spark, f"{sf}/events.parquet") else f"{sf}/events*.parquet", _events(spark, sf).schema)
    slices = Y.drained(Y.partials(stream, "user_id", "event_id", "event_type", None, F.col("value"), "ts", "error", None), f"{folder}/slices", f"{folder}/checkpoint")
    nodes = F.array_join(F.transform(F.map_entries("node_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    out = Y.merged(spark.read.schema(slices.schema).parquet(f"{folder}/slices"))
    return out.select(F.col("run").alias("user_id"), "n_events", F.col("started_ts").cast("timestamp_ntz").alias("started_ts"), F.col("finished_ts").cast("timestamp_ntz").alias("finished_ts"), "duration_ms_total", "rag", nodes.alias("nodes"))


_MASK = "regexp_replace(regexp_replace(replace({}, 'pass-word-1', '***'), 'AIza[0-9A-Za-z_-]{{30,}}', '***', 'g'), 'sk-[A-Za-z0-9_-]{{20,}}', '***', 'g')"
_CUT = f"case when length({_MASK}) > 120 then substr({_MASK}, 1, 120) || '...[truncated]' else {_MASK} end"


def _cut(text):
    return _CUT.format(text, text, text)


_WORD_KEY = _cut("'pass-word-1 ' || coalesce(role, '')")


@register("redact_nested", f"""select conv_id, turn, {_cut("'turn sk-' || repeat('a', 24)")} label, {_WORD_KEY} as key, {_cut("coalesce(text, '')")} as v0, {_cut("coalesce(text, '') || ' AIza' || repeat('b', 32)")} as v1, 1 entries, 'sk' || '***' as var from conversations""")
def redact_nested(spark, sf):
    """Secrets in the fields, keys and elements of struct<label, parts map<string, array<string>>>, and in a variant."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    parts = F.map_from_entries(F.array(F.struct(F.concat(F.lit("pass-word-1 "), role).alias("key"), F.array(text, F.lit("old")).alias("value")), F.struct(F.concat(F.lit("sk-" + "c" * 20 + " "), role).alias("key"), F.array(text, F.concat(text, F.lit(" AIza" + "b" * 32))).alias("value"))))
    e = table(spark, sf, "conversations").select("conv_id", "turn", F.struct(F.lit("turn sk-" + "a" * 24).alias("label"), parts.alias("parts")).alias("body"), F.parse_json(F.concat(F.lit('{"turn":['), F.col("turn").cast("string"), F.lit(',"skpass-word-1"]}'))).alias("v"))
    clean = e.select("conv_id", "turn", *[X.redact_all(F.col(f.name), f.dataType, ("pass-word-1",), 120).alias(f.name) for f in e.schema if f.name in ("body", "v")])
    first = F.get(F.map_entries("body.parts"), F.lit(0))
    return clean.select("conv_id", "turn", F.col("body.label").alias("label"), first["key"].alias("key"), F.get(first["value"], F.lit(0)).alias("v0"), F.get(first["value"], F.lit(1)).alias("v1"), F.size("body.parts").alias("entries"), F.variant_get("v", "$.turn[1]", "string").alias("var"))


@register("ledger_counts", "select count(*) filter (event_id % 4 = 0) executed, count(*) filter (event_id % 4 = 1) skipped, count(*) filter (event_id % 4 = 2) pending, count(*) filter (event_id % 4 = 3) error from events")
def ledger_counts(spark, sf):
    """Cells of a ledger by what became of them."""
    from corvane.operators.evaluation import ledger_counts as counts

    return counts(_events(spark, sf).select(F.get(F.array(*map(F.lit, ("executed", "skipped", "pending", "error"))), (F.col("event_id") % 4).cast("int")).alias("status")))


@register("prompts", """select conv_id, turn, 'Task:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Documentation:' || chr(10) || '[a] one' || chr(10) || chr(10) || '[b] two' || case when turn % 2 = 0 then chr(10) || chr(10) || 'These tests are given and fixed; leave out the tests tag.' || chr(10) || 'assert f' else '' end human from conversations""")
def prompts(spark, sf):
    """First messages to the model: task, documentation that fits, given tests."""
    from corvane.plans import prompts as P

    docs = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("text")) for i, t in (("a", "one"), ("b", "two"), ("c", "x" * 100))])
    given = F.when(F.col("turn") % 2 == 0, F.lit(" assert f "))
    return table(spark, sf, "conversations").select("conv_id", "turn", P.generate(F.col("text"), docs, given, 40)["human"].alias("human"))


_AGAIN = """with t as (select conv_id, turn, coalesce(text, '') x, coalesce(role, '') r, chr(10) n from conversations),
f as (select conv_id, turn, x, r, n, 'Category: runtime_error' || n || n || 'Failing tests: t' || turn || ', unknown' || n || n || substr('Exception: KeyError: ' || x, 1, 300)
  || case when trim(x, ' ' || chr(9) || chr(10) || chr(13)) = '' then '' else n || n || 'Traceback, its end:' || n || case when length(x) > 1500 then right(x, 1500) else x end end || case when r = '' then '' else n || n || 'Output, its end:' || n || r end s from t),
a as (select *, s || n || n || 'Root cause: KeyError: ' || turn || n || 'Plan: code: look' || n || 'Fault: code' || n || 'Suspects: ' || r || '.x, y' m from f)
select conv_id, turn, case when length(m) > 1500 then substr(m, 1, 1500) || n || '...[truncated]' else m end analysis,
'Task:' || n || x || case when r = '' then '' else n || n || 'Code:' || n || r end || n || n || 'What failed:' || n || s || n || n || 'Earlier failures:' || n || 'f2' || n || 'f3' || n || r || case when turn % 2 = 0 then n || n || 'A reviewer says:' || n || 'again' else '' end
  || n || n || 'Documentation:' || n || '[a] one' || n || n || '[b] two' || n || n || 'Give the whole corrected module and tests.' revision from a"""


@register("prompts_again", _AGAIN)
def prompts_again(spark, sf):
    """Later messages to the model: a failed run to analyse, and one to revise with what failed before, three failures at most."""
    from corvane.plans import prompts as P

    x, r = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    failures = F.array(F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("test_name"), x.alias("traceback")), F.struct(F.lit(None).cast("string").alias("test_name"), F.lit("other").alias("traceback")))
    run = F.struct(failures.alias("failures"), r.alias("stdout"), F.lit(" ").alias("stderr"))
    docs = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(t).alias("text")) for i, t in (("a", "one"), ("b", "two"), ("c", "x" * 100))])
    said = (F.lit("runtime_error"), F.lit("KeyError"), x)
    summary = P.failure(run, *said)
    first = P.analyze(run, *said, F.concat(F.lit("KeyError: "), F.col("turn").cast("string")), F.lit("code: look"), F.lit("code"), F.array(F.concat(r, F.lit(".x")), F.lit("y")))
    again = P.revise(x, r, F.lit(""), summary, F.when(F.col("turn") % 2 == 0, "again"), F.array(F.lit("f0"), F.lit("f1"), F.lit("f2"), F.lit("f3"), r), docs, 40)
    return table(spark, sf, "conversations").select("conv_id", "turn", first["human"].alias("analysis"), again["human"].alias("revision"))


@register("add_usage", """with p as (select event_id, 'in' k, case when event_id % 3 = 0 then event_id end v from events union all select event_id, 'out', user_id from events union all select event_id, 'in', case when event_id % 2 = 0 then 5 end from events)
 select event_id, k, sum(v)::bigint n from p group by all having count(v) > 0""")
def add_usage(spark, sf):
    """Counters of two steps added by key."""
    a = F.create_map(F.lit("in"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")), F.lit("out"), F.col("user_id"))
    b = F.create_map(F.lit("in"), F.when(F.col("event_id") % 2 == 0, F.lit(5).cast("bigint")))
    return _events(spark, sf).select("event_id", F.explode(L.add_usage(a, b)).alias("k", "n"))


@register("call_gaps", "select event_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts)) over (partition by user_id order by event_id) / 1e6, 3) gap_s from events")
def call_gaps(spark, sf):
    """Seconds since a run's last call: what a throttle would have had to wait for."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = _events(spark, sf).select("event_id", "user_id", t.alias("t"))
    return L.running(e, "user_id", "event_id", "t").select("event_id", F.round("delta_t", 3).alias("gap_s"))


@register("deepest_files", "select conv_id, turn, case (conv_id + turn) % 3 when 0 then 'solution.py' when 1 then 'test_solution.py' end file from conversations")
def deepest_files(spark, sf):
    """The file of a trace's last place, with the turns' texts as what was printed between."""
    kind, text = (F.col("conv_id") + F.col("turn")) % 3, F.coalesce("text", F.lit(""))
    first, last = F.when(kind == 0, "test_solution.py:3: in t\n").when(kind == 1, "solution.py:9: in f\n"), F.when(kind == 0, "\nsolution.py:9: KeyError").when(kind == 1, "\ntest_solution.py:3: AssertionError")
    return table(spark, sf, "conversations").select("conv_id", "turn", A.deepest_file(F.concat(F.coalesce(first, F.lit("")), text, F.coalesce(last, F.lit("")))).alias("file"))


@register("exceptions", """with t as (select conv_id, turn, (conv_id + turn) % 5 k, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')) x from conversations)
select conv_id, turn, case k when 0 then 'KeyError' when 1 then 'ValueError' when 2 then 'Exception' when 3 then 'ZeroDivisionError' else 'json.JSONDecodeError' end as type,
case k when 1 then rtrim('bad: ' || x) when 2 then case when x = '' then 'so' else substr(x, 1, 120) end else x end message from t""")
def exceptions(spark, sf):
    """The last exception and its message: in a file, the last of several lines, none, marked, and behind other text; messages are the turns' texts."""
    kind, x = (F.col("conv_id") + F.col("turn")) % 5, F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(kind == 0, said("Traceback\nsolution.py:9: KeyError: ", x)).when(kind == 1, said("KeyError: x\nValueError: bad: ", x, "\n")).when(kind == 2, said("so\n", x))
        .when(kind == 3, said("E   ZeroDivisionError: ", x)).otherwise(said(x, "\njson.JSONDecodeError: ", x))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", A.exception_of(text).alias("x")).select("conv_id", "turn", "x.type", "x.message")
