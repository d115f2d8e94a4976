"""Registered queries on evaluation: graded cells are the labels of documents, by language as mode."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.catalog import register, table
from corvane.operators import dense
from corvane.operators import evaluation as E
from corvane.plans import loop

_REC = """rec as (select doc_id task_id, lang as mode, quality = 1 passed, toxic = 0 first_try, quality + 1 attempts, (n_chars % 7)::int llm_calls, n_chars total_tokens, n_chars / 10.0 wall_s,
  case when n_chars % 13 = 0 then 'error' when quality = 1 then 'approved' else 'failed' end status, 1 schema_version from documents join labels using (doc_id))"""


def _records(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return d.select(
        F.col("doc_id").alias("task_id"), F.col("lang").alias("mode"), (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 0).alias("first_try"), (F.col("quality") + 1).alias("attempts"),
        (F.col("n_chars") % 7).cast("int").alias("llm_calls"), F.col("n_chars").alias("total_tokens"), (F.col("n_chars") / 10.0).alias("wall_s"),
        F.when(F.col("n_chars") % 13 == 0, "error").when(F.col("quality") == 1, "approved").otherwise("failed").alias("status"), F.lit(1).alias("schema_version"),
    )


_TWO = """two as (select doc_id task_id, 'quality' as mode, quality = 1 passed, quality::int attempts, 1 llm_calls, case when doc_id % 11 = 0 then 'error' else 'failed' end status, 1 schema_version from labels
  union all select doc_id, 'length', coalesce(n_chars > 800, false), case when n_chars > 800 then 1 else 2 end, 2, 'approved', case when doc_id % 5 = 0 then 2 else 1 end from documents)"""


def _two(spark, sf):
    """Records in two modes: one for every label, one for every document."""
    l = table(spark, sf, "labels").withColumnRenamed("doc_id", "task_id")  # noqa: E741
    a = l.select("task_id", F.lit("quality").alias("mode"), (F.col("quality") == 1).alias("passed"), F.col("quality").cast("int").alias("attempts"), F.lit(1).alias("llm_calls"), F.when(F.col("task_id") % 11 == 0, "error").otherwise("failed").alias("status"), F.lit(1).alias("schema_version"))
    d, long = table(spark, sf, "documents").withColumnRenamed("doc_id", "task_id"), F.coalesce(F.col("n_chars") > 800, F.lit(False))
    b = d.select("task_id", F.lit("length").alias("mode"), long.alias("passed"), F.when(long, 1).otherwise(2).alias("attempts"), F.lit(2).alias("llm_calls"), F.lit("approved").alias("status"), F.when(F.col("task_id") % 5 == 0, 2).otherwise(1).alias("schema_version"))
    return a.union(b)


def _tasks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"))


@register("mode_summary", f"with {_REC} select mode, count(*) runs, count_if(passed)::bigint n_passed, round(avg(passed::int), 6) pass_rate, count_if(first_try)::bigint n_first_try, round(avg(attempts), 6) mean_attempts, round(avg(llm_calls), 6) mean_llm_calls, round(avg(total_tokens), 6) mean_tokens, round(median(wall_s::double), 6) median_wall_s from rec group by 1")
def mode_summary(spark, sf):
    """Runs, rates, means and medians by mode."""
    return E.mode_summary(_records(spark, sf))


@register("complete_records", f"with {_REC} select mode, count(*) n, count_if(status in ('approved', 'failed'))::bigint complete from rec group by 1")
def complete_records(spark, sf):
    """Records that count, by mode."""
    return _records(spark, sf).groupBy("mode").agg(F.count("*").alias("n"), F.count_if(E.is_complete()).alias("complete"))


@register("paired_2x2", f"with {_TWO}, p as (select a.passed pa, b.passed pb, a.llm_calls - b.llm_calls dl, a.attempts - b.attempts da from two a join two b using (task_id) where a.mode = 'quality' and b.mode = 'length') select count(*) pairs, count_if(pa and pb)::bigint as \"both\", count_if(pa and not pb)::bigint only_a, count_if(not pa and pb)::bigint only_b, count_if(not pa and not pb)::bigint neither, round(avg(dl), 6) diff_llm_calls, round(avg(da), 6) diff_attempts from p")
def paired_2x2(spark, sf):
    """Both modes of a task against each other."""
    return E.paired(_two(spark, sf), "quality", "length")


@register("pivot_cells", f"with {_TWO}, c as (select task_id, mode, case when status = 'error' then 'error' else (case when passed then 'PASS' else 'FAIL' end) || ' a=' || attempts || ' c=' || llm_calls end cell from two) select d.doc_id task_id, coalesce(max(cell) filter (mode = 'quality'), '-') quality, coalesce(max(cell) filter (mode = 'length'), '-') as length from documents d left join c on c.task_id = d.doc_id group by 1")
def pivot_cells(spark, sf):
    """One row a task, one column a mode."""
    return E.cells(_tasks(spark, sf), _two(spark, sf), ("quality", "length"))


@register("incomplete_pairs", f"with {_TWO}, f as (select task_id from two where status in ('approved', 'failed') and schema_version = 1 group by 1 having count(distinct mode) = 2) select doc_id task_id from documents where doc_id not in (select task_id from f)")
def incomplete_pairs(spark, sf):
    """Tasks without a full pair."""
    return E.incomplete_pairs(_tasks(spark, sf), _two(spark, sf), "quality", "length")


@register("paired_ids", f"with {_TWO} select task_id from two where mode = 'quality' intersect select task_id from two where mode = 'length'")
def paired_ids(spark, sf):
    """Tasks that both modes have."""
    two = _two(spark, sf)
    return two.where("mode = 'quality'").select("task_id").intersect(two.where("mode = 'length'").select("task_id"))


@register("unknown_ids", "select doc_id task_id from documents except select doc_id from labels")
def unknown_ids(spark, sf):
    """Ids asked for that no task has."""
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("task_id"))
    return asked.exceptAll(table(spark, sf, "labels").select(F.col("doc_id").alias("task_id"))).distinct()


@register("grid_pending", f"with {_TWO}, g as (select doc_id task_id, mode from documents, (values ('quality'), ('length')) m(mode)) select task_id, mode from g anti join (select * from two where status in ('approved', 'failed') and schema_version = 1) d using (task_id, mode)")
def grid_pending(spark, sf):
    """Cells of the grid still to run."""
    modes = spark.createDataFrame([("quality", 0), ("length", 1)], "mode string, mode_no int")
    return E.pending(_tasks(spark, sf), modes, _two(spark, sf))


_RANKS = """q as (select vec_id qid, embedding e, label l from embeddings where vec_id % 100 = 0),
s as (select qid, l, label, vec_id id, list_cosine_similarity(e::double[], embedding::double[]) score from q, embeddings where vec_id <> qid),
r as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) rank from s),
f as (select qid, any_value(l) % 2 kind, min(rank) filter (label = l) as rank from r where rank <= 20 group by 1)"""


@register("hit_mrr", f"with {_RANKS} select kind, count(*) queries, round(avg((coalesce(rank, 99) <= 1)::int), 6) hit_1, round(avg((coalesce(rank, 99) <= 5)::int), 6) hit_5, round(avg((coalesce(rank, 99) <= 10)::int), 6) hit_10, round(avg(coalesce(1.0::double / rank, 0)), 6) mrr, round(avg(rank), 6) mean_rank from f group by grouping sets ((), (kind))")
def hit_mrr(spark, sf):
    """How soon a vector of the query's own label comes: hit rates, reciprocal and mean ranks, overall and by kind."""
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    asked = vec.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec", F.col("label").alias("expected"))
    near = dense.search(vec, asked, 21).where("id <> qid").join(vec.select("id", "label"), "id").join(asked.select("qid", "expected"), "qid")
    w = Window.partitionBy("qid").orderBy("rank")
    ranked = near.withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    first = ranked.groupBy("qid", "expected").agg(F.min(F.when(F.col("label") == F.col("expected"), F.col("rank"))).alias("rank"))
    return E.ranking_metrics(first.withColumn("kind", F.col("expected") % 2))


@register("p95_events", "with s as (select event_type, list_sort(list(value)) v, count(value) n from events group by 1) select event_type, v[(least(n - 1, round_even(0.95::double * (n - 1), 0)))::int + 1] p95, n from s")
def p95_events(spark, sf):
    """The 95th percentile of values by type, without interpolation."""
    return E.p95(table(spark, sf, "events"), "value", ("event_type",))


@register("p95_all", "with s as (select list_sort(list(value)) v, count(value) n from events) select v[(least(n - 1, round_even(0.95::double * (n - 1), 0)))::int + 1] p95, n from s")
def p95_all(spark, sf):
    """The same over all events."""
    return E.p95(table(spark, sf, "events"), "value")


@register("report_header", f"with {_TWO} select (select count(*) from documents) tasks, count_if(status in ('approved', 'failed') and schema_version = 1)::bigint complete, count_if(status = 'error')::bigint errors, len(list(distinct task_id) filter (status = 'error'))::int n_error_tasks from two")
def report_header(spark, sf):
    """Counts at a report's head."""
    return E.report_header(_tasks(spark, sf), _two(spark, sf))


_ROUTED = "select doc_id, n_chars, quality, toxic from labels join documents using (doc_id)"


@register("route_after_tests", f"select doc_id, case when toxic = 1 then 'fail' when quality = 1 then case when doc_id % 2 = 0 then 'finalize' else 'human_review' end when n_chars % 5 < 3 then 'analyze_error' else 'fail' end next_node from ({_ROUTED})")
def route_after_tests(spark, sf):
    """Where runs go after their tests."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    run = F.when(F.col("toxic") != 1, F.struct((F.col("quality") == 1).alias("passed")))
    return d.select("doc_id", run.alias("run"), (F.col("doc_id") % 2 == 0).alias("auto_approve"), (F.col("n_chars") % 5).alias("retries_used")).select("doc_id", loop.after_run_tests().alias("next_node"))


@register("route_after_review", "select doc_id, case doc_id % 5 when 0 then 'finalize' when 1 then 'run_tests' when 2 then case when n_chars % 4 <= 2 then 'revise' else 'fail' end else 'fail' end next_node from documents")
def route_after_review(spark, sf):
    """Where runs go after a decision."""
    decision = F.get(F.array(*map(F.lit, ("approve", "edit", "reject", "reject_final", "odd"))), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf, "documents").select("doc_id", decision.alias("decision"), (F.col("n_chars") % 4).alias("human_rounds")).select("doc_id", loop.after_review().alias("next_node"))
