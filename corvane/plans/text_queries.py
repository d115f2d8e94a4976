"""Registered queries on text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalog import register, table
from corvane.functions import text as X


@register("parse_tags", r"select page_id, case when regexp_matches(html, '(?is)<\s*title\s*>') then regexp_extract(html, '(?is)<\s*title\s*>\s*(.*?)\s*(?:</\s*title\s*>|<\s*(?:explanation|code|tests|docs_used)\s*>|\z)', 1) end title from pages")
def parse_tags(spark, sf):
    """What stands in a page's title tag."""
    return table(spark, sf, "pages").select("page_id", X.parse_tagged("html", "title").alias("title"))


@register("reply_bundles", """with t as (select conv_id, turn, turn % 4 k, rtrim('because ' || x) why, rtrim('x = ' || turn || ' # ' || x) code, rtrim('assert ' || turn || ' # ' || x) test
  from (select *, trim(regexp_replace(coalesce(text, ''), '[`<>]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) x from conversations))
select conv_id, turn, case when k = 3 then '' else why end explanation, case when k = 2 then '' else code end code, case when k in (1, 3) then test else '' end tests, case when k = 0 then 2 else 0 end n_docs, case when k = 2 then 'no code found' end error from t""")
def reply_bundles(spark, sf):
    """Model replies of four forms around the turns' texts, parsed into their parts."""
    t, x = F.col("turn").cast("string"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[`<>]", ""), F.lit(" \t\n\r"))
    why, code, test = F.concat(F.lit("because "), x), F.concat(F.lit("x = "), t, F.lit(" # "), x), F.concat(F.lit("assert "), t, F.lit(" # "), x)
    reply = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<think>hm</think><explanation>"), why, F.lit("</explanation><code>\n```python\n"), code, F.lit("\n```\n</code><docs_used>a, b</docs_used>")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("<explanation> "), why, F.lit(" <code>"), code, F.lit("</code><TESTS>"), test, F.lit("</TESTS>")))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("<explanation>"), why, F.lit("</explanation> no more")))
        .otherwise(F.concat(F.lit("so</think>\n```py\n"), code, F.lit("\n```\nand\n```\n"), test, F.lit("\n```")))
    )
    out = table(spark, sf, "conversations").select("conv_id", "turn", X.parse_bundle(reply).alias("b"))
    return out.select("conv_id", "turn", "b.explanation", "b.code", "b.tests", F.size("b.docs_used").alias("n_docs"), "b.error")


@register("fenced_blocks", "select conv_id, turn, 2 n, trim(coalesce(text, ''), ' ' || chr(10)) first_block from conversations where not contains(coalesce(text, ''), '`')")
def fenced_blocks(spark, sf):
    """Blocks in the code fences of every turn; a text without a fence is put into one, with another block behind it. The twin lacks rows with a backtick."""
    t = F.coalesce("text", F.lit(""))
    fenced = F.when(F.contains(t, F.lit("```")), t).otherwise(F.concat(F.lit("a\n```text\n"), t, F.lit("\n```\nb\n```\nx\n```\n")))
    blocks = X.fenced_blocks(fenced)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(blocks).alias("n"), F.get(blocks, F.lit(0)).alias("first_block"))


@register("token_estimate", "select conv_id, sum(ceil(length(coalesce(text, '')) / 4.0))::bigint tokens from conversations group by 1")
def token_estimate(spark, sf):
    """Estimated tokens by conversation."""
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(X.token_estimate("text")).alias("tokens"))


@register("text_views", r"""with c as (select doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) s from documents)
select doc_id, substr(s, 1, 500) short_query, case when length(s) > 600 then substr(s, 1, 600) || '...' else s end snippet,
 trim(regexp_replace(regexp_replace(substr(text, 1, 200), '[^\x00-\x7F]', '?', 'g'), '\s+', ' ', 'g')) head from c""")
def text_views(spark, sf):
    """Texts as shown in queries, result lists and logs."""
    return table(spark, sf, "documents").select("doc_id", X.short_query("text").alias("short_query"), X.snippet("text").alias("snippet"), X.reply_head("text").alias("head"))


@register("truncated", r"""with c as (select doc_id, text, substr(text, 1, 199) w from documents),
d as (select *, regexp_extract(w, '(?s)^(.*[.!?])(\s|\z)', 1) a, regexp_extract(w, '(?s)^(.+)\n', 1) b, regexp_extract(w, '(?s)^(.+) ', 1) e from c)
select doc_id, case when length(text) <= 200 then text else regexp_replace(case when a <> '' then a when b <> '' then b when e <> '' then e else w end, '\s+\z', '') || '…' end as text from d""")
def truncated(spark, sf):
    """Texts cut at a sentence, line or word."""
    return table(spark, sf, "documents").select("doc_id", X.truncate("text", 200).alias("text"))


@register("first_sentences", r"""with c as (select doc_id, source, trim(substr(trim(regexp_replace(string_split_regex(text, '\. |\n\s*\n')[1], '\s+', ' ', 'g')), 1, 200)) h from documents) select doc_id, case when h = '' then source else source || ': ' || h end embed_text from c""")
def first_sentences(spark, sf):
    """What is embedded of each document: its name and first sentence."""
    return table(spark, sf, "documents").select("doc_id", X.first_sentence("source", "text").alias("embed_text"))


@register("truncated_output", """with c as (select doc_id, text, unnest(string_split(text, '')) ch, unnest(range(1, length(text) + 1)) i from documents where strlen(text) > 2000),
s as (select *, sum(strlen(ch)) over (partition by doc_id order by i) upto, strlen(text) total from c),
p as (select doc_id, string_agg(ch, '' order by i) filter (upto <= 980) h, string_agg(ch, '' order by i) filter (total - upto + strlen(ch) <= 980) e from s group by 1),
o as (select d.doc_id, case when strlen(text) <= 2000 then text else h || chr(10) || '...[truncated]...' || chr(10) || e end as text from documents d left join p using (doc_id)) select doc_id, text, strlen(text)::int bytes from o""")
def truncated_output(spark, sf):
    """Long outputs by head and tail, in bytes."""
    out = X.truncate_output("text", 2000)
    return table(spark, sf, "documents").select("doc_id", out.alias("text"), F.octet_length(out).alias("bytes"))


@register("reply_queries", "select conv_id, turn, case when turn % 2 = 0 then 'one;two' else substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 500) end queries from conversations")
def reply_queries(spark, sf):
    """Queries that a model asks for, or the task itself."""
    reply = F.when(F.col("turn") % 2 == 0, F.lit("<queries>\n- one\n* two\n\n- one\n</queries>")).otherwise(F.lit("none"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(X.reply_queries(reply, F.coalesce("text", F.lit(""))), ";").alias("queries"))
