"""Registered queries on retrieval: tokens, BM25+, dense, fusion, store."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.catalog import register, table
from corvane.functions import text as X
from corvane.functions.arrays import histogram, unrolled
from corvane.functions.vectors import embed_dense, hash_embed
from corvane.operators import evaluation as E
from corvane.operators import fusion, store
from corvane.operators.dense import DenseIndex
from corvane.operators.lexical import LexicalIndex
from corvane.sources.durable import durable, gone_at_exit, small, spread

_TOKENS = r"""flat as (select doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+(?:\.[a-z0-9_]+)*')) t from documents),
toks as (select doc_id, lang, t tok from flat union all select doc_id, lang, unnest(string_split(t, '.')) from flat where contains(t, '.'))"""
_BM25 = (
    _TOKENS
    + r""", post as (select tok, doc_id id, lang, count(*) tf from toks group by all), dl as (select doc_id, count(*) dl from toks group by 1),
sizes as (select d.doc_id id, coalesce(dl, 0) dl from documents d left join dl using (doc_id)), st as (select count(*) n, avg(dl) avgdl from sizes),
df as (select tok, count(*) df from post group by 1),
qflat as (select item_id qid, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+(?:\.[a-z0-9_]+)*')) t from benchmark),
qtok as (select qid, t tok from qflat union all select qid, unnest(string_split(t, '.')) from qflat where contains(t, '.')),
w as (select qid, tok, count(*) * ln((any_value(n) + 1) / any_value(df)) w from qtok join df using (tok), st group by all),
fl as (select qid, sum(w) f from w group by 1),
sc as (select qid, id, sum(w * tf * 2.5 / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf)) s from post join w using (tok) join sizes using (id), st {where} group by all),
bm as (select qid, id, s + f score, row_number() over (partition by qid order by round(s + f, 9) desc, id) rank from sc join fl using (qid))"""
)
_DENSE = """q as (select vec_id qid, embedding e, label qset from embeddings where {asked}),
de as (select qid, qset, vec_id id, list_cosine_similarity(e::double[], embedding::double[]) score from q, embeddings),
dr as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) rank from de)"""


def _docs(spark, sf):
    return table(spark, sf, "documents")


_INDEXES: dict[tuple, object] = {}


def _kept(spark, sf, name, build, kind=""):
    """What is built once for a session's queries on the same files, told by their names, sizes and times."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    key = (spark.sparkContext.applicationId, name, kind, *sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files))
    if key not in _INDEXES:
        _INDEXES[key] = build()
    return _INDEXES[key]


def _index(spark, sf):
    return _kept(spark, sf, "documents", lambda: LexicalIndex.build(_docs(spark, sf), "doc_id", keep=("lang",)))


def _items(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _cells(spark, sf):
    return _kept(spark, sf, "embeddings", lambda: DenseIndex.build(_vectors(spark, sf), keep=("label",)))


def _asked(spark, sf):
    return _vectors(spark, sf).where("id % 100 = 0").select(F.col("id").alias("qid"), "vec", F.col("label").alias("qset"))


@register("tokens_freq", f"with {_TOKENS} select tok, count(*) n, count(distinct doc_id) df from toks group by 1")
def tokens_freq(spark, sf):
    """How often each token occurs, and in how many documents."""
    per = histogram(spread(_docs(spark, sf).select("text")).select(X.tokenize("text").alias("t")), "t", "h")
    return unrolled(per, "h").groupBy(F.col("value").alias("tok")).agg(F.sum("n").alias("n"), F.count("*").alias("df"))


@register("bm25_topk", f"with {_BM25.format(where='')} select qid, id, round(score, 6) score, rank from bm where rank <= 10")
def bm25_topk(spark, sf):
    """The ten best documents of every benchmark item."""
    return _index(spark, sf).search(_items(spark, sf), 10).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("bm25_filtered", "with " + _BM25.format(where="where post.lang = 'de'") + " select qid, id, round(score, 6) score, rank from bm where rank <= 5")
def bm25_filtered(spark, sf):
    """The five best German documents of every item, with the statistics of all documents."""
    return _index(spark, sf).search(_items(spark, sf), 5, {"lang": "de"}).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("dense_topk", f"with {_DENSE.format(asked='vec_id % 100 = 0')} select qid, id, round(score, 6) score, rank from dr where rank <= 10")
def dense_topk(spark, sf):
    """The ten nearest vectors of every hundredth one."""
    return _cells(spark, sf).search(_asked(spark, sf), 10).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("dense_filtered", f"with {_DENSE.format(asked='vec_id % 100 = 0').replace('from q, embeddings', 'from q, embeddings where label = 3')} select qid, id, round(score, 6) score, rank from dr where rank <= 5 and score >= 0.0")
def dense_filtered(spark, sf):
    """The same among the vectors of one label, with a floor on the score."""
    found = _cells(spark, sf).search(_asked(spark, sf), 5, where={"label": 3}, min_score=0.0)
    return found.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("dense_multi_max", f"with {_DENSE.format(asked='vec_id % 100 = 0')}, b as (select qset, id, max(score) score, min([qid, rank]) came from dr where rank <= 5 group by all having max(score) >= 0.2), r as (select *, row_number() over (partition by qset order by round(score, 9) desc, came, id) rank from b) select qset, id, round(score, 6) score, rank from r where rank <= 5")
def dense_multi_max(spark, sf):
    """Queries of one label merged: five of each, the best score per vector, a floor, five in all."""
    asked = _asked(spark, sf)
    ranked = _cells(spark, sf).search(asked, 5).join(asked.select("qid", "qset"), "qid")
    return fusion.merge_max(ranked, 5, 0.2).select("qset", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_STORE = (
    "with final as (select doc_id, lang, case when lang = 'de' then text || ' revised ' || source else text end text from documents), "
    + _BM25.format(where="").replace("from documents", "from final")
    + """, texts as (select 'd' src, doc_id id, text from final union all select 'q', item_id, text from benchmark),
tk as (select src, id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_.]+')) t from texts), ce as (select src, id, (('0x' || substr(sha256(t), 1, 16))::ubigint % 64)::int cell, count(*) n from tk group by all),
un as (select src, id, cell, n / sqrt(sum(n * n) over (partition by src, id)) w from ce),
dv as (select q.id qid, d.id, sum(q.w * d.w) score from un q join un d on q.src = 'q' and d.src = 'd' and q.cell = d.cell group by all),
dn as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) rank from dv)
select 'words' route, qid, rank, round(score, 6) score from bm where rank <= 5 union all select 'vectors', qid, rank, round(score, 6) from dn where rank <= 5"""
)


@register("store_searches", _STORE)
def store_searches(spark, sf):
    """A collection after two batches, the second of which replaces all German texts: searched by a second object, which builds nothing."""
    docs, items = _docs(spark, sf), _items(spark, sf)
    name = f"searched-{uuid.uuid4().hex}"

    def opened():
        return store.ChunkStore(spark, name, embed=lambda rows: embed_dense(rows, "n", "text"), words=F.col("text"))

    first = opened()
    gone_at_exit(spark, first.root)
    batch = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("lang").alias("library"), "source", F.col("doc_id").alias("seq"))
    first.upsert(batch, "seq")
    first.upsert(batch.where("library = 'de'").withColumn("text", F.concat("text", F.lit(" revised "), "source")), "seq")
    second = opened()
    words = second.lexical().search(items, 5).select(F.lit("words").alias("route"), "qid", "rank", "score")
    asked = embed_dense(items, "qid", "text").withColumnRenamed("id", "qid")
    both = words.unionByName(second.dense().search(asked, 5).select(F.lit("vectors").alias("route"), "qid", "rank", "score"))
    return both.select("route", "qid", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


_QUALITY = (
    "with "
    + _BM25.format(where="")
    + """, texts as (select 'd' src, doc_id id, text from documents union all select 'q', item_id, text from benchmark),
tk as (select src, id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_.]+')) t from texts), ce as (select src, id, (('0x' || substr(sha256(t), 1, 16))::ubigint % 64)::int cell, count(*) n from tk group by all),
un as (select src, id, cell, n / sqrt(sum(n * n) over (partition by src, id)) w from ce),
dv as (select q.id qid, d.id, sum(q.w * d.w) score from un q join un d on q.src = 'q' and d.src = 'd' and q.cell = d.cell group by all),
dn as (select *, row_number() over (partition by qid order by round(score, 9) desc, id) rank from dv qualify rank <= 20),
parts as (select qid, id, 1.0::double / (60 + rank) part, score cos, [0, rank] came from dn union all select qid, id, 1.0::double / (60 + rank), null, [1, rank] from bm where rank <= 20),
fu as (select qid, id, sum(part) score, coalesce(max(cos), 0) best, min(came) came from parts group by all),
fr as (select *, row_number() over (partition by qid order by round(score, 9) desc, round(best, 9) desc, came, id) rank from fu),
r as (select 'words' route, qid, id, rank from bm union all select 'vectors', qid, id, rank from dn union all select 'hybrid', qid, id, rank from fr),
hits as (select route, qid, min(rank) as rank from r join documents d on d.doc_id = r.id join benchmark b on b.item_id = r.qid where rank <= 20 and contains(lower(d.text), lower(b.text)) group by all),
ev as (select m.route kind, item_id, f.rank from benchmark cross join (values ('words'), ('vectors'), ('hybrid')) m(route) left join hits f on f.qid = item_id and f.route = m.route)
select kind, count(*) queries, round(avg((coalesce(rank, 99) <= 1)::int), 6) hit_1, round(avg((coalesce(rank, 99) <= 5)::int), 6) hit_5, round(avg((coalesce(rank, 99) <= 10)::int), 6) hit_10, round(avg(coalesce(1.0::double / rank, 0)), 6) mrr, round(avg(rank), 6) mean_rank from ev group by grouping sets ((), (kind))"""
)


def _text_cells(spark, sf):
    return _kept(spark, sf, "documents", lambda: DenseIndex.build(embed_dense(_docs(spark, sf), "doc_id", "text")), "vectors")


@register("search_quality", _QUALITY)
def search_quality(spark, sf):
    """How soon a document comes that holds the item's whole text, by words, by hashed vectors and by both: hit rates, reciprocal and mean ranks. Only what was found is looked into."""
    items, k = _items(spark, sf), 20
    asked = embed_dense(items, "qid", "text").select(F.col("id").alias("qid"), "vec", F.col("id").alias("qset"))
    # Each side is searched once: the hybrid ranks fuse what was found.
    found = {"words": durable(_index(spark, sf).search(items, k), "found"), "vectors": durable(_text_cells(spark, sf).search(asked, k, min_score=0.0), "found")}
    found["hybrid"] = fusion.rrf(*[found[route].join(asked.select("qid", "qset"), "qid") for route in ("vectors", "words")], k).withColumnRenamed("qset", "qid")
    ranks = durable(reduce(DataFrame.unionByName, [df.select(F.lit(route).alias("kind"), "qid", "id", F.col("rank").cast("bigint").alias("rank")) for route, df in found.items()]), "ranks")
    shown = F.broadcast(ranks) if small(ranks) else ranks
    held = _docs(spark, sf).select(F.col("doc_id").alias("id"), "text").join(shown, "id").select("kind", "qid", "rank", F.lower("text").alias("held")).join(items.select("qid", F.lower("text").alias("asked")), "qid")
    first = held.where(F.contains("held", "asked")).groupBy("kind", "qid").agg(F.min("rank").alias("rank"))
    every = items.select("qid", F.explode(F.array(*map(F.lit, found))).alias("kind"))
    return E.ranking_metrics(every.join(first, ["kind", "qid"], "left"))


_HYBRID = (
    "with "
    + _BM25.format(where="")
    + ", "
    + _DENSE.format(asked="vec_id in (select item_id from benchmark)")
    + """, dk as (select qid, id, score, row_number() over (partition by qid order by round(score, 9) desc, id) rank from dr where rank <= 10 and score >= 0.2),
parts as (select qid % 10 qset, id, 1.0::double / (60 + rank) part, score cos, [qid, 0, rank] came from dk union all select qid % 10, id, 1.0::double / (60 + rank), null, [qid, 1, rank] from bm where rank <= 10),
fu as (select qset, id, sum(part) score, coalesce(max(cos), 0) best, min(came) came from parts group by all),
fr as (select *, row_number() over (partition by qset order by round(score, 9) desc, round(best, 9) desc, came, id) rank from fu)
select qset, id, round(score, 6) score, round(best, 6) best, rank, 'hybrid' route from fr where rank <= 10"""
)


@register("retrieve_hybrid", _HYBRID)
def retrieve_hybrid(spark, sf):
    """The flagship: every benchmark item, by vector and by words, fused within sets of items."""
    vec = _vectors(spark, sf)
    queries = _items(spark, sf).join(vec.select(F.col("id").alias("qid"), "vec"), "qid", "left").withColumn("qset", F.col("qid") % 10)
    found = fusion.hybrid(_cells(spark, sf), _index(spark, sf), queries, k=10, adaptive=False)
    return found.select("qset", "id", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"), F.col("rank").cast("bigint").alias("rank"), "route")


_ADAPTIVE = (
    r"with asked as (select item_id qid, case when item_id % 2 = 1 then regexp_extract(text, '[A-Za-z]+') || '.' || regexp_extract(text, '[A-Za-z]+[^A-Za-z]+([A-Za-z]+)', 1) else text end t from benchmark), "
    r"gate as (select qid, t, coalesce(regexp_matches(trim(t), '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]+') or regexp_matches(trim(t), '^[A-Z][A-Za-z0-9]*$'), false) sym from asked), "
    + _BM25.format(where="").replace("select item_id qid, unnest(regexp_extract_all(lower(text),", "select qid, unnest(regexp_extract_all(lower(t),").replace("from benchmark)", "from gate where sym)")
    + ", "
    + _DENSE.format(asked="vec_id in (select item_id from benchmark)")
    + """, dk as (select qid, id, score, row_number() over (partition by qid order by round(score, 9) desc, id) rank from dr where rank <= 5 and score >= 0.2),
parts as (select qid qset, id, 1.0::double / (60 + rank) part, score cos, [0, rank] came from dk union all select qid, id, 1.0::double / (60 + rank), null, [1, rank] from bm where rank <= 5),
fu as (select qset, id, sum(part) score, coalesce(max(cos), 0) best, min(came) came from parts group by all),
fr as (select *, row_number() over (partition by qset order by round(score, 9) desc, round(best, 9) desc, came, id) rank from fu)
select qset, id, round(score, 6) score, round(best, 6) best, rank, case when sym then 'hybrid' else 'dense' end route from fr join gate on qid = qset where rank <= 5"""
)


@register("retrieve_adaptive", _ADAPTIVE)
def retrieve_adaptive(spark, sf):
    """Every benchmark item, every other one as a dotted name: those ask the words too, the others the vectors alone."""
    vec = _vectors(spark, sf)
    dotted = F.concat(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("."), F.regexp_extract("text", "[A-Za-z]+[^A-Za-z]+([A-Za-z]+)", 1))
    asked = _items(spark, sf).withColumn("text", F.when(F.col("qid") % 2 == 1, dotted).otherwise(F.col("text")))
    queries = asked.join(vec.select(F.col("id").alias("qid"), "vec"), "qid", "left").withColumn("qset", F.col("qid"))
    found = fusion.hybrid(_cells(spark, sf), _index(spark, sf), queries, k=5)
    return found.select("qset", "id", F.round("score", 6).alias("score"), F.round("best", 6).alias("best"), F.col("rank").cast("bigint").alias("rank"), "route")


@register("symbol_gate", r"select page_id, coalesce(regexp_matches(trim(url), '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]+') or regexp_matches(trim(url), '^[A-Z][A-Za-z0-9]*$'), false) as symbol from pages")
def symbol_gate(spark, sf):
    """Which addresses would ask the lexical index."""
    return table(spark, sf, "pages").select("page_id", F.coalesce(X.is_symbol_query("url"), F.lit(False)).alias("symbol"))


@register("hash_embed", r"with t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_.]+')) t from documents), c as (select doc_id, (('0x' || substr(sha256(t), 1, 16))::ubigint % 64)::int cell, count(*) n from t group by all), s as (select doc_id, sqrt(sum(n * n)) l from c group by 1) select doc_id, cell, round(n / l, 6) weight from c join s using (doc_id)")
def hash_embedding(spark, sf):
    """Every document's hashed bag of tokens, of unit length."""
    return hash_embed(_docs(spark, sf), "doc_id", "text").select(F.col("id").alias("doc_id"), "cell", F.round("weight", 6).alias("weight"))


@register("stable_ids", "select doc_id, substr(sha1(concat(doc_id::varchar, chr(0), coalesce(lang, ''), chr(0), coalesce(source, ''))), 1, 16) chunk_id from documents")
def stable_ids(spark, sf):
    """Ids by content, the same on every machine."""
    return _docs(spark, sf).select("doc_id", X.stable_id("doc_id", "lang", "source").alias("chunk_id"))


@register("upsert_last_wins", "select source id, arg_max(lang, doc_id) lang, max(doc_id) last_doc, min(doc_id) first_seq from documents group by 1")
def upsert_last_wins(spark, sf):
    """A batch with many rows per key: the last one wins and keeps the first one's place."""
    batch = _docs(spark, sf).select(F.col("source").alias("id"), "lang", F.col("doc_id").alias("last_doc"), F.col("doc_id").alias("seq"))
    return store.last_wins(batch, "seq")


@register("library_counts", "select coalesce(lang, '') lang, count(*) n from documents group by 1")
def library_counts(spark, sf):
    """Documents by language, those without one under ''."""
    return store.counts(_docs(spark, sf), "lang")


@register("distinct_written", "select count(*) n_rows, count(distinct text) written from documents")
def distinct_written(spark, sf):
    """Rows offered against distinct ids written, by content."""
    return _docs(spark, sf).select(X.stable_id("text").alias("id")).groupBy("id").count().agg(F.sum("count").alias("n_rows"), F.count("*").alias("written"))


_LISTS = """new as (select lang k, doc_id id, n_chars::double score, row_number() over (partition by lang order by n_chars desc, doc_id) pos from documents qualify pos <= 6),
prior as (select lang k, doc_id id, n_chars::double score, row_number() over (partition by lang order by doc_id) pos from documents qualify pos <= 6)"""


def _lists(spark, sf):
    d = _docs(spark, sf).select(F.col("lang").alias("key"), F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"))
    longest = d.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))).where("pos <= 6")
    return longest, d.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where("pos <= 6")


@register("merge_prior_docs", f"with {_LISTS}, b as (select *, 0 src from new union all select prior.*, 1 from prior anti join new using (k, id)) select k as key, id, score, place as pos from (select *, row_number() over (partition by k order by src, pos) place from b) where place <= 8")
def merge_prior_docs(spark, sf):
    """New documents, then prior ones that are not among them, eight in all."""
    return fusion.merge_prior(*_lists(spark, sf), cap=8).withColumn("pos", F.col("pos").cast("bigint"))


@register("context_prefix", "with r as (select source, doc_id, sum(length(text) + 2) over (partition by source order by doc_id) total from documents) select source, doc_id, total::bigint total from r where total <= 60000")
def context_prefix(spark, sf):
    """Per source, the documents in order that fit into one context."""
    ranked = _docs(spark, sf).select(F.col("source").alias("key"), F.col("doc_id").alias("pos"), "text")
    return fusion.context_prefix(ranked, 60_000).select(F.col("key").alias("source"), F.col("pos").alias("doc_id"), "total")


@register("seen_queries", "select k as key, count(*) n, bool_and(id in (select id from prior p where p.k = new.k)) all_seen from new group by 1".join([f"with {_LISTS} ", ""]))
def seen_queries(spark, sf):
    """Whether all of a key's new entries are among its prior ones."""
    new, prior = _lists(spark, sf)
    known = prior.select("key", "id", F.lit(True).alias("known"))
    return new.join(known, ["key", "id"], "left").groupBy("key").agg(F.count("*").alias("n"), F.min(F.coalesce("known", F.lit(False))).alias("all_seen"))


@register("split_markdown")
def split_markdown(spark, sf):
    """Pieces of every document under headings, with overlap."""
    from corvane.functions.chunking import splitter

    return _docs(spark, sf).select("doc_id", F.posexplode(splitter()("text")).alias("i", "piece"))


@register("piece_overlap")
def piece_overlap(spark, sf):
    """How many of a document's pieces begin with a stretch of the one before."""
    w = Window.partitionBy("doc_id").orderBy("i")
    p = split_markdown(spark, sf).withColumn("before", F.lag("piece").over(w))
    return p.where("before is not null").groupBy("doc_id").agg(F.count("*").alias("pieces"), F.count_if(F.contains("before", F.substring("piece", 1, 20))).alias("overlapping"))


@register("cosine_neighbours", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_neighbours(spark, sf):
    """Each vector against the next."""
    from corvane.functions.vectors import cosine

    v = _vectors(spark, sf)
    after = v.select((F.col("id") - 1).alias("id"), F.col("vec").alias("other"))
    return v.join(after, "id").select(F.col("id").alias("vec_id"), F.round(cosine(F.col("vec"), F.col("other")), 6).alias("score"))


@register("normalized", "with n as (select vec_id, embedding e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) l from embeddings) select vec_id, i - 1 as i, round(case when l = 0 then e[i] else e[i]::double / l end, 6) x from n, unnest(range(1, len(e) + 1)) u(i)")
def normalized(spark, sf):
    """All components of vectors of unit length."""
    from corvane.functions.vectors import l2_normalize

    return _vectors(spark, sf).select(F.col("id").alias("vec_id"), F.posexplode(l2_normalize(F.col("vec"))).alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@register("corpus_union", "select kind, count(*) n, sum(length(coalesce(text, '')))::bigint chars from (select 'text' kind, text from documents union all select 'page', html from pages) group by 1")
def corpus_union(spark, sf):
    """Chunks of two sources together."""
    docs = _docs(spark, sf).select(F.lit("text").alias("kind"), "text")
    both = docs.unionByName(table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("text")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@register("embed_sources", "select doc_id, case when coalesce(lang, '') = 'en' or lang is null then text else lang end source_text from documents")
def embed_sources(spark, sf):
    """What would be embedded where a short form is given for some."""
    short = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang"))
    return _docs(spark, sf).select("doc_id", store.embed_source(F.col("text"), short).alias("source_text"))
