"""Fusion of rankings: merge of many queries, Reciprocal Rank Fusion, and the gate that asks the lexical index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import is_symbol_query
from corvane.operators import dense
from corvane.operators.dense import DenseIndex
from corvane.operators.lexical import LexicalIndex
from corvane.operators.store import where as equal


def merge_max(ranked: DataFrame, k: int, min_score: float, order: str = "qid") -> DataFrame:
    """(qset, id, score, rank): rankings of a set's queries merged by their best score, floored, then cut; ties go to what came first, by query (order) and rank."""
    best = ranked.groupBy("qset", "id").agg(F.max("score").alias("score"), F.min(F.struct(order, "rank")).alias("_came")).where(F.col("score") >= min_score)
    w = Window.partitionBy("qset").orderBy(F.desc(F.round("score", 9)), "_came", "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_came")


def rrf(dense_ranks: DataFrame, lexical_ranks: DataFrame, k: int, rrf_k: int = 60, dense_weight: float = 1.0, bm25_weight: float = 1.0, order: str = "qid") -> DataFrame:
    """(qset, id, score, best, rank) by the sum of weight / (rrf_k + rank) over both rankings (qset, id, score, rank, order).

    Equal sums go by the best cosine, then to what came first: by query (order), its vectors before its words, and rank.
    """
    at = max(1, int(rrf_k))
    parts = []
    for df, weight, cosine, route in ((dense_ranks, dense_weight, F.col("score"), 0), (lexical_ranks, bm25_weight, F.lit(None).cast("double"), 1)):
        parts.append(df.select("qset", "id", (F.lit(weight) / (at + F.col("rank"))).alias("part"), cosine.alias("cos"), F.struct(order, F.lit(route).alias("route"), F.col("rank").cast("bigint").alias("rank")).alias("came")))
    fused = parts[0].unionByName(parts[1]).groupBy("qset", "id").agg(F.sum("part").alias("score"), F.coalesce(F.max("cos"), F.lit(0.0)).alias("best"), F.min("came").alias("_came"))
    w = Window.partitionBy("qset").orderBy(F.desc(F.round("score", 9)), F.desc(F.round("best", 9)), "_came", "id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_came")


def hybrid(vectors: DataFrame | DenseIndex, index: LexicalIndex | None, queries: DataFrame, k: int = 5, min_score: float = 0.2, rrf_k: int = 60, dense_weight: float = 1.0, bm25_weight: float = 1.0, adaptive: bool = True, where: dict | None = None) -> DataFrame:
    """(qset, id, score, best, rank, route) for queries (qset, qid, text, vec).

    Each query's k nearest at min_score or above are ranked; the lexical ranking joins in for symbol queries, or for all where not
    adaptive. The score is the fused one on either route. Without an index all are dense.
    """
    sets = queries.select("qid", "qset")
    if isinstance(vectors, DenseIndex):
        near = vectors.search(queries, k, where=where, min_score=min_score)
    else:
        near = dense.search(vectors, queries, k, where=equal(where) if where else None, min_score=min_score)
    near = near.join(sets, "qid")
    if index is None:
        return rrf(near, near.limit(0), k, rrf_k, dense_weight, bm25_weight).join(queries.select("qset").distinct().withColumn("route", F.lit("dense")), "qset")
    asked = queries if not adaptive else queries.where(is_symbol_query("text"))
    words = index.search(asked.select("qid", "text"), k, where).join(sets, "qid")
    route = queries.groupBy("qset").agg(F.when(F.max((F.lit(not adaptive) | is_symbol_query("text")).cast("int")) == 1, "hybrid").otherwise("dense").alias("route"))
    return rrf(near, words, k, rrf_k, dense_weight, bm25_weight).join(route, "qset")


def merge_prior(new: DataFrame, prior: DataFrame, cap: int = 8) -> DataFrame:
    """(key, id, score, pos): new rows by position, then prior rows that are not among them, cap in all. Inputs: (key, id, score, pos)."""
    rest = prior.join(new.select("key", "id"), ["key", "id"], "left_anti")
    both = new.withColumn("src", F.lit(0)).unionByName(rest.withColumn("src", F.lit(1)))
    w = Window.partitionBy("key").orderBy("src", "pos")
    return both.withColumn("at", F.row_number().over(w)).where(F.col("at") <= cap).select("key", "id", "score", F.col("at").alias("pos"))


def context_prefix(ranked: DataFrame, max_chars: int = 6000) -> DataFrame:
    """(key, pos, total, ...) while the running length of texts with two separators each stays within max_chars. Input: (key, pos, text, ...).

    A text counts two at least, so more than half of max_chars of them never fit: partitions are cut to so many before the shuffle,
    and lengths stand in for texts where the texts are not asked for.
    """
    w = Window.partitionBy("key").orderBy("pos")
    near = ranked.withColumn("_size", F.coalesce(F.length("text"), F.lit(0)) + 2).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(max_chars // 2, 0))
    return near.withColumn("total", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= max_chars).drop("_size", "_n")
