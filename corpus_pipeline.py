"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the columns
of documents as they came, extra ones included, whatever their names; the last returns one row per packed piece.

Defined cases: rows without a text pass all stages; of equal texts (empty ones too) one row stays, the least id's, null ids last; repeated rows leave
one; very long texts are scored, compared, searched, rewritten and packed whole; without labels nothing is toxic at the threshold, without
benchmark items nothing is contaminated; an empty table gives no rows. Pseudonyms take the key of the session or of the environment (see ``pii``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, neardup, packing, pii, toxicity
from corvane.llm.common import stash, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; learned from the labels of these documents, but for the held-out fold."""
    return toxicity.drop_toxic(docs, toxicity.learned(spark, docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.drop_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data; n_chars follows the text."""
    out = pii.replace_text(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in a sequence of at most 4096 tokens."""
    return packing.pack(docs, packing.vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxic), ("minhash_neardup", near_duplicates), ("decontamination", benchmark_passages), ("pii", personal_data), ("packing", packed)]
#: SQL cannot express the learned, hashed and sequential stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
