"""Text files as chunks: a recursive scan by suffix, tolerant decoding, splitting, and ids that do not depend on the machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.chunking import splitter
from corvane.functions.text import stable_id

SUFFIXES = ("md", "rst", "txt")


def is_text_file(path: Column | str, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """Whether a path's suffix is one of text files, in either case."""
    return F.coalesce(F.lower(F.col(path) if isinstance(path, str) else path).rlike(rf"\.({'|'.join(suffixes)})\z"), F.lit(False))


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, rel, content) of all files below root with a suffix, in either case; rel is relative to root, with slashes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    named = raw.where(is_text_file("path", suffixes))
    rel = F.regexp_replace(F.col("path"), F.lit(r"\A[a-z0-9+.-]+:/*(?=/)"), F.lit(""))
    start = base.split(":", 1)[1] if ":" in base.split("/", 1)[0] else base
    start = "/" + start.lstrip("/")
    return named.select("path", F.when(rel.startswith(start), F.substring(rel, len(start) + 1, 1 << 20)).otherwise(F.element_at(F.split("path", "/"), -1)).alias("rel"), "content")


def _decoded(raw: bytes) -> str:
    try:
        return bytes(raw).decode("utf-8-sig")
    except UnicodeDecodeError:
        return bytes(raw).decode("utf-8", errors="replace")


def text_chunks(spark: SparkSession, root: str, library: str, max_chars: int = 800, overlap: int = 100) -> DataFrame:
    """Chunks of all text files below root, one row per piece, with ids from path, place and content."""
    decode = F.pandas_udf(lambda raw: raw.map(_decoded), "string")
    pieces = list_files(spark, root).select("rel", F.posexplode(splitter(max_chars, overlap)(decode("content"))).alias("i", "text")).where(F.trim("text") != "")
    return pieces.select(
        stable_id(F.lit("text_file"), F.col("rel"), F.col("i"), F.substring(F.sha1("text"), 1, 8)).alias("id"), "text", F.lit(library).alias("library"), F.lit("").alias("version"),
        F.col("rel").alias("qualname"), F.lit("text").alias("kind"), F.lit("").alias("import_path"), F.lit("text_file").alias("source_type"), F.col("rel").alias("source_path"), F.lit(None).cast("string").alias("embed_text"),
    )
