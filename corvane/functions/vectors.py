"""Vectors as Column functions: cosine, normalisation, and a hashing embedder that needs no model."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.arrays import histogram, unrolled
from corvane.functions.bags import bags, lots
from corvane.functions.text import HASH_TOKEN, blank_if_null
from corvane.sources.durable import spread


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    """To unit length; a zero vector stays. The length is bound as a variable, so that it is computed once, not for every element."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n), x.cast("double")))), F.lit(0))


def hash_cell(token: Column, dim: int) -> Column:
    """The dimension of a token: the first 64 bits of its SHA-256, modulo dim."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(dim)).cast("int")


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, cell, weight): the non-zero dimensions of each text's bag of hashed tokens, of unit length."""
    tokens = F.regexp_extract_all(F.lower(blank_if_null(text_col)), F.lit(HASH_TOKEN), F.lit(0))
    # Distinct tokens are hashed once each; a cell's count is the sum over its tokens, all within the row.
    one = histogram(spread(df.select(id_col, text_col)).select(F.col(id_col).alias("id"), tokens.alias("t")), "t", "h")
    flat = one.select("id", F.flatten(F.transform("h", lambda x: F.array_repeat(hash_cell(x["value"], dim), x["n"].cast("int")))).alias("c"))
    cells = histogram(flat, "c", "h").withColumn("len", F.sqrt(F.aggregate("h", F.lit(0).cast("bigint"), lambda s, x: s + x["n"] * x["n"])))
    return unrolled(cells, "h", "id", "len").select("id", F.col("value").alias("cell"), (F.col("n") / F.col("len")).alias("weight"))


def embed_dense(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, vec array<double>): the vectors of ``hash_embed``, a row each, in one pass without a shuffle; a text without tokens is a zero vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, n in lots(whole.column(1)):
                b = whole.slice(at, n)
                words, code, place, many = bags(b.column(1), dotted=False)
                cell = np.fromiter((int.from_bytes(sha256(w.encode()).digest()[:8], "big") % dim for w in words.to_pylist()), np.int64, len(words))
                m = np.bincount(place * dim + cell[code], many, minlength=n * dim).reshape(n, dim)
                size = np.sqrt((m**2).sum(axis=1, keepdims=True))
                m = m / np.where(size > 0, size, 1)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(m.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0), vec], ["id", "vec"])

    asked = spread(df.select(F.col(id_col).alias("id"), F.lower(blank_if_null(text_col)).alias("text")))
    return asked.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, vec array<double>")


#: Models that this worker has built, by the embedder they belong to.
_MODELS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _model(name: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[list[str]], np.ndarray]:
    """The worker's own model. Looked up in the module: what a function sent to a worker sees as globals are copies."""
    from corvane.functions import vectors

    if name not in vectors._MODELS:
        vectors._MODELS[name] = make()
    return vectors._MODELS[name]


class ModelEmbedder:
    """An embedder that holds a model: a function without arguments makes it, once in each worker, and it turns lists of texts into matrices, a row each.

    Texts are given to it in their order, across the borders of Arrow's batches, in lots of at most ``lot`` texts and ``lot_bytes`` bytes, or one text. A null text is an empty one. Models must
    treat a text alike in any lot: then results do not depend on how rows lie in partitions. The number of dimensions is asked for once, with one short
    text, where the embedder is made; a row of another length or with numbers that are not finite raises an error.
    """

    def __init__(self, make: Callable[[], Callable[[list[str]], np.ndarray]], lot: int = 64, lot_bytes: int = 1 << 20, dim: int | None = None):
        self.make, self.lot, self.lot_bytes, self.name = make, lot, lot_bytes, uuid.uuid4().hex
        self.dim = dim or int(np.asarray(make()(["dimension"]), np.float64).reshape(1, -1).shape[1])

    def __call__(self, df: DataFrame, id_col: str, text_col: str, dim: int | None = None) -> DataFrame:
        """(id, vec array<double>); dim, where given, must be the model's."""
        if dim is not None and dim != self.dim:
            raise ValueError(f"the model gives {self.dim} dimensions, {dim} are asked for")
        make, name, size, lot, lot_bytes = self.make, self.name, self.dim, self.lot, self.lot_bytes

        def vectors(ids: list, texts: list[str]) -> pa.RecordBatch:
            m = np.ascontiguousarray(_model(name, make)(texts), np.float64)
            if m.shape != (len(texts), size) or not np.isfinite(m).all():
                raise ValueError(f"the model gave {m.shape} for {len(texts)} texts of {size} dimensions, or numbers that are not finite")
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * size, pa.int32()), pa.array(m.reshape(-1)))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), vec], ["id", "vec"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kind
            ids, texts, waiting = [], [], 0
            for b in batches:
                kind = b.schema.field(0).type
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    more = len((text or "").encode())
                    if texts and (len(texts) >= lot or waiting + more > lot_bytes):
                        yield vectors(ids, texts)
                        ids, texts, waiting = [], [], 0
                    ids.append(i)
                    texts.append(text or "")
                    waiting += more
            if texts:
                yield vectors(ids, texts)

        kind = None
        return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, vec array<double>")
