"""The chunk store: keyed tables with last-wins upserts, filters, counts and versions in the shared folder, searched as they stand."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.dense import DenseIndex, piece_number, write_cells
from corvane.operators.lexical import WINDOW, LexicalIndex, distinct_words, write_segment
from corvane.sources.durable import BROADCAST_ROWS, delete, durable, newest, shared_dir, write_new

#: Segments beyond which small ones are merged.
SEGMENTS = 8
_EMPTY = {"segments": [], "dead": [], "next": 0, "n_dead": 0, "dead_length": 0}
_PIECE = T.StructType().add("seg", T.StringType()).add("at", T.LongType())
_DEAD = T.StructType().add("n", T.LongType()).add("seg", T.StringType()).add("w", T.LongType()).add("piece", _PIECE).add("toks", T.ArrayType(T.StringType())).add("dl", T.LongType())
CHUNK = T.StructType().add("id", T.StringType()).add("text", T.StringType())
for _name in ("library", "version", "qualname", "kind", "import_path", "source_type", "source_path", "embed_text"):
    CHUNK.add(_name, T.StringType())


def where(**wanted) -> Column:
    """Equality on all given columns; a null never equals."""
    return reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in wanted.items()), F.lit(True))


def last_wins(batch: DataFrame, seq: str, key: str = "id") -> DataFrame:
    """One row per key: the last by seq, which keeps the first one's place as ``first_seq``."""
    rest = [c for c in batch.columns if c not in (key, seq)]
    best = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row"), F.min(seq).alias("first_seq"))
    return best.select(key, "__row.*", "first_seq")


def embed_source(text: Column | str = "text", embed_text: Column | str = "embed_text") -> Column:
    """What is embedded of a chunk: embed_text, or the text where that is null or empty."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(col(embed_text), F.lit("")), col(text))


def counts(chunks: DataFrame, by: str = "library") -> DataFrame:
    """(by, n): rows by a column, those without it under ''."""
    return chunks.groupBy(F.coalesce(F.col(by), F.lit("")).alias(by)).agg(F.count("*").alias("n"))


class ChunkStore:
    """A named collection of chunks by id, which outlives the session, with their vectors and postings where an embedder and an index text are given.

    A write adds one segment: the new rows under numbers of their own, their vectors in cells, their postings in windows. Rows whose ids it replaces are listed as
    dead, with what takes them out of searches and statistics; nothing that was written before is touched. A manifest names the segments and dead lists of a version: readers of
    an older one are not disturbed, and a write that fails leaves the collection as it was. One writer at a time: a second one's manifest is refused.

    Beyond ``SEGMENTS`` segments all but the largest are merged into one, without their dead rows, and the largest with them once it is no larger than they are together or a
    third of it is dead: a row is so rewritten a few times for each doubling of the collection. Vectors are carried over, not embedded again.
    """

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType = CHUNK, root: str | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, words: Column | None = None, keep: tuple[str, ...] = ("library",)):
        self.spark, self.schema, self.embed, self.words, self.keep = spark, schema, embed, words, keep
        self.root = f"{root or shared_dir(spark)}/store-{name}"
        self.number, self.about = 0, dict(_EMPTY)
        self.refresh()

    def refresh(self) -> None:
        """The last manifest that was written whole."""
        for number, text in newest(self.spark, f"{self.root}/manifest"):
            self.number = max(self.number, number)
            try:
                self.about = {k: json.loads(text)[k] for k in _EMPTY}
                return
            except (ValueError, KeyError):  # cut off: its writer failed
                continue

    def _commit(self, about: dict) -> None:
        write_new(self.spark, f"{self.root}/manifest/{self.number + 1:012d}.json", json.dumps(about))
        self.number, self.about = self.number + 1, about

    def _rows(self, segments: list[dict], *columns: str) -> DataFrame:
        """(n, seg, chunk columns) of some segments, dead rows among them."""
        schema = T.StructType([T.StructField("n", T.LongType()), *self.schema])
        names = ["n", *(columns or self.schema.names)]
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{s['path']}/chunks").select(*names, F.lit(s["path"]).alias("seg")) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema).select(*names, F.lit("").alias("seg"))

    def _dead(self) -> DataFrame | None:
        """(n, seg, w, piece, toks, dl) of all rows that were replaced and not yet merged away."""
        found = [f"{self.root}/{d}" for d in self.about["dead"]]
        return self.spark.read.schema(_DEAD).parquet(*found) if found else None

    def _live(self, segments: list[dict], *columns: str) -> DataFrame:
        rows, dead = self._rows(segments, *columns), self._dead()
        if dead is None:
            return rows
        gone = dead.select("n")
        return rows.join(F.broadcast(gone) if self.about["n_dead"] <= BROADCAST_ROWS else gone, "n", "left_anti")

    def read(self, **wanted) -> DataFrame:
        """All chunks, or those that match a metadata filter (pushed down to the files)."""
        return self._live(self.about["segments"]).drop("n", "seg").where(where(**wanted))

    def numbered(self) -> DataFrame:
        """All chunks with their numbers n, by which vectors and postings know them."""
        return self._live(self.about["segments"]).drop("seg")

    def upsert(self, batch: DataFrame, seq: str) -> int:
        """Replace or add by id, the batch's last row of an id winning; the number of distinct ids written."""
        self.refresh()
        new = last_wins(batch, seq).drop("first_seq")
        new = new.select([F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        new = durable(new.withColumn("_m", F.monotonically_increasing_id()), "upsert")
        counts = new.groupBy(F.shiftright("_m", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
        if not counts:
            return 0
        # Numbers follow each other within a partition of the batch: those of a window of postings are neighbours.
        starts, at = [], self.about["next"]
        for r in counts:
            starts.append((r["part"], at))
            at += r["n"]
        first = F.broadcast(self.spark.createDataFrame(starts, "part bigint, first bigint"))
        rows = new.withColumn("part", F.shiftright("_m", 33)).join(first, "part").withColumn("n", F.col("first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "first", "_m")
        about = {**self.about, "segments": list(self.about["segments"]), "dead": list(self.about["dead"]), "next": at}
        total = at - self.about["next"]
        self._bury(about, new.select("id"), total)
        about["segments"].append(self._segment(rows, total))
        self._commit(about)
        self._merge()
        return total

    def _segment(self, rows: DataFrame, total: int, vectors: DataFrame | None = None) -> dict:
        """Rows (n, chunk columns) written as a segment; vectors (id: n, vec) are those that are known already."""
        path = f"data/{uuid.uuid4().hex}"
        at = f"{self.root}/{path}"
        rows.select("n", *self.schema.names).write.parquet(f"{at}/chunks")
        rows = self.spark.read.schema(rows.select("n", *self.schema.names).schema).parquet(f"{at}/chunks")
        facts = {"path": path, "rows": total, "vectors": bool(self.embed)}
        if self.embed:
            made = vectors if vectors is not None else self.embed(rows)
            write_cells(made.join(rows.select(F.col("n").alias("id"), *self.keep), "id"), "id", "vec", self.keep, f"{at}/vectors")
        if self.words is not None:
            facts |= write_segment(rows, "n", self.words, self.keep, f"{at}/words", aligned=True)
        return facts

    def _bury(self, about: dict, ids: DataFrame, total: int) -> None:
        """List the live rows of some ids as dead: with their window and piece, and the terms that no longer count."""
        if not about["segments"]:
            return
        names = [c for c in self.schema.names if c != "id"] if self.words is not None else []
        ids = F.broadcast(ids) if total <= BROADCAST_ROWS else ids
        old = self._live(about["segments"], "id", *names).join(ids, "id", "left_semi")
        home = F.expr(f"n div {WINDOW}").alias("w")
        if self.words is not None:
            old = distinct_words(old, "n", self.words, "seg").withColumnRenamed("id", "n")
        else:
            old = old.select("n", "seg", F.array().cast("array<string>").alias("toks"), F.lit(0).cast("bigint").alias("dl"))
        old = durable(old.select("n", "seg", home, "toks", "dl"), "replaced")
        n, length = old.agg(F.count("*"), F.sum("dl")).first()
        if not n:
            return
        path = f"dead/{uuid.uuid4().hex}"
        if self.embed:
            homes = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/{s['path']}/vectors/homes").withColumn("piece", F.struct(F.lit(s["path"]).alias("seg"), F.col("piece").alias("at"))) for s in about["segments"]])
            if n <= BROADCAST_ROWS:  # numbers and pieces are sent, not words
                found = homes.join(F.broadcast(old.select("n")), "n", "left_semi")
                old = old.join(F.broadcast(found), "n", "left")
            else:
                old = old.join(homes, "n", "left")
        else:
            old = old.withColumn("piece", F.lit(None).cast(_PIECE))
        old.select(*_DEAD.names).write.parquet(f"{self.root}/{path}")
        about["dead"].append(path)
        about["n_dead"] += n
        about["dead_length"] += length

    def _merge(self) -> None:
        """Keep segments few (see above)."""
        segments = sorted(self.about["segments"], key=lambda s: -s["rows"])
        gone = {r["seg"]: r["n"] for r in self._dead().groupBy("seg").agg(F.count("*").alias("n")).collect()} if self.about["dead"] else {}  # a row a segment
        rest = sum(s["rows"] for s in segments[1:])
        if len(segments) <= SEGMENTS and not any(gone.get(s["path"], 0) * 3 > s["rows"] for s in segments):
            return
        whole = segments[0]["rows"] <= rest or gone.get(segments[0]["path"], 0) * 3 > segments[0]["rows"]
        merged, kept = (segments, []) if whole else (segments[1:], segments[:1])
        if not merged:
            return
        rows = durable(self._live(merged).drop("seg").repartitionByRange("n").sortWithinPartitions("n"), "merged")
        live = rows.count()
        about = {**self.about, "segments": kept, "dead": [], "n_dead": 0, "dead_length": 0}
        if live:
            vectors = self._vectors(merged) if self.embed else None
            about["segments"] = [*kept, self._segment(rows, live, vectors)]
        left = durable(self._dead().where(F.col("seg").isin([s["path"] for s in kept])), "dead") if kept and self.about["dead"] else None
        n, length = left.agg(F.count("*"), F.sum("dl")).first() if left is not None else (0, 0)
        if n:
            path = f"dead/{uuid.uuid4().hex}"
            left.write.parquet(f"{self.root}/{path}")
            about |= {"dead": [path], "n_dead": n, "dead_length": length}
        self._commit(about)

    def _vectors(self, segments: list[dict]) -> DataFrame:
        """(id, vec) of all rows of some segments, dead ones among them."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for ids, vecs, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids, flat = np.frombuffer(ids, np.int64), np.frombuffer(vecs, f"<f{width}").astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * (len(flat) // len(ids)), pa.int32()), pa.array(flat))], ["id", "vec"])

        pieces = [self.spark.read.parquet(f"{self.root}/{s['path']}/vectors/pieces").select("ids", "vecs", "width") for s in segments]
        return reduce(DataFrame.unionByName, pieces).mapInArrow(unpack, "id bigint, vec array<double>")

    def dense(self) -> DenseIndex | None:
        """The vectors of all segments, as they were written; None where a segment has none."""
        paths = [s["path"] for s in self.about["segments"]]
        if not paths or not all(s["vectors"] for s in self.about["segments"]):
            return None
        dead = self._dead()
        if dead is not None:
            place = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(paths) for x in (p, i)]), F.col("piece.seg"))
            dead = dead.select(piece_number(F.col("piece.at"), place).alias("piece"), "n")
        return DenseIndex.load(self.spark, [f"{self.root}/{p}/vectors" for p in paths], dead)

    def lexical(self) -> LexicalIndex | None:
        """The postings of all segments, with the statistics of the live rows; None where a segment has none."""
        segments = self.about["segments"]
        if not segments or not all("docs" in s for s in segments):
            return None
        windows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/{s['path']}/words/windows") for s in segments])
        terms = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.root}/{s['path']}/words/terms") for s in segments])
        docs, length, dead = sum(s["docs"] for s in segments) - self.about["n_dead"], sum(s["length"] for s in segments) - self.about["dead_length"], self._dead()
        if dead is not None:
            terms = terms.unionByName(dead.select(F.explode("toks").alias("tok")).groupBy("tok").agg((-F.count("*")).alias("df")))
        if len(segments) > 1 or dead is not None:
            terms = terms.groupBy("tok").agg(F.sum("df").alias("df")).where("df > 0")
        return LexicalIndex(windows, terms, docs, length / docs if docs else 0.0, None if dead is None else dead.select("w", "n"))

    def count(self, **wanted) -> int:
        return self.read(**wanted).count()

    def libraries(self) -> DataFrame:
        return counts(self.read())

    def reset(self) -> None:
        """Empty the collection; numbers go on."""
        self.refresh()
        self._commit({**_EMPTY, "next": self.about["next"]})

    def vacuum(self) -> None:
        """Remove the files of older versions; none may be read any more."""
        self.refresh()
        used = {s["path"].split("/")[1] for s in self.about["segments"]} | {d.split("/")[1] for d in self.about["dead"]}
        for folder in ("data", "dead"):
            delete(self.spark, f"{self.root}/{folder}", lambda name: name not in used)
        delete(self.spark, f"{self.root}/manifest", lambda name: name < f"{self.number:012d}")
