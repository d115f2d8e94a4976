"""The engine as one object: ingest, search, run, resume, evaluate, report."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Options
from corvane.functions.text import index_text
from corvane.functions.vectors import embed_dense
from corvane.operators import evaluation as E
from corvane.operators import fusion, store
from corvane.operators.dense import DenseIndex
from corvane.operators.lexical import LexicalIndex
from corvane.plans import loop
from corvane.sources.durable import durable
from corvane.sources.files import text_chunks
from corvane.sources.introspect import introspection_chunks


_LOG = logging.getLogger(__name__)
#: (rows, id column, text column, dimensions) to (id, vec array<double>).
Embedder = Callable[[DataFrame, str, str, int], DataFrame]
#: Numbered chunks (n, library, w: text to index) to an index by n; an ImportError means that there is none here.
IndexFactory = Callable[[DataFrame], LexicalIndex]


class Engine:
    """A store of chunks that is searched as it stands: vectors and postings are written with the chunks, so that a new object searches without building."""

    def __init__(self, spark: SparkSession, name: str = "chunks", options: Options | None = None, root: str | None = None, embedder: Embedder = embed_dense, index_factory: IndexFactory | None = None):
        self.spark, self.options, self.embedder, self.index_factory = spark, options or Options(), embedder, index_factory
        words = index_text("text", "qualname", "import_path") if index_factory is None else None
        self.store = store.ChunkStore(spark, name, root=root, embed=lambda rows: embedder(rows.select("n", store.embed_source().alias("e")), "n", "e", self.options.embed_dim), words=words)
        self.refresh()

    def refresh(self) -> None:
        """Search the store as it is now, also where another object has written to it."""
        self.store.refresh()
        self._index: LexicalIndex | None = None
        self._vectors: DenseIndex | None = None
        self._version = -1
        self._no_index = False

    def ingest(self, libraries: list[str] = (), docs: dict[str, str] | None = None, reset: bool = False) -> dict:
        """Chunks of installed libraries and of folders of text files (by library name); counts by library and distinct ids."""
        if reset:
            self.store.reset()
        parts = ([introspection_chunks(self.spark, list(libraries))] if libraries else []) + [text_chunks(self.spark, p, lib, self.options.chunk_chars, self.options.chunk_overlap) for lib, p in (docs or {}).items()]
        batch = None
        for p in parts:
            batch = p if batch is None else batch.unionByName(p)
        if batch is None:
            return {"written": 0, "counts": {}}
        batch = durable(batch.withColumn("_seq", F.monotonically_increasing_id()), "ingest")
        written = self.store.upsert(batch, "_seq")
        return {"written": written, "counts": {r["library"]: r["n"] for r in store.counts(batch).collect()}}

    def _opened(self) -> tuple[LexicalIndex | None, DenseIndex | None]:
        """The store's postings and vectors, opened once a version; an index of one's own is built anew for each."""
        if self._version != self.store.number:
            self._vectors, self._index, self._version = self.store.dense(), None, self.store.number
            if self.options.hybrid and self.index_factory is None:
                self._index = self.store.lexical()
            elif self.options.hybrid and not self._no_index:
                try:
                    self._index = self.index_factory(self.store.numbered().select("n", "library", index_text("text", "qualname", "import_path").alias("w")))
                except ImportError as e:
                    _LOG.warning("no lexical index, searches are dense: %s", e)
                    self._no_index = True
        return self._index, self._vectors

    def search(self, queries: DataFrame, k: int | None = None, library: str | None = None) -> DataFrame:
        """(id, qset, score, best, rank, route, text, ...) for queries (qset, qid, text); the score is the fused one on either route. An empty
        store has no rows."""
        o, k = self.options, k or self.options.top_k
        index, vectors = self._opened()
        if vectors is None:
            vectors = self.spark.createDataFrame([], "id bigint, vec array<double>, library string")
        vec = self.embedder(queries.select("qid", "text"), "qid", "text", o.embed_dim).withColumnsRenamed({"id": "qid"})
        asked = queries.join(vec, "qid")
        found = fusion.hybrid(vectors, index, asked, k, o.min_score, o.rrf_k, o.dense_weight, o.bm25_weight, o.adaptive, {"library": library} if library else None)
        shown = self.store.numbered().select("n", "id", "text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("library", "qualname", "import_path")])
        return found.withColumnRenamed("id", "n").join(shown, "n").drop("n")

    def run(self, tasks: DataFrame, effects: loop.Effects, auto_approve: bool = True) -> DataFrame:
        """The states of tasks (task_id, task, provided_tests) when all have ended or wait for a review."""
        return loop.run(loop.start(self.spark, tasks, effects, auto_approve), effects, self._limits())

    def resume(self, states: DataFrame, decisions: DataFrame, effects: loop.Effects) -> DataFrame:
        return loop.resume(states, decisions, effects, self._limits())

    def _limits(self) -> loop.Limits:
        return loop.Limits(self.options.max_retries, self.options.max_human_rounds, self.options.llm_budget)

    def evaluate(self, tasks: DataFrame, modes: dict[str, loop.Effects], done: DataFrame, limit: int | None = None, force: bool = False, model: str | None = None) -> DataFrame:
        """Records (``evaluation.RECORD``) of the cells still to run: one loop per mode over all its tasks at once."""
        names = self.spark.createDataFrame([(m, i) for i, m in enumerate(modes)], "mode string, mode_no int")
        cells = durable(E.pending(tasks, names, done, limit, force), "cells")
        started = datetime.now(UTC).strftime("%Y%m%dT%H%M%S") + "-" + uuid.uuid4().hex[:8]
        schema = self.spark.createDataFrame([], E.RECORD).schema
        out = None
        for mode, effects in modes.items():
            mine = tasks.join(cells.where(F.col("mode") == mode).select("task_id"), "task_id", "left_semi")
            s = loop.run(loop.start(self.spark, mine, effects, True), effects, self._limits())
            passed, iso = F.coalesce("run.passed", F.lit(False)), "yyyy-MM-dd'T'HH:mm:ss'Z'"
            made = {
                "schema_version": F.lit(E.SCHEMA_VERSION), "mode": F.lit(mode), "passed": passed, "attempts": F.col("attempt"), "first_try": passed & (F.col("attempt") == 1), "model": F.lit(model),
                "wall_s": F.round((F.unix_micros("finished_ts") - F.unix_micros("started_ts")) / 1e6, 3), "final_category": F.col("run.category"), "n_docs": F.size(F.coalesce("doc_ids", F.array().cast("array<string>"))),
                "re_retrievals": F.greatest(F.size(F.filter("nodes", lambda n: n == "retrieve")) - 1, F.lit(0)), "final_code": F.col("code"), "run_id": F.concat(F.lit(f"{started}-{mode}-"), "task_id"),
                "finished_ts": F.date_format(F.to_utc_timestamp("finished_ts", F.current_timezone()), iso),
            }
            one = s.select([made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema])
            out = one if out is None else out.unionByName(one)
        return durable(out, "records") if out is not None else self.spark.createDataFrame([], schema)

    def _report(self, tasks: DataFrame, records: DataFrame, modes: tuple[str, str], model: str | None) -> Iterator[str]:
        full = records.where(E.is_complete())
        return E.report_lines(E.mode_summary(full).orderBy("mode").collect(), E.paired(full, *modes).first(), E.cells(tasks, records, modes).orderBy("task_id").toLocalIterator(), modes, model)

    def report(self, tasks: DataFrame, records: DataFrame, modes: tuple[str, str], model: str | None = None) -> str:
        """Markdown from the aggregates (a row per mode, one pair) and a line per task: for as many tasks as a text may have lines."""
        return "\n".join(self._report(tasks, records, modes, model)) + "\n"

    def write_report(self, tasks: DataFrame, records: DataFrame, modes: tuple[str, str], path: str, model: str | None = None) -> None:
        """The same into a file, a partition of tasks at a time."""
        E.write_report(self._report(tasks, records, modes, model), path)
