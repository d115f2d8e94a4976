"""MinHash near-duplicates: DartMinHash signatures of weighted shingle bags, banded candidates, exact verification.

A text is a bag of its five-word shingles (a shorter text is one shingle); a shingle's weight is how often it occurs. Each unit
of weight owns a region into which hashed darts fall as a Poisson process in rank; a text collects the darts of its regions up
to a rank that grows until every coordinate has one, and keeps the earliest per coordinate. That costs the darts plus one hash
per unit, not coordinates times units. Bands of coordinates give candidates; weighted Jaccard over the exact bags decides.

Equal texts are one node from the start. In a band's bucket every node is held against the bucket's least node only, so a group of
any size costs links in proportion to it. Components of the verified links follow; buckets that still hold several components
are then searched again, each node against the components' other nodes, until no bucket hides a link (see ``_residual``).

Defined cases: null texts are never duplicates, not even of each other; equal texts always are, also empty ones and those
without words; ties go to the least id, null ids last; equal rows (same id and text) share a class; very long texts are hashed whole, in pieces; an
empty table gives no rows; other columns are not read, and ``drop_duplicates`` hands them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import U64, beside, chunked, components, give_back, map_arrow, mix, shingle_hashes, sized, slices, stash, table, units, word_hashes

#: 24 bands of 5: a pair at 0.8 is missed with probability 7e-5, one at 0.9 with 4e-10.
BANDS, ROWS, SIMILARITY = 24, 5, 0.8
_STEP, _COORD = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)
_ODD = (np.arange(1, ROWS + 1, dtype=U64) * U64(0xA24BAED4963EE406)) | U64(1)


def _bags(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The units of all texts' bags, and their texts' numbers."""
    return units(*shingle_hashes(*word_hashes(col)))


def _throw(u: np.ndarray, at: np.ndarray, theta: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text * k + coordinate, earliest dart) of the darts of rank theta[text] or less in the units' regions."""
    keys, ranks, darts = [], [], []
    rank, level = np.zeros(len(u)), 0
    while len(u):
        level += 1
        x = mix(u + U64(level) * _STEP)
        rank = rank - np.log(((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        alive = rank <= theta[at]
        u, at, rank, x = u[alive], at[alive], rank[alive], mix(x[alive] ^ _COORD)
        keys.append(at * k + (x % U64(k)).astype(np.int64))
        ranks.append(rank)
        darts.append(x)
    key, rank, dart = map(np.concatenate, (keys, ranks, darts))
    order = np.lexsort((rank, key))
    key = key[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return key[first], dart[order][first]


def signatures(u: np.ndarray, at: np.ndarray, n: int, k: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(n, k) earliest darts, and which texts have any unit."""
    weight = np.bincount(at, minlength=n).astype(np.float64)
    has = weight > 0
    sig = np.zeros((n, k), U64)
    with np.errstate(over="ignore", divide="ignore"):
        theta, todo = (k * np.log(k) + 2 * k) / weight, has.copy()
        while todo.any():
            mine = todo[at]
            key, dart = _throw(u[mine], at[mine], theta, k)
            full = np.zeros(n, bool)
            full[np.flatnonzero(np.bincount(key // k, minlength=n) == k)] = True
            ok = full[key // k]
            sig.reshape(-1)[key[ok]] = dart[ok]
            todo &= ~full
            theta = theta * 2
    return sig, has


def _bands(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, node, bands): keys of a text's bands; null where it has no word."""
    id_type = docs.schema["id"].dataType.simpleString()
    odd = (np.arange(1, rows + 1, dtype=U64) * U64(0xA24BAED4963EE406)) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(2)
            for lo, hi in slices(text):
                part = text.slice(lo, hi - lo)
                with np.errstate(over="ignore"):
                    sig, has = signatures(*_bags(part), len(part), bands * rows)
                    keys = mix((sig.reshape(len(part), bands, rows) * odd).sum(axis=2, dtype=U64) + np.arange(1, bands + 1, dtype=U64) * _STEP)
                off = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(keys[has].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), lists], ["id", "node", "bands"])

    return map_arrow(docs, run, f"id {id_type}, node binary, bands array<bigint>")


def similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard of the shingle bags, pair by pair."""
    out = []
    for lo, hi in slices(a):
        ua, ia = _bags(a.slice(lo, hi - lo))
        ub, ib = _bags(b.slice(lo, hi - lo))
        n = hi - lo
        u, i = np.concatenate([ua, ub]), np.concatenate([ia, ib])
        order = np.lexsort((u, i))
        u, i = u[order], i[order]
        both = np.bincount(i[1:][(u[1:] == u[:-1]) & (i[1:] == i[:-1])], minlength=n).astype(np.float64)
        out.append(both / np.maximum(np.bincount(ia, minlength=n) + np.bincount(ib, minlength=n) - both, 1))
    return np.concatenate(out) if out else np.zeros(0)


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. Texts join by number; a hub's rows are split by adaptive skew joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array(similarity(b.column(2), b.column(3)) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    of = texts.select(F.col("nid").alias("b"), F.col("text").alias("tb"))
    to = texts.select(F.col("nid").alias("a"), F.col("text").alias("ta"))
    return map_arrow(pairs.join(of, "b").join(to, "a").select("a", "b", "ta", "tb"), run, "a bigint, b bigint")


def node_of(text) -> F.Column:
    """128 bits of a text's SHA-256: equal texts, equal nodes."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(nid, text) of the nodes wanted (nid, node, id): one row each. Joined by id and node, so copies spread."""
    key = lambda c: F.xxhash64(F.coalesce(c.cast("string"), F.lit("null")), "node")
    src = docs.select("text", node_of("text").alias("node"), "id").select("text", "node", key(F.col("id")).alias("k"))
    want = wanted.select("nid", "node", key(F.col("id")).alias("k"))
    return src.join(want, ["k", "node"]).dropDuplicates(["k", "node"]).select("nid", "text")


def _grouped(src: DataFrame, least: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (id, text): signatures (id, node, bands) by row; nodes (nid, node, id, copies) by distinct text, numbered; and (nid, class_id,
    class_rows, keep) of every node of a class of several."""
    sig = stash(_bands(src.select("id", node_of("text").alias("node"), "text"), bands, rows), "dart-sig")
    # Numbers are given once and written: what follows groups and joins by one long.
    nodes = stash(sig.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("nid"), "node", "id", "bands", "copies"), "dart-nodes")
    keyed = nodes.select("nid", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(F.min("nid").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = stash(keyed.join(buckets, "band"), "dart-members")
    n_members = members.count()
    pairs = stash(sized(members.where("nid != rep").select(F.col("rep").alias("a"), F.col("nid").alias("b")).distinct(), n_members), "dart-pairs")
    wanted = nodes.select("nid", "node", "id").join(beside(members.select("nid").distinct(), n_members), "nid", "left_semi")
    texts = stash(_texts(src, wanted), "dart-texts")
    labels = components(stash(_verify(pairs, texts, least), "dart-links"), "dart")
    rest = stash(sized(_residual(members, n_members, labels, texts, least), n_members), "dart-rest")
    if n_rest := rest.count():  # links between components: these are what is joined now
        of = labels.select("node", "comp")
        for end in ("a", "b"):
            rest = rest.join(of.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        ends = rest.select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = components(ends, "dart-joined").select(F.col("node").alias("comp"), F.col("comp").alias("into"))
        labels = labels.join(beside(joined, 2 * n_rest), "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
        alone = joined.select(F.col("comp").alias("node"), F.col("into").alias("comp"))  # of them those that had no link before
        labels = stash(labels.union(alone.join(labels.select("node"), "node", "left_anti")), "dart-labels")
    mine = stash(nodes.select("nid", "node", "id", "copies").join(labels.withColumnRenamed("node", "nid"), "nid"), "dart-grouped")
    # The least id that is not null, and of its nodes the least: the order of bytes.
    top = mine.groupBy("comp").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_rows"), F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("node")))["node"].alias("keep"))
    return sig, nodes.select("nid", "node", "id", "copies"), stash(mine.select("nid", "comp").join(top, "comp").select("nid", "class_id", "class_rows", "keep"), "dart-class")


def _by_node(nodes: DataFrame, several: DataFrame) -> DataFrame:
    """(node, class_id, class_rows, keep) of every node."""
    named = nodes.join(beside(several, several.count()), "nid", "left")
    return named.select("node", F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_rows", "copies").alias("class_rows"), F.coalesce("keep", "node").alias("keep"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, node, class_id, class_rows, keep): one row per row; class_id: the least id of its class; keep: the text that stays."""
    rows_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sig, nodes, several = _grouped(rows_.where("text is not null"), least, bands, rows)
    found = sig.select("id", "node").join(_by_node(nodes, several), "node").select("id", "node", "class_id", "class_rows", "keep")
    alone = rows_.where("text is null").select("id", F.lit(None).cast("binary").alias("node"), F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_rows"), F.lit(None).cast("binary").alias("keep"))
    return found.union(alone)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: the least id's, by text where ids repeat. Rows without a text stay."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    _, nodes, several = _grouped(rows, least, BANDS, ROWS)
    # A node is kept if it is its class's, and of its rows those of the least id.
    kept = nodes.join(beside(several, several.count()), "nid", "left").where("keep is null or keep = node").select("id", "node")
    a, b = _unused(docs, "id"), _unused(docs, "node")
    word = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    keyed = docs.where(F.col(text_col).isNotNull()).withColumns({a: word(F.col(id_col)), b: node_of(F.col(text_col))})
    # Joined and made distinct by the same keys, id and text: one shuffle of texts, in which copies spread.
    one = keyed.join(kept.select(word(F.col("id")).alias(a), F.col("node").alias(b)), [a, b], "left_semi").dropDuplicates([a, b]).select(docs.columns)
    return one.union(docs.where(F.col(text_col).isNull()))


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def _links(texts: pa.Array, mine: np.ndarray, comp: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(row, row): every similar pair of a row of mine and a row of another component; postings stand in for pairs."""
    u, at = _bags(texts)
    n = len(texts)
    size = np.bincount(at, minlength=n)
    name = np.unique(u, return_inverse=True)[1]
    order = np.argsort(name, kind="stable")
    post, start = at[order], np.searchsorted(name[order], np.arange(len(u) + 1))
    first = np.searchsorted(at, np.arange(n + 1))
    group = np.unique(comp, return_inverse=True)[1]
    out = []
    for i in np.flatnonzero(mine):
        own = name[first[i] : first[i + 1]]
        if len(own):
            both = np.bincount(np.concatenate([post[start[x] : start[x + 1]] for x in own]), minlength=n)
            near = np.flatnonzero((both >= least * (size[i] + size - both)) & (group != group[i]))
            out += [(int(i), int(j)) for j in near[np.unique(group[near], return_index=True)[1]]]
    return out


def _residual(members: DataFrame, n_members: int, labels: DataFrame, texts: DataFrame, least: float, block: int = 1 << 20) -> DataFrame:
    """Links (a, b) that the stars missed: between different components in one bucket of three nodes or more.

    Each node outside its bucket's main component is held against all nodes of the bucket, in blocks of about so many bytes by
    as many, through a small inverted index per block. Rows are nodes and found links (one per node, block and
    component), never pairs, and whatever shares a bucket ends in one component or has been compared.
    """
    at = members.where("n > 2").select("band", "nid").join(labels.select(F.col("node").alias("nid"), "comp"), "nid", "left").select("band", "nid", F.coalesce("comp", "nid").alias("comp"))
    marks = [F.bit_xor(F.xxhash64(F.lit(salt), "nid")).alias(f"x{salt}") for salt in (1, 2)]
    by = at.groupBy("band", "comp").agg(F.count("*").alias("m"), *marks)
    mixed = by.groupBy("band").agg(F.count("*").alias("comps"), F.sum("m").alias("m"), F.max_by("comp", "m").alias("main"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2")).where("comps > 1")
    # Near copies meet in many bands: of buckets with the same nodes (as many, and alike in two 64-bit sums) one is searched.
    mixed = stash(sized(mixed.groupBy("m", "x1", "x2").agg(F.min("band").alias("band"), F.min_by("main", "band").alias("main")).select("band", "main"), n_members), "dart-mixed-bands")
    if not mixed.take(1):
        return members.sparkSession.createDataFrame([], "a bigint, b bigint")
    rows = stash(sized(at.join(mixed, "band").select("band", "nid", "comp", (F.col("comp") != F.col("main")).alias("out")), n_members), "dart-mixed")
    sizes = texts.select("nid", F.octet_length("text").alias("bytes"))
    # Written, so that the joins by band below have plain inputs, which adaptive skew joins can split.
    blocks = stash(sized(rows.join(sizes, "nid").groupBy("band").agg(
        F.ceil(F.sum("bytes") / block).cast("int").alias("nm"), F.ceil(F.sum(F.when(F.col("out"), F.col("bytes")).otherwise(0)) / block).cast("int").alias("ns")
    ).select("band", F.greatest("nm", F.lit(1)).alias("nm"), F.greatest("ns", F.lit(1)).alias("ns")), n_members), "dart-blocks")
    rows = rows.join(blocks, "band")
    spread = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("nid")), F.col(n)).cast("int")
    all_ = rows.select("band", "nid", "comp", F.lit(False).alias("mine"), spread(1, "nm").alias("i"), F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("j"))
    mine = rows.where("out").select("band", "nid", "comp", F.lit(True).alias("mine"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("i"), spread(2, "ns").alias("j"))

    def run(t):
        t = t.combine_chunks()
        give_back()
        found = _links(chunked(t.column("text")), t.column("mine").to_numpy(), t.column("comp").to_numpy(), least)
        node = chunked(t.column("nid"))
        return pa.table([node.take(pa.array([x[0] for x in found], pa.int64())), node.take(pa.array([x[1] for x in found], pa.int64()))], ["a", "b"])

    return all_.union(mine).join(texts, "nid").groupBy("band", "i", "j").applyInArrow(run, "a bigint, b bigint").distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates."""
    docs = table(spark, sf_dir, "documents")
    found = classes(docs)
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_rows")
