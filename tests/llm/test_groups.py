"""Sharding, near-duplicates, decontamination, packing, against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import changed, words

from corvane.llm import decontaminate, neardup, packing, sharding
from corvane.llm.common import components, shingle_hashes, word_hashes


def bag(text, n=5):
    import re

    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    return Counter(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


# ---- sharding


def test_sharding_law(spark, sf_dir, odd_docs, no_docs):
    got = sharding.query(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    m = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and (m["size"] == m.text.map(lambda t: len(t.encode()) + 1)).all() and (m.text_crc32 == m.text.map(lambda t: zlib.crc32(t.encode()))).all()
    assert m.groupby("text").shard.nunique().max() == 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    loads = got.groupby("shard")["size"].sum()
    sizes = m.groupby("text")["size"].sum()
    _, want = sharding.lpt([(int(v), i) for i, v in enumerate(sizes)], 8)
    assert loads.max() - loads.min() <= max(want) - min(want) + sizes.max() * 0.1
    odd = sharding.assign(odd_docs, 3).toPandas()
    assert len(odd) == odd_docs.count() and odd.groupby("text_crc32").shard.nunique().max() == 1 and sharding.assign(no_docs).count() == 0


def test_lpt_is_within_its_bound():
    rng = random.Random(3)
    items = [(rng.randrange(1, 1000), i) for i in range(500)]
    _, loads = sharding.lpt(items, 7)
    assert max(loads) <= (4 / 3 - 1 / 21) * (sum(s for s, _ in items) / 7 + max(s for s, _ in items) / 7)


# ---- near-duplicates


def brute_classes(texts):
    """Components of equal or similar texts, by all pairs."""
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) if t is not None else None for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is not None and texts[j] is not None and (texts[i] == texts[j] or bags[i] and bags[j] and jaccard(bags[i], bags[j]) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = words(rng, rng.choice((8, 40, 150, 400)))
        texts += [" ".join(base)] + [" ".join(changed(rng, base, rng.choice((0.0, 0.005, 0.02, 0.1)))) for _ in range(rng.choice((0, 1, 3)))]
    base = words(rng, 200)
    texts += [" ".join(changed(rng, base, 0.012)) for _ in range(60)]  # one large group of chained near copies
    passage = words(rng, 60)
    texts += [" ".join(words(rng, 100) + passage) for _ in range(20)] + ["", "", None, None, "one", "one", "One", "a b c"]
    return texts


def test_classes_equal_brute_force(spark, copies):
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    got = {r["id"]: r for r in neardup.classes(df).collect()}
    want = brute_classes(copies)
    assert [got[i]["class_id"] for i in range(len(copies))] == want
    sizes = Counter(want)
    assert all(got[i]["class_rows"] == sizes[want[i]] for i in range(len(copies)))
    kept = sorted(r["doc_id"] for r in neardup.drop_duplicates(df).collect())
    assert kept == sorted(set(want))


def test_residual_links_join_what_stars_miss(spark):
    """b is like a and like c, which are unlike; the bucket's least node is a or c."""
    rng = random.Random(8)
    base = words(rng, 300)
    rows = []
    for k in range(12):
        c = list(base)
        for i in range(k * 3, k * 3 + 6):
            c[i * 7] = f"z{k}_{i}"
        rows.append((k, " ".join(c)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes([t for _, t in rows])
    assert [r["class_id"] for r in sorted(neardup.classes(df).collect())] == want


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    got = neardup.classes(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = defaultdict(set)
    for r in got:
        by[r["id"]].add(r["class_id"])
    assert by[5] == by[6] == {5} and by[1] == {1} and by[2] == by[3] == {2}
    kept = neardup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 4, 5, None, 8, 9, 10, 11])
    assert neardup.classes(no_docs).count() == 0 and neardup.drop_duplicates(no_docs).count() == 0


def test_signature_agreement_estimates_weighted_jaccard():
    rng = random.Random(2)
    base = words(rng, 300, 60)
    pairs = [(" ".join(base), " ".join(changed(rng, base, s))) for s in (0.0, 0.01, 0.03, 0.08)]
    for a, b in pairs:
        sig, _ = neardup.signatures(*neardup._bags(pa.array([a, b])), 2, 600)
        assert abs((sig[0] == sig[1]).mean() - jaccard(bag(a), bag(b))) < 0.09
        assert abs(neardup.similarity(pa.array([a]), pa.array([b]))[0] - jaccard(bag(a), bag(b))) < 1e-9


def test_word_hashes_do_not_depend_on_neighbours():
    texts = ["Ab c1 é_x", "", None, "c1", "x" * 5_000_000 + " ab"]
    h, ptr = word_hashes(pa.array(texts))
    assert np.diff(ptr).tolist() == [4, 0, 0, 1, 2] and h[1] == h[4] and h[0] == h[6]
    s, at = shingle_hashes(h, ptr)
    assert at.tolist() == [0, 3, 4]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "t").collect()))
    assert {got[i] for i in range(41)} == {0} and got[105] == 100 and got[201] == 200


# ---- decontamination


def test_decontamination_equals_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(9)
    items = [" ".join(words(rng, n)) for n in (6, 12, 30, 45, 59, 3)] + [None, "", "?!"]
    texts = []
    for _ in range(60):
        w = words(rng, rng.randrange(0, 300))
        at = rng.randrange(len(w) + 1)
        it = rng.choice(items[:5]).split()
        cut = rng.choice((it, it[:-1], it[1:], it[: len(it) // 2], []))
        texts.append(" ".join(w[:at] + [x.upper() + "," for x in cut] + w[at:]))
    texts += [items[5], items[5] + " more", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        import re

        w = re.findall(r"[0-9a-z]+", (t or "").lower())
        for i, x in enumerate(items):
            n = len(re.findall(r"[0-9a-z]+", x or ""))
            if n and w:
                m = min(n, len(w))
                wins = [" ".join(w[a : a + m]) for a in range(len(w) - m + 1)]
                if n < 5:
                    wins = [" ".join(w)] if len(w) < 5 else []
                if any(jaccard(bag(v), bag(x)) >= 0.8 for v in wins):
                    want.add((d, i))
    got = {(r["id"], r["item"]) for r in decontaminate.find(docs, bench).collect()}
    assert got == want and len(want) > 20
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.find(odd_docs, bench).count() == 0 and decontaminate.drop_contaminated(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.find(no_docs, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    asked = prints[:50] ^ sum((np.uint64(1) << rng.integers(0, 63, 50, dtype=np.uint64)) for _ in range(1))
    for radius in (0, 3, 18):
        row, item, far = decontaminate.HammingIndex(prints, radius).near(asked)
        d = np.bitwise_count(asked[:, None] ^ prints[None, :])
        assert set(zip(row.tolist(), item.tolist(), strict=True)) == {(int(a), int(b)) for a, b in np.argwhere(d <= radius)}


# ---- packing


def test_tokens_are_the_tokenizers_own():
    t = packing.WordTokenizer(packing.vocabulary())
    assert t.fast
    rng = random.Random(4)
    texts = ["<|endoftext|> a's I'LL İstanbul", "''s'll 'x' 'ré l'été", "É×é÷ 1234a1!!", None, "", "日本語 x", "\x00\x1c\x85"] + ["".join(rng.choice("ab'strevmld1 .!éÀ\n×K") for _ in range(rng.randrange(40))) for _ in range(3000)]
    ids, where = t.batch(pa.array(texts))
    for i, x in enumerate(texts):
        assert ids[where[i] : where[i + 1]].tolist() == t.t.encode(x or "", add_special_tokens=False).ids, x


def check_packing(got, room):
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= room


def test_packing(spark, sf_dir, odd_docs, no_docs):
    from tokenizers import Tokenizer

    got = packing.query(spark, sf_dir).toPandas()
    check_packing(got, 4096)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    t = Tokenizer.from_file(packing.vocabulary())
    want = {}
    for d, text in zip(docs.doc_id, docs.text, strict=True):
        ids = np.array(t.encode(text, add_special_tokens=False).ids + [1], "<u4")
        for p, a in enumerate(range(0, len(ids), 4096)):
            want[d, p] = (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1
    odd = packing.pack(odd_docs, packing.vocabulary(), room=50).toPandas()
    check_packing(odd, 50)
    assert len(odd[odd.start == 0]) == odd_docs.count() and packing.pack(no_docs, packing.vocabulary()).count() == 0


def test_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(["a"] * rng.randrange(1, 90))) for i in range(2000)], "doc_id long, text string").repartition(13)
    got = packing.pack(df, packing.vocabulary(), room=100).toPandas()
    check_packing(got, 100)
    assert len(got) == 2000 and got.sequence_id.nunique() <= 1.04 * got.length.sum() / 100 + 1


def test_best_fit_places_every_item_once():
    rng = random.Random(7)
    sizes = [rng.randrange(1, 101) for _ in range(3000)]
    place = packing.best_fit(sizes, 100)
    load = defaultdict(list)
    for s, (b, at) in zip(sizes, place, strict=True):
        load[b].append((at, s))
    for items in load.values():
        end = 0
        for at, s in sorted(items):
            assert at == end
            end += s
        assert end <= 100
    assert len(load) <= 1.05 * sum(sizes) / 100 + 1


def test_equal_hashes_are_not_equal_words(monkeypatch):
    """Few different hashes: words are told apart by their bytes, within a batch and between batches."""
    whole = packing.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda data, start, end: whole(data, start, end) & np.uint64(63))
    rng, t = random.Random(8), packing.WordTokenizer(packing.vocabulary())
    for _ in range(3):
        texts = [" ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(20)) if k % 2 else " ".join(words(rng, 15, 300)) for k in range(60)]
        ids, where = t.batch(pa.array(texts))
        for i, x in enumerate(texts):
            assert ids[where[i] : where[i + 1]].tolist() == t.t.encode(x, add_special_tokens=False).ids, x


def test_schedule_equals_a_plain_one(spark):
    """Groups of equal texts, sorted by size, each to the least load found by a search: as even as the operator's shards."""
    rng = random.Random(12)
    texts = [f"{i} " + "x" * rng.randrange(1, 900) for i in range(400)]
    rows = [(i, rng.choice(texts[: 1 + i % 400])) for i in range(1500)] + [(5000 + i, "y" * 2000) for i in range(30)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 5).toPandas()
    size = Counter()
    for _, t in rows:
        size[t] += len(t.encode()) + 1
    loads = [0] * 5
    for s in sorted(size.values(), reverse=True):
        loads[min(range(5), key=lambda k: loads[k])] += s
    assert sorted(got.groupby("shard")["size"].sum().tolist()) == sorted(loads)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_buckets_with_the_same_nodes_are_searched_once(spark):
    """Unlike texts that a band joins, in many bands at once: what is alike among them is still linked."""
    rng = random.Random(13)
    base = words(rng, 120)
    texts = []
    for k in range(10):
        c = list(base)
        for i in range(k * 11, k * 11 + 11):
            c[i] = f"u{k}_{i}"
        texts += [" ".join(c), " ".join([*c[:-1], f"end{k}"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["class_id"] for r in sorted(neardup.classes(df, bands=60, rows=2).collect())] == brute_classes(texts)
