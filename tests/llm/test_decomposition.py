"""Power-of-two packing: every token once, in order, in sequences without padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_helpers import words
from tokenizers import Tokenizer

from corvane.llm import decomposition
from corvane.llm.packing import vocabulary


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12288, 12289, 40_000])
def test_cuts_are_whole_sequences_then_binary_digits(n):
    cuts = decomposition.binary_cuts(n, 4096)
    assert sum(cuts) == n and cuts == sorted(cuts, reverse=True) and all(c & (c - 1) == 0 for c in cuts)
    rest = [c for c in cuts if c < 4096]
    assert len(rest) == len(set(rest)) == bin(n % 4096).count("1") and len(cuts) == n // 4096 + len(rest)


def whole(got, docs, room=4096, end=2):
    """Checks rows against the tokenizer itself."""
    t, by_doc = Tokenizer.from_file(vocabulary()), defaultdict(list)
    for r in got:
        by_doc[r["id"]].append(r)
    for key, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        at, mine = 0, sorted(by_doc[key], key=lambda r: r["start"])
        for r in mine:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] == 1 << r["bucket"] <= room and r["offset"] == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len({r["sequence_id"] for r in got}) == len(got)
    for b in {r["bucket"] for r in got}:
        assert sorted(r["place"] for r in got if r["bucket"] == b) == list(range(sum(r["bucket"] == b for r in got)))


def test_every_token_is_in_one_sequence(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(words(rng, rng.randrange(0, 400)))) for i in range(120)] + [(900, " ".join(words(rng, 9000))), (901, None), (902, ""), (903, "Äö 日本語 \U0001f600"), (904, "a\x00b <|endoftext|> c")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole(decomposition.decompose(df.repartition(5), vocabulary()).collect(), docs)
    whole(decomposition.decompose(df.coalesce(1), vocabulary(), room=64, end_id=1).collect(), docs, 64, 1)


def test_batches_of_equal_shape(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(words(rng, rng.randrange(0, 60)))) for i in range(200)], "doc_id long, text string").repartition(4)
    rows = decomposition.batches(decomposition.decompose(docs, vocabulary()), 256).collect()
    batch = defaultdict(list)
    for r in rows:
        batch[r["bucket"], r["batch"]].append(r["length"])
    last = {b: max(n for x, n in batch if x == b) for b, _ in batch}
    assert all(len(set(v)) == 1 and (sum(v) == max(256, v[0]) or n == last[b]) for (b, n), v in batch.items())


def test_odd_rows(spark, odd_docs, no_docs):
    got = decomposition.decompose(odd_docs, vocabulary()).collect()
    assert sum(r["length"] for r in got if r["id"] == 1) == 1 and len([r for r in got if r["id"] == 5 and r["start"] == 0]) == 2 and [r["id"] for r in got].count(None) > 0
    assert max(r["doc_tokens"] for r in got) > 60_000 and len({r["sequence_id"] for r in got}) == len(got)
    assert decomposition.decompose(no_docs, vocabulary()).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        decomposition.decompose(odd_docs, vocabulary(), room=1000)
