"""Bounds that hold on rows made to break them."""

import random
import time

from llm_helpers import words

from corvane.llm import pii, toxicity


def test_long_local_parts_are_replaced_whole():
    key = b"k"
    began = time.perf_counter()
    for n in (1, 63, 64, 65, 70, 500, 1_000_000):
        rng = random.Random(n)
        local = "".join(rng.choice("abcdefgh0123._%+-") for _ in range(n - 1)) + "z"
        text = f"to <{local}@example.org>, x"
        new = pii.replaced(text, pii.Pseudonyms(key))[0]
        assert new.startswith("to <") and new.endswith("@example.org>, x") and len(new) == len(text) and new != text
        assert pii.replaced(new, pii.Pseudonyms(key, undo=True))[0] == text
        if n > 100:
            assert new[4 : 4 + n - 64] != local[: n - 64]  # what lies before the last 64 characters too
    assert time.perf_counter() - began < 30
    assert [v for v in pii.values("@a.bc é@x.de a@b")] == []


def test_many_signs_are_walked_once():
    began = time.perf_counter()
    assert len(list(pii.values("a" * 300_000 + "@" + "a.bc@" * 50_000))) > 0
    assert time.perf_counter() - began < 5


def test_a_repeated_id_stays_within_the_bound(spark, monkeypatch):
    rng = random.Random(9)
    ordinary = [(i, " ".join(words(rng, 50, 300)) + (" vile" if i % 2 else "")) for i in range(100)]
    # One id with a third of all rows: equal rows, different texts, and one text beyond the bound by itself.
    hot = [(1, "same vile words here")] * 40 + [(1, " ".join(words(rng, 40)) + " vile") for _ in range(30)] + [(1, " ".join(words(rng, 3000, 10**6)))]
    docs = spark.createDataFrame(ordinary + hot, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    sent = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, prior: sent.append([(y, len(k)) for k, _, _, y in rows]) or real(rows, prior))
    for most in (4000, 400_000):
        monkeypatch.setattr(toxicity, "ENTRIES", most)
        machine = toxicity.train(docs, labels)
    small, whole = sent
    for y in (0, 1):
        assert 0 < sum(n for label, n in small if label == y) <= 2000
    assert len(whole) == 100 + 31 + 1  # rows alike once
    got = {r["id"]: r["score"] for r in toxicity.score(docs, machine).collect()}
    assert got[3] > got[2]
