"""Scores of the learned operators against plain sums and votes; bounds of their samples."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_helpers import words

from corvane.llm import language, toxicity


def test_scores_equal_the_sum_over_all_pairs():
    rng = random.Random(6)
    texts = [" ".join(words(rng, n, 60)) for n in (0, 1, 5, 40, 300)] + [None, "", "?!"]
    row, key, _ = toxicity.terms(pa.array(texts))
    keys = np.unique(key)[::2]
    gen = np.random.default_rng(1)
    m = toxicity.Machine(keys, -0.3, gen.normal(0, 0.3, len(keys)), gen.normal(0, 0.3, (len(keys), 3)))
    place = {int(k): i for i, k in enumerate(keys)}
    for t, (text, got) in enumerate(zip(texts, m.score(pa.array(texts)), strict=True)):
        count = Counter(place[int(k)] for k in key[row == t] if int(k) in place)
        n = max(len(re.findall("[0-9a-z]+", text or "")), 20)
        x = {i: math.log1p(100 * c / n) for i, c in count.items()}
        z = m.w0 + sum(m.w[i] * v for i, v in x.items()) + sum(float(m.v[i] @ m.v[j]) * x[i] * x[j] for i in x for j in x if i < j)
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


def brute_counts(text):
    """Features of one text, a pair and a triple of bytes at a time."""
    out = np.zeros(language.WIDTH)
    data = [b if 97 <= b < 123 or b >= 128 else 32 for b in text.lower().encode()]
    for size, base, width in ((2, 0, language._PAIRS), (3, language._PAIRS, language._TRIPLES)):
        for i in range(len(data) - size + 1):
            code = 0
            for b in data[i : i + size]:
                code = (code * 256 + b) % 2**32
            out[((code * 2654435761) % 2**32 >> 15) % width + base] += 1
    return out


def test_features_equal_brute_force(monkeypatch):
    texts = ["", "a", "ab", "Der Äpfel, die Bäume!", "x" * 50 + " y", "日本語 text", None, "one more"]
    whole = language.counts(pa.array(texts))
    assert all((whole[i] == brute_counts(t or "")).all() for i, t in enumerate(texts))
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(language, "_PIECE", piece)
        assert (language.counts(pa.array(texts)) == whole).all()


def test_predictions_equal_plain_votes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0")
    machines = language.train(docs)
    texts = [r["text"] for r in docs.limit(60).collect()]
    names, _ = machines.predict(pa.array(texts))
    for text, name in zip(texts, names, strict=True):
        c = brute_counts(text)
        x = np.sqrt(c / max(c.sum(), 1)).astype(np.float32)
        tops = {f: float(x @ machines.tops[f][0] + machines.tops[f][1]) for f in sorted(machines.members)}
        langs = machines.members[max(tops, key=tops.get)]
        votes, margin = Counter(), Counter()
        for (a, b), (w, c0) in machines.pairs.items():
            if a in langs and b in langs:
                d = float(x @ w + c0)
                votes[a if d > 0 else b] += 1
                margin[a] += d
                margin[b] -= d
        assert name == max(langs, key=lambda n: votes[n] + 0.4 * math.tanh(margin[n]))


def test_samples_are_bounded_by_entries(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 50, 300)), "xa" if i % 2 else "xb") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    seen = []
    monkeypatch.setattr(toxicity, "ENTRIES", 2000)
    monkeypatch.setattr(toxicity, "fit", lambda rows, prior: seen.append(rows))
    toxicity.train(docs, labels)
    by = Counter(r[3] for r in seen[0])
    assert 1 <= by[0] < 25 and 1 <= by[1] < 25 and sum(len(r[0]) for r in seen[0]) <= 2000
    monkeypatch.setattr(language, "ENTRIES", 200)
    monkeypatch.setattr(language, "fit", lambda x, lang: seen.append((x, lang)))
    language.train(docs)
    x, lang = seen[1]
    assert set(lang) == {"xa", "xb"} and len(x.cols) <= 200 and len(lang) < 60
    same = spark.createDataFrame([(None, "a text in many rows", "xa")] * 500 + rows[:4], "doc_id long, text string, lang string")
    language.train(same)
    assert len(seen[2][1]) == 5
