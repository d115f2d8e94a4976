"""Item-sized windows: fingerprints, the index's selectivity, and recall against all windows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_helpers import words

from corvane.llm import decontaminate as dc
from corvane.llm.common import word_hashes


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))


def best(text, item):
    """The first best window by brute force: (start, similarity)."""
    n, own, found = min(len(item), len(text)), bag(item), (0, 0.0)
    if not n or (len(item) < 5) != (len(text) < 5) and len(item) < 5:
        return found
    for a in range(len(text) - n + 1):
        w = bag(text[a : a + n])
        both = sum((w & own).values())
        sim = both / (sum(w.values()) + sum(own.values()) - both)
        if sim > found[1]:
            found = (a, sim)
    return found


def edited(rng, item, kind):
    w = list(item)
    for _ in range(rng.randrange(1, 1 + max(2, len(w) // 22))):
        at = rng.randrange(len(w))
        if kind == "replace":
            w[at] = f"q{rng.randrange(10**6)}"
        elif kind == "insert":
            w.insert(at, f"q{rng.randrange(10**6)}")
        elif kind == "delete" and len(w) > 1:
            del w[at]
        elif kind == "ends":
            k = rng.randrange(0, max(1, len(w) // 8) + 1)
            w = w[rng.randrange(k + 1) :]
            w = w[: len(w) - rng.randrange(k + 1)] or w
        elif kind == "turn":
            w = w[at:] + w[:at]
    return w


def test_no_window_at_the_similarity_is_lost():
    rng = random.Random(23)
    items = [words(rng, rng.choice((5, 8, 14, 22, 33, 39, 40, 44, 59, 76, 90, 140, 200)), rng.choice((40, 5000))) for _ in range(60)] + [["a", "b", "a"], ["a"] * 30, ["ab", "cd"] * 20]
    texts = []
    for _ in range(700):
        item = rng.choice(items)
        around = rng.choice((0, 0, 3, 60))
        texts.append(words(rng, rng.randrange(around + 1), 5000) + edited(rng, item, rng.choice(("replace", "insert", "delete", "ends", "turn", "none"))) + words(rng, rng.randrange(around + 1), 5000))
    got = {(t, i): (a, s) for t, i, a, _, _, s in dc.ItemIndex([" ".join(x) for x in items]).search(pa.array([" ".join(t) for t in texts]))}
    want = {}
    for t, x in enumerate(texts):
        have = set(x)
        for i, item in enumerate(items):
            if len(have & set(item)) * 2 >= len(set(item)):
                a, s = best(x, item)
                if s >= 0.8:
                    want[t, i] = (a, s)
    assert got.keys() == want.keys() and len(want) > 320
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    near = sum(got[k][0] == want[k][0] for k in want)
    assert near >= 0.99 * len(want)  # texts of one word over and over have the same window at many places


def test_prints_are_majorities():
    h, _ = word_hashes(pa.array([" ".join(words(random.Random(4), 40_000))]))
    seen = Counter()
    for size, a, prints in dc.window_prints(h, [1, 5, 20, 39]):
        seen[size] += len(prints)
        for k in range(0, len(prints), 4999):
            w = h[a + k : a + k + size]
            assert prints[k] == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in w) > size)
    assert seen == {s: len(h) - s + 1 for s in (1, 5, 20, 39)}


def test_the_index_selects():
    """Of random windows hardly any item is a candidate; of those that hold an item, that one."""
    rng = random.Random(31)
    items = [words(rng, rng.randrange(15, 60)) for _ in range(2000)]
    index = dc.ItemIndex([" ".join(x) for x in items])
    text = words(rng, 20_000)
    h, ptr = word_hashes(pa.array([" ".join(text), " ".join(text[:500] + items[7] + text[500:])]))
    got = index.candidates(h, ptr)
    assert len(got) < 0.0005 * len(items) * len(h)
    assert [7] == np.unique(got[(got[:, 0] == 1) & (got[:, 4] == 0), 1]).tolist()
