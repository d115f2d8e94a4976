"""Nothing is left out: all languages, windows that fingerprints do not show, changed notices, typed and chained assignments,
bare numbers."""

import random

import pyarrow as pa
from llm_helpers import words

from corvane.llm import decontaminate, language, licenses, pii, secrets


def _made_up(rng, n_languages, per):
    """Documents of languages that each prefer syllables of their own."""
    syllables = [a + b for a in "bcdfghjklmnpqrstvwxz" for b in ("a", "e", "i", "o", "u", "ar", "el", "in")]
    rows = []
    for k in range(n_languages):
        own = random.Random(k).sample(syllables, 12)
        for _ in range(per - k % 3):  # the last of each three have fewer rows
            text = " ".join("".join(rng.choice(own if rng.random() < 0.8 else syllables) for _ in range(3)) for _ in range(40))
            rows.append((len(rows), text, f"x{k:02d}"))
    return rows


def test_every_language_is_learned(spark):
    """More than 64 languages: each is learned and found again, also where the rows a language may have are few."""
    rng = random.Random(5)
    schema = "doc_id long, text string, lang string"
    docs, held = spark.createDataFrame(_made_up(rng, 80, 12), schema), spark.createDataFrame(_made_up(rng, 80, 5), schema)
    truth = {r["doc_id"]: r["lang"] for r in held.collect()}
    for machines in (language.train(docs), language.train(docs, sample=6, rows=1)):
        assert sum(map(len, machines.members.values())) == 80
        got = language.predict(held, machines).collect()
        assert sum(r["lang_pred"] == truth[r["id"]] for r in got) / len(got) > 0.95
        assert {r["lang_pred"] for r in got} == set(truth.values())


def test_a_language_of_one_row_in_many_is_learned(spark):
    rows = [(i, f"alpha beta gamma delta {i}", "xa") for i in range(400)] + [(1000, "ωμέγα ψι χι", "xb")]
    machines = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=1)
    assert machines.members == {"other": ["xa", "xb"]}


def test_rows_in_blocks_give_the_same_machines(spark, monkeypatch):
    import numpy as np

    docs = spark.createDataFrame(_made_up(random.Random(7), 4, 12), "doc_id long, text string, lang string")
    whole = language.train(docs)
    monkeypatch.setattr(language, "BLOCK", 5)
    parts = language.train(docs)
    assert whole.pairs.keys() == parts.pairs.keys() and all(np.allclose(whole.pairs[k][0], parts.pairs[k][0], atol=1e-4) for k in whole.pairs)


def test_no_window_is_dropped_for_its_fingerprint():
    """As many words replaced at the ends as the similarity allows: found at any radius, the exact similarity decides."""
    rng = random.Random(11)
    items = [words(rng, rng.randrange(14, 60)) for _ in range(40)]
    texts, want = [], set()
    for i, w in enumerate(items):
        most = int((len(w) - 4) * 0.2 / 1.8)
        for changed in (most, most + 1):  # one more is below 0.8
            texts.append(" ".join([f"p{i}"] * 3 + [f"r{i}x{k}" for k in range(changed // 2)] + w[changed // 2 : len(w) - (changed - changed // 2)] + [f"s{i}x{k}" for k in range(changed - changed // 2 + 3)]))
            if changed == most:
                want.add((len(texts) - 1, i))
    for radius in (0, 5, decontaminate.RADIUS):
        index = decontaminate.ItemIndex([" ".join(w) for w in items], radius)
        found = index.search(pa.array(texts))
        assert {(t, i) for t, i, *_ in found} == want and all(x[5] >= 0.8 for x in found)


def test_changed_notices_reach_their_coverage(spark):
    """Whatever words of a notice are changed: it is found where the rest has the coverage and its phrase stands."""
    rng = random.Random(17)
    vocabulary = sorted({w for _, text, _ in licenses.TEMPLATES for w in text.split()})
    for weights in ({w: 1.0 for w in vocabulary}, {w: rng.choice((0.1, 1.0, 3.0)) for w in vocabulary}):
        rows, want = [], []
        for label, text, phrase in licenses.TEMPLATES:
            notice = text.split()
            rarest = sorted(range(len(notice)), key=lambda i: (-weights[notice[i]], notice[i]))
            for trial in range(12):
                out = set(rarest[:3] if trial == 0 else rarest[1:4] if trial == 1 else rng.sample(range(len(notice)), rng.randrange(len(notice) // 2)))
                new = ["zz" if i in out else w for i, w in enumerate(notice)]
                kept = sum(weights[w] for w, x in zip(notice, new, strict=True) if w == x) / sum(weights[w] for w in notice)
                if abs(kept - licenses.COVERAGE) > 1e-6:
                    rows.append((len(rows), " ".join(["so", "we", *new, "and", phrase])))
                    want.append((label, 2, kept) if kept >= licenses.COVERAGE else None)
        hits = {r["id"]: r["hits"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), weights).collect()}
        for i, x in enumerate(want):
            own = [h for h in hits[i] if x and h["label"] == x[0] and h["start"] == 2 and abs(h["coverage"] - x[2]) < 1e-9]
            assert len(own) == (x is not None), rows[i]
        assert sum(x is not None for x in want) > 60


def test_typed_prefixed_and_chained_assignments():
    lit = "aB3$xY9!kLm2"
    for text in (
        f'db_password: str = "{lit}"', f'const dbPassword: string = "{lit}";', f'db_pwd: Optional[str] = "{lit}"', f'db_pwd: str | None = "{lit}"', f'a = client_pwd = "{lit}"', f'client_pwd = a = "{lit}"',
        f'a=client_pwd="{lit}"', f'pwd = f"{lit}"', f"pwd = r'{lit}'", f'k = "{lit}"\na = client_pwd = k', f'client_pwd: str = x = "{lit}"',
    ):
        assert [text[a:b] for a, b, _, _ in secrets.lex(text)] == [lit], text
    assert [(a, b) for a, b, _, _ in secrets.lex('pwd = f"aB3$xY9!{user}kLm2"')] == [(8, 16), (22, 26)]
    for text in (f'x: string = "{lit}"; pwd: string;', 'pwd = f"{first}{second}"', f'pwd == "{lit}"', "pwd: str", "a = " * 30_000 + "a=" * 30_000):
        assert secrets.lex(text) == [], text[:40]
    for text in ("password: key=abc123XYZ9", "pwd = YWJjZGVmMTIz="):  # whole values of configuration lines, as before
        assert [text[a:b] for a, b, _, _ in secrets.lex(text)] == [text.split(" ")[-1]]


def test_bare_phone_numbers_and_timestamps():
    names, back = pii.Pseudonyms(), pii.Pseudonyms(undo=True)
    for value, kind in (("+14155552671", "phone"), ("+442071838750", "phone"), ("+3541234567", "phone"), ("415 555 2671", "phone"), ("2021-03-04", "date")):
        for before, after in (("on ", "T10:00:00Z" if kind == "date" else " now"), ("(", "t1000+01:00)" if kind == "date" else ")"), ("", "")):
            new, found = pii.replaced(before + value + after, names)
            assert [(a, b, k) for a, b, k, _ in found] == [(len(before), len(before) + len(value), kind)], value
            put = found[0][3]
            assert put != value and [c.isdigit() for c in put] == [c.isdigit() for c in value] and new == before + put + after
            assert pii.replaced(new, back)[0] == before + value + after
    digits = lambda s: [c for c in s if c.isdigit()]
    assert digits(names.phone("+14155552671")) == digits(names.phone("+1 415 555 2671")) and digits(names.phone("415 555 2671")) == digits(names.phone("415-555-2671"))
    assert names.phone("+442071838750")[:3] == "+44" and names.phone("+3541234567")[:4] == "+354"
    for text in ("2021-03-04Tail", "2021-03-04x", "2021-13-04T10:00:00Z", "+1234", "+12345678901234567", "1415 555 2671", "415 555 26711", "a415 555 2671"):
        assert pii.replaced(text, names) == (text, []), text
