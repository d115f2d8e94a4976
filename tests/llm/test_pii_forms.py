"""Personal data: every form is undone exactly and keeps its format; values found equal a plain search."""

import datetime
import random
import re

from corvane.llm import pii

KEY = b"a key of the tests"


def test_dates_of_every_form_come_back():
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, undo=True)
    rng = random.Random(3)
    forms = (
        lambda d: f"{d:%Y-%m-%d}", lambda d: f"{d.year}/{d.month}/{d.day}", lambda d: f"{d:%d.%m.%Y}", lambda d: f"{d.day}.{d.month}.{d.year}", lambda d: f"{d:%m/%d/%Y}", lambda d: f"{d.month}/{d.day}/{d.year}",
        lambda d: f"{d:%d}/{d.month}/{d.year}", lambda d: f"{d.day} {d:%B} {d.year}", lambda d: f"{d:%B} {d.day}, {d.year}", lambda d: f"{d:%B %d, %Y}".upper(), lambda d: f"{d:%d} {d:%B} {d.year}".lower(),
    )
    shape = lambda s: re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "0", s))
    for _ in range(3000):
        day = datetime.date.fromordinal(rng.randrange(pii.FIRST_DAY, pii.LAST_DAY + 1))
        for form in forms:
            value = form(day)
            new = there.date(value)
            assert new != value and shape(new) == shape(value) and back.date(new) == value, (value, new)
            assert pii.replaced(f"on {new}T10:00:00Z" if form is forms[0] else f"on {new};", back)[0][3:].startswith(value)


def test_dates_of_one_form_are_permuted():
    there = pii.Pseudonyms(KEY)
    days = [datetime.date.fromordinal(x) for x in range(pii.FIRST_DAY, pii.LAST_DAY + 1, 7)]
    values = [f"{d.month}/{d.day}/{d.year}" for d in days if d.day > 12]
    assert len({there.date(v) for v in values}) == len(values)
    assert there.date("2020-03-05") == there.date("2020-03-05") and there.date("05.03.2020").split(".")[::-1] == there.date("2020-03-05").split("-")


def test_addresses():
    there, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, undo=True)
    for value in ("2001:db8::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "FE80::0202:B3FF:FE1E:8329", "10.0.0.1", "255.255.255.255"):
        new, found = pii.replaced(f"from {value}, port 1", there)
        assert len(found) == 1 and found[0][3] != value and pii.replaced(new, back)[0] == f"from {value}, port 1", (value, found)
        if ":" in value:
            assert re.sub("[0-9A-Fa-f]", "0", found[0][3]) == re.sub("[0-9A-Fa-f]", "0", value)
    for text in ("version 1.2.3.4", "v1.2.3.4", "Build: 10.2.3.4", "std::vector", "dead::beef", "a::b", "12:30:45", "00:1b:44:11:3a:b7", "::1", "١٢.١.١.١"):
        assert pii.replaced(text, there) == (text, []), text


def test_values_found_equal_a_plain_search(spark, sf_dir):
    """Each pattern at every place of the text, without the stretches of digits that the operator looks for first."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect() if r["text"]]
    names, n = pii.Pseudonyms(KEY), 0
    for text in texts:
        plain = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", text)]
        plain += [(m.start(), m.end(), "iban") for m in pii._IBAN.finditer(text)] + [(m.start(), m.end(), "date") for m in pii._NAMED.finditer(text)] + [(m.start(), m.end(), "ipv6") for m in pii._IPV6.finditer(text)]
        at = 0
        while m := pii._VALUE.search(text, at):
            plain.append((m.start(), m.end(), next(k for k in pii.KINDS if m.groupdict().get(k))))
            at = m.end()
        want, done = [], 0
        for a, b, kind in sorted(plain, key=lambda x: (x[0], pii.KINDS.index(x[2]))):
            if a >= done and getattr(names, kind)(text[a:b]) is not None:
                want.append((a, b, kind))
                done = b
        assert [x[:3] for x in pii.replaced(text, names)[1]] == want
        n += len(want)
    assert n > 10


def test_the_key_decides(spark):
    df = spark.createDataFrame([(1, "born 1999-12-31")], "doc_id long, text string")
    text = lambda **o: pii.pseudonymise(df, **o).first()["text"]
    assert text(key=b"a") == text(key=b"a") != text(key=b"b") and text() == text()
    spark.conf.set(pii.KEY_CONF, "of the session")
    try:
        assert text() == text(key=b"of the session") == pii.replace_text(df).first()["text"]
    finally:
        spark.conf.unset(pii.KEY_CONF)
