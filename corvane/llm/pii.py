"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Values are found in whole texts and validated (checksums, calendars, ranges) before they are touched; each is then replaced by
another valid value of its own format: a card stays a card with a right check digit, a date a date of the calendar with as many
digits for day and month and in the same order; separators, case and the numbers of digits stay (but for IPv4 addresses and the names of
months). The permutation depends on the key and the kind of value only, so equal values get equal
pseudonyms in all documents, however they are separated. Where a format holds fewer values (days of one digit, say), the cycle is followed
to the next value that it holds: equal dates of one form stay linked in any case, those of different forms where both hold the first step. No
value ever stands for itself, and the holder of the key can undo every form exactly (an IPv6 address in mixed case comes back in lower case).

The key is a parameter; without one it is read from ``spark.corvane.pii.key`` of the session or ``CORVANE_PII_KEY`` of the
environment, and where neither is set it is a random one of this process: pseudonyms are linked within it and can't be undone after it.

Defined cases: a null text stays null, an empty one empty; what fails its validation is left alone; equal rows give equal
rows; values never overlap (the one that starts first counts, at one place the first kind of ``KINDS``); very long texts are read
whole, in one pass per kind of pattern; digits beyond ASCII are no digits; a number behind ``version`` or ``build`` is no address; an empty table gives no rows; other columns are not
read, and ``replace_text`` hands them on as they are.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import os
import re
import secrets as random
import warnings
from collections.abc import Callable, Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import map_arrow, table

KEY_CONF, KEY_VARIABLE = "spark.corvane.pii.key", "CORVANE_PII_KEY"
KINDS = ("email", "iban", "ipv4", "ipv6", "date", "phone", "ssn", "card")
#: English month names, and dates are permuted within these years.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@cache
def _own_key() -> bytes:
    """The environment's key, or a random one of this process."""
    if found := os.environ.get(KEY_VARIABLE):
        return found.encode()
    warnings.warn(f"neither {KEY_CONF} nor {KEY_VARIABLE} is set: pseudonyms take a random key, which is not kept", stacklevel=3)
    return random.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The session's key, or the environment's, or a random one: on the driver, once for all tasks."""
    found = spark.conf.get(KEY_CONF, None)
    return found.encode() if found else _own_key()


class Feistel:
    """Keyed permutations of 0 to n - 1 for any n, without fixed points (for n > 1)."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _f(self, kind: str, n: int, r: int, x: int, m: int) -> int:
        size = max(16, (m.bit_length() + 7) // 8 + 8)
        h = hashlib.shake_128(self.key + f"|{kind}|{n}|{r}|{x}".encode()).digest(size)
        return int.from_bytes(h, "big") % m

    def _walk(self, kind: str, n: int, x: int, back: bool) -> int:
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:  # the halves' product exceeds n by less than one half: few steps, back inside always
            left, right = x % a, x // a
            for r in reversed(range(self.rounds)) if back else range(self.rounds):
                if r % 2:
                    right = (right + (-1 if back else 1) * self._f(kind, n, r, left, b)) % b
                else:
                    left = (left + (-1 if back else 1) * self._f(kind, n, r, right, a)) % a
            x = right * a + left
            if x < n:
                return x

    def permute(self, kind: str, n: int, x: int, undo: bool = False) -> int:
        """One step along a keyed cycle through all values: a permutation that moves every one."""
        if n < 2:
            return x
        return self._walk(kind, n, (self._walk(kind, n, x, False) + (-1 if undo else 1)) % n, True)


def luhn(digits: str) -> int:
    """The sum that is 0 for a right check digit."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def _number(chars: str) -> tuple[int, int]:
    """The value and the number of values of digits and letters, each within its class."""
    x, n = 0, 1
    for c in chars:
        base, at = (10, ord(c) - 48) if c.isdigit() else (26, ord(c.lower()) - 97)
        x, n = x * base + at, n * base
    return x, n


def _spell(x: int, like: str) -> str:
    out = []
    for c in reversed(like):
        x, at = divmod(x, 10 if c.isdigit() else 26)
        out.append(chr(48 + at) if c.isdigit() else chr((65 if c.isupper() else 97) + at))
    return "".join(reversed(out))


def _poured(new: str, like: str) -> str:
    """The characters of new in the places of the ASCII letters and digits of like."""
    it = iter(new)
    return "".join(next(it) if re.match("[A-Za-z0-9]", c) else c for c in like)


class Pseudonyms:
    """Replaces values: one method per kind, each with the value's whole text; None where it is not valid."""

    def __init__(self, key: bytes | None = None, undo: bool = False):
        self.f, self.undo = Feistel(_own_key() if key is None else key), undo

    def _step(self, kind: str, n: int, x: int, fits: Callable[[int], bool]) -> int:
        """The next value of the cycle that the format holds: a permutation of those it holds, as x is one of them."""
        x = self.f.permute(kind, n, x, self.undo)
        while not fits(x):
            x = self.f.permute(kind, n, x, self.undo)
        return x

    def _chars(self, kind: str, text: str) -> str:
        core, out = re.sub("[^A-Za-z0-9]", "", text), []
        for a in range(0, len(core), 64):  # longer ones in stretches, each with a permutation of its own: time grows with the length
            x, n = _number(core[a : a + 64])
            out.append(_spell(self.f.permute(f"{kind}:{a}" if a else kind, n, x, self.undo), core[a : a + 64]))
        return _poured("".join(out), text)

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        return f"{self._chars('email@' + domain.lower(), local)}@{domain}" if re.search("[A-Za-z0-9]", local) else None

    def iban(self, text: str) -> str | None:
        core = re.sub(r"\s", "", text)
        value = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(core) <= 34 or value(core[4:] + core[:4]) % 97 != 1:
            return None
        rest = self._chars("iban" + core[:2], core[4:])
        return _poured(core[:2] + f"{98 - value(rest + core[:2] + '00') % 97:02d}" + rest, text)

    def ipv4(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
            return None
        x = self.f.permute("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"), self.undo)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ipv6(self, text: str) -> str | None:
        """Hexadecimal digits where they are written; what is left out stays left out."""
        if not _is_ipv6(text):
            return None
        digits = re.sub("[^0-9A-Fa-f]", "", text)
        upper = bool(re.search("[A-F]", digits)) and not re.search("[a-f]", digits)

        def spelt(x: int) -> str:
            it = iter(f"{x:0{len(digits)}{'X' if upper else 'x'}}")
            return "".join(c if c == ":" else next(it) for c in text)

        # In capitals only where a letter shows it.
        x = self._step("ipv6", 16 ** len(digits), int(digits, 16), lambda x: _is_ipv6(spelt(x)) and (not upper or bool(re.search("[A-F]", spelt(x)))))
        return spelt(x)

    def date(self, text: str) -> str | None:
        month_first = False
        if m := re.fullmatch(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})", text):
            y, mo, d, like = m[1], m[3], m[4], "{y}" + m[2] + "{m}" + m[2] + "{d}"
        elif m := re.fullmatch(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})", text):
            month_first = int(m[3]) > 12
            y, mo, d = m[4], m[1 if month_first else 3], m[3 if month_first else 1]
            like = ("{m}" + m[2] + "{d}" if month_first else "{d}" + m[2] + "{m}") + m[2] + "{y}"
        elif m := re.fullmatch(r"(\d{1,2})( )([A-Za-z]+)( )(\d{4})", text):
            y, mo, d, like = m[5], m[3], m[1], "{d} {m} {y}"
        elif m := re.fullmatch(r"([A-Za-z]+) (\d{1,2})(,? )(\d{4})", text):
            y, mo, d, like = m[4], m[1], m[2], "{m} {d}" + m[3] + "{y}"
        else:
            return None
        named = mo.lower() in MONTHS
        try:
            day = datetime.date(int(y), MONTHS.index(mo.lower()) + 1 if named else int(mo), int(d)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None

        def fits(x: int) -> bool:
            """Digits as many as before; a month-first date is one that no day-first date is: its day is over 12."""
            new = datetime.date.fromordinal(FIRST_DAY + x)
            if named:
                return new.day < 10 if len(d) == 1 or d[0] == "0" else new.day >= 10
            return (len(d) == 2 or new.day < 10) and (len(mo) == 2 or new.month < 10) and (not month_first or new.day > 12)

        new = datetime.date.fromordinal(FIRST_DAY + self._step("date", LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY, fits))
        month = MONTHS[new.month - 1] if named else f"{new.month:0{len(mo)}d}"
        if named:
            month = month.upper() if mo.isupper() else month.capitalize() if mo[0].isupper() else month
        return like.format(y=f"{new.year}", m=month, d=f"{new.day:0{len(d)}d}")

    def phone(self, text: str) -> str | None:
        m = re.match(r"\+\d{1,3}(?=[ .\-(])", text) or _COUNTRY.match(text)
        head = m[0] if m else ""
        rest = text[len(head) :]
        digits = re.sub(r"\D", "", rest)
        if not 7 <= len(digits) <= 14 or not head and len(digits) != 10:
            return None
        x, n = _number(digits)
        return head + _poured(_spell(self.f.permute("phone", n, x, self.undo), digits), rest)

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.f.permute("ssn", 898 * 99 * 9999, x, self.undo), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn(digits) or not digits.strip("0"):
            return None
        body = _spell(self._step("card", 10 ** (len(digits) - 1), int(digits[:-1]), bool), digits[:-1])  # never all zeros
        return _poured(body + str(-luhn(body + "0") % 10), text)


def _is_ipv6(text: str) -> bool:
    """An address that is no word of a program: with a decimal digit and five digits or more."""
    if len(text) - text.count(":") < 5 or not re.search("[0-9]", text):
        return False
    try:
        return ipaddress.IPv6Address(text).scope_id is None
    except ValueError:
        return False


_MONTH = "|".join(MONTHS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_NAMED = re.compile(rf"(?i)(?<![\w])(?:[0-9]{{1,2}} (?:{_MONTH}) [0-9]{{4}}|(?:{_MONTH}) [0-9]{{1,2}},? [0-9]{{4}})(?!\w)")
#: The country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")
_IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]{7,39}(?![\w:]|\.[0-9]))(?=[0-9A-Fa-f]*:)(?:[0-9A-Fa-f]{0,4}:){2,8}[0-9A-Fa-f]{0,4}(?![\w:])")
#: What stands before a number that is no address.
_VERSION = re.compile(r"(?i)(?:\b(?:version|release|build|ver|rev|v)\.?[ :=]{0,3})\Z")
#: A time behind a date.
_TIME = re.compile(r"[Tt][0-9]{2}(?::?[0-9]{2}|(?=[Zz+\-]))")
#: A stretch of digits and separators; its values are looked for inside.
_RUN = re.compile(r"[+(]?[0-9][0-9 ().+/\-]{5,}[0-9]")
_VALUE = re.compile(
    r"""(?<![\w+])(?:
    (?P<ipv4>(?<![0-9]\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9]))
    |(?P<date>[0-9]{4}([-/.])[0-9]{1,2}\3[0-9]{1,2}(?![0-9])|[0-9]{1,2}([-/.])[0-9]{1,2}\4[0-9]{4}(?![0-9]))
    |(?P<phone>(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|(?:\+[0-9]{1,3}[ .\-])?[0-9]{3}([.\-])[0-9]{3}\6[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .\-]\(?[0-9]{1,8}\)?){1,5}(?![0-9])|\+[1-9][0-9]{6,14}(?![0-9])|[0-9]{3}[ ][0-9]{3}[ ][0-9]{4}(?![0-9]))
    |(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]))
    |(?P<card>[0-9]{13,19}(?![0-9])|[0-9]{4}([ \-])[0-9]{4}\9[0-9]{4}\9[0-9]{4}(?![0-9])|[0-9]{4}([ \-])[0-9]{6}\10[0-9]{5}(?![0-9]))
    )(?!\w)""",
    re.X,
)


def values(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of what looks like a value, in no order; not yet validated."""
    at = text.find("@")
    while at >= 0:
        left, right = at, _DOMAIN.match(text, at + 1)
        while right and left and text[left - 1] in _LOCAL:  # back to the first sign that is in no local part: stretches between two @ are walked once
            left -= 1
        if left < at and right:
            yield left, right.end(), "email"
        at = text.find("@", at + 1)
    if not re.search("[0-9]", text):
        return
    yield from ((m.start(), m.end(), "iban") for m in _IBAN.finditer(text))
    yield from ((m.start(), m.end(), "date") for m in _NAMED.finditer(text))
    if "::" in text or text.count(":") > 6:
        yield from ((m.start(), m.end(), "ipv6") for m in _IPV6.finditer(text))
    for run in _RUN.finditer(text):
        for m in _VALUE.finditer(text, run.start(), run.end()):
            if m["ipv4"] and _VERSION.search(text, max(0, m.start() - 12), m.start()):
                continue
            timed = m["date"] and m["date"][:4].isdigit() and _TIME.match(text, m.end())
            if timed or not (m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_")):
                yield m.start(), m.end(), m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if k in m.groupdict() and m[k])


def replaced(text: str, names: Pseudonyms) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with pseudonyms, and (start, end, kind, pseudonym) of each value, by place in the text as it was."""
    out, found, done = [], [], 0
    for a, b, kind in sorted(values(text), key=lambda x: (x[0], KINDS.index(x[2]))):
        if a >= done and (new := getattr(names, kind)(text[a:b])) is not None:
            out += [text[done:a], new]
            found.append((a, b, kind, new))
            done = b
    return ("".join([*out, text[done:]]) if found else text), found


def _maybe(col: pa.Array) -> np.ndarray:
    """Rows that can hold a value at all: with a digit or an at sign."""
    return pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False).to_numpy(zero_copy_only=False)


_FOUND = "array<struct<start:bigint,end:bigint,kind:string,pseudonym:string>>"


def pseudonymise(docs: DataFrame, key: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, found): whole texts with pseudonyms, and what was replaced where."""
    src, key = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), session_key(docs.sparkSession) if key is None else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("pseudonym", pa.string())]))
        for b in batches:
            text, found = [], []
            for t, maybe in zip(b.column(1).to_pylist(), _maybe(b.column(1)), strict=True):
                new, own = replaced(t, names) if maybe else (t, [])
                text.append(new)
                found.append([dict(zip(("start", "end", "kind", "pseudonym"), x, strict=True)) for x in own])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(found, kind)], ["id", "text", "found"])

    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, text string, found {_FOUND}")


def replace_text(docs: DataFrame, key: bytes | None = None, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in the text column; all other columns as they are. Nothing is shuffled."""
    at, key = docs.columns.index(text_col), session_key(docs.sparkSession) if key is None else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for b in batches:
            col = b.column(at)
            new = [replaced(t, names)[0] if maybe else t for t, maybe in zip(col.to_pylist(), _maybe(col), strict=True)]
            arrays = [pa.array(new, col.type) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, b.schema.names)

    return map_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and the numbers and places of the values replaced."""
    found = pseudonymise(table(spark, sf_dir, "documents"))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "text", *map(count, KINDS), spans.alias("spans"))
