"""Text as Column functions: tokens, identifiers, truncation, redaction, tagged replies. Built-ins only.

Patterns are Java's; where Unicode white space matters they carry (?U).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns and limits that results depend on.
TOKEN = r"[a-z0-9_]+(?:\.[a-z0-9_]+)*"
SYMBOL = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Za-z_][A-Za-z0-9_]*_[A-Za-z0-9_]+"
CAMEL = r"\A[A-Z][A-Za-z0-9]*\z"
KEY_PATTERNS = (r"AIza[0-9A-Za-z_-]{30,}", r"lsv2_[A-Za-z0-9_]{20,}", r"sk-[A-Za-z0-9_-]{20,}")
TAGS = ("explanation", "code", "tests", "docs_used")
HASH_TOKEN = r"[a-z0-9_.]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(_col(c), r"(?U)\A\s+|\s+\z", "")


def collapse(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def tokenize(c: Column | str) -> Column:
    """Lower-cased words and dotted names; a dotted name is followed by its parts. Duplicates stay."""
    found = F.regexp_extract_all(F.lower(blank_if_null(c)), F.lit(TOKEN), F.lit(0))
    return F.flatten(F.transform(found, lambda x: F.when(F.contains(x, F.lit(".")), F.concat(F.array(x), F.split(x, r"\."))).otherwise(F.array(x))))


def index_text(text: Column | str, *names: Column | str) -> Column:
    """What the lexical index sees of a chunk: its names, then its text."""
    return F.concat_ws(" ", *map(blank_if_null, names), blank_if_null(text))


def stable_id(*parts: Column | str) -> Column:
    """16 hexadecimal digits of the parts' SHA-1, with NUL between them; a null part counts as empty."""
    return F.substring(F.sha1(F.concat_ws("\x00", *[blank_if_null(_col(p).cast("string")) for p in parts])), 1, 16)


def is_symbol_query(c: Column | str) -> Column:
    """A dotted or underscored name anywhere, or one capitalised word alone."""
    s = strip(c)
    return s.rlike(SYMBOL) | s.rlike(CAMEL)


def truncate(c: Column | str, limit: int) -> Column:
    """At most limit characters: cut after the last sentence, else before the last newline, else the last blank; then an ellipsis."""
    text = _col(c)
    if limit <= 0:
        return text
    window = F.substring(text, 1, limit - 1)
    sentence = F.regexp_extract(window, r"(?sU)\A(.*[.!?])(?=\s|\z)", 1)
    line, word = (F.regexp_extract(window, rf"(?s)\A(.+){sep}", 1) for sep in ("\n", " "))
    cut = F.coalesce(*[F.when(x != "", x) for x in (sentence, line, word)], window)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+\z", ""), F.lit("…")))


def first_sentence(name: Column | str, doc: Column | str, limit: int = 200) -> Column:
    """name: the first sentence or paragraph of doc, for embedding."""
    head = F.trim(F.substring(collapse(F.split(blank_if_null(doc), r"(?:\. |\n\s*\n)", 2)[0]), 1, limit))
    return F.when(head == "", _col(name)).otherwise(F.concat_ws(": ", _col(name), head))


def short_query(c: Column | str, limit: int = 500) -> Column:
    return F.substring(collapse(c), 1, limit)


def ascii_safe(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[^\x00-\x7F]", "?")


def reply_head(c: Column | str, limit: int = 200) -> Column:
    """The first characters of a reply for a log: one line of ASCII."""
    return collapse(ascii_safe(F.substring(blank_if_null(c), 1, limit)))


def snippet(c: Column | str, limit: int = 600) -> Column:
    s = collapse(c)
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("..."))).otherwise(s)


def redact(c: Column | str, secrets: tuple[str, ...] = (), limit: int = 2000) -> Column:
    """Exact secrets (8 characters or more) and key patterns as ***; cut to limit only afterwards, so that no part of a key stays."""
    out = _col(c)
    for s in secrets:
        if s and len(s) >= 8:
            out = F.replace(out, F.lit(s), F.lit("***"))
    for p in KEY_PATTERNS:
        out = F.regexp_replace(out, p, "***")
    return F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit("...[truncated]"))).otherwise(out)


def redact_all(c: Column, kind: T.DataType, secrets: tuple[str, ...] = (), limit: int = 2000) -> Column:
    """A value of any type with every text in it redacted: fields of structs, elements of arrays, keys and values of maps, all that is in a variant. Built from the
    type alone, as one expression; what holds no text is passed on as it is, nulls stay nulls.

    Keys of a map that become equal leave one entry, the last. A variant goes through its JSON form, in which texts are not cut, and is the text *** where that has a key twice afterwards.
    """
    if not _holds_text(kind):
        return c
    if isinstance(kind, T.StringType):
        return redact(c, secrets, limit)
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[redact_all(c.getField(f.name), f.dataType, secrets, limit).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_all(x, kind.elementType, secrets, limit))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(redact_all(e["key"], kind.keyType, secrets, limit).alias("key"), redact_all(e["value"], kind.valueType, secrets, limit).alias("value")))
        # The entries are bound once, so that they are not computed anew for each of them.
        last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.greatest(F.size(es), F.lit(1))), lambda other: other["key"] == e["key"]))
        return F.map_from_entries(F.get(F.transform(F.array(entries), last), F.lit(0))) if _holds_text(kind.keyType) else F.map_from_entries(entries)
    escaped = tuple(json.dumps(x, ensure_ascii=False)[1:-1] for x in secrets if x and len(x) >= 8)
    return F.when(c.isNotNull(), F.coalesce(F.try_parse_json(redact(F.to_json(c), escaped, (1 << 31) - 1)), F.parse_json(F.lit('"***"'))))


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.keyType) or _holds_text(kind.valueType)
    return isinstance(kind, (T.StringType, T.VariantType))


def truncate_output(c: Column | str, limit: int = 8000) -> Column:
    """Head and tail of long output, each within half the bytes; characters are never split."""
    text, half = _col(c), limit // 2 - 20
    # As many bytes, decoded, without the character that the cut has split.
    raw = F.encode(text, "UTF-8")
    head = F.regexp_replace(F.make_valid_utf8(F.substring(raw, 1, half).cast("string")), "\ufffd+\\z", "")
    last = F.regexp_replace(F.make_valid_utf8(F.substring(raw, F.octet_length(text) - F.lit(half) + F.lit(1), F.lit(half)).cast("string")), "\\A\ufffd+", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(head, F.lit("\n...[truncated]...\n"), last))


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(blank_if_null(c)) / 4).cast("bigint")


# ---- replies in tags


def parse_tagged(c: Column | str, tag: str) -> Column:
    """What stands in a tag, to its end tag, the next known tag or the end; null without the tag."""
    opening = rf"(?is)<\s*{tag}\s*>"
    body = F.regexp_extract(_col(c), rf"{opening}\s*(.*?)\s*(?:</\s*{tag}\s*>|<\s*(?:{'|'.join(TAGS)})\s*>|\z)", 1)
    return F.when(_col(c).rlike(opening), body)


def strip_reasoning(c: Column | str) -> Column:
    """Without think blocks: closed, open to the end, or closed without an opening (all before the last is dropped)."""
    closed = F.regexp_replace(_col(c), r"(?is)<think>.*?</think>", "")
    open_ = F.regexp_replace(closed, r"(?is)<think>.*\z", "")
    return strip(F.when(~F.contains(open_, F.lit("<think>")), F.regexp_replace(open_, r"(?s)\A.*</think>", "")).otherwise(open_))


def strip_fence(c: Column | str) -> Column:
    """Without a code fence around it."""
    s = strip(c)
    inner = F.regexp_extract(s, r"(?s)\A```[^\n]*\n(.*?)(?:^[ \t]*```|\z)".replace("(?s)", "(?sm)"), 1)
    return F.when(s.startswith("```"), strip(inner)).otherwise(s)


def fenced_blocks(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(_col(c), F.lit(r"(?s)```[A-Za-z0-9_+.\-]*[ \t]*\n(.*?)```"), F.lit(1)), strip)


def doc_ids(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(blank_if_null(c), r"[,\n;]"), strip), lambda x: x != "")


def parse_bundle(c: Column | str, require_tests: bool = False) -> Column:
    """struct<explanation, code, tests, docs_used, error>: a reply's parts; error is null where code was found."""
    text = strip_reasoning(c)
    blocks = fenced_blocks(text)
    code0, tests0 = (blank_if_null(strip_fence(parse_tagged(text, t))) for t in ("code", "tests"))
    code = F.when(code0 != "", code0).otherwise(blank_if_null(F.get(blocks, F.lit(0))))
    tests = F.when((tests0 == "") & (code0 == ""), blank_if_null(F.get(blocks, F.lit(1)))).otherwise(tests0)
    error = F.when(strip(blank_if_null(c)) == "", "empty model response").when(code == "", "no code found")
    if require_tests:
        error = error.when(tests == "", "no tests found")
    return F.struct(strip(blank_if_null(parse_tagged(text, "explanation"))).alias("explanation"), code.alias("code"), tests.alias("tests"), doc_ids(parse_tagged(text, "docs_used")).alias("docs_used"), error.alias("error"))


def reply_queries(reply: Column | str, task: Column | str, most: int = 4, limit: int = 80) -> Column:
    """The lines of a queries tag without bullets, distinct; the task where there is none."""
    lines = F.split(parse_tagged(reply, "queries"), r"\R")
    clean = F.transform(lines, lambda x: F.substring(strip(F.regexp_replace(x, r"\A[-*• ]+", "")), 1, limit))
    kept = F.slice(F.array_distinct(F.filter(clean, lambda x: x != "")), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(short_query(task)))
