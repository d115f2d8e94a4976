"""Secret scan: assignment-aware lexing of source and configuration text.

Every text is scanned whole for three base patterns (credential assignments, access key ids, long hexadecimal runs). Texts
that mention a sensitive name anywhere are also lexed into name-literal pairs: quoted strings (also in triple quotes or backticks, in brackets
over several lines, joined by signs or by standing side by side), the bare values and block scalars of configuration, elements of markup, and
entries whose name and value are two fields (``name: X`` and ``value: Y``). A name may have a type (``password: str = "..."``), a string a
prefix (``f"..."``, of which the parts between fields count), and assignments may be chained (``a = password = "..."``).

Constants are propagated through names (``k = "..."; password = k``). A name holds its literal within its function or class and the functions
inside; a function's own constant hides an outer one and ends with it; a name used before any such constant takes the one that the whole
text gives it later. Each literal that reaches a sensitive target is scored by how sensitive the name is and how much it looks like a secret.

Defined cases: a null or empty text has no findings; equal rows give equal findings; of several targets of one literal the best counts, the first
among equals; other columns are not read, so their names cannot clash; an empty table gives no rows; very long texts are lexed in a fixed number
of forward passes, in time that grows with their length and memory that grows with the number of assignments.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import map_arrow, table

#: Fixed patterns: the base kinds in the order in which they are listed, with the least length of what must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more: the greedy run itself, as shorter runs are dropped
KINDS = ("assign", "access", "hex", "literal")

#: How much a part of a target's name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9, "bearer": 0.8,
}
_STEM = re.compile("pass|pwd|secret|token|key|credential|bearer")
_PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*+|\.+|-+|none|null|nil|true|false|undefined|todo|changeme|change_me|placeholder|example|redacted|test|dummy)$|^your|^<.*>$|^\$\{.*\}$|^%\(?.*|^\{\{.*")
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_QUOTED = r"""\"{3}(?:[^"\\]++|\\[\s\S]|"(?!""))*+"{3}|'{3}(?:[^'\\]++|\\[\s\S]|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\\\n]*`"""
_PREFIX = r"(?:[bBrRfFuU]{1,2}(?=[\"']))?"
#: A bracket that is open while the value goes on, or a line end before a quote.
_OPEN = rf"(?:(?P<open>[(\[])\s*+(?={_PREFIX}[\"'`])|(?=\s*+[\"'`])[ \t\r]*\n\s*+)?"
_TYPE = r"(?:&(?:'[a-z]+[ \t]+)?)?[A-Za-z_][A-Za-z0-9_.]*(?:[\[<][^\n=;\"']{0,64}?[\]>])?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*){0,4}"
#: name, type where it has one, operator, value; the value is a quoted string, or a bare run.
_PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])(?P<q>["']?)(?P<name>{_NAME})(?P=q)(?:\]|\))?(?:\??[ \t]*:[ \t]*(?P<type>{_TYPE})(?=[ \t]*=[ \t]*{_PREFIX}["']))?"""
    rf"""[ \t]*(?P<op>:=|=>|[:=](?!=))[ \t]*{_OPEN}(?P<prefix>{_PREFIX})(?P<value>{_QUOTED}|[^\s"'`,;#(){{}}\[\]<>|]+)"""
)
#: Inside a bracket strings also stand side by side, over lines; after a comma comes another value.
_INSIDE = re.compile(rf"""(?P<comma>\s*,)?\s*[+.&]?\s*(?:(?P<prefix>{_PREFIX})(?P<quoted>{_QUOTED})|(?P<name>(?!)))""")
_JOINED = re.compile(rf"""[ \t]*\+[ \t]*(?:(?P<prefix>{_PREFIX})(?P<quoted>{_QUOTED})|(?P<name>{_NAME}))""")
#: A bare name that is itself assigned to.
_LINK = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*+[ \t]*(?::=|=(?![=>]))[ \t]*(?=[^\s=>])")
_FIELD = re.compile(r"\{\{|\}\}|\$?\{[^{}\n]*\}")
_LEAD = re.compile(r"[ \t]*(?:export[ \t]+|- )?")
_END = re.compile(r"[ \t\r]*(?:\n|\Z)")
#: Pairs that are no assignments: an element and its text, two fields that give name and value, a block scalar, a setter's argument.
_ELEMENT = re.compile(rf"<(?:[A-Za-z][\w.\-]*:)?(?P<name>{_NAME})(?:\s[^<>\n]{{0,256}})?>[ \t\r\n]*(?P<value>[^<>\s](?:[^<>\n]*[^<>\s])?)[ \t\r\n]*</")
_ENTRY = re.compile(rf"""(?i:\b(?:key|name|id))["']?[ \t]*[:=][ \t]*["']?(?P<name>{_NAME})["']?[ \t]*,?\s{{0,64}}["']?(?i:value)["']?[ \t]*[:=][ \t]*(?:(?P<quoted>"[^"\n]*"|'[^'\n]*')|(?P<value>[^\s"',<>{{}}]+))""")
_SCALAR = re.compile(rf"(?m)^[ \t]*(?:- )?[\"']?(?P<name>{_NAME})[\"']?[ \t]*:[ \t]*[|>][+\-]?[ \t]*\r?\n[ \t]+(?P<value>\S+)[ \t\r]*$")
_SETTER = re.compile(rf"(?<![A-Za-z0-9_])(?:set|with|put|add)(?P<name>_?[A-Za-z][A-Za-z0-9_]*)[ \t]*\([ \t]*(?P<quoted>\"[^\"\n]*\"|'[^'\n]*')[ \t]*\)")
#: Where functions begin: by indentation, and by a brace that belongs to no condition or loop.
_BLOCK = re.compile(r"(?:async[ \t]+)?(?:def|class)[ \t]+[A-Za-z_]")
_SIGNATURE = re.compile(r"\s*(?:=>\s*|(?:->|:)\s*[\w<>\[\]&:.|?]{1,64}\s*)?")
_ARROW = re.compile(r"=>\s*\Z")
_BRANCH = re.compile(r"\b(?:if|for|while|switch|catch|with|foreach|until|elseif|match)[ \t]*\Z")
_NAMES = re.compile(_NAME)
_IDENT = re.compile(rf"{_NAME}\Z")


def name_weight(name: str) -> float:
    """How sensitive a target is, by the parts of its name (snake, kebab, dotted or camel case) and their pairs."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    both = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in parts + both), default=0.0)


def literal_weight(value: str) -> float:
    """0 to 1: length, entropy of its characters and mixture of classes; 0 for placeholders and prose."""
    if len(value) < 6 or _PLACEHOLDER.search(value) or re.search(r"\s\S+\s", value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, entropy / 3.5) * (0.55 + 0.15 * classes)


def _parts(text: str, start: int, end: int, prefix: str) -> list[tuple[int, int]]:
    """A quoted string's inside; of a formatted one what stands between its fields."""
    width = 3 if end - start >= 6 and text[start : start + 3] in ('"""', "'''") else 1
    out, at, end = [], start + width, end - width
    if "f" in prefix.lower() or text[start] == "`":
        for m in _FIELD.finditer(text, at, end):
            if len(m[0]) > 2 or m[0] == "{}":
                out += [(at, m.start())] * (at < m.start())
                at = m.end()
    return [*out, (at, end)] if at < end or not out else out


def scopes(text: str) -> list[tuple[int, int]]:
    """(start, end) of functions and classes, by start; in one pass over lines and one over braces."""
    out: list[tuple[int, int]] = []
    if "def " in text or "class " in text:
        stack: list[tuple[int, int]] = []
        at = 0
        for line in text.splitlines(keepends=True):
            bare = line.lstrip(" \t")
            if bare.strip() and bare[0] not in ")]}#":
                width = len(line) - len(bare)
                while stack and stack[-1][0] >= width:
                    out.append((stack.pop()[1], at))
                if _BLOCK.match(bare):
                    stack.append((width, at + len(line)))
            at += len(line)
        out += [(start, len(text)) for _, start in stack]
    if "{" in text:
        braces: list[int] = []
        opened: list[int] = []
        closed, head = -100, 0
        for m in re.finditer(r"[(){}]", text):
            if m[0] == "(":
                opened.append(m.start())
            elif m[0] == ")":
                closed, head = m.end(), opened.pop() if opened else m.start()
            elif m[0] == "{":
                signed = m.start() - closed <= 80 and _SIGNATURE.fullmatch(text, closed, m.start()) and not _BRANCH.search(text, max(0, head - 16), head)
                braces.append(m.end() if signed or _ARROW.search(text, max(0, m.start() - 8), m.start()) else 0)
            elif braces:
                start = braces.pop()
                out += [(start, m.start())] * (start > 0)
        out += [(start, len(text)) for start in braces if start > 0]
    return sorted(out)


class _Constants:
    """What names hold, where: the definition last made in the innermost function that is still open."""

    def __init__(self, text: str):
        self.scopes, self.next, self.ends, self.of = scopes(text), 0, [math.inf], defaultdict(list)

    def enter(self, at: int) -> None:
        """Places are visited in order: what has ended by now never comes back."""
        while self.next < len(self.scopes) and self.scopes[self.next][0] <= at:
            self.ends.append(self.scopes[self.next][1])
            self.next += 1
        while len(self.ends) > 1 and self.ends[-1] <= at:
            self.ends.pop()

    def get(self, name: str, at: int) -> list:
        own = self.of.get(name)
        while own and own[-1][0] <= at:
            own.pop()
        return list(own[-1][1]) if own else []

    def set(self, name: str, pieces: list) -> None:
        own = self.of[name]
        if own and own[-1][0] == self.ends[-1]:
            own[-1] = (self.ends[-1], pieces)
        else:
            own.append((self.ends[-1], pieces))

    def whole(self, name: str) -> list:
        """What the whole text holds for a name, after its end."""
        return next((list(p) for end, p in reversed(self.of.get(name, [])) if end == math.inf and p), [])


def lex(text: str, least: float = 0.5) -> list[tuple[int, int, str, float]]:
    """(start, end, target, score) of the literals that reach a sensitive name, in order."""
    constants = _Constants(text)
    found: dict[tuple[int, int], tuple[str, float]] = {}
    later: dict[str, list[tuple[list[str], str]]] = defaultdict(list)

    def known(m: re.Match) -> list[tuple[int, int]]:
        if m["value"][0] in "\"'`":
            return _parts(text, m.start("value"), m.end("value"), m["prefix"])
        return constants.get(m["value"], m.start()) if _IDENT.match(m["value"]) else []

    def reach(name: str, pieces: list[tuple[int, int]]) -> None:
        if weight := name_weight(name):
            score = weight * literal_weight("".join(text[a:b] for a, b in pieces))
            if score >= least:
                for p in pieces:
                    if p[0] < p[1] and score > found.get(p, ("", 0.0))[1]:
                        found[p] = (name, score)

    at, followed, line, checked = 0, 0, 0, 0
    while m := _PAIR.search(text, at):
        constants.enter(m.start())
        links, last = [m.start("value")] if m.start() >= followed and m["value"][0] not in "\"'`" else [], m
        while links and (more := _LINK.match(text, links[-1])):
            links.append(more.end())
        if len(links) > 1:
            followed = links[-2]
            last = _PAIR.match(text, links[-2]) or m
        pieces = known(last)
        if not pieces:  # the first alone: what it is assigned is not known
            last = m
            pieces = known(m)
        names = [m["name"]]
        if last is not m:  # after a colon stands a type, or the name itself
            between = [_NAMES.match(text, a)[0] for a in links[:-1]]
            names += between[1:] if m["op"] == ":" else between
        at = end = last.end()
        name = max([*names, last["name"], last["type"] or ""], key=name_weight)
        if not pieces and m["value"][0] not in "\"'`":  # a bare value counts where it and its name fill a line, as in configuration
            line, checked = text.rfind("\n", checked, m.start()) + 1 or line, m.start()
            if _LEAD.match(text, line).end() == m.start() and _END.match(text, end):
                pieces = [(m.start("value"), m.end("value"))]
            if _IDENT.match(m["value"]):  # a name, it seems: what it holds is not known yet
                later[m["value"]].append((names, name))
                reach(name, pieces)
                for x in names:
                    constants.set(x, [])
                continue
        groups = [pieces]
        while groups[-1] and (more := (_INSIDE if last["open"] else _JOINED).match(text, end)):
            end = more.end()
            part = _parts(text, more.start("quoted"), more.end("quoted"), more["prefix"]) if more["quoted"] else constants.get(more["name"], m.start())
            if last["open"] and more["comma"]:
                groups.append(part)
            else:
                groups[-1] = groups[-1] + part
        at = end if last["open"] else at
        for pieces in groups:
            if pieces:
                pieces = list(dict.fromkeys(pieces))
                for x in names:
                    constants.set(x, pieces)
                reach(name, pieces)
    # Names that held nothing where they were used: what the whole text gives them, and so on along the names.
    ready = [x for x in later if constants.whole(x)]
    while ready:
        source = ready.pop()
        for names, name in later.pop(source, []):
            pieces = constants.whole(source)
            reach(name, pieces)
            for x in names:
                if x in later and not constants.whole(x):
                    constants.of[x].append((math.inf, pieces))
                    ready.append(x)
    for pattern in (_ELEMENT, _ENTRY, _SCALAR, _SETTER):
        for m in pattern.finditer(text):
            a, b = (m.start("quoted") + 1, m.end("quoted") - 1) if "quoted" in pattern.groupindex and m["quoted"] else m.span("value")
            reach(m["name"], [(a, b)])
    return sorted((a, b, name, round(score, 6)) for (a, b), (name, score) in found.items())


def findings(text: str, least: float = 0.5) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, target, score) by start, then kind as in KINDS; positions in code points, end exclusive."""
    low = text.lower()
    out = []
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", m.start(), m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), "", 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), "", 1.0) for m in HEX.finditer(text)]
    if ("=" in text or ":" in text or "<" in text or "(" in text) and _STEM.search(low):
        # A literal inside a base span is none of its own: the farthest end of the spans that begin before it decides.
        starts, far, most = [], [], 0
        for _, a, b, _, _ in sorted(out, key=lambda x: x[1]):
            most = max(most, b)
            starts.append(a)
            far.append(most)
        for a, b, n, x in lex(text, least):
            k = bisect_right(starts, a)
            if not k or far[k - 1] < b:
                out.append(("literal", a, b, n, x))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_FINDING = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("target", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, secrets): one row per row of docs, with all findings of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "target", "score"), x, strict=True)) for x in findings(t.as_py() or "", least)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _FINDING)], ["id", "secrets"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, secrets array<struct<kind:string,start:bigint,end:bigint,target:string,score:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    found = scan(table(spark, sf_dir, "documents"))

    def of(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def spans(keep):
        return F.array_join(F.transform(F.filter("secrets", keep), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        F.col("id").alias("doc_id"), *map(of, KINDS[:3]), F.sha2(spans(lambda x: x["kind"] != "literal"), 256).alias("base_sha256"), spans(lambda x: F.lit(True)).alias("spans"), of("literal")
    )
