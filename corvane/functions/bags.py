"""Bags of words of many texts at once, inside a task: Arrow's bytes are cut and counted by NumPy, where built-ins would match, sort and compare row by row.

Texts come lower-cased (by Spark, so that Unicode's rules are its own). The tokens are those of ``text.TOKEN``, dotted names followed by their parts, or of ``text.HASH_TOKEN``: both
are ASCII, so bytes can be looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are cut at once, or one text.
LOT = 8 << 20
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = True
_DOT = ord(".")


def strings(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings that lie one after the other, by where each ends."""
    off = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one range after the other."""
    n = end - begin
    total = np.cumsum(n)
    return np.arange(total[-1] if len(n) else 0) + np.repeat(begin - (total - n), n)


def lots(text: pa.Array) -> Iterator[tuple[int, int]]:
    """A batch's texts in stretches (first, number) of at most LOT bytes, or one text."""
    ends = _bytes(text)[1][1:]
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, before + LOT, "right")) - at)
        yield at, n
        at += n


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts and where each begins and the last ends. A null text is empty."""
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    raw = text.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8))[off[0] : off[-1]], off - off[0]


def _tokens(text: pa.Array, dotted: bool) -> tuple[pa.Array, np.ndarray]:
    """All tokens of some texts, and the place of each one's text. dotted: dots join words only, and the parts of dotted names follow."""
    raw, off = _bytes(text)
    edge = np.zeros(len(raw) + 1, bool)  # where a text begins or the last ends
    edge[off] = True
    inside, dots = _WORD[raw], np.flatnonzero(raw == _DOT)
    if dotted:
        dots = dots[(dots > 0) & (dots < len(raw) - 1)]
        dots = dots[inside[dots - 1] & inside[dots + 1] & ~edge[dots] & ~edge[dots + 1]]
    inside[dots] = True
    padded = np.concatenate([[False], inside, [False]])
    begin, end = np.flatnonzero(inside & (~padded[:-2] | edge[:-1])), np.flatnonzero(inside & (~padded[2:] | edge[1:])) + 1
    of = lambda b: np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(b, off)))
    size, place, data = end - begin, of(begin), raw[inside]
    if dotted and len(dots):
        has = np.unique(np.searchsorted(begin, dots, "right") - 1)
        b, e = np.sort(np.concatenate([begin[has], dots + 1])), np.sort(np.concatenate([dots, end[has]]))
        size, place, data = np.concatenate([size, e - b]), np.concatenate([place, of(b)]), np.concatenate([data, raw[ranges(b, e)]])
    return strings(data, np.cumsum(size)), place


def bags(text: pa.Array, dotted: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, code, place, n): the distinct tokens of some texts, and how often each occurs in which text, by text and word."""
    tokens, place = _tokens(text, dotted)
    coded = tokens.dictionary_encode()
    words = max(len(coded.dictionary), 1)
    key = np.sort(place * words + coded.indices.to_numpy(zero_copy_only=False))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return coded.dictionary, key[first] % words, key[first] // words, np.diff(np.append(first, len(key)))
