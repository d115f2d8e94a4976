"""Installed libraries as chunks: public classes, methods and functions with signatures and docs.

What it reads is the driver's interpreter, a few thousand rows a library, so it yields rows and hands them to Spark at once.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.metadata
import inspect
import logging
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from corvane.operators.store import CHUNK

_LOG = logging.getLogger(__name__)


def version_of(library: str) -> str:
    """The distribution's version; stdlib where there is none."""
    try:
        return importlib.metadata.version(library)
    except importlib.metadata.PackageNotFoundError:
        return "stdlib"


def _signature(name: str, obj: object) -> str:
    try:
        return name + re.sub(r"<[^<>]* at 0x[0-9A-Fa-f]+>", "...", str(inspect.signature(obj)))
    except (TypeError, ValueError):
        return f"{name}(...)"


def _cut(text: str, limit: int) -> str:
    """At most limit characters, by the rule of functions.text.truncate."""
    if limit <= 0 or len(text) <= limit:
        return text
    window = text[: limit - 1]
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s|\Z)", window)]
    for cut in (ends[-1] if ends else 0, window.rfind("\n"), window.rfind(" ")):
        if cut > 0:
            window = window[:cut]
            break
    return window.rstrip() + "…"


def _row(library: str, version: str, qualname: str, kind: str, text: str, doc: str, max_chars: int) -> dict:
    head = re.sub(r"\s+", " ", re.split(r"\. |\n\s*\n", doc, maxsplit=1)[0]).strip()[:200]
    key = hashlib.sha1("\x00".join(("introspection", library, qualname, kind)).encode()).hexdigest()[:16]
    return {"id": key, "text": _cut(text, max_chars), "library": library, "version": version, "qualname": qualname, "kind": kind, "import_path": library, "source_type": "introspection", "source_path": None, "embed_text": f"{qualname}: {head}" if head else qualname}


def _dunder(name: str) -> bool:
    return name.startswith("__") and name.endswith("__")


def _public(name: str, private: bool) -> bool:
    """Whether a name is taken: without an underscore in front, or any but a dunder where private ones are asked for."""
    return not _dunder(name) if private else not name.startswith("_")


def _methods(cls: type, private: bool) -> Iterator[tuple[str, object]]:
    for name in dir(cls):
        owner = next((c for c in cls.__mro__ if name in vars(c)), None)
        if owner is None or owner.__module__ == "builtins" or not _public(name, private):
            continue
        try:
            raw = inspect.unwrap(getattr(vars(owner)[name], "__func__", vars(owner)[name]))
            if inspect.isroutine(raw):
                yield name, raw
        except Exception as e:  # noqa: BLE001 - one odd method must not end its class
            _LOG.warning("%s.%s is left out: %s", cls.__qualname__, name, e)


def _of_class(library: str, version: str, qual: str, cls: type, max_chars: int, private: bool) -> Iterator[dict]:
    """A class and its methods; a method that resists inspection is left out."""
    own, doc = list(_methods(cls, private)), inspect.getdoc(cls) or ""
    listed = "\n\nMethods: " + ", ".join(n for n, _ in own) if own else ""
    yield _row(library, version, qual, "class", f"{_signature(qual, cls)}\n\n{doc}{listed}", doc, max_chars)
    for n, f in own:
        try:
            d, s = inspect.getdoc(f) or "", _signature(f"{qual}.{n}", f)
        except Exception as e:  # noqa: BLE001
            _LOG.warning("%s.%s is left out: %s", qual, n, e)
            continue
        if d or not s.endswith("(...)"):
            yield _row(library, version, f"{qual}.{n}", "method", f"{s}\n\n{d}".strip(), d, max_chars)


def _of_callable(library: str, version: str, qual: str, obj: object, max_chars: int) -> Iterator[dict]:
    """A function, or an object that can be called; without a doc only where it has a signature."""
    doc, head = inspect.getdoc(obj) or "", _signature(qual, obj)
    if doc or not head.endswith("(...)"):
        yield _row(library, version, qual, "function", f"{head}\n\n{doc}".strip(), doc, max_chars)


def rows(library: str, max_chars: int = 1000, include_private: bool = False) -> Iterator[dict]:
    """One dict per chunk; objects that two names share count once; a library that cannot be imported has none, an object that resists
    inspection is left out."""
    try:
        module = importlib.import_module(library)
    except Exception as e:  # noqa: BLE001 - whatever a library's import raises
        _LOG.warning("%s cannot be imported: %s", library, e)
        return
    version, seen = version_of(library), set()
    for name in getattr(module, "__all__", None) or [n for n in dir(module) if _public(n, include_private)]:
        try:
            obj = getattr(module, name)
            if inspect.ismodule(obj) or id(obj) in seen:
                continue
            seen.add(id(obj))
            qual = f"{library}.{name}"
            if inspect.isclass(obj):
                yield from _of_class(library, version, qual, obj, max_chars, include_private)
            elif callable(obj):
                yield from _of_callable(library, version, qual, obj, max_chars)
        except Exception as e:  # noqa: BLE001 - one odd object must not end the scan
            _LOG.warning("%s.%s is left out: %s", library, name, e)


def introspection_chunks(spark: SparkSession, libraries: list[str], max_chars: int = 1000, include_private: bool = False) -> DataFrame:
    """Chunks of all libraries given; of those that are not there, none."""
    return spark.createDataFrame([r for lib in libraries for r in rows(lib, max_chars, include_private)], CHUNK)
