"""Options of the engine, from arguments or the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields


def read_env(path: str | None) -> dict[str, str]:
    """NAME=value lines of a file, with export in front or quotes around the value or not; other lines are left out, and so is a file that is not there."""
    if path is None or not os.path.exists(path):
        return {}
    found = {}
    with open(path, encoding="utf-8") as f:
        for m in (re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^#\s]*))\s*(?:#.*)?", line.rstrip("\n")) for line in f):
            if m:
                found[m[1]] = next(x for x in (m[2], m[3], m[4]) if x is not None)
    return found


@dataclass(frozen=True)
class Options:
    """Fixed defaults; bounds are checked when an object is made."""

    top_k: int = 5
    max_docs: int = 8
    min_score: float = 0.2
    rrf_k: int = 60
    dense_weight: float = 1.0
    bm25_weight: float = 1.0
    hybrid: bool = True
    adaptive: bool = True
    context_chars: int = 6000
    chunk_chars: int = 800
    chunk_overlap: int = 100
    embed_dim: int = 64
    max_retries: int = 3
    max_human_rounds: int = 2
    llm_budget: int = 10
    api_key: str | None = None
    libraries: tuple[str, ...] = ("json", "re", "collections", "datetime", "pathlib")

    def __post_init__(self):
        named = self.libraries.split(",") if isinstance(self.libraries, str) else self.libraries
        object.__setattr__(self, "libraries", tuple(x for x in (str(n).strip() for n in named) if x))
        if not self.libraries:
            raise ValueError("libraries must name at least one library")
        for name, least in (("top_k", 1), ("max_docs", 1), ("rrf_k", 1), ("context_chars", 1), ("chunk_chars", 1), ("chunk_overlap", 0), ("embed_dim", 1), ("max_retries", 0), ("max_human_rounds", 0), ("llm_budget", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be at least {least}")

    @staticmethod
    def load(environ: dict | None = None, prefix: str = "CORVANE_", env_file: str | None = None, **given) -> Options:
        """Options from the environment, before it from a file of NAME=value lines, a blank value counting as none; arguments win."""
        env, out = read_env(env_file) | dict(os.environ if environ is None else environ), {}
        for f in fields(Options):
            raw = (env.get(prefix + f.name.upper()) or "").strip()
            if raw and f.name == "libraries":
                out[f.name] = raw
            elif raw:
                kind = type(f.default) if f.default is not None else str
                out[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return Options(**out | given)

    def require_key(self) -> str:
        """The model's key; without one an error that says where to set it, and never shows a part of any."""
        key = (self.api_key or "").strip()
        if not key:
            raise ValueError("no api_key: set CORVANE_API_KEY, or name it in the file of options")
        return key

    def shown(self) -> dict:
        """For logs: the key masked."""
        return {f.name: getattr(self, f.name) for f in fields(self)} | {"api_key": "***" if self.api_key else "unset"}
