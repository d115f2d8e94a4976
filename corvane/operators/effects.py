"""Effects of the workflow: a model client with retries and a budget, and a sandbox for tests. Both are injected into the loop.

They run inside Arrow batches on the executors; the defaults are scripted fakes, and the subprocess sandbox is opt-in.
"""

from __future__ import annotations

import ast
import json
import os
import re
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC
from email.utils import parsedate_to_datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed names of what can go wrong with a call.
AUTH, MODEL, REQUEST, DAILY_QUOTA, UNAVAILABLE, BUDGET = "auth", "model", "request", "daily_quota", "unavailable", "budget"
_DAILY = re.compile(r"per day|daily|per-day|requests/day", re.I)


class CallError(Exception):
    """kind is one of the names above."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


def error_kind(status: int | None, message: str = "", wait_s: float | None = None, max_wait_s: float = 120.0) -> str | None:
    """What a failed call means; None where it should be tried again."""
    if status in (401, 402, 403):
        return AUTH
    if status == 404:
        return MODEL
    if status == 429 and (_DAILY.search(message) or (wait_s or 0) > max_wait_s):
        return DAILY_QUOTA
    if status is None or status in (408, 429) or status >= 500:
        return None
    return REQUEST


def backoff(n: int, base: float = 2.0, top: float = 60.0, jitter: float = 1.0, asked: float | None = None) -> float:
    """Seconds before try n + 1: doubling up to top, scaled by jitter, and no less than the server asked for."""
    return max(min(top, base * 2**n) * jitter, asked or 0.0)


def asked_wait(headers: dict, now: float) -> float | None:
    """The longest wait in seconds that a server's headers ask for; None where none can be read.

    retry-after: seconds, or a date; x-ratelimit-reset: when, in seconds or milliseconds since the epoch.
    """
    waits = []
    for name, value in ((k.lower(), str(v).strip()) for k, v in headers.items()):
        number = float(value) if re.fullmatch(r"\d+(\.\d+)?", value) else None
        if name == "retry-after" and number is None:
            try:
                when = parsedate_to_datetime(value)
            except (TypeError, ValueError):
                continue
            waits.append((when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp() - now)
        elif name == "retry-after":
            waits.append(number)
        elif name == "x-ratelimit-reset" and number is not None:
            waits.append((number / 1000 if number >= 1e10 else number) - now)
    return max(0.0, *waits) if waits else None


@dataclass
class Client:
    """call(prompt) -> text, with retries, a least gap between calls and a budget of calls per run."""

    call: Callable[[str], str]
    budget: int = 10
    retries: int = 4
    gap_s: float = 0.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    jitter: Callable[[], float] = lambda: 1.0
    calls: int = field(default=0, init=False)
    api_retries: int = field(default=0, init=False)
    wait_s: float = field(default=0.0, init=False)
    _last: float | None = field(default=None, init=False)

    def _wait(self, seconds: float) -> None:
        if seconds > 0:
            self.wait_s += seconds
            self.sleep(seconds)

    def text(self, prompt: str) -> str:
        if self.calls >= self.budget:
            raise CallError(BUDGET, f"more than {self.budget} calls")
        self.calls += 1
        for n in range(self.retries + 1):
            if self._last is not None:
                self._wait(self.gap_s - (self.clock() - self._last))
            self._last = self.clock()
            try:
                out = self.call(prompt)
                if out and out.strip():
                    return out
                status, message, asked = None, "empty reply", None
            except CallError:
                raise
            except Exception as e:  # noqa: BLE001 - whatever the transport raises is classified here
                status, message, asked = getattr(e, "status", None), str(e), asked_wait(getattr(e, "headers", {}) or {}, time.time())
            if kind := error_kind(status, message, asked):
                raise CallError(kind, message)
            if n < self.retries:
                self.api_retries += 1
                self._wait(backoff(n, jitter=self.jitter(), asked=asked))
        raise CallError(UNAVAILABLE, message)

    def reset(self) -> None:
        self.calls = 0


def call_model(df: DataFrame, prompt: str, make: Callable[[], Client], out: str = "reply") -> DataFrame:
    """df with the replies to a column of prompts; a client per partition; failures are null with their kind in ``<out>_error``."""
    keep = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for b in batches:
            replies = []
            for p in b[prompt]:
                client.reset()
                try:
                    replies.append((client.text(p), None))
                except CallError as e:
                    replies.append((None, e.kind))
            b = b[keep].copy()
            b[out], b[f"{out}_error"] = [r[0] for r in replies], [r[1] for r in replies]
            yield b

    schema = df.schema.add(out, "string").add(f"{out}_error", "string")
    return df.mapInPandas(run, schema)


# ---- code under test


def imports(code: str, top_only: bool = False) -> list[str] | None:
    """Top-level names of imported modules in order; None where the code does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return None
    out = []
    for node in tree.body if top_only else ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [a.name.split(".")[0] for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            out.append(node.module.split(".")[0])
    return list(dict.fromkeys(out))


def preflight(code: str) -> str | None:
    """Why the code cannot run at all; None where it may."""
    import importlib.util

    found = imports(code, top_only=True)
    if found is None:
        return "syntax_error"
    return next(("import_error" for m in found if m != "solution" and m not in sys.builtin_module_names and importlib.util.find_spec(m) is None), None)


def subprocess_sandbox(code: str, tests: str, timeout_s: float = 30.0, mem_mb: int = 1024) -> dict:
    """Run tests in a process of its own with bounds on time, memory and environment. For trusted fixtures only."""
    import resource

    def bound():
        resource.setrlimit(resource.RLIMIT_CPU, (int(timeout_s) + 1, int(timeout_s) + 1))
        resource.setrlimit(resource.RLIMIT_AS, (mem_mb << 20, mem_mb << 20))
        resource.setrlimit(resource.RLIMIT_FSIZE, (50 << 20, 50 << 20))

    with tempfile.TemporaryDirectory() as d:
        Path(d, "solution.py").write_text(code)
        Path(d, "test_solution.py").write_text(tests)
        env = {k: v for k, v in os.environ.items() if k in ("PATH", "LANG", "LC_ALL", "HOME", "TMPDIR")}
        began = time.monotonic()
        try:
            p = subprocess.run([sys.executable, "-m", "pytest", "-q", "--tb=long", "--junitxml=report.xml", "-p", "no:cacheprovider", "test_solution.py"], cwd=d, env=env, capture_output=True, text=True, timeout=timeout_s, preexec_fn=bound)
            out, err, exit_code, late = p.stdout, p.stderr, p.returncode, False
        except subprocess.TimeoutExpired as e:
            out, err, exit_code, late = (e.stdout or b"").decode(errors="replace"), "", -1, True
        report = Path(d, "report.xml")
        return {"stdout": out, "stderr": err, "exit_code": exit_code, "timed_out": late, "duration_s": time.monotonic() - began, "xml": report.read_text() if report.exists() else ""}


def run_tests(df: DataFrame, sandbox: Callable[[str, str], dict] = subprocess_sandbox, run_type: str | None = None) -> DataFrame:
    """df (code, tests, ...) with ``run``: output, report and category of each row's tests."""
    from corvane.operators import analysis as A
    from corvane.plans.loop import RUN
    from corvane.sources.records import parse_junit

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.copy()
            b["_raw"] = [json.dumps(sandbox(c or "", t or "")) for c, t in zip(b["code"], b["tests"], strict=True)]
            yield b

    raw = df.drop("run").mapInPandas(go, df.drop("run").schema.add("_raw", "string"))
    o = raw.withColumn("_o", F.from_json("_raw", "stdout string, stderr string, exit_code int, timed_out boolean, duration_s double, xml string")).withColumn("_j", parse_junit(F.col("_o.xml")))
    trace = F.coalesce(F.get(F.transform("_j.failures", lambda f: f["traceback"]), F.lit(0)), F.lit(""))
    ruled = A.classify(trace, F.col("_o.stdout"), F.col("_o.stderr"), F.col("_j.total"), F.col("_o.exit_code"))
    cat = A.finalize(F.when(F.col("_o.timed_out"), "timeout"), F.col("_o.exit_code"), F.col("_j.total"), F.col("_j.failed"), F.col("_o.xml") != "", ruled)
    run = F.struct(
        (cat == "pass").alias("passed"), cat.alias("category"), F.col("_o.exit_code").alias("exit_code"), F.col("_o.timed_out").alias("timed_out"), F.col("_o.duration_s").alias("duration_s"),
        F.col("_j.total").alias("tests_total"), F.col("_j.failed").alias("tests_failed"), F.col("_j.failures").alias("failures"), F.col("_o.stdout").alias("stdout"), F.col("_o.stderr").alias("stderr"),
    )
    return o.withColumn("run", run.cast(run_type or RUN)).drop("_raw", "_o", "_j")
