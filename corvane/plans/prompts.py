"""Messages to the model, assembled as Columns from a run's parts. The wording is this engine's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import blank_if_null, strip

SYSTEM = "You write one Python module and its tests. Answer in the tags explanation, code, tests and docs_used, and nothing else."
ANALYZE = "You explain why a test run failed. Answer in the tags root_cause and fix_plan, one sentence each."
QUERIES = "You list search queries for documentation, one a line, in the tag queries."
#: Fixed limits: what is kept of a traceback, of outputs, of the exception line and of a whole summary.
TRACE_TAIL, OUTPUT_TAIL, EXCEPTION_HEAD, SUMMARY = 1500, 500, 300, 1500


def tail(c: Column, n: int) -> Column:
    """The last n characters."""
    return F.when(F.length(c) > n, F.right(c, F.lit(n))).otherwise(c)


def _part(title: str, body: Column) -> Column:
    """A titled part; null, and so left out, where its body is blank."""
    return F.when(strip(blank_if_null(body)) != "", F.concat(F.lit(f"{title}\n"), body))


def context(docs: Column, max_chars: int = 6000) -> Column:
    """Texts of docs array<struct<id,text>> in order while they fit: each counts with two separators; the first overflow ends it."""
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def add(so_far: Column, d: Column) -> Column:
        used = F.when(so_far["used"] >= 0, so_far["used"] + F.coalesce(F.length(d["text"]), F.lit(0)) + 2)
        shown = F.concat(so_far["text"], F.when(so_far["used"] > 0, "\n\n").otherwise(""), F.lit("["), blank_if_null(d["id"]), F.lit("] "), blank_if_null(d["text"]))
        return F.when(used <= max_chars, F.struct(shown.alias("text"), used.alias("used"))).otherwise(F.struct(so_far["text"].alias("text"), F.lit(-1).alias("used")))

    return F.aggregate(docs, empty, add, lambda x: x["text"])


def generate(task: Column, docs: Column, provided_tests: Column, max_chars: int = 6000) -> Column:
    """struct<system, human> for the first attempt."""
    fixed = F.when(strip(blank_if_null(provided_tests)) != "", F.concat(F.lit("These tests are given and fixed; leave out the tests tag.\n"), strip(provided_tests)))
    human = F.concat_ws("\n\n", F.concat(F.lit("Task:\n"), blank_if_null(task)), _part("Documentation:", context(docs, max_chars)), fixed)
    return F.struct(F.lit(SYSTEM).alias("system"), human.alias("human"))


def failure(run: Column, category: Column, kind: Column, message: Column) -> Column:
    """A failed run in a few parts, each cut to its tail."""
    names = F.array_join(F.slice(F.transform(F.coalesce(run["failures"], F.array()), lambda f: F.coalesce(f["test_name"], F.lit("unknown"))), 1, 5), ", ")
    trace = F.coalesce(F.get(F.transform(run["failures"], lambda f: f["traceback"]), F.lit(0)), F.lit(""))
    return F.concat_ws(
        "\n\n", F.concat(F.lit("Category: "), F.coalesce(category, F.lit("unknown"))), F.when(names != "", F.concat(F.lit("Failing tests: "), names)), F.substring(F.concat(F.lit("Exception: "), kind, F.lit(": "), message), 1, EXCEPTION_HEAD),
        _part("Traceback, its end:", tail(trace, TRACE_TAIL)), _part("Output, its end:", tail(run["stdout"], OUTPUT_TAIL)), _part("Errors, their end:", tail(run["stderr"], OUTPUT_TAIL)),
    )


def analyze(run: Column, category: Column, kind: Column, message: Column, root_cause: Column, fix_plan: Column, fault: Column, symbols: Column) -> Column:
    """struct<system, human> to refine an analysis; cut as a whole."""
    found = F.concat_ws("\n", F.concat(F.lit("Root cause: "), root_cause), F.concat(F.lit("Plan: "), fix_plan), F.concat(F.lit("Fault: "), fault), F.when(F.size(symbols) > 0, F.concat(F.lit("Suspects: "), F.array_join(symbols, ", "))))
    human = F.concat_ws("\n\n", failure(run, category, kind, message), found)
    return F.struct(F.lit(ANALYZE).alias("system"), F.when(F.length(human) > SUMMARY, F.concat(F.substring(human, 1, SUMMARY), F.lit("\n...[truncated]"))).otherwise(human).alias("human"))


def revise(task: Column, code: Column, tests: Column, summary: Column, feedback: Column, prior: Column, docs: Column, max_chars: int = 6000) -> Column:
    """struct<system, human> for another attempt; prior array<string>: the last three failures before this one count."""
    last = F.when(F.size(prior) > 3, F.slice(prior, -3, 3)).otherwise(prior)
    human = F.concat_ws(
        "\n\n", F.concat(F.lit("Task:\n"), blank_if_null(task)), _part("Code:", code), _part("Tests:", tests), _part("What failed:", summary), _part("Earlier failures:", F.array_join(last, "\n")), _part("A reviewer says:", feedback), _part("Documentation:", context(docs, max_chars)),
        F.lit("Give the whole corrected module and tests."),
    )
    return F.struct(F.lit(SYSTEM).alias("system"), human.alias("human"))
