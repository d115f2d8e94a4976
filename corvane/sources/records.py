"""Evaluation tasks and records, test reports, and checkpoints, as tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.text import strip
from corvane.operators.evaluation import RECORD, SCHEMA_VERSION

TASK = "id string, title string, libraries array<string>, difficulty int, task string, tests string, reference string"


def load_tasks(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """(task columns, at): tasks of a folder's YAML files, by id, or those asked for in the order asked."""
    import yaml

    fields = [x.split()[0] for x in TASK.split(", ")]
    found = {}
    for p in sorted(Path(folder).glob("*.yaml")):
        t = yaml.safe_load(p.read_text(encoding="utf-8"))
        bad = set(t) - set(fields)
        if bad or t.get("id") != p.stem:
            raise ValueError(f"{p.name}: " + (f"unknown fields {sorted(bad)}" if bad else "its id is not its name"))
        found[t["id"]] = t
    unknown = sorted(set(only or ()) - set(found))
    if unknown:
        raise ValueError(f"no such tasks: {', '.join(unknown)}")
    rows = [(*[found[i].get(f) for f in fields], at) for at, i in enumerate(only or sorted(found))]
    return spark.createDataFrame(rows, TASK + ", at int")


def invalid_tasks(tasks: DataFrame) -> DataFrame:
    """(id, problem) of tasks that break a rule."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = {
        "id": ~F.coalesce(F.col("id").rlike(r"\A[a-z0-9_]+\z"), F.lit(False)), "libraries": F.coalesce(F.size("libraries"), F.lit(0)) < 1,
        "difficulty": ~F.coalesce(F.col("difficulty").between(1, 3), F.lit(False)), **{c: blank(c) for c in ("title", "task", "tests", "reference")},
    }
    return tasks.select("id", F.explode(F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]), lambda x: x.isNotNull())).alias("problem"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records, one JSON file each; corrupt files and other versions are left out."""
    raw = spark.read.schema(RECORD + ", _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where(F.col("_bad").isNull() & (F.col("schema_version") == SCHEMA_VERSION)).drop("_bad").orderBy("task_id", "mode")


def write_records(records: DataFrame, path: str) -> None:
    """Records by task and mode; a cell written again replaces the old one only."""
    records.withColumns({"cell_task": F.col("task_id"), "cell_mode": F.col("mode")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell_task", "cell_mode").json(path)


#: Suites within suites that are read.
SUITE_DEPTH = 6
#: Fixed patterns: what a report begins and ends with.
_OPENS, _SHUTS = r"(?s)\A(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<testsuite", r"(?s)(?:</testsuites?\s*>|/>)(?:\s|<!--.*?-->)*\z"
_CASE = "struct<_name:string,failure:array<struct<_message:string,_VALUE:string>>,error:array<struct<_message:string,_VALUE:string>>>"


def _report_schema() -> str:
    suite = f"struct<testcase:array<{_CASE}>>"
    for _ in range(SUITE_DEPTH - 1):
        suite = f"struct<testcase:array<{_CASE}>,testsuite:array<{suite}>>"
    return f"testcase array<{_CASE}>, testsuite array<{suite}>, _corrupt_record string"


def parse_junit(xml: Column) -> Column:
    """struct<total, failed, errors, failures array<struct<test_name, error_type, message, traceback>>> by Spark's XML parser; zeros for what is no report: no
    well-formed XML, another root than testsuite or testsuites, or more text behind it.

    Each test case of a suite counts once, also in nested suites, ``SUITE_DEPTH`` deep. Messages and tracebacks are stripped, of tracebacks the last 2000 characters stay.
    """
    r = F.from_xml(F.when(xml.rlike(_OPENS) & xml.rlike(_SHUTS), xml), _report_schema(), {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})
    none = F.array().cast(f"array<{_CASE}>")
    level, cases = r["testsuite"], F.when(xml.rlike(_OPENS + r"[\s>/]"), F.coalesce(r["testcase"], none)).otherwise(none)
    for depth in range(SUITE_DEPTH):
        cases = F.concat(cases, F.coalesce(F.flatten(F.filter(F.transform(level, lambda x: x["testcase"]), lambda x: x.isNotNull())), none))
        level = F.flatten(F.filter(F.transform(level, lambda x: x["testsuite"]), lambda x: x.isNotNull())) if depth < SUITE_DEPTH - 1 else level
    cases = F.when(r.isNotNull() & r["_corrupt_record"].isNull(), cases).otherwise(none)
    failed = lambda cs: F.filter(cs, lambda c: F.size(F.coalesce(c["failure"], F.array().cast("array<struct<_message:string,_VALUE:string>>"))) > 0)
    blank = lambda c: F.coalesce(c, F.lit(""))

    def item(c: Column) -> Column:
        first, name = F.get(c["failure"], F.lit(0)), F.coalesce(F.nullif(c["_name"], F.lit("")), F.lit("unknown"))
        return F.struct(name.alias("test_name"), F.lit("assertion_failure").alias("error_type"), strip(blank(first["_message"])).alias("message"), F.right(strip(blank(first["_VALUE"])), F.lit(2000)).alias("traceback"))

    # The cases are bound once: the report is parsed once a row.
    whole = lambda cs: F.struct(F.size(cs).alias("total"), F.size(failed(cs)).alias("failed"), F.size(F.filter(cs, lambda c: c["error"].isNotNull())).alias("errors"), F.transform(failed(cs), item).alias("failures"))
    return F.get(F.transform(F.array(cases), whole), F.lit(0))


def latest_state(checkpoints: DataFrame, key: str = "task_id", seq: str = "step") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return checkpoints.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
