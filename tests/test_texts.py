"""Nested redaction, test reports by a parser, embedders that hold a model."""

import os
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X
from corvane.functions.vectors import ModelEmbedder
from corvane.operators.events import write_log
from corvane.sources.records import parse_junit

KEY = "sk-" + "a" * 24


def walked(v, secrets=("hunter2hunter2",), limit=30):
    """The same on plain values."""
    import re

    if isinstance(v, str):
        for s in secrets:
            v = v.replace(s, "***")
        for p in X.KEY_PATTERNS:
            v = re.sub(p, "***", v)
        return v[:limit] + "...[truncated]" if len(v) > limit else v
    if isinstance(v, dict):
        return {walked(k, secrets, limit): walked(x, secrets, limit) for k, x in v.items()}
    return [walked(x, secrets, limit) for x in v] if isinstance(v, (list, tuple)) else v


def test_texts_at_any_depth_are_redacted(spark):
    kind = "struct<a: string, n: int, m: map<string, array<string>>, deep: array<struct<t: string, by: map<int, string>, none: map<string, string>>>>"
    value = (f"x {KEY}", 3, {f"hunter2hunter2 {KEY}": ["y" * 40, None], KEY: [], "sk-" + "b" * 24: [KEY], "plain": None}, [(f"{KEY}{KEY}", {1: "hunter2hunter2", 2: None}, None), None, ("z" * 29 + KEY, {}, {})])
    df = spark.createDataFrame([(1, value), (2, None), (3, (None, None, None, None))], f"id int, v {kind}")
    got = {r["id"]: r["v"] for r in df.select("id", X.redact_all(F.col("v"), df.schema["v"].dataType, ("hunter2hunter2", "short"), 30).alias("v")).collect()}
    plain = lambda v: {k: plain(x) for k, x in v.asDict().items()} if isinstance(v, T.Row) else [plain(x) for x in v] if isinstance(v, list) else v
    assert [list(walked(x).values()) if isinstance(x, dict) and 0 else walked(x) for x in (value[0], value[1], value[2])] == [got[1]["a"], got[1]["n"], got[1]["m"]]
    assert [x and list(x.values()) for x in plain(got[1]["deep"])] == [x and walked(list(x)) for x in value[3]]
    assert got[2] is None and got[3].asDict() == {"a": None, "n": None, "m": None, "deep": None}
    assert list(got[1]["m"]["***"]) == ["***"]  # of two keys that are one now, the last entry stays


def test_variants_and_written_logs(spark, tmp_path):
    made = spark.createDataFrame([(1, '{"k \\"q\\" pass":["' + KEY + '",1,null]}'), (2, None), (3, '{"' + KEY + '":1,"sk-' + "b" * 24 + '":2}')], "id int, j string").select("id", F.parse_json("j").alias("v"), F.map_from_arrays(F.array(F.lit(KEY)), F.array(F.lit("ok"))).alias("m"))
    got = {r["id"]: r["j"] for r in made.select("id", F.to_json(X.redact_all(F.col("v"), T.VariantType(), ('k "q" pass',))).alias("j")).collect()}
    assert got == {1: '{"***":["***",1,null]}', 2: None, 3: '"***"'}
    write_log(made.select("id", "m"), str(tmp_path / "log"))
    assert KEY not in "".join(p.read_text() for p in (tmp_path / "log").glob("*.json"))


REPORTS = [
    "<testsuite><testcase name='a &gt; b'><failure message=\"m > &#65; &lt;\"><![CDATA[tb <raw> & ]]>more</failure></testcase></testsuite>",
    '<?xml version="1.0"?>\n<!-- <testcase/> --><testsuites><testsuite><testcase/><testcase name=""><failure/></testcase></testsuite><testsuite><testcase name="c"><error/></testcase></testsuite></testsuites>\n<!-- end -->',
    "<testsuite>" + "<testcase name='t'><failure message='  padded\n '> \n x" + "y" * 3000 + " \n</failure></testcase>" * 3 + "</testsuite>",
    "<testsuites><testcase name='outside'/></testsuites>", "<testsuites/>", "<testsuite/>", "<testsuite><testcase></testsuite>", "<testsuite></testsuite> and more />", "<html><testcase name='x'/></html>", "<testsuiteX><testcase/></testsuiteX>", "", " ", "text", "<testsuite><testcase name='a'/>", "<testsuite>&undefined;</testsuite>",
]


def plain_junit(xml):
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return 0, 0, []
    cases = [c for s in root.iter("testsuite") for c in s.findall("testcase")]
    failed = [c for c in cases if c.find("failure") is not None]
    return len(cases), len(failed), [(c.get("name") or "unknown", (c.find("failure").get("message") or "").strip(), (c.find("failure").text or "").strip()[-2000:]) for c in failed]


@pytest.mark.parametrize("xml", REPORTS)
def test_reports_like_an_xml_parser(spark, xml):
    r = spark.createDataFrame([(xml,)], "x string").select(parse_junit(F.col("x")).alias("r")).first()["r"]
    assert (r["total"], r["failed"], [(f["test_name"], f["message"], f["traceback"]) for f in r["failures"]]) == plain_junit(xml)


def test_a_null_report(spark):
    r = spark.createDataFrame([(None,)], "x string").select(parse_junit(F.col("x")).alias("r")).first()["r"]
    assert (r["total"], r["failed"], r["errors"], r["failures"]) == (0, 0, 0, [])


def test_a_model_is_built_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            assert len(texts) <= 8 and (len(texts) == 1 or sum(len(t.encode()) for t in texts) <= 100)
            return np.array([[len(t), sum(map(ord, t)) % 97, 1.0] for t in texts])

        return model

    embed = ModelEmbedder(make, lot=8, lot_bytes=100)
    assert embed.dim == 3 and len(os.listdir(folder)) == 1  # the dimension probe, here
    rows = [(i, None if i == 5 else "ä" * (i % 70)) for i in range(200)]
    want = {i: [len(t or ""), sum(map(ord, t or "")) % 97, 1.0] for i, t in rows}
    for parts in (1, 3, 9):
        df = spark.createDataFrame(rows, "id long, t string").repartition(parts)
        assert {r["id"]: r["vec"] for r in embed(df, "id", "t", 3).collect()} == want
    builds = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(builds) == len(set(builds)) <= 1 + 4  # one a worker, whatever its tasks
    with pytest.raises(ValueError, match="dimensions"):
        embed(df, "id", "t", 64)
    assert embed(df.limit(0), "id", "t").count() == 0
