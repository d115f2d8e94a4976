"""Rules that have no SQL twin, or that a twin shows in part only: pieces of texts, order statistics, ties, answers, options."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from corvane.config import Options
from corvane.functions.chunking import split_markdown
from corvane.functions.text import tokenize  # noqa: F401
from corvane.operators import evaluation, fusion
from corvane.plans import loop, prompts
from corvane.plans.retrieval_queries import split_markdown as split_query
from corvane.sources.files import is_text_file


def plain_pieces(text, most=800, overlap=100):
    """The same by the rules, one character and one candidate at a time."""
    lines, parts, fenced = text.replace("\r\n", "\n").replace("\r", "\n").split("\n"), [["", []]], False
    for line in lines:
        bare = line.lstrip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        indent, marks = len(line) - len(line.lstrip()), len(bare) - len(bare.lstrip("#"))
        if not fenced and not bare.startswith(("```", "~~~")) and indent <= 3 and 1 <= marks <= 6 and bare[marks : marks + 1].isspace():
            parts.append([line.strip(), []])
        else:
            parts[-1][1].append(line)
    out = []
    for heading, body in ((h, "\n".join(b)) for h, b in parts):
        body = body.strip()
        head = heading + "\n\n" if heading else ""
        if not body:
            out += [heading] if heading and len(heading) <= most else []
            continue
        if len(head) + len(body) <= most:
            out.append(head + body)
            continue
        room, at = max(most - len(head), 1), 0
        while True:
            if at + room >= len(body):
                out.append(head + body[at:].strip())
                break
            end = None
            for mark in ("\n\n", "\n", " "):  # the last paragraph's end that the window holds whole, else line's, else word's; never its first character
                ends = [i + len(mark) for i in range(at + 1, at + room - len(mark) + 1) if body[i : i + len(mark)] == mark]
                if ends:
                    end = ends[-1]
                    break
            if end is None and not any(ch in "\n " for ch in body[at : at + room]):
                end = next((i + 1 for i in range(at + room, len(body)) if body[i] == "\n"), len(body))
                after = end
            else:
                end = end if end is not None else at + room
                after = end - overlap if end - overlap > at else end
            out.append(head + body[at:end].strip())
            if end >= len(body):
                break
            at = after
    return [p for p in out if p.strip() and not (p.endswith("\n\n") and p.strip() == p[:-2].strip() and p != p.strip())]


def test_pieces_of_a_whole_table(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in split_query(spark, sf_dir).orderBy("doc_id", "i").collect():
        got.setdefault(r["doc_id"], []).append(r["piece"])
    assert got == {i: p for i, t in docs.items() if (p := plain_pieces(t))} and sum(len(p) > 3 for p in got.values()) > 20


@pytest.mark.parametrize("seed", range(40))
def test_pieces_of_odd_texts(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "# Head\n", "\n\n", "\n", "   ## B\n", "```\n", "longlonglong", "é", " ", "#no\n", "~~~x\n", "\r\n", "\t"]) for _ in range(rng.randrange(300)))
    for most, overlap in ((40, 10), (25, 0), (100, 60)):
        assert split_markdown(text, most, overlap) == plain_pieces(text, most, overlap)


def test_order_statistics(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *[x / 4 for x in range(50)]])) for _ in range(3000)] + [("only", 2.5), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    got = {r["g"]: (r["n"], r["median"]) for r in evaluation.medians(df, "v", ("g",)).collect()}
    assert got == {g: (len(v), statistics.median(v)) for g, v in want.items()}
    assert evaluation.medians(df, "v").first()["median"] == statistics.median([x for v in want.values() for x in v])
    upper = {r["g"]: r["p95"] for r in evaluation.p95(df, "v", ("g",)).collect()}
    assert upper == {g: sorted(v)[min(len(v) - 1, round(0.95 * (len(v) - 1)))] for g, v in want.items()}
    assert evaluation.p95(df.limit(0), "v", ("g",)).count() == 0


def test_ties_go_to_what_came_first(spark):
    ranked = spark.createDataFrame([(0, 1, 9, 0.5, 1), (0, 1, 3, 0.4, 2), (0, 2, 2, 0.5, 1), (0, 2, 3, 0.5, 2)], "qset int, qid int, id long, score double, rank int")
    assert [r["id"] for r in fusion.merge_max(ranked, 5, 0.0).orderBy("rank").collect()] == [9, 3, 2]  # 3 was seen with the first query
    words = spark.createDataFrame([(0, 1, 7, 3.0, 1), (0, 1, 9, 2.0, 2)], "qset int, qid int, id long, score double, rank int")
    near = spark.createDataFrame([(0, 2, 5, 0.0, 1)], "qset int, qid int, id long, score double, rank int")
    assert [r["id"] for r in fusion.rrf(near, words, 5).orderBy("rank").collect()] == [7, 5, 9]


def test_answers_to_callers(spark):
    s = spark.createDataFrame([("t", "approved", "c", None, 2, ["a", None], ["retrieve", "generate"]), (None, None, "c", "x", None, None, None), ("u", "failed", None, None, 1, [], ["generate"])], "task_id string, status string, code string, tests string, attempt int, doc_ids array<string>, nodes array<string>")
    rest = {"retries_used": "int", "retrieval_queries": "array<string>", "failure_reason": "string", "started_ts": "timestamp", "finished_ts": "timestamp"}
    whole = s.withColumns({c: F.lit(None).cast(t) for c, t in rest.items()})
    got = [r.asDict() for r in loop.responses(whole.withColumns({"started_ts": F.timestamp_seconds(F.lit(1.0)), "finished_ts": F.when(F.col("task_id") == "t", F.timestamp_seconds(F.lit(3.25)))})).collect()]
    assert [(r["status"], r["final_code"], r["code"], r["tests"], r["attempts"], r["retrieved_doc_ids"], r["duration_s"]) for r in got] == [("approved", "c", "c", "", 2, ["a", ""], 2.25), ("running", None, "c", "x", 0, [], None), ("failed", None, "", "", 1, [], None)]
    assert got[0]["task_id"] == "t" and re.fullmatch("[0-9a-f]{32}", got[1]["task_id"])
    assert [r["r"] for r in whole.select(loop.rag_enabled().alias("r")).collect()] == [True, False, False]


def test_options_and_suffixes(spark):
    assert Options.load({"CORVANE_LIBRARIES": " json , ,re"}).libraries == ("json", "re") and Options(libraries=["x "]).libraries == ("x",)
    with pytest.raises(ValueError, match="at least one"):
        Options.load({"CORVANE_LIBRARIES": " , "})
    assert Options(api_key=" k ").require_key() == "k"
    with pytest.raises(ValueError, match="CORVANE_API_KEY"):
        Options(api_key=" ").require_key()
    paths = spark.createDataFrame([("a/b.MD",), ("x.txt",), ("y.py",), ("md",), (None,)], "p string")
    assert [r["t"] for r in paths.select(is_text_file("p").alias("t")).collect()] == [True, True, False, False, False]


def test_context_is_read_once(spark):
    docs = F.array(*[F.struct(F.lit(str(i)).alias("id"), F.lit("d" * n).alias("text")) for i, n in enumerate((3, 0, 5, 1))], F.struct(F.lit("n").alias("id"), F.lit(None).cast("string").alias("text")))
    at = lambda n: spark.range(1).select(prompts.context(docs, n).alias("c")).first()["c"]
    assert [at(n) for n in (4, 5, 7, 13, 14)] == ["", "[0] ddd", "[0] ddd\n\n[1] ", "[0] ddd\n\n[1] ", "[0] ddd\n\n[1] \n\n[2] ddddd"]  # what does not fit ends it, also where a later one would
    assert at(100).endswith("[3] d\n\n[n] ")
