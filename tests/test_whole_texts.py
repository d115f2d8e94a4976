"""Queries read whole texts and all rows: small tables of their own, against the rule in plain Python."""

import re
from itertools import groupby

from corvane import catalog


def _conversations(spark, folder, texts):
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_rle_text_of_whole_texts(spark, tmp_path):
    texts = [None, "", " ", "aaab", "aa bb  cc", "one two\n\nthree", "\t\tx", "zz" * 3 + "y 11 22", "ßß \U0001f600\U0001f600\U0001f600 é", "a" * 5000 + " " + "b" * 7, "ab" * 30_000 + " end"]
    got = {r["turn"]: r["rle"] for r in catalog.queries()["rle_text"](spark, _conversations(spark, tmp_path, texts)).collect()}
    assert got == {i: "".join(f"{c}{len(list(g))}" for c, g in groupby(t or "")) for i, t in enumerate(texts)}


def test_fenced_blocks_of_turns_with_code(spark, tmp_path):
    """The reference's rule: a text's own blocks where it has a fence; no turn is left out."""
    own = ["so\n```python\nx = 1\n\n```\nand\n```\nassert x\n```", "```c++  \nint a;```", "an open one\n```py\nx = 1", "```one line```", "~~~\nx\n~~~\n```\n\n```\n```sh\nls `pwd`\n```"]
    bare = [None, "", "  plain words \n", "inline `code` here", "`", "two ``x`` ticks"]
    got = {r["turn"]: (r["n"], r["first_block"]) for r in catalog.queries()["fenced_blocks"](spark, _conversations(spark, tmp_path, own + bare)).collect()}
    want = [[b.strip() for b in re.findall(r"```[A-Za-z0-9_+.\-]*[ \t]*\n(.*?)```", t, re.S)] for t in own] + [[(t or "").strip(), "x"] for t in bare]
    assert got == {i: (len(b), b[0] if b else None) for i, b in enumerate(want)}
