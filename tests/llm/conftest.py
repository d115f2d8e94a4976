"""Small tables for the operators' tests."""

import random

import pytest
from llm_helpers import words


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(1)
    long = " ".join(words(rng, 60_000))
    rows = [
        (1, None, None, 7, "x"), (2, "", "en", 7, "x"), (3, "", None, None, None), (4, "  \n\t ", "de", 1, "y"), (5, "same text of a few words here", "en", 1, "y"), (5, "same text of a few words here", "en", 1, "y"),
        (6, "same text of a few words here", "en", 2, "z"), (None, "id is null in this row but the text is not", "en", 3, "z"), (8, long, "en", 4, "q"), (9, "Äö ü ß 日本語 \U0001f600 ÷×", "de", 5, "q"), (10, "a", "en", 6, "q"), (11, "\x00\x01 \x7f", "en", 6, "q"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id long, node string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, id long, node string")
