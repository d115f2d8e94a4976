"""The quality of searches: each index is asked once."""

from corvane.operators.dense import DenseIndex
from corvane.operators.lexical import LexicalIndex
from corvane.plans import retrieval_queries as R


def test_each_index_is_searched_once(spark, sf_dir, monkeypatch):
    asked = []
    for kind in (LexicalIndex, DenseIndex):
        monkeypatch.setattr(kind, "search", lambda self, *a, f=kind.search, kind=kind, **b: asked.append(kind.__name__) or f(self, *a, **b))
    R.search_quality(spark, sf_dir)
    assert sorted(asked) == ["DenseIndex", "LexicalIndex"]  # the hybrid ranks asked both again
