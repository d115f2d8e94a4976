"""Every registered query runs; where it has a SQL twin, both give the same rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from corvane import catalog

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if hasattr(v, "item") and getattr(v, "ndim", 0) == 0:
        v = v.item()
    if v is None or v is pd.NA or v != v:
        return None
    return int(v) if isinstance(v, float) and v.is_integer() else v  # a column with gaps comes as floats


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in catalog.oracle_sql():
        want = duck.execute(catalog.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda df: sorted(repr(tuple(plain(v) for v in r)) for r in df[columns].astype(object).itertuples(index=False))
        assert rows(got) == rows(want)


def test_flagship_plan_has_no_cartesian_product(spark, sf_dir):
    df = catalog.queries()[catalog.FLAGSHIP](spark, sf_dir)
    assert "Cartesian" not in df._jdf.queryExecution().toString()
