"""The driver contract, and each query against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lorekeep.plans import catalogue

BASE = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")
SQL = catalogue.SQL  # the optional subpackage tests its own queries


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{BASE}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def canon(df):
    def cell(x):
        if x is None or pd.isna(x):
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, int | float) or hasattr(x, "dtype") else str(x)

    return sorted(map(repr, (tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))))


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, BASE).toPandas()
    assert canon(got) == canon(duck.execute(SQL[name]).df())


@needs_data
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, BASE)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns) and any(v is not None for r in rows for v in r)
