"""Every registered query on the smallest tables, and its SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

from lorekeep.llm import queries

BASE = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not BASE.exists(), reason="needs the test tables")


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, str(BASE))
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(df.columns)) == len(df.columns) and len(set(got[1])) == len(got[1])
    if name not in queries.SQL:
        assert got[1], "no rows"
        return
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in BASE.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    rel = con.execute(queries.SQL[name])
    assert got == table([d[0] for d in rel.description], rel.fetchall())
