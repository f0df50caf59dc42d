"""Every registered query runs on the smallest tables; those with SQL agree with it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _norm(rows):
    number = lambda x: repr(round(float(x), 5))
    return sorted(tuple("None" if x is None or x != x else number(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.plans.oracle_sql()))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert _norm(map(tuple, df.select(*cols).collect())) == _norm([r[want.columns.index(c)] for c in cols] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
