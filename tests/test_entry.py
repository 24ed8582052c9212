import glob
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = [n for n in entry.oracle_sql()]


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    done = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in done.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(cell(v) for v in row) for row in done.fetchall())
    assert Counter(tuple(cell(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
