"""Every query with SQL against DuckDB over the smallest tables, as the SQL's own columns and rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    if name.startswith(("p1_", "p4_", "p5_", "p8_", "p9_", "p10_")):
        pytest.skip("in tests/llm")
    df = QUERIES[name](spark, DIR)
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(norm(v) for v in r) for r in cur.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["userid", "session_start", "session_end", "duration", "events"]
