"""The subpackage's queries against DuckDB, and the parts of the rest that must not need it."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from conftest import rows
from millrace.llm import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@needs
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    if name not in SQL:
        assert df.columns and got
        return
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(norm(r[c]) for c in cols) for r in got) == sorted(tuple(norm(v) for v in r) for r in cur.fetchall())


@needs
def test_packing_of_the_documents(spark):
    packed = QUERIES["p8_packed"](spark, DIR).toPandas()
    fill = packed.groupby("container").length.sum()
    assert fill.max() <= 2048 and len(fill) <= fill.sum() / 2048 * 1.02 + 1
    assert packed[packed.piece > 0].doc_id.nunique() == len(rows(QUERIES["p8_found"](spark, DIR)))


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    hits = [p for p in (root / "millrace").rglob("*.py") if "llm" not in p.parts and "millrace.llm" in p.read_text()]
    assert not hits
    block = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; assert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", block], cwd=root, check=True)
