"""What reaches the scan, how often rows are shuffled, and that no Python stands in the way of plain queries."""

import os
from types import SimpleNamespace

import pytest

from millrace.lineage import discard, materialize, scope, scratch, shared_dir, sweep
from millrace.plans import clickstream, hits_queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plan(spark, q):
    return hits_queries.QUERIES[f"hits_q{q:02d}"](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def columns(text):
    return {c.split(":")[0] for c in text.split("ReadSchema: struct<")[1].split(">")[0].split(",") if c}


@needs
@pytest.mark.parametrize("q, read", [(0, set()), (1, {"advengineid"}), (3, {"userid"}), (12, {"searchphrase"}), (20, {"url"}), (35, {"clientip"}), (42, {"counterid", "eventdate", "isrefresh", "dontcounthits", "eventtime"})])
def test_only_needed_columns_are_read(spark, q, read):
    assert columns(plan(spark, q)) == read


@needs
@pytest.mark.parametrize("q, pushed", [(1, "Not(EqualTo(AdvEngineID,0))"), (19, "EqualTo(UserID,"), (20, "StringContains(URL,"), (36, "EqualTo(CounterID,62)"), (36, "GreaterThanOrEqual(EventDate,2013-07-01)"), (40, "In(TraficSourceID, [-1,6])")])
def test_filters_reach_the_scan(spark, q, pushed):
    assert pushed.lower() in plan(spark, q).lower()


@needs
@pytest.mark.parametrize("q", range(43))
def test_shuffles_and_python(spark, q):
    text = plan(spark, q)
    distinct = {8, 9, 10, 11, 13, 22}
    assert text.count("Exchange hashpartitioning") <= (2 if q in distinct else 1)
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
    if q in (12, 15, 18, 23, 26, 33, 39, 42):
        assert "TakeOrderedAndProject" in text


@needs
def test_rewrites(spark):
    assert plan(spark, 29).count("sum(") <= 4
    keys = plan(spark, 35).split("HashAggregate(keys=[")[1].split("]")[0]
    assert keys.count("#") == 1


def test_intermediate_tables(spark):
    df = spark.range(10)
    t = materialize(df)
    assert t.count() == 10 and t._millrace_path.startswith(shared_dir(spark))
    discard(t)
    discard(df)


def test_the_cluster_names_the_folder():
    named = SimpleNamespace(conf={"spark.checkpoint.dir": "hdfs://here/x/"})
    assert shared_dir(named) == "hdfs://here/x"
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_intermediate_tables_go_with_their_scope(spark):
    kept = materialize(spark.range(3))
    with scope():
        inside = materialize(spark.range(4))
        path = scratch(spark)
        spark.range(2).write.parquet(path)
        assert inside.count() == 4
    assert kept.count() == 3
    for gone in (inside._millrace_path, path):
        with pytest.raises(Exception):
            spark.read.parquet(gone)
    discard(kept)


def test_tables_of_killed_drivers_are_swept(spark):
    old = materialize(spark.range(3))
    assert sweep(spark, hours=1) == 0 and old.count() == 3
    assert sweep(spark, hours=-1) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(old._millrace_path)


@needs
def test_the_count_of_a_table_comes_from_its_footers(spark):
    from millrace.sources.storage import count_rows

    text = count_rows(spark, f"{DIR}/hits.parquet")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in text or "PushedAggregation: [COUNT(" in text


def test_queries_take_other_tables(spark):
    assert set(clickstream.QUERIES) == set(range(43))
