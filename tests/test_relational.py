import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.functions import aggs as A
from millrace.functions import expr as E
from millrace.operators.relational import count_table, filter_, global_aggregate, group_aggregate, project, top_n


def test_group_sums(spark):
    df = spark.createDataFrame([(k % 4, k * k) for k in range(50)], "key long, value long")
    assert rows(group_aggregate(df, {"key": "key"}, {"s": A.sum_int("value")})) == [(r, sum(k * k for k in range(r, 50, 4))) for r in range(4)]


def test_null_keys_leave(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (1, None), (1, "a")], "k int, s string")
    out = group_aggregate(df, {"k": "k", "s": "s"}, {"n": A.count_star()})
    assert rows(out) == [(1, "a", 2)] and dict(out.dtypes)["k"] == "bigint"


def test_bool_and_char_keys_are_numbers(spark):
    df = spark.createDataFrame([(i % 3 == 0, i, "xyz"[i % 3]) for i in range(10)] + [(None, 99, None)], "flag boolean, value long, c string")
    assert rows(group_aggregate(df, {"flag": "flag"}, {"s": A.sum_int("value")})) == [(0, 27), (1, 18)]
    assert rows(group_aggregate(df, {"c": E.char_code("c")}, {"n": A.count_star()})) == [(120, 4), (121, 3), (122, 3)]


def test_key_may_bear_the_name_of_an_aggregated_column(spark):
    df = spark.createDataFrame([(1, 5), (2, 7)], "x int, __key_9 int")
    assert rows(group_aggregate(df, {"x": E.times("x", 0)}, {"s": A.sum_int("x")})) == [(0, 3)]


def test_double_key_is_an_error(spark):
    with pytest.raises(TypeError):
        group_aggregate(spark.createDataFrame([(1.0,)], "x double"), {"x": "x"}, {})


def test_empty_input(spark):
    df = spark.createDataFrame([], "k int, s string")
    assert rows(group_aggregate(df, {"k": "k"}, {"n": A.count_star()})) == []
    assert rows(global_aggregate(df, {"n": A.count_star(), "m": A.min_("s")})) == [(0, None)]
    assert rows(count_table(df)) == [(0,)]
    assert rows(top_n(df, [("k", True)], 3)) == []


def test_top_n_nulls_ties_and_offset(spark):
    df = spark.createDataFrame([(1, 40), (2, None), (3, 40), (4, 41), (5, 40)], "id int, score int")
    ids = lambda d: [r.id for r in d.collect()]
    assert ids(top_n(df, [("score", True)], 3, tie_break=["id"])) == [2, 1, 3]
    assert ids(top_n(df, [("score", False)], None, tie_break=["id"])) == [4, 1, 3, 5, 2]
    assert ids(top_n(df, [("score", False)], 2, 3, tie_break=["id"])) == [5, 2]
    assert ids(top_n(df, [("score", False)], 2, 50, tie_break=["id"])) == []
    assert ids(top_n(df, [(F.col("id") * -1, True)], 2)) == [5, 4]
    assert top_n(df, [], 2).count() == 2


def test_limit_needs_no_full_sort(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    plan = top_n(df, [("x", False)], 5, 2, tie_break=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=7" in plan


def test_project_and_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, s string")
    assert rows(project(df, {"one": E.const(1), "s": "s"})) == [(1, None), (1, "a")]
    assert rows(filter_(df, F.col("s") != "z")) == [(1, "a")]


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 AS k", "'x' AS unused").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = group_aggregate(filter_(t, (F.col("id") > 3) & (F.col("k") != 5)), {"k": "k"}, {"n": A.count_star()})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "Not(EqualTo(k,5))" in plan and "unused" not in plan
