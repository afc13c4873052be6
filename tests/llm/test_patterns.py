import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from millrace.llm.patterns import distinct_per, distinct_where, memberships, merge_memberships, patterns, written
from millrace.llm.queries import p1_found

KIND = "uid long, day string, c int, rows int, n int"


def table(spark, data):
    return spark.createDataFrame([(*r, 1, 2) for r in data], KIND)


CELL = st.tuples(st.one_of(st.none(), st.integers(1, 12)), st.sampled_from([None, "", "a", "b"]), st.one_of(st.none(), st.integers(0, 3)))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(CELL, max_size=60))
def test_all_groupings_against_sets(spark, data):
    found = patterns(written(table(spark, data), "uid", ["day", "c"]), "uid")
    for by, of in ((["day"], lambda d, c: (d,)), (["c"], lambda d, c: (c,)), (["day", "c"], lambda d, c: (d, c))):
        want = {}
        for u, d, c in data:
            if u is not None:
                want.setdefault(of(d, c), set()).add(u)
        assert {r[:-1]: r[-1] for r in map(tuple, distinct_per(found, by).collect())} == {k: len(v) for k, v in want.items()}


def test_combinations_and_patterns(spark):
    data = [(1, "a", 1), (1, "a", 1), (1, "b", 2), (2, "b", 2), (2, "a", 1), (3, "a", 1), (4, "b", 2), (4, None, None), (None, "a", 1)]
    found = patterns(written(table(spark, data), "uid", ["day", "c"]), "uid")
    assert rows(found.groupBy("pattern").agg(F.first("ids"), F.count("*"))) == [(1, 2, 2), (3, 1, 1), (4, 1, 2)]
    one = lambda **kw: distinct_where(found, **kw).first()[0]
    day, c = F.col("day"), F.col("c")
    assert one(any_of=[day == "a", c == 2]) == 4 and one(all_of=[day == "a", day == "b"]) == 2
    assert one(all_of=[day == "b"], none_of=[day == "a"]) == 1 and one(any_of=[day == "z"]) == 0 and one() == 4 and one(all_of=[day.isNull()]) == 1


def test_null_and_values_are_told_apart(spark):
    data = [(1, None, 5), (2, "", 5), (3, "a", None), (4, None, None)]
    assert patterns(written(table(spark, data), "uid", ["day", "c"]), "uid").count() == 4


def test_loads_merge(spark):
    data = [(i % 7, "ab"[i % 2], i % 3) for i in range(50)]
    parts = [memberships(table(spark, data[k::3]), "uid", ["day", "c"]) for k in range(3)]
    assert rows(merge_memberships(*parts)) == rows(memberships(table(spark, data), "uid", ["day", "c"]))


def test_one_user_and_one_group_hold_most(spark):
    df = spark.range(30_000).selectExpr("IF(id % 3 = 0, 7L, id) AS uid", "CAST(IF(id % 2 = 0, 62, id % 5000) AS int) AS c", "'x' AS day")
    got = {r.c: r.ids for r in distinct_per(patterns(written(df, "uid", ["c"]), "uid"), ["c"]).collect()}
    assert got == {r.c: r.n for r in df.groupBy("c").agg(F.count_distinct("uid").alias("n")).collect()}


def test_empty_and_names(spark):
    found = patterns(written(table(spark, []), "uid", ["c"]), "uid")
    assert rows(found) == [] and rows(distinct_per(found, ["c"])) == [] and rows(distinct_where(found)) == [(0,)]
    with pytest.raises(ValueError):
        memberships(table(spark, []), "uid", ["rows"])


def test_found_keeps_null_groups(spark, tmp_path):
    hits = spark.range(120).selectExpr("id AS userid", "nullif(DATE '2013-07-01', if(id % 4 < 2, DATE '2013-07-01', NULL)) AS eventdate", "nullif(CAST(id % 2 AS int), 0) AS counterid")
    hits.write.parquet(str(tmp_path / "hits.parquet"))
    assert rows(p1_found(spark, str(tmp_path))) == [(None, None), (None, 1), ("2013-07-01", None), ("2013-07-01", 1)]
