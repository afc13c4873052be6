import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from millrace.llm.topn import top_per_group


def brute(data, n):
    out = []
    for g in {g for g, i, s in data if g is not None}:
        order = sorted(((-s if s is not None else float("inf"), i.encode(), i, s) for q, i, s in data if q == g and i is not None))
        out += [(g, i, s, k) for k, (_, _, i, s) in enumerate(order[:n], 1)]
    return sorted(out, key=lambda r: (r[0], r[3]))


def run(spark, data, n):
    df = spark.createDataFrame([(g, i, s, 1, "x") for g, i, s in data], "g string, i string, s long, part int, item string")
    return sorted(map(tuple, top_per_group(df, ["g"], "s", "i", n).collect()), key=lambda r: (r[0], r[3]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "", "a", "b"]), st.sampled_from([None, "", "é", "z", "zz"]), st.one_of(st.none(), st.integers(-3, 3))), max_size=80), st.integers(1, 5))
def test_against_sorting(spark, data, n):
    assert run(spark, data, n) == brute(data, n)


def test_a_group_over_many_partitions(spark):
    data = [("hot", f"{i:05}", i % 50) for i in range(4000)] + [(f"g{i % 300}", f"{i}", i) for i in range(1000)]
    assert run(spark, data, 700) == brute(data, 700)


def test_several_group_columns_and_empty_input(spark):
    df = spark.createDataFrame([(1, "x", "u", 5), (1, "x", "v", 5), (1, "y", "u", 1), (2, None, "u", 9)], "a int, b string, url string, n int")
    assert rows(top_per_group(df, ["a", "b"], "n", "url", 1)) == [(1, "x", "u", 5, 1), (1, "y", "u", 1, 1)]
    assert run(spark, [], 3) == []
    with pytest.raises(ValueError):
        top_per_group(df, ["a"], "n", "url", 0)
