import math
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from millrace.operators.key_quantiles import key_quantiles

QS = (0, 0.1, 0.5, 0.99, 1)


def brute(data):
    out = []
    for k in {k for k, _ in data if k is not None}:
        vs = sorted(v for q, v in data if q == k and v is not None)
        n = sum(q == k for q, _ in data)
        out.append((k, n, len(vs), *[vs[max(1, math.ceil(Decimal(str(q)) * len(vs))) - 1] if vs else None for q in QS]))
    return sorted(out)


def run(spark, data, fanout=8):
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in data], "k string, v long, n int, b int")
    return rows(key_quantiles(df, ["k"], "v", QS, fanout))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "", "a", "b"]), st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.integers(-3, 3))), max_size=60))
def test_against_sorting(spark, data):
    assert run(spark, data) == brute(data)


def test_small_fanout_takes_more_rounds(spark):
    data = [("a", (i * i * 7919) % 100_003 - 50_000) for i in range(400)] + [("b", 5)] * 30 + [("c", None)] * 3
    assert run(spark, data, 8) == brute(data)


def test_one_key_and_one_value_hold_most(spark):
    data = [("hot", 7)] * 3000 + [("hot", i) for i in range(1000)] + [(str(i % 50), i) for i in range(500)]
    assert run(spark, data, 16) == brute(data)


def test_empty_and_bad_arguments(spark):
    assert run(spark, []) == []
    for qs in ((), (2,), (0.5, 0.5)):
        with pytest.raises(ValueError):
            key_quantiles(spark.range(1), ["id"], "id", qs)
    with pytest.raises(ValueError):
        key_quantiles(spark.range(1), ["id"], "id", fanout=4)
    for kind in ("double", "string", "date"):
        with pytest.raises(TypeError):
            key_quantiles(spark.range(1).selectExpr("id", f"CAST(NULL AS {kind}) AS v"), ["id"], "v")


def test_each_task_sends_at_most_fanout_rows_of_a_key(spark):
    """A hot key in one task, all values different: what leaves the scan is a histogram."""
    df = spark.range(0, 200_000, 1, 1).selectExpr("1 AS k", "id * 37 % 200003 AS v")
    out = key_quantiles(df, ["k"], "v", (0.5,), fanout=16)
    values = sorted(i * 37 % 200_003 for i in range(200_000))
    assert rows(out) == [(1, 200_000, 200_000, values[99_999])]


def test_three_values_of_a_bucket_are_told_apart(spark):
    data = [("a", v) for v in (-7, 10**15, 10**15 + 3, 10**15 + 9)] + [("b", 2**62 + i) for i in (5, 1, 9)]
    assert run(spark, data) == brute(data)


def test_several_keys(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (1, "x", 7), (None, "x", 1)], "a int, b string, v int")
    assert rows(key_quantiles(df, ["a", "b"], "v", (0.5,))) == [(1, "x", 2, 2, 5), (1, "y", 1, 1, 6)]
