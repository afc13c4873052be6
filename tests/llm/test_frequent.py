from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from millrace.llm.frequent import Sketch, _rest, frequent_items


def exact(values, share):
    there = [v for v in values if v]
    return {v: n for v, n in Counter(there).items() if n >= share * len(there)}


def test_finds_all_and_no_others(spark):
    rng = np.random.default_rng(5)
    a = [None, ""] * 500 + ["hot"] * 3000 + [f"é{i}" for i in range(20) for _ in range(90)] + [f"rare {x}" for x in rng.integers(0, 10**9, 4000)]
    b = ["x" * 50_000] * 200 + [f"{x}" for x in rng.integers(0, 10**9, len(a) - 200)]
    rng.shuffle(a)
    df = spark.createDataFrame(list(zip(a, b)), "item string, b string").repartition(5)
    out = {(r.item_field, r.item): (r.n_rows, r.estimate) for r in frequent_items(df, ["item", "b"], 0.01).collect()}
    want = {("item", v): n for v, n in exact(a, 0.01).items()} | {("b", v): n for v, n in exact(b, 0.01).items()}
    assert {k: n for k, (n, _) in out.items()} == want and all(n <= e for n, e in out.values())


def test_threshold_is_included(spark):
    df = spark.createDataFrame([("a",)] * 10 + [(f"r{i}",) for i in range(990)], "s string")
    assert rows(frequent_items(df, ["s"], 0.01), "item", "n_rows") == [("a", 10)]


def test_no_rows_and_no_values(spark):
    assert rows(frequent_items(spark.createDataFrame([], "s string"), ["s"])) == []
    assert rows(frequent_items(spark.createDataFrame([(None,), ("",)], "s string"), ["s"])) == []


def test_collisions_are_noticed(spark):
    """Four buckets can't part 40 equal values; the wider sketches that follow can, or an error says so."""
    df = spark.createDataFrame([(f"v{i % 40}",) for i in range(4000)], "s string")
    with pytest.raises(RuntimeError):
        frequent_items(df, ["s"], 0.02, Sketch(depth=1, width=2), attempts=2)
    assert frequent_items(df, ["s"], 0.02, Sketch(depth=2, width=16), attempts=12).count() == 40


def test_many_values_of_like_counts(spark):
    """No sketch parts these; they are counted by value."""
    near = [f"n{i}" for i in range(99)] * 10 + ["n0", "n1"] * 2 + [f"m{i}" for i in range(4)]
    a = [f"v{i % 150}" for i in range(1500)]
    b = [f"w{i % 199}" for i in range(1490)] + ["hot"] * 10
    df = spark.createDataFrame(list(zip(a, b, (near * 2)[:1500])), "a string, b string, c string").repartition(3)
    for share in (0.01, 0.008, 0.0066):
        out = {(r.item_field, r.item): (r.n_rows, r.estimate) for r in frequent_items(df, ["a", "b", "c"], share).collect()}
        want = {(c, v): n for c, x in (("a", a), ("b", b), ("c", (near * 2)[:1500])) for v, n in exact(x, share).items()}
        assert {k: n for k, (n, _) in out.items()} == want and all(n <= e for n, e in out.values())
    out = frequent_items(df, ["a"], 0.01, attempts=1)
    assert rows(out) == []


def test_rest_is_counted_exactly(spark):
    """With no value decoded, all frequent ones come from the last count."""
    s = Sketch(width=64)
    full = np.ones((s.depth, s.width), bool)
    df = spark.createDataFrame([(x,) for x in ["a"] * 5 + ["é"] * 4 + ["c"] * 3 + [None, ""]], "s string")
    value = F.when(F.col("s") != "", F.col("s"))
    assert sorted(x[:2] for x in _rest(df, value, s, full, {}, 4.0)) == [("a", 5), ("é", 4)]
    a = next(h for v, _, h in _rest(df, value, s, full, {}, 4.0) if v == "a")
    assert [x[:2] for x in _rest(df, value, s, full, {a: 5}, 4.0)] == [("é", 4)]
    full[1, s.bucket(1, np.array([a], np.uint64))] = False
    assert "a" not in {x[0] for x in _rest(df, value, s, full, {}, 1.0)}


def test_sketches_add_up():
    s, h = Sketch(width=64), np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = (np.zeros((s.depth, s.width, 65), np.int64) for _ in range(2))
    s.add(a, h)
    for part in np.split(h, 10):
        s.add(b, part)
    assert (a == b).all()


def test_bad_shape():
    with pytest.raises(ValueError):
        Sketch(width=100)
