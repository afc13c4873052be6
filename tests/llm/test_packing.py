import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from millrace.llm.packing import containers, gain, improve, next_fit, pack


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_search_keeps_the_capacity_and_never_opens_a_container(sizes):
    s = np.array(sizes, np.int64)
    before = next_fit(s, 50)
    after = improve(s, before, 50)
    assert len(after) == len(s)
    if len(s):
        fill = np.bincount(after, s)
        assert fill.max() <= 50 and len(np.unique(after[s > 0])) <= len(np.unique(before[s > 0]))
        old = np.bincount(before, s)
        assert (fill.astype(int) ** 2).sum() >= (old.astype(int) ** 2).sum()


@pytest.mark.parametrize("low, high, most", [(1, 200, 1.01), (100, 900, 1.02), (600, 1100, 1.13), (1, 2048, 1.08)])
def test_quality(low, high, most):
    """Containers over the least possible number; of 600 to 1,100 no three ever fit, and pairs leave room."""
    s = np.random.default_rng(3).integers(low, high, 2000)
    start = next_fit(s, 2048)
    end = improve(s, start, 2048)
    assert np.bincount(end, s).max() <= 2048
    least = -(-s.sum() // 2048)
    assert len(np.unique(end)) <= min(least * most + 1, len(np.unique(start)))


def test_each_step_is_one_of_the_three():
    """A move, an exchange of one for one, an exchange of two for one: each alone empties a container or fills one."""
    assert len(set(improve(np.array([5, 3]), np.array([0, 1]), 10, 1.0).tolist())) == 1
    one = improve(np.array([6, 3, 5, 5]), np.array([0, 0, 1, 1]), 11, 1.0)
    assert sorted(np.bincount(one, [6, 3, 5, 5]).tolist())[-1] == 11
    two = improve(np.array([2, 3, 8, 4]), np.array([0, 0, 1, 1]), 13, 1.0)
    assert sorted(np.bincount(two, [2, 3, 8, 4]).tolist())[-1] == 13


def test_pack(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.minimum(5000, rng.lognormal(5, 1.2, 3000))] + [0, 2048, 2049, 4096, 10_000]
    df = spark.createDataFrame([*enumerate(sizes), (None, 5), (None, 5), (7, None)], "id long, n long").selectExpr("*", "1 AS bin", "2 AS row", "3 AS shard")
    out = pack(df, "id", "n", 2048, shard_items=500).cache()
    assert out.columns == ["id", "piece", "start", "length", "container", "opened"]
    fills = rows(containers(out))
    assert all(0 <= used <= 2048 for _, _, used, _ in fills)
    total = sum(sizes) + 10
    assert sum(used for *_, used, _ in fills) == total and len(fills) <= total / 2048 * 1.01 + 2
    pieces = {}
    for i, p, s, n, *_ in out.collect():
        pieces.setdefault(i, []).append((p, s, n))
    for i, n in enumerate(sizes):
        if i != 7:
            want = [(k, 2048 * k, min(2048, n - 2048 * k)) for k in range(max(1, -(-n // 2048)))]
            assert sorted(pieces[i]) == want
    assert sorted(pieces[None]) == [(0, 0, 5), (0, 0, 5)] and len(pieces[7]) == 2
    g = gain(out).first()
    assert g.used == len(fills) and g.least == -(-total // 2048) and g.opened >= g.used
    out.unpersist()


def test_the_layout_of_the_input_changes_nothing(spark):
    rng = np.random.default_rng(4)
    data = [(int(i), int(x)) for i, x in enumerate(np.minimum(3000, rng.lognormal(5, 1.2, 2000)))] + [(None, 7)] * 300 + [(5, 11)] * 200
    df = spark.createDataFrame(data, "id long, n long")
    one = rows(pack(df.coalesce(1), "id", "n", 2048, shard_items=300))
    assert one == rows(pack(df.repartition(3).sortWithinPartitions("n"), "id", "n", 2048, shard_items=300)) and len(one) >= len(data)


def test_equal_items_are_dealt_to_all_shards(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 1 ELSE id END AS id", "CASE WHEN id % 2 = 0 THEN 40 ELSE id % 90 + 1 END AS n")
    out = pack(df, "id", "n", 100, shard_items=2000)
    per_shard = out.filter("id = 1").selectExpr("shiftright(opened, 24) AS shard").groupBy("shard").count().collect()
    assert len(per_shard) == 10 and max(r["count"] for r in per_shard) < 2500
    assert out.count() == 20_000


def test_many_empty_items_and_no_items(spark):
    df = spark.range(3000).selectExpr("id", "0 AS n")
    assert pack(df, "id", "n", 10, shard_items=1000).count() == 3000
    assert rows(pack(df.limit(0), "id", "n")) == []
    with pytest.raises(ValueError):
        pack(df, "id", "n", 0)
