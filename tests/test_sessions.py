import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from millrace.operators.sessions import sessionize

T0 = dt.datetime(2013, 7, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def brute(events, gap):
    out = []
    for u in {u for u, t in events if u is not None}:
        ts = sorted(t for v, t in events if v == u and t is not None)
        run = []
        for t in ts:
            if run and t - run[-1] > gap:
                out.append((u, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(t)
        if run:
            out.append((u, run[0], run[-1], run[-1] - run[0], len(run)))
    return sorted(out)


BASE = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())


def run(spark, events, gap, kind="long"):
    df = spark.createDataFrame([(u, None if t is None else at(t), 1, "x") for u, t in events], f"userid {kind}, eventtime timestamp_ntz, n int, u string")
    return [(u, s - BASE, e - BASE, d, n) for u, s, e, d, n in rows(sessionize(df, gap=gap))]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 400))), max_size=120))
def test_against_brute_force(spark, events):
    assert run(spark, events, 10) == brute(events, 10)


def test_one_user_holds_everything(spark):
    """A session over many partitions, and pauses that fall anywhere."""
    events = [(7, 5 * i + (1000 if i > 1500 else 0)) for i in range(3000)] + [(7, 0)] * 50 + [(u, 3 * u) for u in range(20)]
    assert run(spark, events, 10) == brute(events, 10)


def test_the_gap_is_included(spark):
    assert run(spark, [(1, 0), (1, 10), (1, 21)], 10) == [(1, 0, 10, 10, 2), (1, 21, 21, 0, 1)]


def test_string_users_and_empty_input(spark):
    assert run(spark, [("b", 3), ("", 1), ("", 2), (None, 2)], 10, "string") == [("", 1, 2, 1, 2), ("b", 3, 3, 0, 1)]
    assert run(spark, [], 10) == []
