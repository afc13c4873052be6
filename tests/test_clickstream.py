"""The 43 queries on a small table of our own, with NULLs, ties and repeated rows, against DuckDB and by hand."""

import datetime as dt

import duckdb
import pytest

from conftest import rows
from millrace.plans import clickstream
from millrace.plans.clickstream import Params

SITES = ["http://www.maps.example/a", "https://shop.example/b?q=1", "ftp.example", "http://google.example/x", "", None, "https://www.search.google.test/y/z", "http://odd.example"]
PHRASES = ["", "red kettle", None, "kayak", "Kayak", "red kettle", "zebra crossing"]
TITLES = ["Google tips", "Tools", "", None, "About Google, again"]
KINDS = {
    "AdvEngineID": "short", "ResolutionWidth": "short", "UserID": "long", "RegionID": "int", "SearchPhrase": "string", "EventDate": "date", "URL": "string", "MobilePhoneModel": "string", "Title": "string",
    "EventTime": "timestamp_ntz", "CounterID": "int", "DontCountHits": "short", "IsRefresh": "short", "MobilePhone": "short", "SearchEngineID": "short", "ClientIP": "int", "WatchID": "long", "IsLink": "short",
    "IsDownload": "short", "URLHash": "long", "RefererHash": "long", "Referer": "string", "WindowClientWidth": "short", "WindowClientHeight": "short", "TraficSourceID": "short",
}
PARAMS = Params(user=7003, referer_hash=31, url_hash=42, having_min=3)


def row(i):
    day = dt.date(2013, 7, 1 + i * 5 % 31)
    at = dt.datetime(2013, 7, 13 + i % 4, i % 24, i * 7 % 60, i % 50)
    user = None if i % 11 == 0 else 7000 + i % 6
    return (i % 3, 900 + i * 13 % 400, user, i % 5, PHRASES[i % 7], day if i % 3 else at.date(), SITES[i % 8], ["", "slab", "brick"][i % 3], TITLES[i % 5], at, 62 if i % 5 else 5, i // 2 % 2, int(i % 9 == 0), i % 4, i % 2 * 3, -100 + i % 4,
            9000 + i, i % 2, int(i % 10 == 7), 42 if i % 3 else 43, 31 if i % 3 else 30, SITES[i * 3 % 8], 1000 + i % 3 * 10, 700 + i % 2, (-1, 2, 6, 9)[i % 4])


@pytest.fixture(scope="module")
def hits(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hits") / "t")
    data = [row(i) for i in range(160)] + [row(i) for i in range(5)]
    spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in KINDS.items())).coalesce(2).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW hits AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return spark.read.parquet(path), con


@pytest.mark.parametrize("q", range(43))
def test_same_as_sql(hits, q):
    table, con = hits
    df = clickstream.run(table, q, PARAMS)
    cur = con.execute(clickstream.sql(q, PARAMS))
    names = [d[0] for d in cur.description]
    assert sorted(c.lower() for c in df.columns) == sorted(n.lower() for n in names)
    got = sorted(tuple(map(str, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert got == sorted(tuple(map(str, r)) for r in cur.fetchall())
    assert got


def test_by_hand(hits):
    table, _ = hits
    ask = lambda q: [tuple(r) for r in clickstream.run(table, q, PARAMS).collect()]
    all_rows = [row(i) for i in [*range(160), *range(5)]]
    assert ask(0) == [(165,)]
    widths = [r[1] for r in all_rows]
    assert ask(2) == [(sum(r[0] for r in all_rows), 165, sum(widths) // 165)]
    assert list(ask(29)[0]) == [sum(widths) + 165 * i for i in range(90)]
    users = [r[2] for r in all_rows]
    assert ask(15)[0] == max(((u, users.count(u)) for u in set(users) - {None}), key=lambda x: (x[1], -x[0]))
    ips = [r[15] for r in all_rows]
    assert sorted(ask(35)) == sorted((ip, ip - 1, ip - 2, ip - 3, ips.count(ip)) for ip in set(ips))
    assert {h for h, *_ in ask(28)} <= {"maps.example", "shop.example", "ftp.example", "google.example", "search.google.test", "http://odd.example"}


def test_ties_without_the_columns_for_them(hits):
    table, _ = hits
    out = clickstream.run(table.drop("WindowClientWidth"), 22, PARAMS)
    assert out.columns == ["SearchPhrase", "min_url", "min_title", "c", "distinct_u"] and rows(out) == rows(clickstream.run(table, 22, PARAMS))


def test_unknown_id(hits):
    for q in (43, -1):
        with pytest.raises(ValueError):
            clickstream.run(hits[0], q)
