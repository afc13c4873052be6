"""The 43 click-stream benchmark queries over one table of page hits, ids 0 to 42.

Each is a DataFrame declaration; where a rewrite that Catalyst lacks saves a pass (a sum of shifted columns, keys that
depend on another key) the query is written in the cheap form. Every ordered cut has a total order, so results don't
depend on the layout of the input. Rows with a NULL group key are dropped throughout.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import aggs as A
from millrace.functions import expr as E
from millrace.operators.relational import count_table, filter_, global_aggregate, group_aggregate, project, top_n

# The openings of an address that the host query strips, longest first.
HOST_PREFIXES = ("http://www.", "https://www.", "http://", "https://")


@dataclass(frozen=True)
class Params:
    """Constants of the queries."""

    # Fixed values of the public benchmark.
    user: int = 435090932899640449
    counter: int = 62
    first_day: dt.date = dt.date(2013, 7, 1)
    last_day: dt.date = dt.date(2013, 7, 31)
    minute_first_day: dt.date = dt.date(2013, 7, 14)
    minute_last_day: dt.date = dt.date(2013, 7, 15)
    referer_hash: int = 3594120000172545465
    url_hash: int = 2868770270353813622
    having_min: int = 100_000
    needle: str = "google"
    title_needle: str = "Google"
    url_not: str = ".google."


def _grouped(hits: DataFrame, keys: Sequence[str], aggs: dict[str, Column], by: Sequence[tuple[str, bool]], limit: int | None = 10, **renamed: E.Expr) -> DataFrame:
    """Group by columns (or ``renamed`` expressions), order by ``by`` and then by all keys."""
    named = {k: k for k in keys} | renamed
    return top_n(group_aggregate(hits, named, aggs), list(by), limit, tie_break=[k for k in named if k not in {b for b, _ in by}])


def _top_count(hits: DataFrame, keys: Sequence[str], name: str = "c", **extra: Column) -> DataFrame:
    return _grouped(hits, keys, {name: A.count_star(), **extra}, [(name, False)])


def _phrases(hits: DataFrame) -> DataFrame:
    return filter_(hits, F.col("SearchPhrase") != "")


def _month(hits: DataFrame, p: Params) -> DataFrame:
    return filter_(hits, (F.col("CounterID") == p.counter) & E.between("EventDate", F.lit(p.first_day), F.lit(p.last_day)) & (F.col("IsRefresh") == 0))


def q0(h, p):
    return count_table(h)


def q1(h, p):
    return global_aggregate(filter_(h, F.col("AdvEngineID") != 0), {"count": A.count_star()})


def q2(h, p):
    return global_aggregate(h, {"sum": A.sum_int("AdvEngineID"), "count": A.count_star(), "avg": A.avg_int("ResolutionWidth")})


def q3(h, p):
    return global_aggregate(h, {"avg": A.avg_int("UserID")})


def q4(h, p):
    return global_aggregate(h, {"distinct": A.count_distinct("UserID")})


def q5(h, p):
    return global_aggregate(h, {"distinct": A.count_distinct("SearchPhrase")})


def q6(h, p):
    return global_aggregate(h, {"min": A.min_("EventDate"), "max": A.max_("EventDate")})


def q7(h, p):
    return _grouped(filter_(h, F.col("AdvEngineID") != 0), ["AdvEngineID"], {"count": A.count_star()}, [("count", False)], limit=None)


def q8(h, p):
    return _grouped(h, ["RegionID"], {"u": A.count_distinct("UserID")}, [("u", False)])


def q9(h, p):
    return _top_count(h, ["RegionID"], sum=A.sum_int("AdvEngineID"), avg=A.avg_int("ResolutionWidth"), distinct=A.count_distinct("UserID")).select("RegionID", "sum", "c", "avg", "distinct")


def q10(h, p):
    return _grouped(filter_(h, F.col("MobilePhoneModel") != ""), ["MobilePhoneModel"], {"u": A.count_distinct("UserID")}, [("u", False), ("MobilePhoneModel", False)])


def q11(h, p):
    return _grouped(filter_(h, F.col("MobilePhoneModel") != ""), ["MobilePhone", "MobilePhoneModel"], {"u": A.count_distinct("UserID")}, [("u", False)])


def q12(h, p):
    return _top_count(_phrases(h), ["SearchPhrase"])


def q13(h, p):
    return _grouped(_phrases(h), ["SearchPhrase"], {"u": A.count_distinct("UserID")}, [("u", False)])


def q14(h, p):
    return _top_count(_phrases(h), ["SearchEngineID", "SearchPhrase"])


def q15(h, p):
    return _top_count(h, ["UserID"], "count")


def q16(h, p):
    return _top_count(h, ["UserID", "SearchPhrase"], "count")


def q17(h, p):
    return _grouped(h, ["UserID", "SearchPhrase"], {"count": A.count_star()}, [("UserID", True), ("SearchPhrase", True)])


def q18(h, p):
    grouped = group_aggregate(h, {"UserID": "UserID", "m": E.extract_minute("EventTime"), "SearchPhrase": "SearchPhrase"}, {"count": A.count_star(), "ip": A.max_("ClientIP")})
    return top_n(grouped, [("count", False), ("ip", False), ("m", False)], 10, tie_break=["UserID", "SearchPhrase"]).drop("ip")


def q19(h, p):
    return filter_(h, F.col("UserID") == p.user).select("UserID")


def q20(h, p):
    return global_aggregate(filter_(h, E.contains("URL", p.needle)), {"count": A.count_star()})


def q21(h, p):
    return _top_count(_phrases(filter_(h, E.contains("URL", p.needle))), ["SearchPhrase"], min_url=A.min_("URL")).select("SearchPhrase", "min_url", "c")


def q22(h, p):
    """Ties of the count go by window width and hit id, if the table has both."""
    kept = _phrases(filter_(h, E.contains("Title", p.title_needle) & E.not_contains("URL", p.url_not)))
    aggs = {"min_url": A.min_("URL"), "min_title": A.min_("Title"), "c": A.count_star(), "distinct_u": A.count_distinct("UserID")}
    order = [("c", False)]
    if {"windowclientwidth", "watchid"} <= {c.lower() for c in h.columns}:
        aggs |= {"w": A.max_("WindowClientWidth"), "id": A.min_("WatchID")}
        order += [("w", False), ("id", True)]
    return top_n(group_aggregate(kept, {"SearchPhrase": "SearchPhrase"}, aggs), order, 10, tie_break=["SearchPhrase"]).drop("w", "id")


def q23(h, p):
    return top_n(filter_(h, E.contains("URL", p.needle)), [("EventTime", True)], 10, tie_break=["WatchID"])


def q24(h, p):
    return top_n(_phrases(h).select("SearchPhrase", "EventTime", "WatchID"), [("EventTime", True)], 10, tie_break=["WatchID"]).drop("WatchID")


def q25(h, p):
    return top_n(_phrases(h).select("SearchPhrase"), [("SearchPhrase", True)], 10)


def q26(h, p):
    return top_n(_phrases(h).select("SearchPhrase", "EventTime"), [("EventTime", True), ("SearchPhrase", True)], 10)


def _long_texts(h: DataFrame, p: Params, key: dict[str, E.Expr], text: str, **extra: Column) -> DataFrame:
    grouped = group_aggregate(filter_(h, F.col(text) != ""), key, {"l": A.avg_int(E.length_bytes(text)), "c": A.count_star(), **extra})
    return top_n(filter_(grouped, F.col("c") > p.having_min), [("l", False)], 25, tie_break=list(key))


def q27(h, p):
    return _long_texts(h, p, {"CounterID": "CounterID"}, "URL")


def q28(h, p):
    return _long_texts(h, p, {"k": E.prefix_capture("Referer", HOST_PREFIXES, "/")}, "Referer", min_referer=A.min_("Referer"))


def q29(h, p):
    """SUM(x + i) for 90 values of i is SUM(x) + i COUNT(x): two aggregates, not ninety."""
    base = h.agg(A.sum_int("ResolutionWidth").alias("s"), F.count("ResolutionWidth").alias("n"))
    return base.selectExpr(*[f"s + {i}L * n AS sum{i}" for i in range(90)])


def _refreshes(h: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _top_count(h, keys, sum_is_refresh=A.sum_int("IsRefresh"), avg=A.avg_int("ResolutionWidth"))


def q30(h, p):
    return _refreshes(_phrases(h), ["SearchEngineID", "ClientIP"])


def q31(h, p):
    return _refreshes(_phrases(h), ["WatchID", "ClientIP"])


def q32(h, p):
    return _refreshes(h, ["WatchID", "ClientIP"])


def q33(h, p):
    return _top_count(h, ["URL"])


def q34(h, p):
    """The constant key joins after the cut."""
    return q33(h, p).select(E.const(1).alias("1"), "URL", "c")


def q35(h, p):
    """The keys ClientIP - i follow from ClientIP, so one key is grouped and the others are computed on ten rows."""
    top = _top_count(h, ["ClientIP"])
    return project(top, {"ClientIP": "ClientIP", **{f"ClientIP_{i}": E.minus("ClientIP", i) for i in (1, 2, 3)}, "c": "c"})


def q36(h, p):
    return _top_count(filter_(_month(h, p), (F.col("DontCountHits") == 0) & (F.col("URL") != "")), ["URL"], "PageViews")


def q37(h, p):
    return _top_count(filter_(_month(h, p), (F.col("DontCountHits") == 0) & (F.col("Title") != "")), ["Title"], "PageViews")


def q38(h, p):
    return _top_count(filter_(_month(h, p), (F.col("IsLink") != 0) & (F.col("IsDownload") == 0)), ["URL"], "PageViews")


def q39(h, p):
    src = E.case((F.col("SearchEngineID") == 0) & (F.col("AdvEngineID") == 0), F.col("Referer"), F.lit(""))
    return _grouped(_month(h, p), ["TraficSourceID", "SearchEngineID", "AdvEngineID"], {"PageViews": A.count_star()}, [("PageViews", False)], Src=src, Dst=F.col("URL"))


def q40(h, p):
    return _top_count(filter_(_month(h, p), E.is_in("TraficSourceID", [-1, 6]) & (F.col("RefererHash") == p.referer_hash)), ["URLHash", "EventDate"], "PageViews")


def q41(h, p):
    return _top_count(filter_(_month(h, p), (F.col("DontCountHits") == 0) & (F.col("URLHash") == p.url_hash)), ["WindowClientWidth", "WindowClientHeight"], "PageViews")


def q42(h, p):
    kept = filter_(h, (F.col("CounterID") == p.counter) & E.between("EventDate", F.lit(p.minute_first_day), F.lit(p.minute_last_day)) & (F.col("IsRefresh") == 0) & (F.col("DontCountHits") == 0))
    return top_n(group_aggregate(kept, {"M": E.trunc_minute("EventTime")}, {"PageViews": A.count_star()}), [("M", True)], 10)


QUERIES: dict[int, Callable[[DataFrame, Params], DataFrame]] = {i: globals()[f"q{i}"] for i in range(43)}


def run(hits: DataFrame, query: int, params: Params = Params()) -> DataFrame:
    """The DataFrame of one query; an id outside 0..42 is an error."""
    if query not in QUERIES:
        raise ValueError(f"unsupported query {query}: ids are 0 to 42")
    return QUERIES[query](hits, params)


# ---- the same queries as SQL for DuckDB ----

_AVG = "CAST(SUM({0})//COUNT({0}) AS BIGINT)"


def _avg(x: str) -> str:
    return _AVG.format(x)


def _sum(x: str) -> str:
    return f"CAST(SUM({x}) AS BIGINT)"


def _top(keys: dict[str, str], aggs: str, where: str, order: str, limit: str = "LIMIT 10", having: str = "", out: str = "") -> str:
    """GROUP BY over rows whose keys are all present."""
    inner = ", ".join(f"{e} AS key_{i}" for i, e in enumerate(keys.values()))
    present = " AND ".join(f"({e}) IS NOT NULL" for e in keys.values())
    named = ", ".join(f"key_{i} AS {k}" for i, k in enumerate(keys))
    by = ", ".join(f"key_{i}" for i in range(len(keys)))
    rows = f"SELECT *, {inner} FROM hits WHERE {present}" + (f" AND {where}" if where else "")
    return f"SELECT {out or '*'} FROM (SELECT {named}, {aggs} FROM ({rows}) GROUP BY {by}{having}) ORDER BY {order} {limit}".strip()


def _long(*names: str) -> dict[str, str]:
    return {n: f"CAST({n} AS BIGINT)" for n in names}


def _text(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def sql(query: int, p: Params = Params()) -> str:
    month = f"CounterID = {p.counter} AND EventDate BETWEEN DATE '{p.first_day}' AND DATE '{p.last_day}' AND IsRefresh = 0"
    minutes = f"CounterID = {p.counter} AND EventDate BETWEEN DATE '{p.minute_first_day}' AND DATE '{p.minute_last_day}' AND IsRefresh = 0 AND DontCountHits = 0"
    phrase, c = "SearchPhrase <> ''", "COUNT(*) AS c"
    host = "regexp_replace(Referer, '^https?://(?:www\\.)?([^/]+)/[^\\n]*$', '\\1')"
    has = lambda x, s: f"contains({x}, '{s}')"
    refresh = f"COUNT(*) AS c, {_sum('IsRefresh')} AS sum_is_refresh, {_avg('ResolutionWidth')} AS avg"
    du = "COUNT(DISTINCT {}) AS u"
    every = {
        0: "SELECT COUNT(*) AS count FROM hits",
        1: "SELECT COUNT(*) AS count FROM hits WHERE AdvEngineID <> 0",
        2: f"SELECT {_sum('AdvEngineID')} AS sum, COUNT(*) AS count, {_avg('ResolutionWidth')} AS avg FROM hits",
        3: f"SELECT {_avg('UserID')} AS avg FROM hits",
        4: 'SELECT COUNT(DISTINCT UserID) AS "distinct" FROM hits',
        5: 'SELECT COUNT(DISTINCT SearchPhrase) AS "distinct" FROM hits',
        6: "SELECT MIN(EventDate) AS min, MAX(EventDate) AS max FROM hits",
        7: _top(_long("AdvEngineID"), "COUNT(*) AS count", "AdvEngineID <> 0", "count DESC, AdvEngineID", ""),
        8: _top(_long("RegionID"), du.format("UserID"), "", "u DESC, RegionID"),
        9: _top(_long("RegionID"), f'{_sum("AdvEngineID")} AS sum, COUNT(*) AS c, {_avg("ResolutionWidth")} AS avg, COUNT(DISTINCT UserID) AS "distinct"', "", "c DESC, RegionID"),
        10: _top(_text("MobilePhoneModel"), du.format("UserID"), "MobilePhoneModel <> ''", "u DESC, MobilePhoneModel DESC"),
        11: _top(_long("MobilePhone") | _text("MobilePhoneModel"), du.format("UserID"), "MobilePhoneModel <> ''", "u DESC, MobilePhone, MobilePhoneModel"),
        12: _top(_text("SearchPhrase"), c, phrase, "c DESC, SearchPhrase"),
        13: _top(_text("SearchPhrase"), du.format("UserID"), phrase, "u DESC, SearchPhrase"),
        14: _top(_long("SearchEngineID") | _text("SearchPhrase"), c, phrase, "c DESC, SearchEngineID, SearchPhrase"),
        15: _top(_text("UserID"), "COUNT(*) AS count", "", "count DESC, UserID"),
        16: _top(_text("UserID", "SearchPhrase"), "COUNT(*) AS count", "", "count DESC, UserID, SearchPhrase"),
        17: _top(_text("UserID", "SearchPhrase"), "COUNT(*) AS count", "", "UserID, SearchPhrase"),
        18: _top(_text("UserID") | {"m": "extract(minute FROM EventTime)"} | _text("SearchPhrase"), "COUNT(*) AS count, MAX(ClientIP) AS ip", "", "count DESC, ip DESC, m DESC, UserID, SearchPhrase", out="UserID, m, SearchPhrase, count"),
        19: f"SELECT UserID AS \"UserID\" FROM hits WHERE UserID = {p.user}",
        20: f"SELECT COUNT(*) AS count FROM hits WHERE {has('URL', p.needle)}",
        21: _top(_text("SearchPhrase"), "MIN(URL) AS min_url, COUNT(*) AS c", f"{phrase} AND {has('URL', p.needle)}", "c DESC, SearchPhrase"),
        22: _top(_text("SearchPhrase"), "MIN(URL) AS min_url, MIN(Title) AS min_title, COUNT(*) AS c, COUNT(DISTINCT UserID) AS distinct_u, MAX(WindowClientWidth) AS w, MIN(WatchID) AS id", f"{phrase} AND {has('Title', p.title_needle)} AND NOT {has('URL', p.url_not)}", "c DESC, w DESC, id, SearchPhrase", out="SearchPhrase, min_url, min_title, c, distinct_u"),
        23: f"SELECT * FROM hits WHERE {has('URL', p.needle)} ORDER BY EventTime, WatchID LIMIT 10",
        24: f"SELECT SearchPhrase AS \"SearchPhrase\", EventTime AS \"EventTime\" FROM hits WHERE {phrase} ORDER BY EventTime, WatchID LIMIT 10",
        25: f"SELECT SearchPhrase AS \"SearchPhrase\" FROM hits WHERE {phrase} ORDER BY SearchPhrase LIMIT 10",
        26: f"SELECT SearchPhrase AS \"SearchPhrase\", EventTime AS \"EventTime\" FROM hits WHERE {phrase} ORDER BY EventTime, SearchPhrase LIMIT 10",
        27: _top(_long("CounterID"), f"{_avg('strlen(URL)')} AS l, COUNT(*) AS c", "URL <> ''", "l DESC, CounterID", "LIMIT 25", f" HAVING COUNT(*) > {p.having_min}"),
        28: _top({"k": host}, f"{_avg('strlen(Referer)')} AS l, COUNT(*) AS c, MIN(Referer) AS min_referer", "Referer <> ''", "l DESC, k", "LIMIT 25", f" HAVING COUNT(*) > {p.having_min}"),
        29: "SELECT " + ", ".join(f"{_sum(f'CAST(ResolutionWidth AS BIGINT) + {i}')} AS sum{i}" for i in range(90)) + " FROM hits",
        30: _top(_long("SearchEngineID", "ClientIP"), refresh, phrase, "c DESC, SearchEngineID, ClientIP"),
        31: _top(_text("WatchID") | _long("ClientIP"), refresh, phrase, "c DESC, WatchID, ClientIP"),
        32: _top(_text("WatchID") | _long("ClientIP"), refresh, "", "c DESC, WatchID, ClientIP"),
        33: _top(_text("URL"), c, "", "c DESC, URL"),
        34: _top(_text("URL"), c, "", "c DESC, URL", out='CAST(1 AS BIGINT) AS "1", URL, c'),
        35: _top(_long("ClientIP"), c, "", "c DESC, ClientIP", out="ClientIP, ClientIP - 1 AS ClientIP_1, ClientIP - 2 AS ClientIP_2, ClientIP - 3 AS ClientIP_3, c"),
        36: _top(_text("URL"), "COUNT(*) AS PageViews", f"{month} AND DontCountHits = 0 AND URL <> ''", "PageViews DESC, URL"),
        37: _top(_text("Title"), "COUNT(*) AS PageViews", f"{month} AND DontCountHits = 0 AND Title <> ''", "PageViews DESC, Title"),
        38: _top(_text("URL"), "COUNT(*) AS PageViews", f"{month} AND IsLink <> 0 AND IsDownload = 0", "PageViews DESC, URL"),
        39: _top(_long("TraficSourceID", "SearchEngineID", "AdvEngineID") | {"Src": "CASE WHEN SearchEngineID = 0 AND AdvEngineID = 0 THEN Referer ELSE '' END", "Dst": "URL"}, "COUNT(*) AS PageViews", month, "PageViews DESC, TraficSourceID, SearchEngineID, AdvEngineID, Src, Dst"),
        40: _top(_text("URLHash", "EventDate"), "COUNT(*) AS PageViews", f"{month} AND TraficSourceID IN (-1, 6) AND RefererHash = {p.referer_hash}", "PageViews DESC, URLHash, EventDate"),
        41: _top(_long("WindowClientWidth", "WindowClientHeight"), "COUNT(*) AS PageViews", f"{month} AND DontCountHits = 0 AND URLHash = {p.url_hash}", "PageViews DESC, WindowClientWidth, WindowClientHeight"),
        42: _top({"M": "date_trunc('minute', EventTime)"}, "COUNT(*) AS PageViews", minutes, "M"),
    }
    return every[query]
