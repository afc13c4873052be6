"""One query for each operator, expression, function and aggregate, over the whole test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import aggs as A
from millrace.functions import expr as E
from millrace.lineage import scratch
from millrace.operators.relational import count_table, filter_, global_aggregate, group_aggregate, project, top_n
from millrace.plans.clickstream import HOST_PREFIXES
from millrace.schema import TableSchema
from millrace.sources.csv_io import read_csv, write_csv
from millrace.sources.storage import count_rows, read_table, table_schema, table_stats, write_table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Fixed value: the pattern of the benchmark's query 28.
HOST_PATTERN = r"^https?://(?:www\.)?([^/]+)/.*$"


def _op(name: str, table: str, sql: str | None):
    """Register a function of a table (or of none) under a name, with its SQL."""

    def add(f):
        QUERIES[name] = lambda spark, d: f(spark.read.parquet(f"{d}/{table}.parquet"))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- relational ----
_op("op_scan_project_rename", "orders", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")(lambda t: project(t, {"id": "o_orderkey", "status": "o_orderstatus"}))
_op("op_scan_all", "nation", "SELECT * FROM nation")(lambda t: t)
_op("op_const_column", "nation", "SELECT CAST(7 AS BIGINT) AS seven, 'x' AS x, n_name FROM nation")(lambda t: project(t, {"seven": E.const(7), "x": E.const("x"), "n_name": "n_name"}))
_op("op_const_only", "nation", "SELECT CAST(7 AS BIGINT) AS seven FROM nation")(lambda t: project(t, {"seven": E.const(7)}))
_op("op_count_table", "lineitem", "SELECT COUNT(*) AS count FROM lineitem")(count_table)
for _name, _f, _sign in (("eq", Column.__eq__, "="), ("ne", Column.__ne__, "<>"), ("lt", Column.__lt__, "<"), ("le", Column.__le__, "<="), ("gt", Column.__gt__, ">"), ("ge", Column.__ge__, ">=")):
    _op(f"op_cmp_{_name}_int", "lineitem", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber {_sign} 3")(lambda t, f=_f: filter_(t, f(F.col("l_linenumber"), F.lit(3))).select("l_orderkey", "l_linenumber"))
    _op(f"op_cmp_{_name}_string", "orders", f"SELECT o_orderkey FROM orders WHERE o_orderpriority {_sign} '3-MEDIUM'")(lambda t, f=_f: filter_(t, f(F.col("o_orderpriority"), F.lit("3-MEDIUM"))).select("o_orderkey"))
_op("op_cmp_columns", "lineitem", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < l_suppkey")(lambda t: filter_(t, F.col("l_partkey") < F.col("l_suppkey")).select("l_orderkey", "l_partkey", "l_suppkey"))
_op("op_cmp_string_columns", "hits", "SELECT watchid FROM hits WHERE url > referer")(lambda t: filter_(t, F.col("url") > F.col("referer")).select("watchid"))
_op("op_cmp_double", "lineitem", "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount >= 0.05")(lambda t: filter_(t, F.col("l_discount") >= 0.05).select("l_orderkey", "l_discount"))
_op("op_cmp_double_int", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 25")(lambda t: filter_(t, F.col("l_quantity") > E.const(25)).select("l_orderkey", "l_quantity"))
_NAN = "CASE WHEN l_linenumber = 2 THEN {} WHEN l_linenumber = 3 THEN NULL ELSE l_discount END"
for _name, _sign, _sql in (("less", "<=", "x <= 0.05 AND NOT isnan(x)"), ("greater", ">", "x > 0.05 AND NOT isnan(x)"), ("unlike", "<>", "x <> 0.05")):
    _op(f"op_cmp_nan_{_name}", "lineitem", f"SELECT l_orderkey, l_linenumber FROM (SELECT *, {_NAN.format("'NaN'::DOUBLE")} AS x FROM lineitem) WHERE {_sql}")(
        lambda t, s=_sign: filter_(t.withColumn("x", F.expr(_NAN.format("double('NaN')"))), E.compare_double("x", s, 0.05)).select("l_orderkey", "l_linenumber")
    )
_op("op_cmp_date", "hits", "SELECT watchid FROM hits WHERE eventdate >= DATE '2013-07-20'")(lambda t: filter_(t, F.col("eventdate") >= F.lit(dt.date(2013, 7, 20))).select("watchid"))
_op("op_cmp_timestamp", "hits", "SELECT watchid FROM hits WHERE eventtime < TIMESTAMP '2013-07-02 12:00:00'")(lambda t: filter_(t, F.col("eventtime") < F.lit("2013-07-02 12:00:00").cast("timestamp_ntz")).select("watchid"))
_op("op_cmp_char", "hits_full", "SELECT watchid FROM hits_full WHERE hitcolor = ' '")(lambda t: filter_(t, F.col("hitcolor") == " ").select("watchid"))
_op("op_and_or_in", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber IN (1, 4, 7) AND l_returnflag = 'R') OR l_linestatus = 'O'")(
    lambda t: filter_(t, (E.is_in("l_linenumber", [1, 4, 7]) & (F.col("l_returnflag") == "R")) | (F.col("l_linestatus") == "O")).select("l_orderkey", "l_linenumber")
)
_op("op_between_date", "orders", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")(
    lambda t: filter_(t, E.between(F.col("o_orderdate").cast("date"), F.lit(dt.date(1995, 1, 1)), F.lit(dt.date(1995, 12, 31)))).select("o_orderkey")
)
_op("op_bool_column", "lineitem", "SELECT l_orderkey, l_quantity > 25 AS big FROM lineitem WHERE l_quantity > 25")(lambda t: filter_(t.withColumn("big", F.col("l_quantity") > 25), F.col("big")).select("l_orderkey", "big"))
_op("op_predicate_value", "hits", "SELECT watchid, coalesce(searchphrase <> '', false) AS searched FROM hits")(lambda t: project(t, {"watchid": "watchid", "searched": E.pred(F.col("searchphrase") != "")}))
_op("op_contains", "documents", "SELECT doc_id FROM documents WHERE contains(text, '%') OR contains(text, 'quote')")(lambda t: filter_(t, E.contains("text", "%") | E.contains("text", "quote")).select("doc_id"))
_op("op_not_contains", "hits", "SELECT watchid FROM hits WHERE NOT contains(url, '.html')")(lambda t: filter_(t, E.not_contains("url", ".html")).select("watchid"))
_op("op_non_empty", "hits", "SELECT watchid FROM hits WHERE searchphrase <> ''")(lambda t: filter_(t, F.col("searchphrase") != "").select("watchid"))
_op("op_case", "hits", "SELECT watchid, CASE WHEN searchengineid = 0 AND advengineid = 0 THEN referer ELSE '' END AS src FROM hits")(
    lambda t: project(t, {"watchid": "watchid", "src": E.case((F.col("searchengineid") == 0) & (F.col("advengineid") == 0), F.col("referer"), F.lit(""))})
)
_op("op_case_null_condition", "hits", "SELECT watchid, CASE WHEN userid > 0 THEN 'known' ELSE 'unknown' END AS u FROM hits")(lambda t: project(t, {"watchid": "watchid", "u": E.case(F.col("userid") > 0, F.lit("known"), F.lit("unknown"))}))
_op("op_arith_add_sub_mul", "hits", "SELECT watchid, CAST(clientip AS BIGINT) + 3 AS plus, CAST(clientip AS BIGINT) - 3 AS minus, CAST(clientip AS BIGINT) * 1000 AS times FROM hits")(
    lambda t: project(t, {"watchid": "watchid", "plus": E.plus("clientip", 3), "minus": E.minus("clientip", 3), "times": E.times("clientip", 1000)})
)
_op("op_arith_columns", "hits", "SELECT watchid, CAST(windowclientwidth AS BIGINT) * windowclientheight AS area FROM hits")(lambda t: project(t, {"watchid": "watchid", "area": E.times("windowclientwidth", "windowclientheight")}))

# ---- functions ----
_op("op_length_bytes", "documents", "SELECT doc_id, strlen(text) AS n FROM documents")(lambda t: project(t, {"doc_id": "doc_id", "n": E.length_bytes("text")}))
_HOST_SQL = "SELECT watchid, regexp_replace(referer, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') AS host FROM hits"
_op("op_re2_host", "hits", _HOST_SQL)(lambda t: project(t, {"watchid": "watchid", "host": E.re2_replace("referer", HOST_PATTERN, r"\1")}))
_op("op_prefix_capture_host", "hits", _HOST_SQL)(lambda t: project(t, {"watchid": "watchid", "host": E.prefix_capture("referer", HOST_PREFIXES, "/")}))
_op("op_re2_every_match", "documents", "SELECT doc_id, regexp_replace(text, '([0-9])([0-9]+)', '\\2$\\1', 'g') AS x FROM documents")(lambda t: project(t, {"doc_id": "doc_id", "x": E.re2_replace("text", "([0-9])([0-9]+)", r"\2$\1")}))
_op("op_re2_classes", "documents", "SELECT doc_id, regexp_replace(text, '\\p{Lu}[\\p{Ll}''-]+|[[:digit:]&&]{2,}|[^\\n]$', '<\\0>', 'g') AS x FROM documents")(
    lambda t: project(t, {"doc_id": "doc_id", "x": E.re2_replace("text", r"\p{Lu}[\p{Ll}'-]+|[[:digit:]&&]{2,}|[^\n]$", r"<\0>")})
)
_op("op_extract_minute", "events", "SELECT event_id, extract(minute FROM ts) AS m FROM events")(lambda t: project(t, {"event_id": "event_id", "m": E.extract_minute("ts")}))
_op("op_trunc_minute", "events", "SELECT event_id, date_trunc('minute', ts) AS m FROM events")(lambda t: project(t, {"event_id": "event_id", "m": E.trunc_minute("ts")}))
_op("op_date_number", "hits", "SELECT watchid, CAST(eventdate - DATE '1970-01-01' AS BIGINT) AS d, epoch_us(eventtime)//1000000 AS s FROM hits")(lambda t: project(t, {"watchid": "watchid", "d": E.date_number("eventdate"), "s": E.wall_seconds("eventtime")}))
_op("op_char_code", "hits_full", "SELECT watchid, CAST(ascii(hitcolor) AS BIGINT) AS code FROM hits_full")(lambda t: project(t, {"watchid": "watchid", "code": E.char_code("hitcolor")}))

# ---- aggregates ----
_AVG = "CAST(SUM({0})//COUNT({0}) AS BIGINT)"
_op("op_global_sum", "hits", "SELECT CAST(SUM(clientip) AS BIGINT) AS s FROM hits")(lambda t: global_aggregate(t, {"s": A.sum_int("clientip")}))
_op("op_global_avg_int", "hits", f"SELECT {_AVG.format('userid')} AS a, {_AVG.format('clientip')} AS b FROM hits")(lambda t: global_aggregate(t, {"a": A.avg_int("userid"), "b": A.avg_int("clientip")}))
_op("op_global_min_max", "hits", "SELECT MIN(regionid) AS a, MAX(url) AS b, MIN(eventdate) AS c, MAX(eventtime) AS d FROM hits")(lambda t: global_aggregate(t, {"a": A.min_("regionid"), "b": A.max_("url"), "c": A.min_("eventdate"), "d": A.max_("eventtime")}))
_op("op_global_min_max_double", "lineitem", "SELECT MIN(l_extendedprice) AS a, MAX(l_discount) AS b FROM lineitem")(lambda t: global_aggregate(t, {"a": A.min_("l_extendedprice"), "b": A.max_("l_discount")}))
_op("op_global_distinct", "hits", "SELECT COUNT(DISTINCT userid) AS u, COUNT(DISTINCT url) AS v FROM hits")(lambda t: global_aggregate(t, {"u": A.count_distinct("userid"), "v": A.count_distinct("url")}))
_op("op_global_agg_empty", "hits", "SELECT COUNT(*) AS n, MIN(url) AS m, CAST(SUM(clientip) AS BIGINT) AS s, COUNT(DISTINCT url) AS d FROM hits WHERE counterid < 0")(
    lambda t: global_aggregate(filter_(t, F.col("counterid") < 0), {"n": A.count_star(), "m": A.min_("url"), "s": A.sum_int("clientip"), "d": A.count_distinct("url")})
)
_op("op_sum_double", "lineitem", "SELECT l_returnflag AS f, CAST(ROUND(SUM(l_extendedprice), 2) AS DOUBLE) AS s FROM lineitem GROUP BY 1")(lambda t: group_aggregate(t, {"f": "l_returnflag"}, {"s": F.round(A.sum_double("l_extendedprice"), 2)}))
_op("op_sum_exact", "lineitem", "SELECT l_returnflag AS f, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1")(lambda t: group_aggregate(t, {"f": "l_returnflag"}, {"s": A.sum_exact("l_extendedprice", 2)}))
_op("op_sum_exact_doubles", "lineitem", "SELECT l_returnflag AS f, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY 1")(lambda t: group_aggregate(t, {"f": "l_returnflag"}, {"s": F.round(A.sum_exact("l_extendedprice"), 2)}))
_op("op_sum_date_number", "hits", "SELECT CAST(SUM(eventdate - DATE '1970-01-01') AS BIGINT) AS s FROM hits")(lambda t: global_aggregate(t, {"s": A.sum_int(E.date_number("eventdate"))}))

# ---- grouped aggregation: the key shapes ----
_G = "COUNT(*) AS n, CAST(SUM(clientip) AS BIGINT) AS s"


def _group(name: str, keys, sql_keys: dict[str, str]) -> None:
    """``keys`` is called when the query is built: columns need a running session."""
    sel = ", ".join(f"{e} AS {k}" for k, e in sql_keys.items())
    there = " AND ".join(f"({e}) IS NOT NULL" for e in sql_keys.values())
    _op(name, "hits", f"SELECT {sel}, {_G} FROM hits WHERE {there} GROUP BY {', '.join(str(i + 1) for i in range(len(sql_keys)))}")(lambda t: group_aggregate(t, keys(), {"n": A.count_star(), "s": A.sum_int("clientip")}))


_B = "CAST({} AS BIGINT)".format
_group("op_group_int", lambda: {"k": "counterid"}, {"k": _B("counterid")})
_group("op_group_string", lambda: {"k": "searchphrase"}, {"k": "searchphrase"})
_group("op_group_int_int", lambda: {"a": "counterid", "b": "regionid"}, {"a": _B("counterid"), "b": _B("regionid")})
_group("op_group_int_string", lambda: {"a": "userid", "b": "searchphrase"}, {"a": "userid", "b": "searchphrase"})
_group("op_group_int_int_string", lambda: {"a": "userid", "m": E.extract_minute("eventtime"), "b": "searchphrase"}, {"a": "userid", "m": "extract(minute FROM eventtime)", "b": "searchphrase"})
_group("op_group_composite", lambda: {"a": "counterid", "d": "eventdate", "b": "url", "c": "title"}, {"a": _B("counterid"), "d": "eventdate", "b": "url", "c": "title"})
_group("op_group_bool_key", lambda: {"k": F.col("windowclientwidth") > 1000}, {"k": _B("windowclientwidth > 1000")})
_group("op_group_date_key", lambda: {"k": "eventdate"}, {"k": "eventdate"})
_group("op_group_timestamp_key", lambda: {"k": E.trunc_minute("eventtime")}, {"k": "date_trunc('minute', eventtime)"})
_group("op_group_expr_key", lambda: {"k": E.plus("regionid", 100)}, {"k": "CAST(regionid AS BIGINT) + 100"})
_group("op_group_null_keys_dropped", lambda: {"u": "userid", "t": "title", "r": "referer"}, {"u": "userid", "t": "title", "r": "referer"})
_op("op_group_char_key", "hits_full", "SELECT CAST(ascii(hitcolor) AS BIGINT) AS k, COUNT(*) AS n FROM hits_full WHERE hitcolor IS NOT NULL GROUP BY 1")(lambda t: group_aggregate(t, {"k": E.char_code("hitcolor")}, {"n": A.count_star()}))
_op("op_group_all_aggregates", "hits", f"SELECT CAST(counterid AS BIGINT) AS k, COUNT(*) AS n, CAST(SUM(isrefresh) AS BIGINT) AS s, {_AVG.format('resolutionwidth')} AS a, COUNT(DISTINCT userid) AS u, COUNT(DISTINCT url) AS v, MIN(title) AS lo, MAX(eventtime) AS hi FROM hits WHERE counterid IS NOT NULL GROUP BY counterid")(
    lambda t: group_aggregate(t, {"k": "counterid"}, {"n": A.count_star(), "s": A.sum_int("isrefresh"), "a": A.avg_int("resolutionwidth"), "u": A.count_distinct("userid"), "v": A.count_distinct("url"), "lo": A.min_("title"), "hi": A.max_("eventtime")})
)
_op("op_distinct_keys", "hits", "SELECT DISTINCT CAST(counterid AS BIGINT) AS c, CAST(regionid AS BIGINT) AS r FROM hits WHERE counterid IS NOT NULL AND regionid IS NOT NULL")(lambda t: group_aggregate(t, {"c": "counterid", "r": "regionid"}, {}))
_op("op_group_empty", "hits", "SELECT CAST(counterid AS BIGINT) AS k, COUNT(*) AS n FROM hits WHERE counterid < 0 GROUP BY counterid")(lambda t: group_aggregate(filter_(t, F.col("counterid") < 0), {"k": "counterid"}, {"n": A.count_star()}))
_op("op_having", "hits", "SELECT CAST(counterid AS BIGINT) AS k, COUNT(*) AS n FROM hits WHERE counterid IS NOT NULL GROUP BY counterid HAVING COUNT(*) > 50")(lambda t: filter_(group_aggregate(t, {"k": "counterid"}, {"n": A.count_star()}), F.col("n") > 50))

# ---- sort, limit, offset ----
_op("op_topn_desc", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda t: top_n(t.select("o_orderkey", "o_totalprice"), [("o_totalprice", False)], 20, tie_break=["o_orderkey"]))
_op("op_topn_multi_key", "lineitem", "SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag DESC, l_shipdate, l_orderkey, l_linenumber LIMIT 25")(
    lambda t: top_n(t.select("l_returnflag", "l_shipdate", "l_orderkey", "l_linenumber"), [("l_returnflag", False), ("l_shipdate", True)], 25, tie_break=["l_orderkey", "l_linenumber"])
)
_op("op_topn_nulls_first", "hits", "SELECT DISTINCT userid, url FROM hits ORDER BY userid NULLS FIRST, url NULLS FIRST LIMIT 30")(lambda t: top_n(t.select("userid", "url").distinct(), [("userid", True), ("url", True)], 30))
_op("op_topn_nulls_last", "documents", "SELECT author, doc_id FROM documents ORDER BY author DESC NULLS LAST, doc_id LIMIT 30 OFFSET 900")(lambda t: top_n(t.select("author", "doc_id"), [("author", False)], 30, 900, tie_break=["doc_id"]))
_op("op_topn_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 1000")(lambda t: top_n(t.select("o_orderkey"), [("o_orderkey", True)], 10, 1000))
_op("op_topn_offset_beyond", "nation", "SELECT n_name FROM nation ORDER BY n_name LIMIT 10 OFFSET 1000")(lambda t: top_n(t.select("n_name"), [("n_name", True)], 10, 1000))
_op("op_topn_expr_key", "hits", "SELECT DISTINCT url, strlen(url) AS n FROM hits WHERE url IS NOT NULL ORDER BY n DESC, url LIMIT 15")(
    lambda t: top_n(project(t, {"url": "url"}).dropna().distinct().withColumn("n", E.length_bytes("url")), [(E.length_bytes("url"), False)], 15, tie_break=["url"])
)
_op("op_limit_no_sort_count", "orders", "SELECT COUNT(*) AS n FROM (SELECT 1 FROM orders LIMIT 7)")(lambda t: top_n(t, [], 7).agg(F.count(F.lit(1)).alias("n")))
_op("op_sort_all", "supplier", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")(lambda t: top_n(t.select("s_suppkey", "s_acctbal"), [("s_acctbal", True), ("s_suppkey", True)]))
_op("op_full_row_topn", "hits_full", "SELECT * FROM hits_full WHERE contains(url, 'panel') ORDER BY eventtime, watchid LIMIT 10")(lambda t: top_n(filter_(t, E.contains("url", "panel")), [("eventtime", True)], 10, tie_break=["watchid"]))


# ---- storage ----
def _there_and_back(codec: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = spark.read.parquet(f"{d}/hits.parquet").select("watchid", "userid", "url", "eventdate", "eventtime", "regionid")
        path = scratch(spark)
        write_table(t, path, TableSchema.of_struct(t.schema), codec, {"url": "dictionary", "watchid": "plain"} | ({"eventtime": "delta"} if codec != "none" else {}))
        return read_table(spark, path)

    return run


for _codec in ("none", "lz4_raw", "zstd"):
    QUERIES[f"io_parquet_roundtrip_{_codec}"] = _there_and_back(_codec)
    SQL[f"io_parquet_roundtrip_{_codec}"] = "SELECT watchid, userid, url, eventdate, eventtime, regionid FROM hits"


def io_parquet_roundtrip_delta(spark: SparkSession, d: str) -> DataFrame:
    """Numbers only, in delta pages and run lengths."""
    t = spark.read.parquet(f"{d}/hits.parquet").select("watchid", "userid", "eventdate", "eventtime", "regionid")
    path = scratch(spark)
    write_table(t, path, TableSchema.of_struct(t.schema), "zstd", {"watchid": "plain", "eventdate": "frame_of_reference", "eventtime": "delta", "regionid": "rle"})
    return read_table(spark, path)


def io_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All of hits as text and back: NULL and '' stay apart, quotes and non-ASCII text survive."""
    t = spark.read.parquet(f"{d}/hits.parquet")
    schema = TableSchema.of_struct(t.schema)
    path = scratch(spark)
    write_csv(t, path, schema, header=True)
    return read_csv(spark, path, schema, header=True)


def io_schema_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The schema of a written table as the table itself tells it: types, char and NOT NULL included."""
    t = spark.read.parquet(f"{d}/hits_full.parquet").select("watchid", "hitcolor", "userid", "url", "eventdate", "isrefresh")
    path = scratch(spark)
    schema = TableSchema.of([("watchid", "int64"), ("hitcolor", "char", True), ("userid", "int64", True), ("url", "string", True), ("eventdate", "date"), ("isrefresh", "int16")])
    write_table(t, path, schema)
    kept = table_schema(read_table(spark, path)).fields
    return spark.createDataFrame([(i, f.name, f.type, f.nullable) for i, f in enumerate(kept)], "place int, name string, type string, nullable boolean")


def io_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, NULLs, least and greatest value of columns, put together from the footers' statistics."""
    t = spark.read.parquet(f"{d}/hits.parquet").select("watchid", "userid", "regionid", "counterid")
    path = scratch(spark)
    write_table(t, path, TableSchema.of_struct(t.schema))
    chunks = [(s.column, s.rows, s.nulls, s.low, s.high) for s in table_stats(spark, path)]
    stats = spark.createDataFrame(chunks, "name string, n long, nulls long, low long, high long")
    return stats.groupBy("name").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"))


def io_count_footers(spark: SparkSession, d: str) -> DataFrame:
    return count_rows(spark, f"{d}/hits.parquet")


def io_projected_scan(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, f"{d}/hits.parquet", [2, "url"])


QUERIES |= {"io_schema_roundtrip": io_schema_roundtrip, "io_stats": io_stats, "io_count_footers": io_count_footers, "io_parquet_roundtrip_delta": io_parquet_roundtrip_delta, "io_csv_roundtrip": io_csv_roundtrip, "io_projected_scan": io_projected_scan}
_STATS = " UNION ALL ".join(f"SELECT '{c}' AS name, COUNT(*) AS n, COUNT(*) - COUNT({c}) AS nulls, CAST(MIN({c}) AS BIGINT) AS low, CAST(MAX({c}) AS BIGINT) AS high FROM hits" for c in ("watchid", "userid", "regionid", "counterid"))
SQL |= {
    "io_schema_roundtrip": "SELECT * FROM (VALUES (0, 'watchid', 'int64', false), (1, 'hitcolor', 'char', true), (2, 'userid', 'int64', true), (3, 'url', 'string', true), (4, 'eventdate', 'date', false), (5, 'isrefresh', 'int16', false)) t(place, name, type, nullable)",
    "io_stats": _STATS,
    "io_count_footers": "SELECT COUNT(*) AS count FROM hits",
}
SQL |= {"io_parquet_roundtrip_delta": "SELECT watchid, userid, eventdate, eventtime, regionid FROM hits", "io_csv_roundtrip": "SELECT * FROM hits", "io_projected_scan": "SELECT userid, url FROM hits"}
