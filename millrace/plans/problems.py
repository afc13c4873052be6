"""Queries of the general data-processing operators: hot keys, sessions, broken records and repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.expr import wall_seconds
from millrace.operators.dedup import deduplicate, surplus
from millrace.operators.key_quantiles import key_quantiles
from millrace.operators.rejects import split_records
from millrace.operators.sessions import sessionize
from millrace.schema import Field, TableSchema

#: The share of all rows from which a key counts as hot.
HOT_SHARE = 0.03
SESSION_GAP = 1800


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/hits.parquet")


def p2_counter_times(spark: SparkSession, d: str) -> DataFrame:
    """Rows and exact quartiles of the hit time for every counter."""
    return key_quantiles(_hits(spark, d), ["counterid"], wall_seconds("eventtime"), (0.25, 0.5, 0.75))


def p2_user_widths(spark: SparkSession, d: str) -> DataFrame:
    """Rows, median and 90th percentile of the window width for every user."""
    return key_quantiles(_hits(spark, d), ["userid"], "windowclientwidth", (0.5, 0.9))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Counters and users with at least 3 % of all rows, by the rows that the per-key results count.

    The per-key results are the quartiles of the hit time, of both kinds of key in one pass over the table.
    """
    hits = _hits(spark, d)
    fields = ("counterid", "userid")
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).cast("long").alias("key_value")) for i, c in enumerate(fields)]))
    keyed = hits.select(key.alias("k"), wall_seconds("eventtime").alias("t")).select("k.*", "t")
    keys = key_quantiles(keyed, ["kind", "key_value"], "t", (0.25, 0.5, 0.75))
    rows = hits.agg(F.count(F.lit(1)).alias("rows"))  # one row
    name = F.element_at(F.array(*[F.lit(c) for c in fields]), F.col("kind") + 1)
    return keys.join(F.broadcast(rows), F.col("n_rows") >= F.col("rows") * HOT_SHARE).select(name.alias("key_field"), "key_value")


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessionize(_hits(spark, d), "userid", "eventtime", SESSION_GAP)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_sessions(spark, d).select("userid", "session_start", "session_end")


def _csv_schema(spark: SparkSession, d: str) -> TableSchema:
    """The schema table as a schema: one row a column, so its size is that of a table's header."""
    rows = spark.read.parquet(f"{d}/hits_csv_schema.parquet").orderBy("ordinal").collect()
    return TableSchema(tuple(Field(r.field_name, r.field_type, r.is_nullable) for r in rows))


def _records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return split_records(spark.read.parquet(f"{d}/hits_raw.parquet"), "raw_line", _csv_schema(spark, d), ["line_id"])


def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    """The good records, typed."""
    return _records(spark, d)[0]


def p6_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The broken records as they came, with the reason."""
    return _records(spark, d)[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_rejected(spark, d).select("line_id", "reason")


def _feed(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/hit_feed.parquet")


def p7_messages(spark: SparkSession, d: str) -> DataFrame:
    """One copy of each message, the first that was received."""
    return deduplicate(_feed(spark, d), "watchid", ["received_at", "delivery_id"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries after the first of their message, in order of delivery."""
    return surplus(_feed(spark, d), "watchid", ["delivery_id"], "delivery_id").select("delivery_id")


QUERIES = {f.__name__: f for f in (p2_counter_times, p2_user_widths, p2_found, p3_sessions, p3_found, p6_valid, p6_rejected, p6_found, p7_messages, p7_found)}

_SESSIONS = """
WITH hits_ AS (SELECT userid, epoch_us(eventtime)//1000000 AS t FROM hits WHERE userid IS NOT NULL AND eventtime IS NOT NULL),
     cut AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 1800 THEN 0 ELSE 1 END AS fresh FROM hits_ WINDOW w AS (PARTITION BY userid ORDER BY t)),
     named AS (SELECT *, SUM(fresh) OVER (PARTITION BY userid ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM cut),
     s AS (SELECT userid, MIN(t) AS session_start, MAX(t) AS session_end, MAX(t) - MIN(t) AS duration, COUNT(*) AS events FROM named GROUP BY userid, k)
"""
_CELLS = r"""
WITH rec AS (SELECT *, CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS r FROM hits_raw),
     parsed AS (SELECT *, NOT regexp_full_match(r, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS quoting,
                       regexp_extract_all(',' || r, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) AS cells FROM rec),
     width AS (SELECT COUNT(*) AS n FROM hits_csv_schema),
     one AS (SELECT line_id, unnest(cells) AS cell, generate_subscripts(cells, 1) AS place FROM parsed, width WHERE NOT quoting AND len(cells) = n),
     typed AS (SELECT line_id, place, field_type, is_nullable, cell LIKE '"%' AS quoted,
                      CASE WHEN cell LIKE '"%' THEN replace(cell[2:length(cell)-1], '""', '"') ELSE cell END AS v FROM one JOIN hits_csv_schema ON place = ordinal),
     bad AS (SELECT DISTINCT line_id FROM typed WHERE NOT CASE
               WHEN v = '' AND NOT quoted THEN is_nullable OR field_type = 'string'
               WHEN field_type = 'string' THEN true
               WHEN field_type = 'int16' THEN regexp_full_match(v, '-?[0-9]+') AND coalesce(TRY_CAST(v AS SMALLINT) IS NOT NULL, false)
               WHEN field_type = 'int32' THEN regexp_full_match(v, '-?[0-9]+') AND TRY_CAST(v AS INTEGER) IS NOT NULL
               WHEN field_type = 'int64' THEN regexp_full_match(v, '-?[0-9]+') AND TRY_CAST(v AS BIGINT) IS NOT NULL
               WHEN field_type = 'date' THEN regexp_full_match(v, '[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])')
               WHEN field_type = 'timestamp' THEN regexp_full_match(v, '[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[ T]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]')
               END),
     failed AS (SELECT line_id, CASE WHEN quoting THEN 'quoting' WHEN len(cells) <> n THEN 'columns' ELSE 'value' END AS reason
                FROM parsed, width WHERE quoting OR len(cells) <> n OR line_id IN (FROM bad))
"""
_VALID = """
SELECT line_id, {} FROM (SELECT line_id, list(CASE WHEN v = '' AND NOT quoted AND is_nullable THEN NULL ELSE v END ORDER BY place) AS a FROM typed WHERE line_id NOT IN (SELECT line_id FROM failed) GROUP BY line_id)
"""
_DUCK = {"int16": "SMALLINT", "int32": "INTEGER", "int64": "BIGINT", "string": "VARCHAR", "date": "DATE", "timestamp": "TIMESTAMP"}
#: The columns of the test table's schema file, in its order.
_CSV_FIELDS = (
    "AdvEngineID int16, ResolutionWidth int16, UserID int64, RegionID int32, SearchPhrase string, EventDate date, URL string, MobilePhoneModel string, Title string, "
    "EventTime timestamp, CounterID int32, DontCountHits int16, IsRefresh int16, MobilePhone int16, SearchEngineID int16, ClientIP int32, WatchID int64, IsLink int16, "
    "IsDownload int16, URLHash int64, RefererHash int64, Referer string, WindowClientWidth int16, WindowClientHeight int16, TraficSourceID int16"
)

SQL = {
    "p2_counter_times": "SELECT counterid, COUNT(*) AS n_rows, COUNT(t) AS n_values, " + ", ".join(f"quantile_disc(t, {q}) AS q{q * 100:g}" for q in (0.25, 0.5, 0.75)) + " FROM (SELECT counterid, epoch_us(eventtime)//1000000 AS t FROM hits WHERE counterid IS NOT NULL) GROUP BY counterid",
    "p2_user_widths": "SELECT userid, COUNT(*) AS n_rows, COUNT(t) AS n_values, " + ", ".join(f"quantile_disc(t, {q}) AS q{q * 100:g}" for q in (0.5, 0.9)) + " FROM (SELECT userid, CAST(windowclientwidth AS BIGINT) AS t FROM hits WHERE userid IS NOT NULL) GROUP BY userid",
    "p2_found": " UNION ALL ".join(f"SELECT '{c}' AS key_field, CAST({c} AS BIGINT) AS key_value FROM hits WHERE {c} IS NOT NULL GROUP BY {c} HAVING COUNT(*) >= 0.03 * (SELECT COUNT(*) FROM hits)" for c in ("counterid", "userid")),
    "p3_sessions": _SESSIONS + "SELECT * FROM s",
    "p3_found": _SESSIONS + "SELECT userid, session_start, session_end FROM s",
    "p6_valid": _CELLS + _VALID.format(", ".join(f'CAST(a[{i}] AS {_DUCK[t]}) AS "{n}"' for i, (n, t) in enumerate((x.split() for x in _CSV_FIELDS.split(", ")), 1))),
    "p6_rejected": _CELLS + "SELECT h.*, f.reason FROM hits_raw h JOIN failed f USING (line_id)",
    "p6_found": _CELLS + "SELECT * FROM failed",
    "p7_messages": "SELECT * FROM hit_feed WHERE watchid IS NULL UNION ALL SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY watchid ORDER BY received_at, delivery_id) AS k FROM hit_feed WHERE watchid IS NOT NULL) WHERE k = 1",
    "p7_found": "SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY watchid ORDER BY delivery_id) AS k FROM hit_feed WHERE watchid IS NOT NULL) WHERE k > 1",
}
