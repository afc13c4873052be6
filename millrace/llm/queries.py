"""Queries of the training-data operators, and what DuckDB can say about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.frequent import frequent_items
from millrace.llm.leakage import leaks
from millrace.llm.packing import containers, gain, pack
from millrace.llm.patterns import distinct_per, distinct_where, patterns, written
from millrace.llm.repetition import flag_repetitive, group_thresholds, repetition
from millrace.llm.tokens import token_counts
from millrace.llm.topn import top_per_group

CAPACITY = 2048
FREQUENT_SHARE = 0.01
TOP = 3
LEAK_RUN = 13
REPEATED_SHARE = 0.5
LEAST_WORDS = 40


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _members(spark: SparkSession, d: str) -> DataFrame:
    return written(_read(spark, d, "hits"), "userid", ["eventdate", "counterid"])


def p1_days(spark: SparkSession, d: str) -> DataFrame:
    return distinct_per(patterns(_members(spark, d), "userid"), ["eventdate"])


def p1_counters(spark: SparkSession, d: str) -> DataFrame:
    return distinct_per(patterns(_members(spark, d), "userid"), ["counterid"])


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return distinct_per(patterns(_members(spark, d), "userid"), ["eventdate", "counterid"])


def p1_combination(spark: SparkSession, d: str) -> DataFrame:
    """Users seen at counter 62 and at counter 3147, but not on the month's first day."""
    c = F.col("counterid")
    return distinct_where(patterns(_members(spark, d), "userid"), all_of=[c == 62, c == 3147], none_of=[F.col("eventdate") == F.lit("2013-07-01").cast("date")])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of day and counter with at least 20 rows that have a user and 0.6 times as many users."""
    members, pair = _members(spark, d), ["eventdate", "counterid"]
    users = distinct_per(patterns(members, "userid"), pair).withColumnsRenamed({c: f"users_{c}" for c in pair})
    rows = members.groupBy(*pair).agg(F.sum("rows").alias("rows")).filter("rows >= 20")
    same = [F.col(c).eqNullSafe(F.col(f"users_{c}")) for c in pair]  # NULL is a group too
    return rows.join(users, same).filter(F.col("ids") * 10 >= F.col("rows") * 6).select(F.col("eventdate").cast("string").alias("eventdate"), "counterid")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    hits = _read(spark, d, "hits").filter(F.col("url") != "")
    return hits.groupBy("counterid", "url").agg(F.count(F.lit(1)).alias("hits"))


def p4_top_urls(spark: SparkSession, d: str) -> DataFrame:
    """The ten urls of each counter with most hits, and their positions."""
    return top_per_group(_scored(spark, d), ["counterid"], "hits", "url", 10)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_per_group(_scored(spark, d), ["counterid"], "hits", "url", TOP).select("counterid", "url")


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    return frequent_items(_read(spark, d, "hits"), ["searchphrase", "url"], FREQUENT_SHARE)


def p5_frequent(spark: SparkSession, d: str) -> DataFrame:
    """Frequent values with their rows, and whether the sketch's estimate keeps its bounds: never below, less than double."""
    return _frequent(spark, d).select("item_field", "item", "n_rows", F.col("estimate").between(F.col("n_rows"), F.col("n_rows") * 2 - 1).alias("estimate_holds"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select("item_field", "item")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(_read(spark, d, "documents"), ["doc_id"]), "doc_id", "tokens", CAPACITY)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return containers(_packed(spark, d), CAPACITY)


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: none too full, every text whole and once, only larger texts cut."""
    packed = _packed(spark, d)
    full = containers(packed, CAPACITY).agg(F.count_if(F.col("used") > CAPACITY).alias("too_full"))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "start", "length")))  # a text's pieces: as many as containers it fills
    texts = packed.groupBy("doc_id").agg(ordered.alias("p"), F.sum("length").alias("tokens"))
    whole = F.forall("p", lambda x: (x.start == x.piece * CAPACITY) & ((x.length == CAPACITY) | (x.start + x.length == F.col("tokens"))))
    judged = texts.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~whole).alias("broken"), F.count_if((F.size("p") > 1) != (F.col("tokens") > CAPACITY)).alias("cut_wrongly"))
    return judged.join(F.broadcast(full))


def p8_gain(spark: SparkSession, d: str) -> DataFrame:
    """What the search gained: containers before it, after it, and the least possible."""
    return gain(_packed(spark, d), CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lie in more than one container."""
    spans = _packed(spark, d).groupBy("doc_id").agg(F.min("container").alias("low"), F.max("container").alias("high"))
    return spans.filter("low < high").select("doc_id")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"), run=LEAK_RUN)


def p9_longest(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items with a long common passage, and its words."""
    return p9_leaks(spark, d).filter(F.col("longest") >= LEAK_RUN).select("doc_id", "item_id", "longest")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).filter(F.col("longest") >= LEAK_RUN).select("doc_id", "item_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition(_read(spark, d, "documents"), ["doc_id"])


def p10_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The share of repetition from which a document stands out, in each language and source."""
    return group_thresholds(_read(spark, d, "documents"))


def p10_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat more than is usual in their language and source."""
    return flag_repetitive(_read(spark, d, "documents"), ["doc_id"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the flagged documents those that also meet the fixed rule.

    The ceiling speaks only where a twentieth of a group repeats half of its words, and keeps the rule's cases in then.
    """
    flagged = flag_repetitive(_read(spark, d, "documents"), ["doc_id"], ceiling=REPEATED_SHARE)
    return flagged.filter((F.col("words") >= LEAST_WORDS) & (F.col("repeated") * 2 >= F.col("words"))).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p1_days, p1_counters, p1_pairs, p1_combination, p1_found, p4_top_urls, p4_found, p5_frequent, p5_found, p8_packed, p8_containers, p8_check, p8_gain, p8_found, p9_leaks, p9_longest, p9_found, p10_shares, p10_thresholds, p10_flagged, p10_found)
}

_WORDS = r"regexp_extract_all(lower(regexp_replace({0}, '<[^<>]*>|\[[^\[\]]*\]|&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', ' ', 'g')), '[\p{{L}}\p{{Nd}}]+')"
_REPEATED = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
     runs AS (SELECT doc_id, i, w[i:i+3] AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1))) AS i FROM w)),
     again AS (SELECT doc_id, i FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
     hit AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM again, range(4) t(k) GROUP BY doc_id),
     s AS (SELECT doc_id, len(w) AS words, coalesce(n, 0) AS repeated, coalesce(n, 0) / greatest(len(w), 1) AS share FROM w LEFT JOIN hit USING (doc_id))
"""
_TOP = """
SELECT counterid, url, hits, position FROM (
  SELECT *, row_number() OVER (PARTITION BY counterid ORDER BY hits DESC, url) AS position
  FROM (SELECT counterid, url, COUNT(*) AS hits FROM hits WHERE url <> '' AND counterid IS NOT NULL GROUP BY counterid, url)) WHERE position <= {}
"""
#: The exact form of the thresholds: sketches of up to 1,024 documents hold every share.
_LIMITS = (
    _REPEATED
    + """,
     g AS (SELECT s.*, coalesce(nullif(regexp_extract(lower(trim(lang)), '^[a-z]+'), ''), 'und') AS lang_key, coalesce(source, '') AS source_key FROM s JOIN documents USING (doc_id)),
     a AS (SELECT quantile_disc(share, 0.95) AS t FROM g),
     l AS (SELECT lang_key, a.t + (quantile_disc(share, 0.95) - a.t) * (COUNT(*) / (COUNT(*) + 200.0::DOUBLE)) AS t FROM g, a GROUP BY lang_key, a.t),
     t AS (SELECT g.lang_key, source_key, COUNT(*) AS documents, l.t + (quantile_disc(share, 0.95) - l.t) * (COUNT(*) / (COUNT(*) + 200.0::DOUBLE)) AS threshold
           FROM g JOIN l ON g.lang_key = l.lang_key GROUP BY g.lang_key, source_key, l.t)
"""
)
_FREQUENT = " UNION ALL ".join(
    f"SELECT '{c}' AS item_field, {c} AS item, COUNT(*) AS n_rows FROM hits WHERE {c} <> '' GROUP BY {c} HAVING COUNT(*) >= {FREQUENT_SHARE} * (SELECT COUNT(*) FROM hits WHERE {c} <> '')" for c in ("searchphrase", "url")
)

SQL = {
    "p1_days": "SELECT eventdate, COUNT(DISTINCT userid) AS ids FROM hits WHERE userid IS NOT NULL GROUP BY eventdate",
    "p1_counters": "SELECT counterid, COUNT(DISTINCT userid) AS ids FROM hits WHERE userid IS NOT NULL GROUP BY counterid",
    "p1_pairs": "SELECT eventdate, counterid, COUNT(DISTINCT userid) AS ids FROM hits WHERE userid IS NOT NULL GROUP BY eventdate, counterid",
    "p1_combination": "SELECT COUNT(*) AS ids FROM (SELECT userid FROM hits WHERE userid IS NOT NULL GROUP BY userid HAVING bool_or(counterid = 62) AND bool_or(counterid = 3147) AND NOT bool_or(eventdate = DATE '2013-07-01'))",
    "p1_found": "SELECT CAST(eventdate AS VARCHAR) AS eventdate, counterid FROM hits WHERE userid IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 20 AND COUNT(DISTINCT userid) * 10 >= COUNT(*) * 6",
    "p4_top_urls": _TOP.format(10),
    "p4_found": f"SELECT counterid, url FROM ({_TOP.format(TOP)})",
    "p5_frequent": f"SELECT *, true AS estimate_holds FROM ({_FREQUENT})",
    "p5_found": f"SELECT item_field, item FROM ({_FREQUENT})",
    "p8_check": "SELECT COUNT(*) AS documents, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS cut_wrongly, CAST(0 AS BIGINT) AS too_full FROM documents",
    "p9_longest": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), e AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items),
     dr AS (SELECT doc_id, i, w[i:i+12] AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
     er AS (SELECT item_id, j, w[j:j+12] AS run FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS j FROM e)),
     same AS (SELECT doc_id, item_id, i, i - j AS diagonal FROM dr JOIN er USING (run)),
     island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS k FROM same)
SELECT doc_id, item_id, MAX(n) + 12 AS longest FROM (SELECT doc_id, item_id, COUNT(*) AS n FROM island GROUP BY doc_id, item_id, diagonal, k) GROUP BY doc_id, item_id""",
    "p9_found": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), e AS (SELECT item_id, {_WORDS.format("text")} AS w FROM eval_items),
     dr AS (SELECT DISTINCT doc_id, w[i:i+12] AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
     er AS (SELECT DISTINCT item_id, w[i:i+12] AS run FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (run)""",
    "p10_shares": _REPEATED + "SELECT * FROM s",
    "p10_thresholds": _LIMITS + "SELECT * FROM t",
    "p10_flagged": _LIMITS + "SELECT doc_id, g.lang_key, g.source_key, words, repeated, share, threshold FROM g JOIN t USING (lang_key, source_key) WHERE share > 0 AND share >= threshold",
    "p10_found": _REPEATED + f"SELECT doc_id FROM s WHERE words >= {LEAST_WORDS} AND repeated * 2 >= words",
}
