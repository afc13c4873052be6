"""Typed loading of delimited records, with the broken ones set apart and a reason for each."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.lineage import materialize
from millrace.schema import TYPES, TableSchema

#: Reasons in the order in which they are looked for; a record gets the first that holds.
REASONS = ("quoting", "columns", "value")

# Marks for work on a record: a delimiter outside quotes, and what stands for these two characters where the data holds them.
_CUT, _ESCAPE = "\x01", "\x02"
_ESCAPED = ((_ESCAPE, _ESCAPE + "e"), (_CUT, _ESCAPE + "c"))

_INT_RANGE = {"int16": (-(2**15), 2**15 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1)}


def _split(text: Column, ch: str) -> Column:
    """Cut at one character, which isn't a pattern."""
    return F.split(text, ch if ch not in "\\^$.|?*+()[]{}" else "\\" + ch, -1)


def _parsed(df: DataFrame, raw: str, delimiter: str, quote: str) -> DataFrame:
    """``__pieces`` of each record between quotes, ``__quoting`` whether its quotes are sound, and its ``__cells``.

    Pieces at even places stand outside quotes. The quotes are sound if their number is even and every piece outside
    is either empty between two quotes (a doubled quote) or parted from its quotes by delimiters.
    """
    text = F.coalesce(F.col(f"`{raw}`"), F.lit(""))
    text = F.when(text.endswith("\r"), F.expr(f"left(`{raw}`, length(`{raw}`) - 1)")).otherwise(text)
    for plain, escaped in _ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    df = df.withColumn("__pieces", _split(text, quote))
    last = F.size("__pieces") - 1

    def broken(p: Column, i: Column) -> Column:
        opens, closes = p.endswith(delimiter) | (i == last), p.startswith(delimiter) | (i == 0)
        return (i % 2 == 0) & (p != "") & ~(opens & closes)

    def cut(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.replace(p, F.lit(delimiter), F.lit(_CUT))).otherwise(p)

    sound = (last % 2 == 0) & (F.size(F.filter("__pieces", broken)) == 0)
    cells = _split(F.array_join(F.transform("__pieces", cut), quote), _CUT)
    return df.withColumns({"__quoting": ~sound, "__cells": cells}).drop("__pieces")


def _value(cell: Column, quote: str) -> Column:
    inner = F.replace(cell.substr(F.lit(2), F.length(cell) - 2), F.lit(quote * 2), F.lit(quote))
    value = F.when(cell.startswith(quote), inner).otherwise(cell)
    for plain, escaped in reversed(_ESCAPED):
        value = F.replace(value, F.lit(escaped), F.lit(plain))
    return value


def _date(v: Column) -> Column:
    """A day past the month's end runs into the next month."""
    late = F.date_add(F.make_date(v.substr(1, 4).cast("int"), v.substr(6, 2).cast("int"), F.lit(1)), v.substr(9, 2).cast("int") - 1)
    return F.coalesce(v.try_cast("date"), late)


_DAY = r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_CLOCK = r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"


def fits(v: Column, kind: str) -> Column:
    """Whether a present value can be read as a type."""
    if kind in _INT_RANGE:
        low, high = _INT_RANGE[kind]
        n = v.try_cast("bigint")  # a value that comes out as it went in needs no pattern
        return F.coalesce(n.between(low, high), F.lit(False)) & ((n.cast("string") == v) | v.rlike(r"\A-?[0-9]+\z"))
    if kind == "double":
        return v.rlike(r"(?i)\A[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\z") & ~(v.rlike("[0-9]") & F.coalesce(F.abs(v.try_cast("double")) == float("inf"), F.lit(True)))
    if kind == "bool":
        return F.lower(v).isin("1", "0", "true", "false")
    if kind == "date":
        return F.coalesce(v.try_cast("date").cast("string") == v, F.lit(False)) | v.rlike(rf"\A{_DAY}\z")
    if kind == "timestamp":
        return v.rlike(rf"\A{_DAY}[ T]{_CLOCK}\z")
    if kind == "char":
        return F.octet_length(v) == 1
    return F.lit(True)


def typed(v: Column, kind: str) -> Column:
    if kind == "bool":
        return F.lower(v).isin("1", "true")
    if kind == "date":
        return _date(v)
    if kind == "timestamp":
        return F.coalesce(v.try_cast("timestamp_ntz"), F.concat(_date(v).cast("string"), F.lit(" "), v.substr(12, 8)).cast("timestamp_ntz"))
    return v if kind in ("string", "char") else v.cast(TYPES[kind])


def _rules(df: DataFrame, schema: TableSchema) -> DataFrame:
    rows = [(i, f.type, f.nullable) for i, f in enumerate(schema.fields)]
    return df.sparkSession.createDataFrame(rows, "__place int, __type string, __nullable boolean")


def errors(df: DataFrame, raw: str, schema: TableSchema, key: Sequence[str], delimiter: str = ",", quote: str = '"') -> DataFrame:
    """One row for each failing record: ``key`` columns, ``__content`` and ``__check`` (hashes of the record) and ``__reason``.

    Cells are exploded into record, place and value, joined with the table of rules (one row a column of the schema,
    so its size is bounded by the schema and it is broadcast), and each is validated; what fails is reduced to the
    first reason of each record. Only failures are shuffled.
    """
    width = len(schema.fields)
    keys = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(key)]
    parsed = _parsed(df, raw, delimiter, quote).select(*keys, *_content(raw), "__quoting", "__cells", F.col(f"`{raw}`").isNull().alias("__none"))
    names = [f"__k{i}" for i in range(len(key))]
    whole = F.when(F.col("__quoting"), 0).when(F.col("__none") | (F.size("__cells") != width), 1)  # NULL: look at the cells
    ranked = parsed.select(*names, *_HASHES, whole.alias("__whole"), "__cells")
    cells = ranked.select(*names, *_HASHES, "__whole", F.posexplode(F.when(F.col("__whole").isNull(), F.col("__cells")).otherwise(F.array(F.lit("")))).alias("__place", "__cell"))
    value = cells.select(*names, *_HASHES, "__whole", "__place", _value(F.col("__cell"), quote).alias("__value"), F.col("__cell").startswith(quote).alias("__quoted"))
    checks = functools.reduce(lambda w, k: w.when(F.col("__type") == k, fits(F.col("__value"), k)), [k for k in TYPES if k != "string"], F.when(F.col("__type") == "string", True))
    missing = ~F.col("__quoted") & (F.col("__value") == "")
    good = F.when(missing, F.col("__nullable") | (F.col("__type") == "string")).otherwise(checks)
    failed = value.join(F.broadcast(_rules(df, schema)), "__place").filter(F.col("__whole").isNotNull() | ~good).select(*names, *_HASHES, F.coalesce("__whole", F.lit(2)).alias("__rank"))
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.min("__rank") + 1)
    return failed.groupBy(*names, *_HASHES).agg(reason.alias("__reason")).withColumnsRenamed(dict(zip(names, [f"__key{i}" for i in range(len(key))])))


_HASHES = ("__content", "__check")


def _content(raw: str) -> list[Column]:
    """128 bits that stand for a record: of n different ones two share them with a chance of about n²/2¹²⁹."""
    c = F.col(f"`{raw}`")
    return [F.xxhash64(c.isNull(), c).alias(_HASHES[0]), F.xxhash64(F.lit("check"), c).alias(_HASHES[1])]


def _match(df: DataFrame, found: DataFrame, raw: str, key: Sequence[str]) -> Column:
    a, b = _content(raw)
    on = (a == F.col(_HASHES[0])) & (b == F.col(_HASHES[1]))
    for i, c in enumerate(key):
        on = on & df[c].eqNullSafe(F.col(f"__key{i}"))
    return on


def split_records(df: DataFrame, raw: str, schema: TableSchema, key: Sequence[str] = (), delimiter: str = ",", quote: str = '"') -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``: typed columns of the good records, and the broken ones unchanged with their ``reason``.

    ``raw`` holds one record a row; it may hold line ends inside quotes, and one closing carriage return isn't part of
    it. A record fails by ``quoting`` (a quoted field not closed or followed by anything but a delimiter or the end, or
    a quote in an unquoted field), else ``columns`` (the wrong number of fields), else ``value`` (a field that its type
    can't read; an unquoted empty field is NULL in a nullable column, ``''`` in another string column, else invalid).

    The records are judged once, when this is called, and the failures are written (key, hashes, reason); both results
    read them. A join with them is a broadcast only where that table is small; a record is matched by its key and by 128
    bits of its content, so a good one is mistaken for a broken one with a chance of about n²/2¹²⁹.

    ``key`` names columns that tell records apart (they only spread the work: the verdict depends on the content alone,
    so repeated and NULL keys do no harm). An input column named ``reason`` stays, and the
    new one is ``_reason``. ``valid`` has the key columns and the schema's; a key that bears a schema
    column's name is left out of it. A NULL record fails by ``columns``. Empty input gives two empty tables.
    """
    found = materialize(errors(df, raw, schema, key, delimiter, quote))
    name = "reason"
    while name in {c.lower() for c in df.columns}:
        name = "_" + name
    rejected = df.join(found, _match(df, found, raw, key)).select(*[df[c] for c in df.columns], F.col("__reason").alias(name))
    clean = _parsed(df.join(found, _match(df, found, raw, key), "left_anti"), raw, delimiter, quote)
    taken = {n.lower() for n in schema.names}
    cols = [F.col(f"`{c}`") for c in key if c.lower() not in taken]
    for i, f in enumerate(schema.fields):
        cell = F.get("__cells", F.lit(i))
        v = _value(cell, quote)
        empty = F.lit(None) if f.nullable else F.lit("") if f.type == "string" else F.lit(None)
        cols.append(F.when(cell == "", empty.cast(TYPES[f.type])).otherwise(typed(v, f.type)).alias(f.name))
    return clean.select(*cols), rejected
