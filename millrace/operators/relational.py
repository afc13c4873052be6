"""Filter, project, aggregate, sort and top-n: thin declarations over the DataFrame API.

They add only what Spark does otherwise: rows with a NULL key leave a grouped aggregation, integer-like keys widen to 64
bits, and an ordered cut carries a tie-break that makes it total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expr import Expr, _c

_WIDENED = (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)


def filter_(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose condition is true; NULL drops the row. Also serves as HAVING after an aggregation."""
    return df.filter(condition)


def project(df: DataFrame, columns: Mapping[str, Expr]) -> DataFrame:
    """Compute, rename, reorder; names must be distinct."""
    return df.select([_c(e).alias(n) for n, e in columns.items()])


def count_table(df: DataFrame, name: str = "count") -> DataFrame:
    """One row with the number of rows; over a file scan no column is read."""
    return df.agg(F.count(F.lit(1)).alias(name))


def global_aggregate(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """Exactly one row, over empty input too: counts 0, everything else NULL."""
    return df.agg(*[a.alias(n) for n, a in aggs.items()])


def group_aggregate(df: DataFrame, keys: Mapping[str, Expr], aggs: Mapping[str, Column]) -> DataFrame:
    """GROUP BY expressions. Rows with a NULL in any key are dropped; integer and boolean keys become 64-bit.

    A floating key is an error. Empty input gives no rows. ``aggs`` may be empty (distinct keys).
    """
    inner = {n: f"__key_{i}" for i, n in enumerate(keys)}  # a key may bear the name of a column that an aggregate reads
    types = df.select([_c(e).alias(n) for n, e in keys.items()]).schema
    cols = {}
    for f, e in zip(types.fields, keys.values()):
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            raise TypeError(f"key {f.name!r} is floating")
        c = _c(e)
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        cols[inner[f.name]] = c.cast("long") if isinstance(f.dataType, _WIDENED) else c
    keyed = df.withColumns(cols).dropna(subset=list(inner.values()))
    grouped = keyed.groupBy(*inner.values())
    out = grouped.agg(*[a.alias(n) for n, a in aggs.items()]) if aggs else keyed.select(*inner.values()).distinct()
    return out.select([F.col(i).alias(n) for n, i in inner.items()] + [F.col(n) for n in aggs])


def top_n(df: DataFrame, sort: Sequence[tuple[Expr, bool]], limit: int | None = None, offset: int = 0, tie_break: Sequence[Expr] = ()) -> DataFrame:
    """Sort by ``(expression, ascending)`` keys, then skip and cut. NULL is smallest.

    With a limit Spark plans a bounded heap a partition and no full sort. ``tie_break`` (ascending) is needed for a
    result that does not depend on the layout of the input; without keys the first rows of the input are taken.
    """
    order = [(_c(e).asc_nulls_first() if up else _c(e).desc_nulls_last()) for e, up in [*sort, *((t, True) for t in tie_break)]]
    out = df.orderBy(*order) if order else df
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)
