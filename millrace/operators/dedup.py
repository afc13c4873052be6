"""Messages that were delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return True
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def _digest(df: DataFrame) -> Column:
    """A hash of the whole row that tells NULLs and columns apart; maps go in as JSON."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [c.isNull(), F.to_json(F.struct(c)) if _has_map(f.dataType) else c]
    return F.xxhash64(*parts)


def deduplicate(df: DataFrame, key: str, earliest: Sequence[str]) -> DataFrame:
    """Exactly one row for each value of ``key``: the first by the ``earliest`` columns, then by a hash of the row.

    One aggregation by ``key``: ``min_by`` of the row over a struct of the delivery order and the tie-break. Each task
    reduces its own copies first, so a message with very many copies sends one row a task through the shuffle. The
    minimum is associative, so batches that were reduced apart merge by union and another call.

    NULL in an order column comes last. A NULL key identifies nothing, so all rows with one are kept. Rows that are
    equal in every column are one message. Columns keep their names and types; empty input gives no rows.
    """
    order = []
    for c in earliest:
        order += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    identified = (
        df.filter(F.col(f"`{key}`").isNotNull())
        .select(F.col(f"`{key}`").alias("__key"), row.alias("__row"), F.struct(*order, _digest(df)).alias("__order"))
        .groupBy("__key")
        .agg(F.min_by("__row", "__order").alias("__row"))
        .select([F.col("__row").getField(c).alias(c) for c in df.columns])
    )
    return identified.unionByName(df.filter(F.col(f"`{key}`").isNull()))


def surplus(df: DataFrame, key: str, earliest: Sequence[str], row_id: str) -> DataFrame:
    """The rows that :func:`deduplicate` by ``[*earliest, row_id]`` leaves out.

    ``row_id`` must be unique and not NULL. Only the key, the order and the id take part in the aggregation.
    """
    order = [*earliest, *([] if row_id in earliest else [row_id])]
    slim = df.select([F.col(f"`{c}`") for c in dict.fromkeys([key, *order])])
    kept = deduplicate(slim, key, order).select(F.col(f"`{row_id}`").alias("__kept"))
    return df.join(kept, F.col(f"`{row_id}`") == F.col("__kept"), "left_anti")


def merge_batch(kept: DataFrame, batch: DataFrame, key: str, earliest: Sequence[str]) -> DataFrame:
    """The kept rows after one more batch of deliveries; copies in different batches meet here."""
    return deduplicate(kept.unionByName(batch), key, earliest)
