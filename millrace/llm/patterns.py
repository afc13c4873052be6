"""Distinct counts over huge identifier sets, exact for every combination of groups, by membership patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.lineage import materialize


def memberships(df: DataFrame, identifier: str, groups: Sequence[str]) -> DataFrame:
    """The mergeable partial result of a load: ``identifier, groups…, rows``, each identifier once a group.

    An identifier or group with very many rows is reduced on the map side. Rows with a NULL identifier are left out;
    NULL is a group value like any other. Empty input gives no rows. Other columns are ignored; of the columns named,
    none may be called ``rows``, ``ids`` or ``pattern``.
    """
    if {identifier.lower(), *(g.lower() for g in groups)} & {"rows", "ids", "pattern"}:
        raise ValueError("rows, ids and pattern are names of the result")
    return df.select(identifier, *groups).filter(F.col(identifier).isNotNull()).groupBy(identifier, *groups).agg(F.count(F.lit(1)).alias("rows"))


def merge_memberships(*parts: DataFrame) -> DataFrame:
    """Memberships of several loads together; an identifier that occurs in more than one is still counted once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*[c for c in out.columns if c != "rows"]).agg(F.sum("rows").alias("rows"))


def patterns(members: DataFrame, identifier: str) -> DataFrame:
    """Membership patterns in rows: ``pattern, groups…, ids``: each pattern's groups, and how many identifiers have it.

    An identifier's pattern is the set of groups that hold it. Identifiers with equal sets are found by a set hash
    (two 64-bit hashes combined by exclusive or, and the number of groups), which partial results add up to, so a set
    is never built in one place, however large. A pattern bears the name of its least identifier, whose rows in
    ``members`` spell the set out.

    The error of counts from it is 0, but for a chance of about p²/2¹²⁹ that two of p patterns share their hashes.
    ``members`` is read twice: pass a written table.
    """
    groups = [c for c in members.columns if c not in (identifier, "rows")]
    parts: list[Column] = [x for g in groups for x in (F.col(f"`{g}`").isNull(), F.col(f"`{g}`"))]
    sets = members.groupBy(identifier).agg(
        F.bit_xor(F.xxhash64(F.lit(1), *parts)).alias("__a"), F.bit_xor(F.xxhash64(F.lit(2), *parts)).alias("__b"), F.count(F.lit(1)).alias("__n")
    )
    totals = sets.groupBy("__a", "__b", "__n").agg(F.min(identifier).alias("pattern"), F.count(F.lit(1)).alias("ids"))
    return members.drop("rows").join(totals.select("pattern", "ids"), F.col(identifier) == F.col("pattern")).select("pattern", *groups, "ids")


def distinct_per(found: DataFrame, by: Sequence[str], name: str = "ids") -> DataFrame:
    """Distinct identifiers for each value of some group columns, any subset of those that the patterns were built on."""
    if set(found.columns) - {"pattern", "ids"} != set(by):  # on fewer columns a pattern may name a group more than once
        found = found.groupBy(*by, "pattern").agg(F.first("ids").alias("ids"))
    return found.groupBy(*by).agg(F.sum("ids").alias(name))


def distinct_where(found: DataFrame, any_of: Sequence[Column] = (), all_of: Sequence[Column] = (), none_of: Sequence[Column] = (), name: str = "ids") -> DataFrame:
    """One row: identifiers in at least one of some groups, in each of some, and in none of some.

    Each condition tells which rows belong to a group (or a set of groups). Without matches the count is 0.
    """
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    keep = F.lit(True)
    if any_of:
        keep = keep & F.greatest(F.lit(False), *[has(c) for c in any_of]) if len(any_of) > 1 else keep & has(any_of[0])
    for c in all_of:
        keep = keep & has(c)
    for c in none_of:
        keep = keep & ~has(c)
    return found.groupBy("pattern").agg(F.first("ids").alias("ids"), keep.alias("keep")).filter("keep").agg(F.coalesce(F.sum("ids"), F.lit(0)).alias(name))


def written(df: DataFrame, identifier: str, groups: Sequence[str]) -> DataFrame:
    """Memberships as a table in the shared folder."""
    return materialize(memberships(df, identifier, groups))
