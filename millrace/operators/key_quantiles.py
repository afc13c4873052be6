"""Exact per-key results where a few keys hold most rows."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expr import Expr, _c
from millrace.lineage import materialize

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)


def _label(q: float) -> str:
    return "q" + f"{q * 100:g}".replace(".", "_")


def key_quantiles(df: DataFrame, keys: Sequence[str], value: Expr, quantiles: Sequence[float] = (0.5, 0.9, 0.99), fanout: int = 1024) -> DataFrame:
    """Rows, values and exact quantiles for each key: ``keys, n_rows, n_values, q50, …``.

    A quantile q is the smallest value that at least ``q * n_values`` values (one at least) don't exceed. ``value`` must
    be an integer or boolean (it is read as 64-bit); another type is an error.

    A first pass counts each key's values and finds the least and the greatest. Keys with more than ``fanout`` values are
    hot, and their values are never gathered: each round reads the rows inside the intervals where a rank is open,
    straight from the scan, and counts them in at most ``fanout`` buckets of each interval, with each bucket's least and
    greatest value and the exclusive or of its values. These merge, so a task sends at most ``fanout`` rows for an
    interval, however many rows it has; rows spread by key and bucket. The bucket that holds the rank is the next
    interval, unless it tells the value: the rank is its first or last, all values are equal, or there are three (the
    exclusive or gives the middle one). A bucket of at most ``fanout`` values is sorted as it is. A round takes
    ``log2(fanout)`` bits off the range. All other keys have at most ``fanout`` values and are numbered in order. The
    joins with hot keys and open intervals are broadcasts only where Spark finds their written tables small.

    Rows with a NULL key are left out. NULL values count in ``n_rows`` only; a key without values has NULL quantiles.
    Empty input gives no rows. Other columns are ignored, whatever their names.
    """
    if not quantiles or any(not 0 <= q <= 1 for q in quantiles) or len({_label(q) for q in quantiles}) < len(quantiles):
        raise ValueError("quantiles must be distinct numbers from 0 to 1")
    if fanout < 8:
        raise ValueError("fanout must be at least 8")
    kind = df.select(_c(value).alias("v")).schema[0].dataType
    if not isinstance(kind, _INTEGERS):
        raise TypeError(f"quantiles of {kind.simpleString()} values: only integers have exact 64-bit ranks")
    ks, places = [f"__k{i}" for i in range(len(keys))], range(len(quantiles))
    given = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, ks)], _c(value).cast("long").alias("v")).dropna(subset=ks)
    ranks = [F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(Decimal(str(q))) * F.col("n_values")).cast("long")) for q in quantiles]
    rows, values = F.count(F.lit(1)), F.count("v")

    totals = given.groupBy(*ks).agg(rows.alias("n_rows"), values.alias("n_values"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    hot = materialize(totals.filter(F.col("n_values") > fanout))
    over = Window.partitionBy(*ks)
    others = given.join(hot.select(*ks), ks, "left_anti")
    numbered = others.select("*", F.row_number().over(over.orderBy(F.col("v").asc_nulls_last())).alias("at"), rows.over(over).alias("n_rows"), values.over(over).alias("n_values"))
    cold = numbered.groupBy(*ks).agg(F.first("n_rows").alias("n_rows"), F.first("n_values").alias("n_values"), *[F.max(F.when(F.col("at") == r, F.col("v"))).alias(f"s{i}") for i, r in zip(places, ranks)])

    # open ranks: key, number of the quantile, and the rank within an interval of known ends and number of values
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in zip(places, ranks)])).alias("t")
    targets = hot.select(*ks, "lo", "hi", F.col("n_values").alias("n"), asked).select(*ks, "lo", "hi", "n", "t.i", "t.r")
    ends = F.when((F.col("r") == 1) | (F.col("lo") == F.col("hi")), F.col("lo")).when(F.col("r") == F.col("n"), F.col("hi"))
    found = materialize(targets.withColumn("s", ends))
    solved: list[DataFrame] = []
    while True:
        solved.append(found.filter("s IS NOT NULL").select(*ks, "i", "s"))
        open_ = found.filter("s IS NULL")
        asked = F.collect_list(F.struct("i", "r")).alias("asked")  # at most one for each quantile
        intervals = materialize(open_.groupBy(*ks, "lo", "hi", "n").agg(asked).withColumn("many", F.col("n") > fanout), "many")
        kinds = {r.many for r in intervals.select("many").distinct().collect()}
        few, many = (intervals.filter(c).drop("many") for c in (~F.col("many"), F.col("many")))
        inside = lambda some: given.join(some, ks).filter(F.col("v").between(F.col("lo"), F.col("hi")))
        if False in kinds:
            sorted_ = inside(few).groupBy(*ks, "lo").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.first("asked").alias("asked"))
            solved.append(materialize(sorted_.select(*ks, "vs", F.explode("asked").alias("t")).select(*ks, "t.i", F.element_at("vs", F.col("t.r").cast("int")).alias("s"))))
        if True not in kinds:
            break
        finer = inside(many).select(*ks, F.col("lo").alias("g"), _bucket(fanout).alias("b"), "v")
        upto = Window.partitionBy(*ks, "g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        counted = finer.groupBy(*ks, "g", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.bit_xor("v").alias("x")).withColumn("cum", F.sum("n").over(upto))
        wanted = many.select(*ks, F.col("lo").alias("g"), F.explode("asked").alias("t")).select(*ks, "g", "t.i", "t.r")
        rank = F.col("r") - F.col("cum") + F.col("n")
        hit = counted.join(wanted, [*ks, "g"]).filter("cum >= r AND cum - n < r")
        found = materialize(hit.select(*ks, "lo", "hi", "n", "i", rank.alias("r"), _solved(rank).alias("s")))
    late = functools.reduce(DataFrame.union, solved).groupBy(*ks).agg(*[F.max(F.when(F.col("i") == i, F.col("s"))).alias(f"s{i}") for i in places])
    out = cold.unionByName(hot.select(*ks, "n_rows", "n_values").join(late, ks))
    return out.select(*[F.col(k).alias(c) for k, c in zip(ks, keys)], "n_rows", "n_values", *[F.col(f"s{i}").alias(_label(q)) for i, q in zip(places, quantiles)])


def _bucket(fanout: int) -> Column:
    """Number of the bucket of ``v`` between ``lo`` and ``hi``, by halves of the numbers so that no difference overflows."""
    half = lambda c: F.shiftright(c, 1)
    width = F.call_function("div", half(F.col("hi")) - half(F.col("lo")), F.lit(fanout // 2)) + 1  # of halves
    wide = F.call_function("div", half(F.col("v")) - half(F.col("lo")), width)
    narrow = F.call_function("div", F.col("v") - F.col("lo"), F.call_function("div", F.col("hi") - F.col("lo"), F.lit(fanout)) + 1)
    return F.when(half(F.col("hi")) - half(F.col("lo")) > F.lit(2**61), wide).otherwise(narrow)


def _solved(rank: Column) -> Column:
    """The value at a rank within a bucket, if the bucket's four numbers tell it."""
    lo, hi = F.col("lo"), F.col("hi")
    middle = F.when(F.col("n") == 3, F.col("x").bitwiseXOR(lo).bitwiseXOR(hi))
    return F.when((rank == 1) | (lo == hi), lo).when(rank == F.col("n"), hi).otherwise(middle)
