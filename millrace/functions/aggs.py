"""Aggregates with the engine's exact semantics, as plain Spark aggregate columns.

All combine partial results on the map side, so a hot group costs one row a task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expr import Expr, _c, as_int, not_floating


def count_star() -> Column:
    return F.count(F.lit(1))


def sum_int(x: Expr) -> Column:
    """64-bit sum of integers; NULL over no values, an error for other types."""
    return F.sum(as_int(x))


def sum_double(x: Expr) -> Column:
    return F.sum(_c(x).cast("double"))


def sum_exact(x: Expr, scale: int | None = None) -> Column:
    """Sum of doubles without the rounding of each step; NULL over no values.

    With ``scale``, values are taken as decimals of that many places and summed exactly; use it where the values are
    decimals by nature (prices, rates). Without it every value is split, without loss, into whole multiples of 34 powers
    of two, these are summed as decimals, and the sums are put together at the end, so the result is off by two units in
    the last place at most (bits below 2⁻⁹⁶⁰ are left out). Both merge like any sum. NaN and infinities give what a plain sum gives.
    """
    c = _c(x).cast("double")
    if scale is not None:
        return F.sum(_c(x).cast(T.DecimalType(28, scale))).cast("double")
    odd = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(F.bool_or(odd), F.sum(c)).otherwise(_windows(F.when(odd, F.lit(0.0)).otherwise(c)))


_STEP = 60
_POWERS = range(-960, 1021, _STEP)


def _windows(x: Column) -> Column:
    def part(e: int) -> Column:
        """What ``x`` has between the powers ``e`` and ``e + 60``, in multiples of 2ᵉ; nothing if it is too large to reach down there."""
        here = F.rint(x * F.lit(2.0**-e))
        if e < _POWERS[-1]:
            here = here - F.rint(x * F.lit(2.0 ** -(e + _STEP))) * F.lit(2.0**_STEP)
        if e + _STEP + 53 < 1024:
            here = F.when(F.abs(x) < F.lit(2.0 ** (e + _STEP + 53)), here).otherwise(F.lit(0.0))
        return F.sum(here.cast("long").cast(T.DecimalType(38, 0)))

    whole = T.DecimalType(38, 0)
    base = F.lit(2**_STEP).cast(whole)
    start = F.struct(F.lit(0).cast(whole).alias("carry"), F.array().cast("array<double>").alias("done"))

    def carried(acc: Column, v: Column) -> Column:
        """Upwards: what exceeds a power's half goes to the next, so that lower powers can't outweigh a higher one."""
        total = (v + acc["carry"]).cast(whole)
        up = F.round(total.cast(T.DecimalType(38, 4)) / F.lit(2**_STEP).cast(T.DecimalType(20, 0)), 0).cast(whole)
        return F.struct(up.alias("carry"), F.array_append(acc["done"], (total - up * base).cast("double")).alias("done"))

    digits = F.aggregate(F.array(*[part(e) for e in _POWERS]), start, carried)
    scaled = F.zip_with(F.array_append(digits["done"], digits["carry"].cast("double")), F.array(*[F.lit(2.0 ** (e - 4)) for e in _POWERS], F.lit(float("inf"))), lambda d, p: F.when(d == 0, F.lit(0.0)).otherwise(d * p))
    total = F.aggregate(F.reverse(scaled), F.lit(0.0), lambda a, v: a + v) * 16  # a sixteenth, since the first parts may exceed the sum
    return F.when(F.count(x) > 0, total)


def avg_int(x: Expr) -> Column:
    """Integer mean: 128-bit sum over the count, truncated toward zero; NULL over no values, an error for other types."""
    return F.call_function("div", F.sum(as_int(x).cast(T.DecimalType(38, 0))), F.count(_c(x)))


def count_distinct(x: Expr) -> Column:
    """Exact number of distinct values; NULLs don't count, floating values are an error."""
    return F.count_distinct(not_floating(x))


def min_(x: Expr) -> Column:
    return F.min(_c(x))


def max_(x: Expr) -> Column:
    return F.max(_c(x))
