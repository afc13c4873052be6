"""The most frequent values of columns with hundreds of millions of them, by combinatorial group testing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 64


@dataclass(frozen=True)
class Sketch:
    """Shape of the group-testing sketch: ``depth`` hash rows of ``width`` buckets (a power of two) with 65 counters.

    Its size is fixed: depth * width * 65 numbers for each column, whatever the number of rows or values.
    """

    depth: int = 4
    width: int = 512
    seed: int = 1
    _odd: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.width & (self.width - 1) or self.width < 2 or self.depth < 1:
            raise ValueError("width must be a power of two, depth positive")
        object.__setattr__(self, "_odd", np.random.default_rng(self.seed).integers(0, 2**63, self.depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1))

    @staticmethod
    def for_share(share: float, seed: int = 1, widen: int = 1) -> Sketch:
        """Four buckets and more for each value that can reach the share."""
        return Sketch(width=max(64, 2 ** int(np.ceil(np.log2(4 * widen / share)))), seed=seed)

    def bucket(self, row: int, h: np.ndarray) -> np.ndarray:
        mixed = h ^ (h >> np.uint64(29))
        return ((mixed * self._odd[row]) >> np.uint64(64 - (self.width.bit_length() - 1))).astype(np.int64)

    def add(self, counters: np.ndarray, h: np.ndarray) -> None:
        """Count hashes in ``counters[row, bucket, 0]`` (all) and ``[row, bucket, 1 + bit]`` (those with the bit set)."""
        values, counts = np.unique(h, return_counts=True)
        rows = [self.bucket(r, values) for r in range(self.depth)]
        for r in range(self.depth):
            counters[r, :, 0] += np.bincount(rows[r], counts, self.width).astype(np.int64)
        for bit in range(_BITS):
            on = (values >> np.uint64(bit)) & np.uint64(1) == 1
            c = counts[on]
            for r in range(self.depth):
                counters[r, :, 1 + bit] += np.bincount(rows[r][on], c, self.width).astype(np.int64)

    def decode(self, counters: np.ndarray, least: float) -> dict[int, int]:
        """Hashes that dominate a bucket, with the least count of their buckets (never below the true count)."""
        found: dict[int, int] = {}
        for r in range(self.depth):
            heavy = np.flatnonzero(counters[r, :, 0] >= max(1, least))
            bits = (counters[r, heavy, 1:] * 2 > counters[r, heavy, :1]).astype(np.uint64)
            h = (bits << np.arange(_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            h = h[self.bucket(r, h) == heavy]
            if not len(h):
                continue
            bound = np.min([counters[q, self.bucket(q, h), 0] for q in range(self.depth)], axis=0)
            found |= {int(x): int(b) for x, b in zip(h, bound) if b >= least}
        return found

    def bound(self, counters: np.ndarray, h: int) -> int:
        """The least count of a hash's buckets."""
        return int(min(counters[r, self.bucket(r, np.array([h], np.uint64))[0], 0] for r in range(self.depth)))

    def left(self, counters: np.ndarray, counted: Mapping[int, int]) -> np.ndarray:
        """Rows of each bucket, ``[row, bucket]``, that aren't counted yet."""
        h = np.array(list(counted), np.uint64)
        n = np.array(list(counted.values()), np.int64)
        return np.array([counters[r, :, 0] - (np.bincount(self.bucket(r, h), n, self.width).astype(np.int64) if len(h) else 0) for r in range(self.depth)])

    def complete(self, counters: np.ndarray, counted: Mapping[int, int], least: float) -> bool:
        """Whether no other value can have ``least`` rows: in some hash row no bucket has as many left."""
        return bool((self.left(counters, counted).max(axis=1) < least).any())


def _sketched(df: DataFrame, fields: list[str], sketch: Sketch) -> np.ndarray:
    """Sketches of hash columns, added up over all partitions: ``[field, row, bucket, counter]``.

    A task sends a sketch however little it read, so splits are read several to a task where there are far more of them
    than cores and shuffle partitions.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((len(fields), sketch.depth, sketch.width, 1 + _BITS), np.int64)
        for b in batches:
            for i in range(len(fields)):
                h = b.column(i).drop_null().to_numpy(zero_copy_only=False).view(np.uint64)
                if len(h):
                    sketch.add(counters[i], h)
        flat = counters.reshape(-1, 1 + _BITS)
        used = np.flatnonzero(flat[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(flat[used, k]) for k in range(1 + _BITS)]], ["slot", *[f"c{k}" for k in range(1 + _BITS)]])

    parts = df.coalesce(tasks).mapInArrow(fill, "slot long, " + ", ".join(f"c{k} long" for k in range(1 + _BITS)))
    total = parts.groupBy("slot").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(1 + _BITS)])
    out = np.zeros((len(fields) * sketch.depth * sketch.width, 1 + _BITS), np.int64)
    table = total.toArrow()  # at most one row for each slot of the fixed-size sketch
    out[table.column(0).to_numpy()] = np.column_stack([table.column(k + 1).to_numpy() for k in range(1 + _BITS)])
    return out.reshape(len(fields), sketch.depth, sketch.width, 1 + _BITS)


def frequent_items(df: DataFrame, columns: list[str], share: float = 0.01, sketch: Sketch | None = None, attempts: int = 4) -> DataFrame:
    """``item_field, item, n_rows, estimate``: the values with at least ``share`` of a column's rows.

    Rows where the column is NULL or ``''`` don't count, in the share neither. Values are told apart by a 64-bit hash.
    First pass: every task fills a sketch of fixed size; sketches add up, and buckets that one value dominates spell its
    hash in their bit counters. Second pass: rows whose hash was decoded are counted by their exact value (a hot value
    is reduced on the map side), so ``n_rows`` is exact; ``estimate`` is the sketch's bound, never below it and seldom
    more than a quarter of ``share`` of the rows above.

    The result is proven whole: what the exact counts leave in the buckets must stay below the threshold in some hash
    row. If it doesn't (two frequent values met in every row), a wider sketch with other hashes is tried. Columns for
    which ``attempts`` of them don't do (some hundred values of about the same count) are finished exactly: rows in
    buckets that still hold as many in every hash row are counted by their value. Only a ``sketch`` of the caller's own
    bounds the work, and raises an error then; nothing is left out in silence. Empty input gives no rows.
    """
    spark = df.sparkSession
    value = lambda c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`").cast("string"))
    hashed = df.select(*[F.when(value(c).isNotNull(), F.xxhash64(value(c))).alias(f"h{i}") for i, c in enumerate(columns)])
    schema = "item_field string, item string, n_rows long, estimate long"
    for attempt in range(attempts):
        shape = sketch or Sketch.for_share(share)
        shape = Sketch(shape.depth, shape.width << attempt, shape.seed + attempt)
        counters = _sketched(hashed, columns, shape)
        totals = counters[:, 0, :, 0].sum(axis=1)
        bounds = [shape.decode(counters[i], share * totals[i]) for i in range(len(columns))]
        rows = _verified(df, columns, value, bounds)
        counted = [{h: n for j, _, n, h in rows if j == i} for i in range(len(columns))]
        open_ = [i for i in range(len(columns)) if totals[i] and not shape.complete(counters[i], counted[i], share * totals[i])]
        if not open_:
            break
    else:
        if sketch:
            raise RuntimeError("frequent values met in all hash rows: pass a sketch with more rows or buckets")
        for i in open_:
            rest = _rest(df, value(columns[i]), shape, shape.left(counters[i], counted[i]) >= share * totals[i], counted[i], share * totals[i])
            rows += [(i, v, n, h) for v, n, h in rest]
            bounds[i] |= {h: shape.bound(counters[i], h) for _, _, h in rest}
    return spark.createDataFrame([(columns[j], v, n, bounds[j][h]) for j, v, n, h in rows if n >= share * totals[j]], schema)


def _verified(df: DataFrame, columns: list[str], value, bounds: list[dict[int, int]]) -> list[tuple[int, str, int, int]]:
    """Exact counts of the decoded candidates, at most depth * width a column: place, value, rows, hash."""
    picks: list[Column] = []
    for i, c in enumerate(columns):
        signed = [int(np.uint64(h).astype(np.int64)) for h in bounds[i]]
        if signed:
            v = value(c)
            picks.append(F.when(F.xxhash64(v).isin(signed), F.struct(F.lit(i).alias("place"), v.alias("item"))))
    if not picks:
        return []
    found = df.select(F.explode(F.array_compact(F.array(*picks))).alias("x")).groupBy("x.place", "x.item").agg(F.count(F.lit(1)).alias("n"), F.xxhash64(F.col("x.item")).alias("h"))
    return [(r.place, r.item, r.n, int(np.int64(r.h).astype(np.uint64))) for r in found.collect()]


def _rest(df: DataFrame, value: Column, sketch: Sketch, full: np.ndarray, counted: Mapping[int, int], least: float) -> list[tuple[str, int, int]]:
    """Values with ``least`` rows whose hash isn't counted and whose buckets are full in every hash row: value, rows, hash.

    Only hashes go to Python. Equal values are reduced on the map side, and at most 1 / share of them reach the driver.
    """
    known = np.array(list(counted), np.uint64)

    @F.arrow_udf("boolean")
    def open_(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array(np.logical_and.reduce([full[r, sketch.bucket(r, h)] for r in range(sketch.depth)]) & ~np.isin(h, known))

    there = df.select(value.alias("item")).filter(F.col("item").isNotNull()).withColumn("h", F.xxhash64("item"))
    found = there.filter(open_("h")).groupBy("item", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= float(least))
    return [(r.item, r.n, int(np.int64(r.h).astype(np.uint64))) for r in found.collect()]
