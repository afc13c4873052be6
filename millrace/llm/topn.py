"""The N highest-scoring items of every group, by one global sort."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lineage import materialize


def top_per_group(df: DataFrame, groups: Sequence[str], score: str, item: str, n: int, result: str = "position") -> DataFrame:
    """``groups…, item, score, position``: the rows at positions 1 to ``n`` of each group.

    Order: score descending (NULL last), then item ascending in byte order. Rows are range-partitioned and sorted over
    the whole cluster by group, score and item, so a group of any size spreads over as many partitions as it fills.
    Each partition is scanned once: it numbers the rows of its groups, hands on the first ``n`` of each (no others can
    stand among the first ``n`` of the whole group) and the counts of its first and last group, the only ones that may
    go on in a neighbour. Prefix sums of these counts, two rows a partition, turn numbers into exact positions.

    Rows with a NULL group or item are left out. Repeated rows keep their repeats, each with its own position. Groups of
    fewer than ``n`` rows come out whole; empty input gives no rows. Other columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be positive")
    gs = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(groups, gs)], F.col(f"`{item}`").alias("item"), F.col(f"`{score}`").alias("score")).dropna(subset=[*gs, "item"])
    order = [*[F.col(g).asc() for g in gs], F.col("score").desc_nulls_last(), F.col("item").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shape = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields], T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()), T.StructField("total", T.LongType())])
    parts = materialize(ordered.mapInArrow(_scan(len(gs), n), shape))
    before = Window.partitionBy(*gs).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.filter("total is not null").select(*gs, "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("skip"))
    placed = parts.filter("total is null").join(ends, [*gs, "part"], "left")
    position = F.col("local") + F.coalesce(F.col("skip"), F.lit(0))
    return placed.select(*[F.col(g).alias(c) for g, c in zip(gs, groups)], F.col("item").alias(item), F.col("score").alias(score), position.alias(result)).filter(F.col(result) <= n)


def _scan(width: int, n: int):
    """Number the rows of sorted partitions; ``total`` marks the rows with the counts of the first and last group."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen, first_open, names, kinds = None, 0, True, None, None

        def out(cols: list, local: list | np.ndarray, total: list) -> pa.RecordBatch:
            k = len(local)
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(k, part, np.int32)), pa.array(local, pa.int64()), pa.array(total, pa.int64())], [*names, "part", "local", "total"])

        def count(group: list) -> pa.RecordBatch:
            return out([*group, *[pa.nulls(1, t) for t in kinds[width:]]], [None], [seen])

        for b in batches:
            if not b.num_rows:
                continue
            names, kinds = b.schema.names, b.schema.types
            key, size = [b.column(i) for i in range(width)], b.num_rows
            cut = np.zeros(size, bool)
            for c in key:
                cut[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            goes_on = last is not None and all(a[0].as_py() == c[0].as_py() for a, c in zip(last, key))
            starts = np.flatnonzero(cut)
            if last is not None and not goes_on and first_open:
                yield count(last)
                first_open = False
            base = seen if goes_on else 0
            edge = np.concatenate([[0], starts])
            place = np.arange(size) - np.repeat(edge, np.diff(np.append(edge, size))) + 1
            place[: starts[0] if len(starts) else size] += base
            if len(starts) and first_open:
                seen = int(base + starts[0])
                yield count([c[:1] for c in key])
                first_open = False
            keep = np.flatnonzero(place <= n)
            if len(keep):
                taken = b.take(pa.array(keep))
                yield out(taken.columns, place[keep], [None] * len(keep))
            seen, last = int(place[-1]), [c[-1:] for c in key]
        if last is not None:
            yield count(last)

    return scan
