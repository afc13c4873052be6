"""Sessions: series of events of one user without a long pause."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expr import Expr, _c, wall_seconds
from millrace.lineage import materialize


def sessionize(df: DataFrame, user: str = "userid", time: Expr = "eventtime", gap: int = 1800) -> DataFrame:
    """Sessions of each user: ``user, session_start, session_end, duration, events``, times in seconds as stored.

    An event belongs to the session of the one before it if it follows within ``gap`` seconds, that bound included.

    The events are sorted by user and time over the whole cluster (range partitions, so a user with a third of all
    events spreads over many of them) and each partition is scanned once, with the open session as its only state. A
    partition's first and last sessions may go on in its neighbours; these two a partition are merged afterwards.
    The place of an event in the input is the last sort key of the range partitions, so a single instant with very many
    events spreads too.

    Rows with a NULL user or time have no place in a session and are left out. Fractions of seconds are cut off. Empty
    input gives no rows; ties and repeated rows all count as events. Other columns are ignored.
    """
    kind = df.select(F.col(user).alias("u")).schema[0].dataType
    events = df.select(F.col(user).alias("u"), wall_seconds(time).alias("t")).dropna().withColumn("place", F.monotonically_increasing_id())
    ordered = events.repartitionByRange("u", "t", "place").select("u", "t").sortWithinPartitions("u", "t")
    shape = T.StructType([T.StructField("u", kind), *(T.StructField(c, T.LongType()) for c in ("s", "e", "n")), T.StructField("edge", T.BooleanType())])
    parts = materialize(ordered.mapInArrow(_scan(gap), shape))
    by_user = Window.partitionBy("u").orderBy("s", "e")
    edges = parts.filter("edge").withColumn("fresh", F.coalesce(F.col("s") - F.lag("e").over(by_user) > gap, F.lit(True)).cast("int"))
    merged = (
        edges.withColumn("k", F.sum("fresh").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("u", "k")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"))
    )
    out = parts.filter("not edge").select("u", "s", "e", "n").union(merged.select("u", "s", "e", "n"))
    return out.select(F.col("u").alias(user), F.col("s").alias("session_start"), F.col("e").alias("session_end"), (F.col("e") - F.col("s")).alias("duration"), F.col("n").alias("events"))


def _scan(gap: int):
    """One pass over rows sorted by user and time; holds the open session and one batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, first = None, True

        def out(u: pa.Array, s, e, n, edge) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([u, pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(n, pa.int64()), pa.array(edge, pa.bool_())], ["u", "s", "e", "n", "edge"])

        for b in batches:
            if not b.num_rows:
                continue
            u, t = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            cut = np.ones(len(t), bool)
            cut[1:] = pc.not_equal(u[1:], u[:-1]).to_numpy(zero_copy_only=False) | (np.diff(t) > gap)
            at = np.flatnonzero(cut)
            start, end, total = t[at].copy(), t[np.append(at[1:], len(t)) - 1], np.diff(np.append(at, len(t)))
            who = u.take(pa.array(at))
            if open_ is not None:
                ou, os_, oe, on = open_
                if ou[0].as_py() == who[0].as_py() and start[0] - oe <= gap:
                    start[0], total[0] = os_, total[0] + on
                else:
                    who, start, end, total = pa.concat_arrays([ou, who]), np.append(os_, start), np.append(oe, end), np.append(on, total)
            open_ = (who[-1:], start[-1], end[-1], total[-1])
            if len(start) > 1:
                edge = np.zeros(len(start) - 1, bool)
                edge[0], first = first, False
                yield out(who[:-1], start[:-1], end[:-1], total[:-1], edge)
        if open_ is not None:
            yield out(open_[0], [open_[1]], [open_[2]], [open_[3]], [True])

    return scan
