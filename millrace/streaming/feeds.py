"""Feeds: files or messages that keep arriving.

The operators with mergeable results (memberships, deduplicated messages, quantile sketches, counts) run on each batch alone
and leave one partial table a batch; a query merges what has arrived so far. Nothing is kept between batches but the stream's
own checkpoint, so a feed of any length needs the memory of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def drop_repeats(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first copy of each message, as long as its repeats arrive within ``delay`` of it in event time.

    State is dropped beyond the delay. Where repeats can come later, reduce batches by :func:`fold_batches` and merge them.

    No message is lost: one that arrives behind the watermark is sent on as well, unless a copy is still remembered, and
    is then remembered until the watermark has moved by ``delay``. A NULL key identifies nothing, so all rows with one
    are sent on, as by ``deduplicate``. Of copies in one batch the earliest by ``time`` is kept, without a time the last.

    Spark's stateful operators drop the rows whose marked event time is behind the watermark. Here rows pass the state
    packed, with the time as a plain number, and the mark that the operator asks for is on a NULL, which is never late.
    """
    taken = stream.columns
    marked = stream.withWatermark(time, delay)
    at = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    wait = F.unix_millis(F.timestamp_millis(F.lit(0)) + F.lit(delay).cast("interval"))
    cells = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(taken)]
    packed = marked.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), at.alias("at"), wait.alias("wait"), *cells)
    kind = packed.schema["k"].dataType.simpleString()
    shape = f"k {kind}, at long, wait long, row binary"
    never = F.lit(None).cast("timestamp").alias("never", metadata={"spark.watermarkDelayMs": 0})
    rows = packed.mapInArrow(_pack, shape).select("*", never).groupBy("k").applyInPandasWithState(_first, "row binary", "until long", "append", "EventTimeTimeout")
    fields = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(stream.schema.fields)])
    kept = rows.mapInArrow(_unpack, fields).select([F.col(f"c{i}").alias(c) for i, c in enumerate(taken)])
    return kept.unionByName(marked.filter(F.col(f"`{key}`").isNull()))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's columns as bytes, which keep every type as it is."""
    for b in batches:
        given = pa.RecordBatch.from_arrays(b.columns[3:], schema=pa.schema(list(b.schema)[3:]))
        packed = []
        for i in range(b.num_rows):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, given.schema) as w:
                w.write_batch(given.slice(i, 1))
            packed.append(out.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary())], ["k", "at", "wait", "row"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.column(0):
            yield from pa.ipc.open_stream(row.as_buffer())


def _first(key: tuple, frames: Iterator, state) -> Iterator:
    """The earliest row of a key that isn't remembered."""
    import pandas as pd

    if state.hasTimedOut:
        state.remove()
        return
    best, known = None, state.exists
    for f in frames:
        if not known:
            for at, wait, row in zip(f["at"], f["wait"], f["row"]):
                order = (at != at or at is None, at)
                if best is None or (order[0], 0 if order[0] else order[1]) < best[0]:
                    best = ((order[0], 0 if order[0] else order[1]), int(wait), row)
    if best is None:
        if known:  # a timeout holds for one call only
            state.setTimeoutTimestamp(max(state.get[0], state.getCurrentWatermarkMs() + 1))
        return
    mark = max(0, state.getCurrentWatermarkMs())
    until = max(mark, int(best[0][1]) // 1000) + best[1] + 1
    state.update((until,))
    state.setTimeoutTimestamp(until)
    yield pd.DataFrame({"row": [best[2]]})


def fold_batches(stream: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Reduce all input that is there, batch by batch, to one partial table each: ``path/batch=N``.

    A batch that is run again after a failure overwrites its own table, so each input row counts once. Read ``path`` and
    merge to get the result so far.
    """

    def write(batch: DataFrame, n: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
