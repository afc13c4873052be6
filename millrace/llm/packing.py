"""Filling containers of fixed capacity, by swap-based local search."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import discard, materialize


def next_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The first assignment, which the search then improves: a container opens when an item doesn't fit into the last."""
    out, k, fill = np.empty(len(sizes), np.int64), 0, 0
    for i, s in enumerate(sizes.tolist()):
        if fill + s > capacity:
            k, fill = k + 1, 0
        out[i], fill = k, fill + s
    return out


def improve(sizes: np.ndarray, bins: np.ndarray, capacity: int, full: float = 0.99) -> np.ndarray:
    """Local search from a given assignment; returns the containers of the items, numbered as before, some now empty.

    The emptiest container that is under ``full`` gives documents away until it is empty or stuck: a document moves to
    a container where it fits; or it is exchanged for a smaller one; or two of its documents are exchanged for one
    smaller than both together. Of all exchanges of a kind the one is taken that carries over most (of equals, the one
    that leaves least room). The receiver ends up fuller than the giver was, so the sum of squared fills grows with
    each step, which also bounds the search: it ends where no step of the three kinds is left in any underfull
    container that changed since it was last tried.
    """
    bins = bins.copy()
    count = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, sizes, count).astype(np.int64)
    number = np.bincount(bins, minlength=count)
    members: list[set[int]] = [set() for _ in range(count)]
    for i, b in enumerate(bins.tolist()):
        members[b].add(i)
    stuck = np.zeros(count, bool)
    limit = capacity * full

    def put(i: int, to: int) -> None:
        at = int(bins[i])
        members[at].discard(i)
        members[to].add(i)
        fill[at] -= sizes[i]
        fill[to] += sizes[i]
        number[at] -= 1
        number[to] += 1
        bins[i] = to

    def partner(amounts: np.ndarray, base: np.ndarray, room: np.ndarray) -> tuple[int, int] | None:
        """Where, and which of the sorted amounts, so that ``amount - base`` is greatest within ``0 < … <= room``."""
        k = np.searchsorted(amounts, base + room, "right") - 1
        gain = np.where(k >= 0, amounts[k] - base, -1)
        gain[room < 0] = -1
        most = int(gain.max()) if len(gain) else 0
        if most <= 0:
            return None
        ties = np.flatnonzero(gain == most)
        at = int(ties[np.argmin(room[ties])])
        return at, int(k[at])

    while True:
        open_ = np.flatnonzero((fill > 0) & (fill < limit) & ~stuck)
        if not len(open_):
            return bins
        giver = int(open_[np.argmin(fill[open_])])
        own = np.array(sorted(members[giver], key=lambda i: (sizes[i], i)))
        own = own[sizes[own] > 0]
        mine = sizes[own]
        room = capacity - fill
        room[(number == 0) | (fill < fill[giver])] = -1  # containers that are emptier are stuck, or have been emptied
        room[giver] = -1
        step = partner(mine, np.zeros(count, np.int64), room)
        if step:
            to, k = step
            put(int(own[k]), to)
            stuck[to] = stuck[giver] = False
            continue
        there = room[bins]
        step = partner(mine, sizes, there)
        if step:
            back, k = step
            to = int(bins[back])
            put(int(own[k]), to)
            put(back, giver)
            stuck[to] = stuck[giver] = False
            continue
        if len(own) > 1:  # pairs of sizes: a container holds few different ones, however many items
            size, first, count_ = np.unique(mine, return_index=True, return_counts=True)
            a, b = np.triu_indices(len(size))
            usable = (a != b) | (count_[a] > 1)
            a, b = a[usable], b[usable]
            sums, pair = np.unique(size[a] + size[b], return_index=True)
            step = partner(sums, sizes, there)
            if step:
                back, k = step
                to, x, y = int(bins[back]), int(a[pair[k]]), int(b[pair[k]])
                put(int(own[first[x]]), to)
                put(int(own[first[y] + (x == y)]), to)
                put(back, giver)
                stuck[to] = stuck[giver] = False
                continue
        stuck[giver] = True


#: Copies of one item that travel as one row.
_COPIES = 64


def _pack_shard(capacity: int, full: float):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        if "bin" not in table.column_names:  # first round: the rows in an order of their own, each copy an item
            order = np.lexsort([np.arange(table.num_rows), *(table.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "size", "part", "digest"))])
            copies = table.column("copies").to_numpy()[order]
            table = table.take(pa.array(np.repeat(order, copies))).drop_columns(["copies", "part", "digest", "shard"])
            sizes = table.column("size").to_numpy()
            start = next_fit(sizes, capacity)
            name = np.int64(key[0].as_py()) << np.int64(24)
            bins = np.unique(improve(sizes, start, capacity, full), return_inverse=True)[1]
            return table.append_column("opened", pa.array(name + start)).append_column("bin", pa.array(name + bins))
        names, local = np.unique(table.column("bin").to_numpy(), return_inverse=True)
        order = np.lexsort([table.column(c).to_numpy() for c in ("opened", "piece", "size")] + [local])  # by container, whatever the order of arrival
        table, local = table.take(pa.array(order)), local[order]
        bins = names[improve(table.column("size").to_numpy(), local.astype(np.int64), capacity, full)]
        return table.set_column(table.schema.get_field_index("bin"), "bin", pa.array(bins, pa.int64())).drop_columns(["shard"])

    return pack


def pack(items: DataFrame, item_id: str, size: str, capacity: int = 2048, shard_items: int = 4096, full: float = 0.99) -> DataFrame:
    """``item_id, piece, start, length, container, opened``: every item in a container, none above ``capacity``.

    An item larger than a container is cut into full containers and a rest, which is packed like other items; no other
    item is cut. ``start`` is where the piece begins in its item. Items of size 0 (or NULL) lie in some container and
    take no room. Ids may repeat or be NULL; each row is an item. Empty input gives no rows.

    Items are dealt by a hash of their content to shards of about ``shard_items``, whatever their number. In each shard
    the next-fit assignment (``opened``) is the start of the local search (:func:`improve`), whose result is
    ``container``. What is left underfull in all shards is dealt to new shards, whole containers together, and searched
    again, until one shard took it all or a round emptied no container; so the space lost at the shards' borders shrinks
    with each round while no task ever sees more than a shard. The result doesn't depend on the layout of the input.
    Equal items travel as rows of at most 64 copies, each dealt for itself, so even a third of all rows being equal
    fills no shard above the others.
    """
    if capacity < 1 or shard_items < 2 or shard_items >= 1 << 24:
        raise ValueError("capacity and shard_items must be positive, shard_items below 2^24")
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    grouped = items.select(F.col(item_id).alias("id"), n.alias("n")).groupBy("id", "n").agg(F.count(F.lit(1)).alias("all"))
    thousands = F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / (_COPIES * 1024)))
    coarse = grouped.withColumn("k", F.explode(thousands)).withColumn("left", F.least(F.col("all") - F.col("k") * _COPIES * 1024, F.lit(_COPIES * 1024)))
    fine = coarse.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("left") - 1) / _COPIES))))
    fine = fine.select("id", "n", F.least(F.col("left") - F.col("j") * _COPIES, F.lit(_COPIES)).alias("copies"), (F.col("k") * 1024 + F.col("j")).alias("part"))
    last = F.greatest(F.ceil(F.col("n") / capacity).cast("long"), F.lit(1)) - 1
    pieces = fine.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * capacity
    table = pieces.select("id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).alias("size"), "copies", "part", F.xxhash64("id", "n", "piece", "part").alias("digest"))
    current = materialize(table)
    id_type = current.schema["id"].dataType.simpleString()
    shape = f"id {id_type}, piece long, start long, size long, opened long, bin long"
    done: list[DataFrame] = []
    total = current.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    by, bins = F.col("digest"), None
    for r in itertools.count():
        shards = max(1, -(-total // shard_items))
        dealt = current.withColumn("shard", F.pmod(by, F.lit(shards)))
        packed = materialize(dealt.groupBy("shard").applyInArrow(_pack_shard(capacity, full), shape))
        discard(current)
        if shards == 1:
            done.append(packed)
            break
        under = materialize(packed.groupBy("bin").agg(F.sum("size").alias("fill"), F.count(F.lit(1)).alias("n")).filter(F.col("fill") < capacity * full))
        left = under.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if left[0] == 0 or bins is not None and left[0] >= bins:
            done.append(packed)
            break
        bins, total = left
        done.append(packed.join(under, "bin", "left_anti").select(*packed.columns))
        current = materialize(packed.join(under.select("bin"), "bin").select(*packed.columns))
        by = F.xxhash64(F.lit(r), F.col("bin"))
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select(F.col("id").alias(item_id), "piece", "start", F.col("size").alias("length"), F.col("bin").alias("container"), "opened")


def containers(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``container, pieces, used, free``: one row a container."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("used")).withColumn("free", F.lit(capacity) - F.col("used"))


def gain(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row ``opened, used, least``: containers of the first assignment, after the search, and the least possible."""
    count = lambda c: packed.select(c).distinct().agg(F.count(F.lit(1)).alias(c))
    least = packed.agg(F.ceil(F.coalesce(F.sum("length"), F.lit(0)) / capacity).cast("long").alias("least"))
    return count("opened").join(count("container").withColumnRenamed("container", "used")).join(least).select("opened", "used", "least")
