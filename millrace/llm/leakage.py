"""Evaluation passages inside a corpus, by greedy string tiling."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.lineage import materialize
from millrace.llm.words import Roller, windows, word_hashes

SEED = 5
_FILLER = np.array([0x5851F42D4C957F2D], np.uint64)  # a hash that no word is likely to have
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class SeedFilter:
    """The seeds of all items as a Bloom filter of three bits: 64 bits a seed, 64 MB at most.

    It never denies a seed. Beyond eight million seeds it takes more other runs for seeds (about 5 % at eighty million),
    which only lets more of the corpus through to the tiling.
    """

    def __init__(self, seeds: int) -> None:
        self.shift = np.uint64(64 - min(29, max(13, int(seeds * 64).bit_length())))
        self.bits = np.zeros(1 << (64 - int(self.shift) - 3), np.uint8)
        self.lengths: set[int] = set()

    def _places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _ in range(3):
            at = h >> self.shift
            yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))
            h = (h ^ (h >> np.uint64(31))) * _MIX

    def add(self, items: list[np.ndarray]) -> None:
        size = np.array([len(v) for v in items], np.int64)
        flat = np.concatenate(items) if items else np.empty(0, np.uint64)
        begin = np.cumsum(size) - size
        for n in set(np.minimum(size, SEED).tolist()) - {0}:
            of = size >= SEED if n == SEED else size == n
            places = np.repeat(begin[of] - np.cumsum(size[of] - n + 1) + size[of] - n + 1, size[of] - n + 1) + np.arange((size[of] - n + 1).sum())
            self.lengths.add(n)
            for at, bit in self._places(windows(flat, n)[places]):
                np.bitwise_or.at(self.bits, at, bit)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` of what may be seeds. A bit is looked up only where those before it are set."""
        left = np.arange(len(h))
        for k in range(3):
            at = h >> self.shift
            hit = np.flatnonzero((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            left, h = left[hit], h[hit]
            h = (h ^ (h >> np.uint64(31))) * _MIX
        return left


class Index:
    """Evaluation items of one block, by the hashes of their runs of ``SEED`` words; shorter items by their whole.

    A document shares enough with an item only if at least ``needed`` of the item's places hold a seed of it. So an item
    is entered under all but the ``needed - 1`` seeds that most items of the block have: one of the others is in every
    such document, and a passage common to all items leads to none of them.
    """

    def __init__(self, items: list[np.ndarray], run: int = 13, coverage: float = 0.5) -> None:
        self.items = items
        self.sizes = np.array([len(v) for v in items], np.int64)
        self.needed = np.minimum(run - SEED + 1, np.maximum(1, np.ceil(coverage * self.sizes / SEED))).astype(np.int64)
        runs = [windows(v, SEED) for v in items]
        flat = np.concatenate(runs) if runs else np.empty(0, np.uint64)
        self.hashes, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        self.of_item = np.split(place, np.cumsum([len(r) for r in runs])[:-1]) if runs else []
        kept = [np.unique(p[np.argsort(-count[p], kind="stable")][n - 1 :]) for p, n in zip(self.of_item, self.needed.tolist())]
        where = np.repeat(np.arange(len(items)), [len(k) for k in kept])
        seed = np.concatenate(kept) if kept else np.empty(0, np.int64)
        order = np.argsort(seed, kind="stable")
        self.owner, self.start = where[order], np.searchsorted(seed[order], np.arange(len(self.hashes) + 1))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in set(self.sizes[(self.sizes > 0) & (self.sizes < SEED)].tolist()):
            of = np.flatnonzero(self.sizes == n)
            h = np.array([windows(items[i], n)[0] for i in of.tolist()], np.uint64)
            order = np.argsort(h, kind="stable")
            self.short[n] = h[order], of[order]

    def seeds(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that hold a seed, and the seed's number."""
        if not len(self.hashes) or not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        return hit, at[hit]

    def candidates(self, seeds: np.ndarray) -> list[int]:
        """Items with enough places among the distinct seeds of a document."""
        a, b = self.start[seeds], self.start[seeds + 1]
        size = b - a
        places = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return [i for i in np.unique(self.owner[places]).tolist() if np.isin(self.of_item[i], seeds).sum() >= self.needed[i]]

    def whole(self, doc: np.ndarray) -> Iterator[int]:
        """Items shorter than a seed that stand in a document."""
        for n, (h, of) in self.short.items():
            there = np.unique(windows(doc, n))
            yield from of[np.isin(h, there)].tolist()


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(place in doc, place in item, length)``, no word of either in two tiles, longest first.

    Each round finds the greatest length at which the unmarked runs of both share a Karp-Rabin hash (by bisection: a
    shared run contains shared runs of every smaller length), marks runs of that length from left to right, and goes
    on until nothing of ``least`` words is left. Equal runs are compared before they count.
    """
    d, t = Roller(doc), Roller(item)
    free_d, free_t = np.ones(len(doc), bool), np.ones(len(item), bool)

    def open_runs(r: Roller, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        h = r.of(n)
        taken = np.concatenate([[0], np.cumsum(~free)])
        ok = np.flatnonzero(taken[n:] == taken[: len(taken) - n]) if len(h) else np.empty(0, np.int64)
        return ok, h[ok]

    def shared(n: int) -> bool:
        return bool(np.isin(open_runs(t, free_t, n)[1], open_runs(d, free_d, n)[1]).any())

    tiles: list[tuple[int, int, int]] = []
    high = min(len(doc), len(item))
    while high >= least and shared(least):
        low, top = least, high
        while low < top:
            mid = (low + top + 1) // 2
            low, top = (mid, top) if shared(mid) else (low, mid - 1)
        high = low
        at_t, h_t = open_runs(t, free_t, low)
        at_d, h_d = open_runs(d, free_d, low)
        order = np.argsort(h_d, kind="stable")
        h_d, at_d = h_d[order], at_d[order]
        first, end = np.searchsorted(h_d, h_t), np.searchsorted(h_d, h_t, "right")
        next_free: dict[int, int] = {}
        marked = False
        for p, a, b in zip(at_t.tolist(), first.tolist(), end.tolist()):
            if a == b or not free_t[p : p + low].all():
                continue
            k = next_free.get(a, a)
            while k < b and not free_d[at_d[k] : at_d[k] + low].all():
                k += 1
            next_free[a] = k
            if k < b and (doc[at_d[k] : at_d[k] + low] == item[p : p + low]).all():
                q = int(at_d[k])
                free_d[q : q + low] = free_t[p : p + low] = False
                tiles.append((q, p, low))
                marked = True
        if not marked:
            high = low - 1
    return tiles


def matched_parts(doc: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The words of a document that lie in a run of ``SEED`` words from one of the sorted ``places``, parted by a filler.

    If these are all places where an item's seeds stand, every tile of both texts lies whole in one part, so a long
    document is tiled at the cost of what it shares with the item.
    """
    breaks = np.flatnonzero(np.diff(places) > SEED) + 1
    starts, ends = places[np.append(0, breaks)], places[np.append(breaks - 1, len(places) - 1)] + SEED
    parts = [x for a, b in zip(starts, ends) for x in (doc[a:b], _FILLER)]
    return np.concatenate(parts[:-1])


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", run: int = 13, coverage: float = 0.5, block_words: int = 2_000_000) -> DataFrame:
    """``doc_id, item_id, longest, tiles, matched, item_words, coverage``: the items that leaked into each document.

    A pair is reported if the texts share ``run`` consecutive words, or if tiles of at least ``SEED`` words cover the
    share ``coverage`` of the item's words in any order. An item of fewer words than a seed is one tile, or none.

    The corpus is read once, whatever the number of items: a filter of all their seeds (bounded, see :class:`SeedFilter`)
    is broadcast, and of each document only the runs that may be seeds go on, into a written table that is as small as
    what the texts share. That table passes blocks of at most ``block_words`` words of items (16 MB of hashes, or one
    longer item), one after the other, each broadcast and indexed once a worker. A pair is tiled only if enough of the
    item's places are seeds for one of the two conditions to hold, which drops no case.

    NULL and empty texts share nothing. Rows with a NULL id count like others; repeated documents are each reported;
    ids of items that occur twice are reported for each occurrence. Empty tables give no rows.
    """
    if run < SEED:
        raise ValueError(f"run must be at least {SEED}")
    spark = documents.sparkSession
    kind, doc_kind = items.schema[item_id].dataType.simpleString(), documents.schema[doc_id].dataType.simpleString()
    cut = items.select(F.col(item_id).alias("id"), F.col(text).alias("t")).mapInArrow(_hashed, f"id {kind}, w array<bigint>")
    hashed = materialize(cut.withColumn("row", F.monotonically_increasing_id()))
    schema = f"doc {doc_kind}, id {kind}, longest long, tiles long, matched long, item_words long, coverage double"
    known = SeedFilter(hashed.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0])
    blocks = dict(_blocks(hashed, block_words))
    for block in blocks.values():
        known.add(_fetched(block)[1])
    if not blocks:
        return spark.createDataFrame([], schema).withColumnsRenamed({"doc": doc_id, "id": item_id})
    seeds = spark.sparkContext.broadcast(known)
    given = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))
    shared = materialize(given.mapInArrow(_matching(seeds), f"doc {doc_kind}, w array<bigint>"))
    seeds.destroy()
    done: list[DataFrame] = []
    pending, run_id = None, uuid.uuid4().hex
    for number, block in blocks.items():
        if pending is not None:  # more blocks follow: finish one before the next is fetched
            done.append(materialize(pending[0]))
            pending[1].destroy()
        held = spark.sparkContext.broadcast((f"{run_id}-{number}", *_fetched(block)))
        pending = shared.mapInArrow(_tiler(held, run, coverage), schema), held
    done.append(pending[0])
    return functools.reduce(DataFrame.unionByName, done).withColumnsRenamed({"doc": doc_id, "id": item_id})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with words, as lists of hashes."""
    for b in batches:
        for first, flat, sizes in word_hashes(b.column(1)):
            ids = b.column(0).slice(first, len(sizes)).filter(pa.array(sizes > 0))
            yield pa.RecordBatch.from_arrays([ids, _lists(flat, sizes[sizes > 0])], ["id", "w"])


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat.view(np.int64)))


def _matching(shared):
    """Of each document the runs that may be seeds, with the words around them left out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: SeedFilter = shared.value
        for b in batches:
            for first, flat, sizes in word_hashes(b.column(1)):
                ends = np.cumsum(sizes)
                inside = np.zeros(len(flat) + 1, np.int64)  # +1 where a run begins, -1 behind its end
                for n in known.lengths:
                    at = known.holds(windows(flat, n))
                    at = at[at + n <= ends[np.searchsorted(ends, at, "right")]]
                    np.add.at(inside, at, 1)
                    np.add.at(inside, at + n, -1)
                kept = np.flatnonzero(np.cumsum(inside)[:-1])
                if not len(kept):
                    continue
                doc = np.searchsorted(ends, kept, "right")
                parts = np.flatnonzero((np.diff(kept) > 1) & (np.diff(doc) == 0)) + 1  # a filler between parts of a document
                words, doc = np.insert(flat[kept], parts, _FILLER), np.insert(doc, parts, doc[parts])
                docs, size = np.unique(doc, return_counts=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + docs)), _lists(words, size)], ["doc", "w"])

    return scan


def _blocks(hashed: DataFrame, block_words: int) -> Iterator[tuple[int, DataFrame]]:
    """Items in blocks of bounded size, each in a folder of its own."""
    parts = hashed.select("row", F.shiftright("row", 33).alias("part"), F.size("w").cast("long").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each written file
    starts = totals.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("row")), F.lit(0))
    block = F.floor((F.col("start") + F.col("inner")) / block_words).alias("block")
    keys = parts.withColumn("inner", inner).join(starts, "part").select("row", block)
    table = materialize(hashed.join(keys, "row").repartition("block").select("id", "w", "block"), "block")
    for r in table.select("block").distinct().orderBy("block").toLocalIterator():
        yield r.block, table.filter(F.col("block") == r.block).select("id", "w")


def _fetched(block: DataFrame) -> tuple[pa.Array, list[np.ndarray]]:
    """The ids and word hashes of one block."""
    table = block.toArrow()
    ids, lists = table.column("id").combine_chunks(), table.column("w").combine_chunks()
    flat, size = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False)
    return ids, np.split(flat, np.cumsum(size)[:-1])


_indexed: dict[str, Index] = {}


def _tiler(shared, run: int, coverage: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, items = shared.value
        if name not in _indexed:  # once a worker; only the block at hand is kept
            _indexed.clear()
            _indexed[name] = Index(items, run, coverage)
        index = _indexed[name]
        for b in batches:
            w = b.column(1)
            ends = np.concatenate([[0], np.cumsum(w.value_lengths().to_numpy(zero_copy_only=False))])
            flat = w.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit, seed = index.seeds(windows(flat, SEED))
            doc = np.searchsorted(ends, hit, "right") - 1
            inside = hit + SEED <= ends[doc + 1]
            hit, doc, seed = hit[inside], doc[inside], seed[inside]
            cut = np.searchsorted(doc, np.arange(len(ends)))
            rows: list[tuple] = []
            for d in np.unique(doc).tolist():
                places, seeds = hit[cut[d] : cut[d + 1]], seed[cut[d] : cut[d + 1]]
                for i in index.candidates(np.unique(seeds)):
                    tiles = tile(matched_parts(flat, places[np.isin(seeds, index.of_item[i])]), items[i], SEED)
                    longest, matched = max((n for *_, n in tiles), default=0), sum(n for *_, n in tiles)
                    if longest >= run or matched >= coverage * index.sizes[i]:
                        rows.append((d, i, longest, len(tiles), matched, int(index.sizes[i]), matched / index.sizes[i]))
            if index.short and coverage <= 1:
                for d in range(b.num_rows):
                    rows += [(d, i, n, 1, n, n, 1.0) for i in index.whole(flat[ends[d] : ends[d + 1]]) for n in [int(index.sizes[i])]]
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0])), ids.take(pa.array(c[1])), *[pa.array(x, pa.int64()) for x in c[2:6]], pa.array(c[6], pa.float64())], ["doc", "id", "longest", "tiles", "matched", "item_words", "coverage"])

    return scan
