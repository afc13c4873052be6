"""Repetition inside single documents, and thresholds that adapt to language and source."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import materialize
from millrace.llm.words import windows, word_hashes


def repetition(df: DataFrame, keep: Sequence[str], text: str = "text", n: int = 4) -> DataFrame:
    """``keep…, words, repeated, share``: the words of each document that lie in a repeated run of ``n`` words.

    A run is repeated if it occurs more than once in the document (overlaps count); ``share`` is ``repeated / words``, 0
    for a document without words (NULL and empty texts too). Texts go to Python by Arrow batch and are cut into word
    hashes there, about a megabyte at a time in a few vector operations; documents never meet others, so there is no
    shuffle. ``keep`` columns may hold anything but one of the result's names.
    """
    if {c.lower() for c in keep} & {"words", "repeated", "share"}:
        raise ValueError("words, repeated and share are names of the result")
    given = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    shape = ", ".join([*[f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(given.schema.fields[:-1])], "words long", "repeated long", "share double"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, found = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for first, flat, sizes in word_hashes(b.column(len(keep))):
                hit = np.concatenate([[0], np.cumsum(repeated_words(flat, sizes, n))])
                size[first : first + len(sizes)] = sizes
                found[first : first + len(sizes)] = np.diff(hit[np.concatenate([[0], np.cumsum(sizes)])])
            names = [*b.schema.names[:-1], "words", "repeated", "share"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(size), pa.array(found), pa.array(found / np.maximum(size, 1))], names)

    return given.mapInArrow(measure, shape).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def repeated_words(flat: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """For the words of several documents in a row: whether each lies in a run of ``n`` that its document repeats."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    hit = np.zeros(len(flat), bool)
    if len(flat) < n:
        return hit
    inside = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1])
    h = windows(flat, n)[inside] ^ ((doc[inside] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    again = inside[count[back] > 1]
    for k in range(n):
        hit[again + k] = True
    return hit


def language_key(lang):
    """A language label without case, spaces and region; ``und`` where it is missing."""
    label = F.regexp_extract(F.lower(F.trim(lang)), "^[a-z]+", 0)
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit("und")).otherwise(label)


def share_sketches(shares: DataFrame, groups: Sequence[str], share: str = "share", k: int = 1024) -> DataFrame:
    """``groups…, sketch``: a KLL quantile sketch of the share in each group.

    Its rank error is about 0.3 % for k = 1024, and 0 in groups of up to ``k`` documents. Sketches fill in part on the
    map side and merge, so a group with most documents is one row a task, and loads that were sketched apart join with
    ``kll_merge_agg_double``.
    """
    return shares.groupBy(*groups).agg(F.kll_sketch_agg_double(F.col(share), F.lit(k)).alias("sketch"))


def adaptive_thresholds(sketches: DataFrame, groups: Sequence[str], quantile: float = 0.95, least: int = 200, floor: float | None = None, ceiling: float | None = None) -> DataFrame:
    """``groups…, documents, threshold``: the share that a group's ``quantile`` reaches, steadied in small groups.

    The threshold of all documents is the quantile of their merged sketches. From there each level adds a column of
    ``groups``: n documents with the same values up to there weigh their own quantile by n and the threshold of the
    level above by ``least``. A small group so falls back on its first column, then on all, by degrees and without a
    step; a large one has its own quantile. Unless ``floor`` or ``ceiling`` are given, nothing else bounds a threshold.
    """
    if not groups:
        raise ValueError("thresholds need a column to group by")
    own, n = F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(quantile)), F.kll_sketch_get_n_double("sketch")
    merged = F.kll_merge_agg_double(F.col("sketch")).alias("sketch")
    out = F.broadcast(sketches.agg(merged).select(own.alias("above")))  # one row
    for k in range(1, len(groups) + 1):
        level = sketches.groupBy(*groups[:k]).agg(merged) if k < len(groups) else sketches
        named = {c: f"up_{c}" for c in groups[: k - 1]}
        upper = out.withColumnsRenamed(named)
        same = [F.col(c).eqNullSafe(F.col(u)) for c, u in named.items()]
        joined = level.join(upper, same) if same else level.join(upper)
        out = joined.select(*groups[:k], n.alias("documents"), (F.col("above") + (own - F.col("above")) * (n / (n + F.lit(float(least))))).alias("above"))
    limit = F.col("above")
    limit = limit if floor is None else F.greatest(F.lit(float(floor)), limit)
    limit = limit if ceiling is None else F.least(F.lit(float(ceiling)), limit)
    return out.select(*groups, "documents", limit.alias("threshold"))


_GROUPS = ("lang_key", "source_key")


def _measured(df: DataFrame, keep: Sequence[str], lang: str, source: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Shares with their groups, measured once and written, and the groups' sketches."""
    if {c.lower() for c in keep} & {*_GROUPS, "threshold"}:
        raise ValueError("lang_key, source_key and threshold are names of the result")
    given = df.withColumns({"lang_key": language_key(F.col(lang)), "source_key": F.coalesce(F.col(source), F.lit(""))})
    shares = materialize(repetition(given, [*keep, *_GROUPS], text, n))
    return shares, materialize(share_sketches(shares, _GROUPS))


def group_thresholds(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", n: int = 4, **limits) -> DataFrame:
    """``lang_key, source_key, documents, threshold`` of the documents' languages and sources."""
    return adaptive_thresholds(_measured(df, [], lang, source, text, n)[1], _GROUPS, **limits)


def flag_repetitive(df: DataFrame, keep: Sequence[str], lang: str = "lang", source: str = "source", text: str = "text", n: int = 4, **limits) -> DataFrame:
    """Documents that repeat anything and reach the threshold of their language and source.

    Columns: ``keep…, lang_key, source_key, words, repeated, share, threshold``. The shares are measured once and
    written; the thresholds come from sketches of them and are joined back. Whether that join is a broadcast is left to
    the sizes seen at run time, and a group with most documents is split there. A missing source is the group ``''``.
    ``limits`` go to :func:`adaptive_thresholds`. Empty input gives no rows.
    """
    shares, sketches = _measured(df, keep, lang, source, text, n)
    limit = adaptive_thresholds(sketches, _GROUPS, **limits).drop("documents")
    return shares.join(limit, [*_GROUPS]).filter((F.col("share") > 0) & (F.col("share") >= F.col("threshold"))).select(*keep, *_GROUPS, "words", "repeated", "share", "threshold")
