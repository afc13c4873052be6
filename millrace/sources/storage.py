"""Columnar tables in Parquet: strict writes, projected reads, and what footers tell."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schema import TYPES, Field, TableSchema
from millrace.sources.files import list_files, read_bytes

#: Names of codecs and what Spark's writer calls them.
CODECS = {"none": "none", "lz4": "lz4_raw", "lz4_raw": "lz4_raw", "zstd": "zstd"}
#: Where a table's files keep what Spark's types can't say of a column.
_KEPT = "millrace"
#: Encodings a column can ask for. Parquet's writer decides between run lengths and bit packing by itself.
ENCODINGS = ("auto", "plain", "dictionary", "rle", "frame_of_reference", "bit_packing", "delta")
_INTEGERS = ("int16", "int32", "int64", "date", "timestamp")
_ALLOWED = {"dictionary": ("string",), "rle": (*_INTEGERS, "double", "bool", "char"), "frame_of_reference": _INTEGERS, "bit_packing": (*_INTEGERS, "bool"), "delta": _INTEGERS}


def write_table(df: DataFrame, path: str, schema: TableSchema, compression: str = "lz4", encodings: Mapping[str, str] | None = None, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write a table whose names and types must be the schema's; a NULL in a NOT NULL column stops the write.

    ``encodings`` steers single columns: ``plain`` turns the dictionary off, ``dictionary`` and ``rle`` on (the ids of a
    dictionary are run-length coded; booleans, which have none, get run lengths from format 2); ``delta``,
    ``frame_of_reference`` and ``bit_packing`` ask for Parquet's delta pages (format 2), which hold a block's least value
    and bit-packed residuals; ``bit_packing`` refuses negative values. Format 2 also turns strings without a dictionary
    into delta pages, which Spark's vectorised reader was seen to misread in uncompressed files, so it is refused for
    tables with strings and without a codec. The codec holds for the whole table. Statistics are always written, and
    the files keep the schema (see :func:`table_schema`).
    """
    have, want = [(f.name, f.dataType) for f in df.schema.fields], [(f.name, TYPES[f.type]) for f in schema.fields]
    if have != want:
        raise ValueError(f"the table has {have}, its schema {want}")
    if compression not in CODECS:
        raise ValueError(f"unknown codec {compression!r}: {', '.join(CODECS)}")
    columns = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        bad = lambda why: F.raise_error(F.lit(f"{why} in column {f.name}")).cast(TYPES[f.type])  # noqa: B023, E731
        if f.type == "char":
            c = F.when(F.octet_length(c) != 1, bad("more or less than one byte")).otherwise(c)
        if encodings and encodings.get(f.name) == "bit_packing" and f.type in ("int16", "int32", "int64"):
            c = F.when(c < 0, bad("a negative value")).otherwise(c)
        if not f.nullable and df.schema[f.name].nullable:
            c = F.coalesce(c, bad("NULL"))
        columns.append(c.alias(f.name, metadata={_KEPT: {"type": f.type, "nullable": f.nullable}}))
    checked = df.select(columns)
    w = checked.write.mode(mode).option("compression", CODECS[compression])
    for name, e in (encodings or {}).items():
        if e not in ENCODINGS:
            raise ValueError(f"unknown encoding {e!r}")
        if schema[name].type not in _ALLOWED.get(e, TYPES):
            raise ValueError(f"column {name!r}: {e} doesn't hold {schema[name].type}")
        if e != "auto":
            w = w.option(f"parquet.enable.dictionary#{name}", e in ("dictionary", "rle"))
        paged = e in ("delta", "frame_of_reference", "bit_packing") or e == "rle" and schema[name].type == "bool"
        if paged and compression == "none" and any(TYPES[f.type] == T.StringType() for f in schema.fields):
            raise ValueError(f"column {name!r}: {e} needs a codec in a table with strings")
        if paged:
            w = w.option("parquet.writer.version", "v2")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str | int] | None = None) -> DataFrame:
    """All columns, or some by name or place; an unknown one is an error. Only these are read from the files."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    names = []
    for c in columns:
        if isinstance(c, int) and not 0 <= c < len(df.columns):
            raise IndexError(f"no column {c}: the table has {len(df.columns)}")
        names.append(df.columns[c] if isinstance(c, int) else c)
        if names[-1] not in df.columns:
            raise KeyError(f"no column {names[-1]!r}")
    return df.select([F.col(f"`{n}`") for n in names])


def table_schema(df: DataFrame) -> TableSchema:
    """The schema a table was written with, NOT NULL and char included; of other files, what Spark sees."""
    fields = []
    for f in df.schema.fields:
        kept = f.metadata.get(_KEPT)
        fields.append(Field(f.name, kept["type"], kept["nullable"]) if kept else TableSchema.of_struct(T.StructType([f])).fields[0])
    return TableSchema(tuple(fields))


def _footers(spark: SparkSession, path: str) -> Iterator[tuple[str, pq.FileMetaData]]:
    """What each file's footer says; only the footers are read."""
    for name, size in list_files(spark, path, ".parquet"):
        length, magic = struct.unpack("<I4s", read_bytes(spark, name, size - 8, 8))
        if magic != b"PAR1":
            raise ValueError(f"{name}: no Parquet file")
        yield name, pq.read_metadata(io.BytesIO(b"PAR1" + read_bytes(spark, name, size - 8 - length, length + 8)))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows by the footers alone, read by the driver; of tables with very many files see :func:`count_rows`."""
    return sum(meta.num_rows for _, meta in _footers(spark, path))


def count_rows(spark: SparkSession, path: str, name: str = "count") -> DataFrame:
    """One row with the number of rows, which Spark's tasks take from the footers (by ``aggregatePushdown``)."""
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set(key, ",".join(x for x in before.split(",") if x != "parquet"))
    try:
        df = spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)
    return df.agg(F.count(F.lit(1)).alias(name))


@dataclass(frozen=True)
class ChunkStats:
    """Statistics of one column in one row group. NULL and NaN are left out of least and greatest."""

    file: str
    row_group: int
    column: str
    rows: int
    nulls: int | None
    low: object
    high: object
    encodings: tuple[str, ...]
    codec: str
    bytes: int


def table_stats(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> list[ChunkStats]:
    """What the footers say of each column chunk."""
    out = []
    for file, meta in _footers(spark, path):
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for i in range(group.num_columns):
                c = group.column(i)
                if columns is not None and c.path_in_schema not in columns:
                    continue
                s = c.statistics
                has = s is not None and s.has_min_max and s.min == s.min  # a chunk of NaN alone has none
                out.append(ChunkStats(file, g, c.path_in_schema, group.num_rows, s.null_count if s is not None and s.has_null_count else None, s.min if has else None, s.max if has else None, tuple(c.encodings), c.compression, c.total_compressed_size))
    return out
