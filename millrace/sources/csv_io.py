"""Delimited text with an explicit schema, read strictly: a record that doesn't fit stops the read.

For input that may hold broken records see :mod:`millrace.operators.rejects`, which sets them apart instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schema import Field, TableSchema

_LF, _CR = 10, 13
#: Bytes of text that are cut at a time.
_PIECE = 1 << 19
#: What a split of a file sends besides whole records: the end of one begun before, the beginning of one, the middle.
_END, _BEGIN, _MIDDLE = 1, 2, 3


def read_csv(spark: SparkSession, path: str | list[str], schema: TableSchema, delimiter: str = ",", quote: str = '"', header: bool = False, multi_line: bool = True) -> DataFrame:
    """Typed rows of delimited text, whatever it holds: carriage returns, line ends in quotes, control characters.

    An unquoted empty field is NULL in a nullable column, ``''`` in another string column and an error elsewhere; a
    quoted empty field is ``''``. It is an error if a quoted field isn't closed or stands beside other text, if an
    unquoted field holds a quote, if a record has the wrong number of fields (an empty line is one empty field), and if
    a value can't be read. One carriage return before a line end isn't part of the record. With ``header`` the first
    record of each file is left out. Cells are cut and converted in Arrow batches, column by column.

    Files are split and read in parallel. With ``multi_line`` a quoted field may hold line ends: a first pass over the
    text counts the quotes of each split, so every split knows whether it begins inside a field (the driver gets one row
    a split), and raises here if a file ends inside one. Records that lie across splits, at most one a border, are put
    together by a second reading of the text, only if there are any. Without ``multi_line`` a record is a line and there
    is one pass. Delimiter and quote are single ASCII characters.
    """
    if len(delimiter) != 1 or len(quote) != 1 or not (delimiter + quote).isascii() or delimiter == quote or set(delimiter + quote) & set("\n\r"):
        raise ValueError("delimiter and quote must be two single ASCII characters and no line ends")
    where = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *where)
    inside = _splits_inside(spark, path, quote) if multi_line else set()
    reader = _Reader(schema, delimiter, quote, header, multi_line, inside)
    rows = lines.mapInArrow(reader.rows, schema.struct(True))
    return rows.union(_across(lines.mapInArrow(reader.borders, _BORDER), reader)) if inside else rows


def _splits_inside(spark: SparkSession, path: str | list[str], quote: str) -> set[tuple[int, int]]:
    """Splits that begin inside a quoted field, by a count of the quotes in each; one row a split comes to the driver."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(quote), F.lit("")))
    counted = spark.read.option("lineSep", "\n").text(path).select(*where, quotes.alias("n")).groupBy("file", "start").agg(F.sum("n").alias("n"))
    opened: dict[str, bool] = {}
    found = set()
    for r in sorted(counted.select("*", F.xxhash64("file").alias("hash")).collect(), key=lambda r: (r.file, r.start)):
        if opened.get(r.file):
            found.add((r.hash, r.start))
        opened[r.file] = opened.get(r.file, False) ^ bool(r.n % 2)
    for file, is_open in opened.items():
        if is_open:
            raise ValueError(f"{file}: a quoted field isn't closed")
    return found


_BORDER = "file long, start long, kind int, heading boolean, text binary"


def _across(borders: DataFrame, reader: _Reader) -> DataFrame:
    """Records that lie across splits, from their pieces: two or three a split, in the order of the file."""
    order = Window.partitionBy("file").orderBy("start", "kind")
    numbered = borders.withColumn("record", F.sum((F.col("kind") == _BEGIN).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    whole = numbered.groupBy("file", "record").agg(F.bool_or("heading").alias("heading"), F.aggregate(pieces, F.lit(b""), lambda a, p: F.concat(a, p.text)).alias("text"))
    return whole.filter(~F.col("heading")).select("text").mapInArrow(reader.texts, reader.schema.struct(True))


class _Reader:
    """Cuts lines of splits into records and these into cells, some thousand lines in a few vector operations."""

    def __init__(self, schema: TableSchema, delimiter: str, quote: str, header: bool, multi_line: bool, inside: set[tuple[int, int]]) -> None:
        self.schema, self.width, self.delimiter, self.quote = schema, len(schema.fields), ord(delimiter), ord(quote)
        self.header, self.multi_line, self.inside = header, multi_line, inside

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records that lie within one split, typed."""
        for _, whole, _ in self._walk(batches):
            if len(whole):
                yield self.typed(whole)

    def borders(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of records that lie across splits."""
        for (file, start), _, pieces in self._walk(batches):
            for kind, heading, text in pieces:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start]), pa.array([kind], pa.int32()), pa.array([heading]), pa.array([text.tobytes()], pa.binary())], ["file", "start", "kind", "heading", "text"])

    def texts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records, typed."""
        for b in batches:
            if b.num_rows:
                yield self.typed(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8))

    def _walk(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray, list]]:
        """``split, records, pieces``: text of whole records, and at a split's ends the pieces of others."""
        at, rest, opened, heading = None, np.empty(0, np.uint8), False, False
        for b in batches:
            if not b.num_rows:
                continue
            file, start = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            size = np.cumsum(pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)) // _PIECE
            cuts = (np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1]) | (size[1:] != size[:-1])) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                here = int(file[i]), int(start[i])
                if here != at:
                    if at is not None:
                        yield at, rest[:0], self._left(rest, opened, heading)
                    at, rest, opened, heading = here, rest[:0], here in self.inside, self.header and here[1] == 0
                text = np.concatenate([rest, _joined(b.column(0).slice(i, j - i))])
                pieces = []
                ends = self._ends(text, opened)
                if opened and len(ends):
                    pieces = [(_END, False, text[: ends[0]])]
                    text, ends, opened = text[ends[0] :], ends[1:] - ends[0], False
                if opened or not len(ends):
                    rest = text
                    if pieces:
                        yield at, text[:0], pieces
                    continue
                first = 0
                if heading:
                    first, heading = int(ends[0]), False
                yield at, text[first : ends[-1]], pieces
                rest = text[ends[-1] :]
        if at is not None:
            yield at, rest[:0], self._left(rest, opened, heading)

    def _left(self, rest: np.ndarray, opened: bool, heading: bool) -> list:
        return [(_MIDDLE if opened else _BEGIN, heading, rest)] if len(rest) else []

    def _ends(self, text: np.ndarray, opened: bool) -> np.ndarray:
        """Places behind the line ends that end a record."""
        if not self.multi_line:
            return np.flatnonzero(text == _LF) + 1
        within = np.logical_xor.accumulate(text == self.quote) ^ opened
        return np.flatnonzero((text == _LF) & ~within) + 1

    def typed(self, text: np.ndarray) -> pa.RecordBatch:
        """Records of text as rows."""
        cells = self.cells(text)
        places = np.arange(0, len(cells), self.width)
        return pa.RecordBatch.from_arrays([_column(cells.take(pa.array(places + i)), f) for i, f in enumerate(self.schema.fields)], self.schema.names)

    def cells(self, text: np.ndarray) -> pa.Array:
        """The cells of all records in a row; NULL where a field is empty and not quoted."""
        is_quote = text == self.quote
        line = text == _LF
        within = np.logical_xor.accumulate(is_quote)  # from an opening quote up to before the closing one
        if not self.multi_line and within[line].any():
            self._fail(text, np.flatnonzero(line & within)[0], "a quoted field isn't closed")
        end = line & ~within
        bound = end | ((text == self.delimiter) & ~within)
        cr = np.zeros(len(text), bool)
        cr[:-1] = (text[:-1] == _CR) & ~within[:-1] & end[1:]
        opens, closes = is_quote & within, is_quote & ~within
        after_bound = np.append(True, bound[:-1])  # the first byte of a field
        again = opens & np.append(False, closes[:-1])  # the second of two quotes, which stand for one
        before = np.append((bound | cr | is_quote)[1:], True)
        wrong = (opens & ~after_bound & ~again) | (closes & ~before)
        if wrong.any():
            self._fail(text, np.flatnonzero(wrong)[0], "a quoted field stands beside other text, or an unquoted one holds a quote")
        last = np.flatnonzero(bound)
        number = np.diff(np.append(-1, np.flatnonzero(end[last])))
        if (number != self.width).any():
            k = int(np.flatnonzero(number != self.width)[0])
            self._fail(text, np.flatnonzero(end)[k], f"{number[k]} fields in place of {self.width}")
        keep = ~(bound | cr | closes | (opens & ~again))
        kept = np.cumsum(keep, dtype=np.int32)
        offset = np.append(0, kept[last])
        first = np.append(0, last[:-1] + 1)
        present = (np.diff(offset) > 0) | (text[first] == self.quote)
        valid = pa.py_buffer(np.packbits(present, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.string(), len(last), [valid, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(text[keep])])

    def _fail(self, text: np.ndarray, at: int, why: str) -> None:
        begin = max(0, at - 60)
        raise ValueError(f"{why}: {text[begin : at + 40].tobytes().decode('utf-8', 'replace')!r}")


def _joined(lines: pa.Array) -> np.ndarray:
    """The bytes of lines, each with its line end."""
    raw = lines.cast(pa.large_binary())
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False)
    stop = np.cumsum(size)
    begin = int(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset])
    data = np.frombuffer(raw.buffers()[2], np.uint8)[begin : begin + int(stop[-1])] if raw.buffers()[2] else np.empty(0, np.uint8)
    out = np.full(len(data) + len(lines), _LF, np.uint8)
    text = np.ones(len(out), bool)
    text[stop + np.arange(len(lines))] = False
    out[text] = data
    return out


_ARROW = {"int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64()}
_REAL = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"


def _column(cells: pa.Array, f: Field) -> pa.Array:
    """Cells as values of a column's type; a cell that can't be read is an error."""
    if cells.null_count and not f.nullable:
        if f.type == "string":
            return pc.fill_null(cells, "")
        raise ValueError(f"column {f.name}: not a {f.type}: nothing")
    if f.type == "string":
        return cells
    present = cells.drop_null()
    values, good = _READERS[f.type](present, f.type)
    if not good.all():
        raise ValueError(f"column {f.name}: not a {f.type}: {present[int(np.flatnonzero(~good)[0])].as_py()!r}")
    if not cells.null_count:
        return values
    there = cells.is_valid().to_numpy(zero_copy_only=False)
    return values.take(pa.array(np.cumsum(there) - 1, pa.int64(), mask=~there))


def _bytes(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The cells' bytes in a row, and where each begins and ends."""
    at = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset : cells.offset + len(cells) + 1] if len(cells) else np.zeros(1, np.int32)
    data = cells.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _integers(cells: pa.Array, kind: str) -> tuple[pa.Array, np.ndarray]:
    data, at = _bytes(cells)
    plain = ((data >= 48) & (data <= 57)) | (data == 45)
    good = np.diff(np.append(0, np.cumsum(~plain, dtype=np.int32))[at]) == 0
    if good.all():
        try:
            return cells.cast(_ARROW[kind]), good
        except pa.ArrowInvalid:
            pass
    low, high = -(2 ** (int(kind[3:]) - 1)), 2 ** (int(kind[3:]) - 1) - 1
    for i, c in enumerate(cells.to_pylist()):  # an error is near: find it
        good[i] &= bool(re.fullmatch(r"-?[0-9]+", c)) and low <= int(c) <= high
    return pa.array([int(c) if g else 0 for c, g in zip(cells.to_pylist(), good)], _ARROW[kind]), good


def _reals(cells: pa.Array, kind: str) -> tuple[pa.Array, np.ndarray]:
    good = pc.match_substring_regex(cells, _REAL).to_numpy(zero_copy_only=False)
    x = np.array([float(c) if g else 0.0 for c, g in zip(cells.to_pylist(), good)])
    return pa.array(x, pa.float64()), good & ~(np.isinf(x) & pc.match_substring_regex(cells, "[0-9]").to_numpy(zero_copy_only=False))


def _bools(cells: pa.Array, kind: str) -> tuple[pa.Array, np.ndarray]:
    low = pc.ascii_lower(cells)
    true, false = (pc.is_in(low, pa.array(words)).to_numpy(zero_copy_only=False) for words in (["1", "true"], ["0", "false"]))
    return pa.array(true), true | false


def _chars(cells: pa.Array, kind: str) -> tuple[pa.Array, np.ndarray]:
    return cells, np.diff(_bytes(cells)[1]) == 1


def _times(cells: pa.Array, kind: str) -> tuple[pa.Array, np.ndarray]:
    """Days, and seconds of timestamps; a day past the month's end runs into the next month."""
    size = 10 if kind == "date" else 19
    data, at = _bytes(cells)
    good = np.diff(at) == size
    text = data[(at[:-1][good, None] + np.arange(size)).astype(np.int64)].astype(np.int64)
    digits = [k for k in range(size) if k not in (4, 7, 10, 13, 16)]
    fine = ((text[:, digits] >= 48) & (text[:, digits] <= 57)).all(axis=1) & (text[:, 4] == 45) & (text[:, 7] == 45)
    number = lambda *places: sum((text[:, k] - 48) * 10**e for e, k in enumerate(reversed(places)))
    year, month, day = number(0, 1, 2, 3), number(5, 6), number(8, 9)
    fine &= (month >= 1) & (month <= 12) & (day >= 1) & (day <= 31)
    value = ((year - 1970) * 12 + month - 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + day - 1
    if kind == "timestamp":
        hour, minute, second = number(11, 12), number(14, 15), number(17, 18)
        fine &= ((text[:, 10] == 32) | (text[:, 10] == 84)) & (text[:, 13] == 58) & (text[:, 16] == 58) & (hour <= 23) & (minute <= 59) & (second <= 59)
        value = (value * 86400 + hour * 3600 + minute * 60 + second) * 1_000_000
    out = np.zeros(len(cells), np.int64)
    out[good] = value
    good[good] = fine
    return pa.array(out.astype(np.int32), pa.int32()).cast(pa.date32()) if kind == "date" else pa.array(out).cast(pa.timestamp("us")), good


_READERS = {"int16": _integers, "int32": _integers, "int64": _integers, "double": _reals, "bool": _bools, "char": _chars, "date": _times, "timestamp": _times}


def _rendered(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit("nan")).when(F.abs(c) == float("inf"), F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(F.format_string("%.6f", c))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def csv_lines(df: DataFrame, schema: TableSchema | None = None, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """One column ``value`` with the text of each row.

    NULL is an empty field; an empty string is a quoted one in a nullable column, an empty field elsewhere. Fields are
    quoted only if they hold a delimiter, a quote or a line end. Doubles have six decimals, timestamps whole seconds.
    """
    declared = {f.name.lower(): f.nullable for f in schema.fields} if schema else {}
    cells = []
    for f in df.schema.fields:
        s = _rendered(F.col(f"`{f.name}`"), f.dataType)
        if not isinstance(f.dataType, T.StringType):  # nothing to quote
            cells.append(F.coalesce(s, F.lit("")))
            continue
        risky = s.contains(delimiter) | s.contains(quote) | s.contains("\n") | s.contains("\r")
        cell = F.when(risky, F.concat(F.lit(quote), F.replace(s, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(s)
        if declared.get(f.name.lower(), f.nullable):
            cell = F.when(s == "", F.lit(quote * 2)).otherwise(cell)
        cells.append(F.coalesce(cell, F.lit("")))
    return df.select(F.concat_ws(delimiter, *cells).alias("value"))


def write_csv(df: DataFrame, path: str, schema: TableSchema | None = None, delimiter: str = ",", quote: str = '"', header: bool = False, mode: str = "errorifexists") -> None:
    """Write :func:`csv_lines` to a folder of files; with ``header`` each begins with the names."""
    lines = csv_lines(df, schema, delimiter, quote)
    if header:
        names = df.sparkSession.createDataFrame([tuple(df.columns)], T.StructType([T.StructField(c, T.StringType()) for c in df.columns]))
        first = csv_lines(names, TableSchema(()), delimiter, quote).first().value

        def headed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.string())], ["value"])
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], ["value"])

        lines = lines.mapInArrow(headed, "value string")
    lines.write.mode(mode).option("lineSep", "\n").text(path)
