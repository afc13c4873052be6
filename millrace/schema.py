"""Explicit table schemas: typed fields with a declared NOT NULL flag, and their text file form."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import types as T

#: Type names of schema files and the Spark types that stand for them.
TYPES: dict[str, T.DataType] = {
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "double": T.DoubleType(),
    "bool": T.BooleanType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "char": T.StringType(),
}


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = False

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown type {self.type!r} of column {self.name!r}")


@dataclass(frozen=True)
class TableSchema:
    """Ordered fields. Spark's file sources force every column nullable, so the declared flag is kept here."""

    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        seen: set[str] = set()
        for f in self.fields:
            if f.name.lower() in seen:
                raise ValueError(f"duplicate column {f.name!r}")
            seen.add(f.name.lower())

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"no column {name!r}")

    def struct(self, all_nullable: bool = False) -> T.StructType:
        return T.StructType([T.StructField(f.name, TYPES[f.type], all_nullable or f.nullable) for f in self.fields])

    @staticmethod
    def of(rows: Iterable[tuple]) -> TableSchema:
        return TableSchema(tuple(Field(*r) for r in rows))

    @staticmethod
    def of_struct(struct: T.StructType) -> TableSchema:
        """The schema of a DataFrame; a type outside the list is an error."""
        names = {v: k for k, v in reversed(TYPES.items())} | {T.StringType(): "string", T.TimestampType(): "timestamp"}
        for f in struct.fields:
            if f.dataType not in names:
                raise ValueError(f"column {f.name!r}: {f.dataType.simpleString()} has no name in a schema file")
        return TableSchema(tuple(Field(f.name, names[f.dataType], f.nullable) for f in struct.fields))


def parse_schema(text: str) -> TableSchema:
    """``name,type[,nullable]`` a line; ``nullable`` or ``true`` mark a nullable column, anything else NOT NULL."""
    fields = []
    for n, row in enumerate(csv.reader(io.StringIO(text)), 1):
        if not row:
            continue
        if len(row) < 2:
            raise ValueError(f"line {n}: a column needs a name and a type")
        fields.append(Field(row[0], row[1], len(row) > 2 and row[2] in ("nullable", "true")))
    return TableSchema(tuple(fields))


def render_schema(schema: TableSchema) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    for f in schema.fields:
        w.writerow([f.name, f.type, "nullable"] if f.nullable else [f.name, f.type])
    return out.getvalue()


def read_schema(path: str) -> TableSchema:
    with open(path, encoding="utf-8", newline="") as f:
        return parse_schema(f.read())


def write_schema(schema: TableSchema, path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(render_schema(schema))
