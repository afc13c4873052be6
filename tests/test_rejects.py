import csv
import datetime as dt
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from millrace.operators.rejects import split_records
from millrace.schema import TableSchema

ABC = TableSchema.of([("a", "int16", False), ("b", "string", True), ("c", "string", False)])


def split(spark, lines, schema=ABC, key=("line",)):
    df = spark.createDataFrame(list(enumerate(lines)), "line long, raw string")
    valid, rejected = split_records(df, "raw", schema, key)
    return rows(valid), rows(rejected, "line", "reason")


def test_reasons(spark):
    lines = [
        "1,x,y", '2,"x,""q""\nz",', "3,,", '4,"",""', "5,x,y\r", '6,"x,y', '7,"x"z,y', '8,x"z,y', "9,x", "10,x,y,z", "x,x,y", ",x,y", "40000,x,y", "-0,x,y", "+1,x,y", " 1,x,y",
        "", None, '"7","x","y"', '"",x,y', "\x01,\x01,y", '11,"""",y', '12,x,"""a"', "0012,x,y", '13,"a" ,y', "١,x,y",
    ]
    valid, rejected = split(spark, lines)
    assert rejected == [(5, "quoting"), (6, "quoting"), (7, "quoting"), (8, "columns"), (9, "columns"), *[(i, "value") for i in (10, 11, 12, 14, 15)], (16, "columns"), (17, "columns"), (19, "value"), (20, "value"), (24, "quoting"), (25, "value")]
    assert dict((r[0], r[1:]) for r in valid) == {0: (1, "x", "y"), 1: (2, 'x,"q"\nz', ""), 2: (3, None, ""), 3: (4, "", ""), 4: (5, "x", "y"), 13: (0, "x", "y"), 18: (7, "x", "y"), 21: (11, '"', "y"), 22: (12, "x", '"a'), 23: (12, "x", "y")}


def test_first_reason_wins(spark):
    assert split(spark, ['x,"y', "x,y"])[1] == [(0, "quoting"), (1, "columns")]


@pytest.mark.parametrize(
    "kind, good, bad",
    [
        ("int32", {"-2147483648": -(2**31), "2147483647": 2**31 - 1}, ["2147483648", "1.0", "1e3", "", "-", "--1", "NULL", "\\N"]),
        ("int64", {"9223372036854775807": 2**63 - 1}, ["9223372036854775808", "99999999999999999999999"]),
        ("bool", {"1": True, "0": False, "TRUE": True, "False": False}, ["2", "yes"]),
        ("double", {"1": 1.0, "-.5e1": -5.0, "1.": 1.0}, ["1e999", "x", "1,5", "e1"]),
        ("date", {"2013-07-04": dt.date(2013, 7, 4), "2013-02-31": dt.date(2013, 3, 3)}, ["2013-7-4", "2013-13-01", "2013-00-10", "20130704", "2013-07-32", "2013-07-04 "]),
        ("timestamp", {"2013-07-04 10:00:00": dt.datetime(2013, 7, 4, 10), "2013-07-04T23:59:59": dt.datetime(2013, 7, 4, 23, 59, 59)}, ["2013-07-04", "2013-07-04 24:00:00", "2013-07-04 10:60:00", "2013-07-04 10:00", "1372932000"]),
        ("char", {"x": "x", " ": " "}, ["ab", "é"]),
    ],
)
def test_types(spark, kind, good, bad):
    schema = TableSchema.of([("v", kind, False)])
    quoted = [f'"{x}"' for x in [*good, *bad]]
    valid, rejected = split(spark, quoted, schema)
    assert [r[1] for r in sorted(valid)] == list(good.values())
    assert [r[0] for r in rejected] == list(range(len(good), len(quoted))) and {r[1] for r in rejected} == {"value"}


def test_missing_values(spark):
    assert split(spark, [""], TableSchema.of([("v", "int32", True)])) == ([(0, None)], [])
    assert split(spark, [""], TableSchema.of([("v", "date", False)])) == ([], [(0, "value")])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(2**15), 2**15 - 1), st.one_of(st.none(), st.text(max_size=6)), st.text(max_size=6)), min_size=1, max_size=20))
def test_what_a_csv_writer_writes_is_read(spark, data):
    lines = []
    for r in data:
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_NOTNULL, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    data = [r for r, x in zip(data, lines) if "\x00" not in x and not any(0xD800 <= ord(c) < 0xE000 for c in x)]
    lines = [x for x in lines if "\x00" not in x and not any(0xD800 <= ord(c) < 0xE000 for c in x)]
    valid, rejected = split(spark, lines)
    assert rejected == [] and sorted(valid) == sorted([(i, *r) for i, r in enumerate(data)])


def test_long_records_repeats_and_clashing_columns(spark):
    long = '1,"' + 'a,""' * 100_000 + '",y'
    df = spark.createDataFrame([(None, long, "k", 1), (None, "1,2", "k", 2), (None, "1,2", "k", 2), (4, "9,x,y", None, 3)], "a long, raw string, reason string, C int")
    valid, rejected = split_records(df, "raw", ABC, ["a"])
    assert rejected.columns == ["a", "raw", "reason", "C", "_reason"]
    assert rows(rejected) == [(None, "1,2", "k", 2, "columns")] * 2
    assert valid.columns == ["a", "b", "c"] and sorted((r.a, len(r.b)) for r in valid.collect()) == [(1, 300_000), (9, 1)]


def test_empty(spark):
    assert split(spark, []) == ([], [])


def test_other_marks(spark):
    df = spark.createDataFrame([("1;'a;b';c",), ("1;x'y;c",)], "raw string")
    valid, rejected = split_records(df, "raw", ABC, delimiter=";", quote="'")
    assert rows(valid) == [(1, "a;b", "c")] and rows(rejected) == [("1;x'y;c", "quoting")]


def test_records_may_hold_the_marks_used_inside(spark):
    valid, rejected = split(spark, ["1,\x01\x02c\x02,\x02e", '2,"\x01,\x02",\x02c\x01e', "3,\x01"])
    assert valid == [(0, 1, "\x01\x02c\x02", "\x02e"), (1, 2, "\x01,\x02", "\x02c\x01e")] and rejected == [(2, "columns")]
