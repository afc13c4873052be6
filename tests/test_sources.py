import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from millrace import cli, convert
from millrace.plans.op_queries import QUERIES
from millrace.schema import Field, TableSchema, parse_schema, read_schema, render_schema, write_schema
from millrace.sources.csv_io import csv_lines, read_csv, write_csv
from millrace.sources.files import list_files, read_bytes, write_bytes
from millrace.sources.storage import count_rows, read_table, row_count, table_schema, table_stats, write_table


def test_schema_file(tmp_path):
    s = parse_schema('plot,int32\n"crop, main",string,true\nyield,double,nullable\nkind,char\ntilled,bool,no\nsown,date,\n')
    assert [f.nullable for f in s.fields] == [False, True, True, False, False, False]
    assert render_schema(s) == 'plot,int32\n"crop, main",string,nullable\nyield,double,nullable\nkind,char\ntilled,bool\nsown,date\n'
    write_schema(s, str(tmp_path / "s"))
    assert read_schema(str(tmp_path / "s")) == s and s["kind"] == Field("kind", "char")
    for bad in ("plot\n", "plot,integer\n", "plot,int64\nPlot,string\n"):
        with pytest.raises(ValueError):
            parse_schema(bad)


def read(spark, tmp_path, text, fields, **kw):
    (tmp_path / "in.csv").write_text(text, newline="")
    return read_csv(spark, str(tmp_path / "in.csv"), TableSchema.of(fields), **kw)


S2 = [("a", "string", True), ("b", "string", True)]


@pytest.mark.parametrize(
    "text, fields, kw, want",
    [
        ('"4"" pipe, bent",plain\n', S2, {}, [('4" pipe, bent', "plain")]),
        ('"top\r\nbase",side\nx,y', S2, {}, [("top\r\nbase", "side"), ("x", "y")]),
        (",left,\n", [*S2, ("c", "string", False)], {}, [(None, "left", "")]),
        ("\n\nz\n", [("a", "string", True)], {}, [(None,), (None,), ("z",)]),
        ("h\n1\n", [("a", "int32")], {"header": True, "multi_line": False}, [(1,)]),
        ('"h\nh",i\n1,2\n', S2, {"header": True}, [("1", "2")]),
        ("a\x01,\x02\r\r\n", S2, {}, [("a\x01", "\x02\r")]),
        ("|a,b|;c\n", S2, {"delimiter": ";", "quote": "|"}, [("a,b", "c")]),
        ("a;b\n", S2, {"delimiter": ";"}, [("a", "b")]),
        (',""\n"",\n1,2\n', S2, {}, [(None, ""), ("", None), ("1", "2")]),
        ("true,false\n1,0\n", [("a", "bool"), ("b", "bool")], {}, [(True, False), (True, False)]),
        ("h,i\nx, y \r\n", S2, {"header": True}, [("x", " y ")]),
        ("1,\n2,\r\n", [("a", "int32"), ("b", "string", True)], {}, [(1, None), (2, None)]),
        ("2013-07-01,2013-07-01T10:00:00\n", [("a", "date"), ("b", "timestamp")], {}, [(dt.date(2013, 7, 1), dt.datetime(2013, 7, 1, 10))]),
        ("5,x\n", [("a", "int16"), ("b", "char")], {}, [(5, "x")]),
        ("", S2, {}, []),
        ("-32768,+1.5e3,TRUE,é\n,.5,0,\n7,NaN,1,z\n", [("a", "int16", True), ("b", "double"), ("c", "bool"), ("d", "string", True)], {}, [(-32768, 1500.0, True, "é"), (None, 0.5, False, None), (7, float("nan"), True, "z")]),
        ("2013-02-31,1969-12-31 23:59:59\n0001-01-01,\n", [("a", "date"), ("b", "timestamp", True)], {}, [(dt.date(2013, 3, 3), dt.datetime(1969, 12, 31, 23, 59, 59)), (dt.date(1, 1, 1), None)]),
    ],
)
def test_csv_reads(spark, tmp_path, text, fields, kw, want):
    assert str(rows(read(spark, tmp_path, text, fields, **kw))) == str(sorted(want, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r)))


@pytest.mark.parametrize("text, fields", [("4x\n", [("a", "int64")]), ("4,5\n", [("a", "int64")]), ("no\n", [("a", "char")]), ("4\n", S2), ("4,5,6\n", S2), ("\n", S2), ("4,5\n\n", S2), (",x\n", [("a", "int32"), ("b", "string")]), ("70000\n", [("a", "int16")]), *[(f"1\n{x}\n", [("a", "int64")]) for x in ("+1", " 1", "0x1", "1-", "-", "", '""', "9223372036854775808", "1.0")],
    *[(f"{x}\n", [("a", "double", True)]) for x in ("1e999", "e5", "1.5f", '""')], *[(f"{x}\n", [("a", "date")]) for x in ("2013-13-01", "2013-00-10", "2013-01-32", "2013-1-01", "2013/01/01", "12013-01-01")],
    *[(f"{x}\n", [("a", "timestamp")]) for x in ("2013-01-01 24:00:00", "2013-01-01 10:60:00", "2013-01-01x10:00:00", "2013-01-01 10:00:00.5", "2013-01-01")], ("yes\n", [("a", "bool")]), ("é\n", [("a", "char")])])
def test_csv_is_strict(spark, tmp_path, text, fields):
    with pytest.raises(Exception):
        read(spark, tmp_path, text, fields).collect()


@pytest.mark.parametrize(
    "text",
    ['"ab"cd,x\n', 'q,"open\n1,2\n3,4\n', '1,2\nx,"y', '1,a"b\n', '"a" ,b\n', '"1\n2"x,y\n', '"1\n2","3\n""4\n', '"a"\r\r\nb,c\n'],
)
@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_quotes_are_strict(spark, tmp_path, text, multi_line):
    with pytest.raises(Exception):
        read(spark, tmp_path, text, S2, multi_line=multi_line).collect()


def test_csv_quotes_over_many_splits(spark, tmp_path):
    """Splits of 200 bytes begin inside and outside quotes."""
    data = [(f"{i}", "\n".join(f'line {k}, "{i}"' for k in range(i % 30))) for i in range(1, 200)]
    lines = [f'{a},"{b.replace(chr(34), chr(34) * 2)}"\n' for a, b in data]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert rows(read(spark, tmp_path, "".join(lines), S2)) == sorted((a, b) for a, b in data)
        for broken in ('x,"y"z\n', 'x,"y\n', 'x,y"z"\n'):
            for at in (0, 100, len(lines)):
                with pytest.raises(Exception):
                    read(spark, tmp_path, "".join([*lines[:at], broken, *lines[at:]]), S2).collect()
        assert read(spark, tmp_path, '"h\n' + "h" * 900 + '",i\n' + "".join(lines), S2, header=True).count() == len(data)
        assert rows(read(spark, tmp_path, f'1,"{"long" * 400}\n"\n2,b\n', S2)) == [("1", "long" * 400 + "\n"), ("2", "b")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_arguments(spark, tmp_path):
    for kw in ({"delimiter": "::"}, {"quote": ""}, {"delimiter": "é"}, {"delimiter": '"'}, {"quote": "\n"}):
        with pytest.raises(ValueError):
            read(spark, tmp_path, "a,b\n", S2, **kw)


TEXT = st.text(alphabet=st.sampled_from('a,"\n\r\x01\x02\0 é日'), max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), TEXT), TEXT, st.one_of(st.none(), TEXT)), max_size=12))
def test_csv_loses_nothing(spark, tmp_path_factory, data):
    schema = TableSchema.of([("a", "string", True), ("b", "string"), ("c", "string", True)])
    path = str(tmp_path_factory.mktemp("csv") / "t")
    write_csv(spark.createDataFrame(data, schema.struct(True)), path, schema)
    assert rows(read_csv(spark, path, schema)) == rows(spark.createDataFrame(data, schema.struct(True)))


def test_csv_lines(spark):
    df = spark.createDataFrame([(1, 3.14, "", None, "a,b", True), (2, float("nan"), "x", "", 'q"\n', None)], "i int, d double, s string, t string, u string, v boolean")
    schema = TableSchema.of([("i", "int32"), ("d", "double"), ("s", "string"), ("t", "string", True), ("u", "string"), ("v", "bool", True)])
    assert rows(csv_lines(df, schema)) == [('1,3.140000,,,"a,b",true',), ('2,nan,x,"","q""\n",',)]


def test_csv_there_and_back(spark, tmp_path):
    data = [(None, "", 1.5, dt.date(2013, 7, 1)), ('x"y', "é, ", -0.25, None), ("", "\n", 1e6, None)]
    schema = TableSchema.of([("a", "string", True), ("b", "string"), ("c", "double"), ("d", "date", True)])
    df = spark.createDataFrame(data, schema.struct(True))
    for header in (False, True):
        write_csv(df, str(tmp_path / f"t{header}"), schema, header=header)
        assert rows(read_csv(spark, str(tmp_path / f"t{header}"), schema, header=header)) == rows(df)


def test_storage(spark, tmp_path):
    schema = TableSchema.of([("id", "int64"), ("name", "string", True)])
    df = spark.createDataFrame([(11, "oak"), (-4, None), (8, "ash")], schema.struct()).coalesce(1)
    for codec in ("none", "lz4", "zstd"):
        path = str(tmp_path / codec)
        write_table(df, path, schema, codec, {"name": "plain", "id": "delta"} if codec != "none" else {"name": "plain"})
        assert rows(read_table(spark, path)) == rows(df) and row_count(spark, path) == 3 and rows(count_rows(spark, path)) == [(3,)]
        a, b = table_stats(spark, path)
        assert ("DELTA_BINARY_PACKED" in a.encodings) == (codec != "none")
        assert (a.low, a.high, a.nulls, b.low, b.high, b.nulls) == (-4, 11, 0, "ash", "oak", 1)
    assert rows(read_table(spark, path, [1])) == [(None,), ("ash",), ("oak",)]
    assert read_table(spark, path, ["name", 0]).columns == ["name", "id"]
    with pytest.raises(IndexError):
        read_table(spark, path, [2])
    with pytest.raises(KeyError):
        read_table(spark, path, ["x"])


def test_the_table_keeps_its_schema(spark, tmp_path):
    schema = TableSchema.of([("id", "int64"), ("mark", "char", True), ("name", "string"), ("at", "timestamp", True), ("ok", "bool")])
    df = spark.createDataFrame([(1, "x", "a", dt.datetime(2013, 7, 1), True), (2, None, "", None, False)], schema.struct(True))
    write_table(df, str(tmp_path / "t"), schema)
    assert table_schema(read_table(spark, str(tmp_path / "t"))) == schema
    assert table_schema(read_table(spark, str(tmp_path / "t"), ["mark", 0])).fields == (schema["mark"], schema["id"])
    assert table_schema(spark.range(1)).fields == (Field("id", "int64", False),)
    with pytest.raises(Exception):
        write_table(df.replace("x", "xy"), str(tmp_path / "u"), schema)


def test_files(spark, tmp_path):
    path = str(tmp_path / "d" / "x.bin")
    write_bytes(spark, path, b"0123456789")
    assert read_bytes(spark, path) == b"0123456789" and read_bytes(spark, path, 3, 4) == b"3456"
    write_bytes(spark, str(tmp_path / "d" / "_hidden.bin"), b"")
    assert [(n.rsplit("/", 1)[1], s) for n, s in list_files(spark, str(tmp_path / "d"), ".bin")] == [("x.bin", 10)]
    with pytest.raises(ValueError):
        row_count(spark, path)


def test_delta_pages(spark, tmp_path):
    schema = TableSchema.of([("id", "int64"), ("day", "date")])
    df = spark.range(1000).selectExpr("id", "date_add(DATE '2013-07-01', CAST(id AS int)) AS day").coalesce(1)
    write_table(df, str(tmp_path / "t"), schema, "none", {"id": "delta", "day": "frame_of_reference"})
    assert all("DELTA_BINARY_PACKED" in s.encodings for s in table_stats(spark, str(tmp_path / "t")))
    assert rows(read_table(spark, str(tmp_path / "t"))) == rows(df)


def test_run_lengths(spark, tmp_path):
    """Long runs of a number are ids of a dictionary, those of a boolean need format 2; beside strings that takes a codec."""
    schema = TableSchema.of([("n", "int64"), ("x", "double"), ("b", "bool")])
    df = spark.range(100_000).selectExpr("id DIV 10000 AS n", "CAST(id DIV 20000 AS double) AS x", "id < 50000 AS b").coalesce(1)
    write_table(df, str(tmp_path / "t"), schema, "none", {"n": "rle", "x": "rle", "b": "rle"})
    n, x, b = table_stats(spark, str(tmp_path / "t"))
    assert "RLE_DICTIONARY" in n.encodings and "RLE_DICTIONARY" in x.encodings and "RLE" in b.encodings and "PLAIN" not in b.encodings
    assert all(s.bytes < 1000 for s in (n, x, b))
    assert rows(read_table(spark, str(tmp_path / "t"))) == rows(df)
    schema = TableSchema.of([*[(f.name, f.type) for f in schema.fields], ("s", "string")])
    df = df.selectExpr("*", "'s' AS s")
    write_table(df, str(tmp_path / "u"), schema, "zstd", {"n": "rle", "b": "rle", "s": "plain"})
    assert rows(read_table(spark, str(tmp_path / "u"))) == rows(df)


def test_delta_round_trip_has_delta_pages(spark, tmp_path):
    spark.range(1000).selectExpr("id AS watchid", "id AS userid", "DATE '2013-07-01' AS eventdate", "timestamp_ntz '2013-07-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS eventtime", "CAST(id DIV 100 AS int) AS regionid").coalesce(1).write.parquet(str(tmp_path / "hits.parquet"))
    df = QUERIES["io_parquet_roundtrip_delta"](spark, str(tmp_path))
    pages = {s.column: s.encodings for f in df.inputFiles() for s in table_stats(spark, f)}
    assert "DELTA_BINARY_PACKED" in pages["eventtime"] and "DELTA_BINARY_PACKED" in pages["eventdate"]
    assert rows(df) == rows(spark.read.parquet(str(tmp_path / "hits.parquet")))


def test_storage_is_strict(spark, tmp_path):
    schema = TableSchema.of([("id", "int64"), ("s", "string", True)])
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "a"), schema)
    df = df.selectExpr("CAST(nullif(id, 1) AS long) AS id", "s")
    with pytest.raises(Exception):
        write_table(df, str(tmp_path / "b"), schema)
    for kw in ({"compression": "x"}, {"encodings": {"id": "dictionary"}}, {"encodings": {"s": "delta"}}, {"encodings": {"s": "x"}}, {"compression": "none", "encodings": {"id": "delta"}}):
        with pytest.raises(ValueError):
            write_table(df, str(tmp_path / "c"), schema, **kw)
    with pytest.raises(Exception):
        write_table(df.selectExpr("-5L AS id", "s"), str(tmp_path / "d"), schema, encodings={"id": "bit_packing"})


def test_stats_leave_out_nan(spark, tmp_path):
    schema = TableSchema.of([("x", "double", True)])
    write_table(spark.createDataFrame([(5.0,), (None,)], "x double").coalesce(1), str(tmp_path / "t"), schema)
    (s,) = table_stats(spark, str(tmp_path / "t"))
    assert (s.low, s.high, s.nulls) == (5.0, 5.0, 1)
    write_table(spark.createDataFrame([(math.nan,)], "x double").coalesce(1), str(tmp_path / "u"), schema)
    (s,) = table_stats(spark, str(tmp_path / "u"))
    assert s.low is None


def test_converter(spark, tmp_path):
    (tmp_path / "s").write_text("id,int64\nname,string,nullable\nmark,char\n")
    (tmp_path / "in.csv").write_text('1,"a,b",x\n2,,y\n3,"",z\n')
    args = ["--schema", str(tmp_path / "s")]
    assert convert.main(["--mode", "csv2columnar", *args, "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "t")]) == 0
    assert convert.main(["--mode", "columnar2csv", "--schema", str(tmp_path / "s2"), "--input", str(tmp_path / "t"), "--output", str(tmp_path / "out")]) == 0
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert sorted(text.split("\n")) == sorted(['1,"a,b",x', "2,,y", '3,"",z', ""])
    assert (tmp_path / "s2").read_text() == (tmp_path / "s").read_text()
    assert convert.main(["--mode", "csv2columnar", *args, "--single-line", "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "t2")]) == 0
    assert rows(read_table(spark, str(tmp_path / "t2"))) == rows(read_table(spark, str(tmp_path / "t")))
    assert convert.main(["--mode", "csv2columnar", *args, "--input", str(tmp_path / "none.csv"), "--output", str(tmp_path / "u")]) == 1


def test_runner(spark, tmp_path):
    spark.createDataFrame([(1, 0), (2, 3)], "WatchID long, AdvEngineID short").write.parquet(str(tmp_path / "hits"))
    ask = lambda q, *more: cli.main(["--input", str(tmp_path / "hits"), "--query", str(q), "--output", str(tmp_path / f"o{q}"), *more])
    assert ask(1, "--header") == 0
    assert "".join(p.read_text() for p in (tmp_path / "o1").glob("part-*")) == "count\n1\n"
    assert ask(43) == 2 and ask(-1) == 1 and ask(5) == 1
