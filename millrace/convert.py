"""Converter between delimited text and columnar tables: ``python -m millrace.convert --mode csv2columnar …``"""

from __future__ import annotations

import argparse
import sys

from millrace.schema import parse_schema, render_schema
from millrace.session import get_session
from millrace.sources.csv_io import read_csv, write_csv
from millrace.sources.files import read_bytes, write_bytes
from millrace.sources.storage import CODECS, read_table, table_schema, write_table


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace.convert", description=__doc__)
    p.add_argument("--mode", required=True, choices=("csv2columnar", "columnar2csv"))
    p.add_argument("--schema", help="schema file: read in csv2columnar; in columnar2csv written there if given")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--compression", default="lz4", choices=sorted(CODECS))
    p.add_argument("--delimiter", default=",")
    p.add_argument("--header", action="store_true")
    p.add_argument("--single-line", action="store_true", help="no field holds a line end, so one pass over the text will do")
    a = p.parse_args(args)
    if a.mode == "csv2columnar" and not a.schema:
        p.error("csv2columnar needs --schema")
    spark = get_session("millrace-convert")
    try:
        if a.mode == "csv2columnar":
            schema = parse_schema(read_bytes(spark, a.schema).decode("utf-8"))
            write_table(read_csv(spark, a.input, schema, a.delimiter, header=a.header, multi_line=not a.single_line), a.output, schema, a.compression)
        else:
            df = read_table(spark, a.input)
            schema = table_schema(df)
            write_csv(df, a.output, schema, a.delimiter, header=a.header)
            if a.schema:
                write_bytes(spark, a.schema, render_schema(schema).encode("utf-8"))
    except Exception as e:  # a command's failure is an exit code and a line
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
