"""Runs of the benchmark queries kept in folders, and their times and results side by side.

    python -m millrace.runs keep --input hits.parquet --folder runs/today [--queries 0,7,28]
    python -m millrace.runs compare runs/today runs/before [--expected runs/good] [--output table.csv] [--markdown table.md]

A folder holds ``query_times.csv`` (``query,time_ms``, ``NA`` for a query that failed) and a folder ``query_N`` with each
result as text. Against an expected folder a time becomes ``WA`` where the result's text differs or is missing; queries
without an expected result and failures keep what they have.
"""

from __future__ import annotations

import argparse
import csv
import io
import sys
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from millrace.plans import clickstream
from millrace.session import get_session
from millrace.sources.csv_io import write_csv
from millrace.sources.files import list_files, read_bytes, write_bytes
from millrace.sources.storage import read_table

FAILED, WRONG = "NA", "WA"


def keep(spark: SparkSession, table: str, folder: str, queries: Sequence[int]) -> dict[str, str]:
    """Run queries on a table and keep results and times."""
    hits, times = read_table(spark, table), {}
    for q in queries:
        began = time.perf_counter()
        try:
            write_csv(clickstream.run(hits, q).coalesce(1), f"{folder}/query_{q}", header=True, mode="overwrite")
            times[str(q)] = f"{(time.perf_counter() - began) * 1000:.0f}"
        except Exception as e:  # the other queries go on
            print(f"query {q}: {e}", file=sys.stderr)
            times[str(q)] = FAILED
    write_bytes(spark, f"{folder}/query_times.csv", _table(["query", "time_ms"], times.items()).encode())
    return times


def read_times(spark: SparkSession, folder: str) -> dict[str, str]:
    lines = csv.DictReader(io.StringIO(read_bytes(spark, f"{folder}/query_times.csv").decode()))
    if not {"query", "time_ms"} <= set(lines.fieldnames or ()):
        raise ValueError(f"{folder}: query_times.csv needs the columns query and time_ms")
    return {r["query"].strip(): (r["time_ms"] or "").strip() for r in lines if (r["query"] or "").strip()}


def _result(spark: SparkSession, folder: str, query: str) -> bytes | None:
    try:
        found = list_files(spark, f"{folder}/query_{query}", ".txt")
    except Exception:  # no such folder
        return None
    return b"".join(read_bytes(spark, name) for name, _ in found)


def compare(spark: SparkSession, folders: Sequence[str], expected: str | None = None) -> list[list[str]]:
    """A row for each query: its number and a cell for each folder, empty where a folder lacks it."""
    runs = []
    for folder in folders:
        times = read_times(spark, folder)
        for q, t in times.items():
            want = _result(spark, expected, q) if expected and t.upper() != FAILED else None
            if want is not None and _result(spark, folder, q) != want:
                times[q] = WRONG
        runs.append(times)
    queries = sorted({q for r in runs for q in r}, key=lambda q: (not q.isdigit(), int(q) if q.isdigit() else 0, q))
    return [[q, *[r.get(q, "") for r in runs]] for q in queries]


def _table(names: Sequence[str], rows) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([names, *rows])
    return out.getvalue()


def markdown(names: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """The same as a Markdown table; an empty cell says that the query didn't run."""
    line = lambda cells: "| " + " | ".join(c or FAILED for c in cells) + " |\n"
    return line(names) + "|" + "---|" * len(names) + "\n" + "".join(map(line, rows))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace.runs", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("keep")
    a.add_argument("--input", required=True)
    a.add_argument("--folder", required=True)
    a.add_argument("--queries", default=",".join(map(str, clickstream.QUERIES)))
    b = sub.add_parser("compare")
    b.add_argument("folders", nargs="+")
    b.add_argument("--expected")
    b.add_argument("--output", default="-")
    b.add_argument("--markdown")
    o = p.parse_args(args)
    spark = get_session("millrace-runs")
    try:
        if o.what == "keep":
            return int(FAILED in keep(spark, o.input, o.folder, [int(q) for q in o.queries.split(",")]).values())
        names, rows = ["query", *o.folders], compare(spark, o.folders, o.expected)
        for target, text in ((o.output, _table(names, rows)), (o.markdown, markdown(names, rows))):
            if target == "-":
                sys.stdout.write(text)
            elif target:
                write_bytes(spark, target, text.encode())
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
