"""Query runner: ``python -m millrace.cli --input hits.parquet --query 7 --output out [--header]``

Exit codes: 0 done, 1 an error, 2 no such query.
"""

from __future__ import annotations

import argparse
import sys
import time

from millrace.plans import clickstream
from millrace.session import get_session
from millrace.sources.csv_io import write_csv
from millrace.sources.storage import read_table


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    p.add_argument("--input", required=True, help="columnar table of page hits")
    p.add_argument("--query", required=True, type=int, help="0 to 42")
    p.add_argument("--output", required=True, help="folder for the result as CSV")
    p.add_argument("--header", action="store_true")
    p.add_argument("--explain", action="store_true", help="print the plan and don't run it")
    a = p.parse_args(args)
    if a.query < 0:
        print("error: negative query id", file=sys.stderr)
        return 1
    if a.query not in clickstream.QUERIES:
        print(f"error: no query {a.query}", file=sys.stderr)
        return 2
    try:
        spark = get_session("millrace-query")
        began = time.time()
        df = clickstream.run(read_table(spark, a.input), a.query)
        if a.explain:
            df.explain("formatted")
            return 0
        write_csv(df.coalesce(1), a.output, header=a.header)
        print(f"query {a.query}: {time.time() - began:.2f} s", file=sys.stderr)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
