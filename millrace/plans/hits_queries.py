"""The benchmark queries over the test table ``hits``.

Four constants of the public benchmark name values that this table doesn't hold, so they are replaced here; the SQL
beside each query uses the same ones.
"""

from __future__ import annotations

from millrace.plans import clickstream

PARAMS = clickstream.Params(user=4589355320376533200, having_min=200, needle="panel", title_needle="Panel", url_not=".invalid", referer_hash=-1970711489451281740, url_hash=7062611474903351933)

QUERIES = {f"hits_q{i:02d}": (lambda spark, d, i=i: clickstream.run(spark.read.parquet(f"{d}/hits.parquet"), i, PARAMS)) for i in clickstream.QUERIES}
SQL = {f"hits_q{i:02d}": clickstream.sql(i, PARAMS) for i in clickstream.QUERIES}
