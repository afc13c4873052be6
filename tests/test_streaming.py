import datetime as dt
from decimal import Decimal

from conftest import rows
from millrace.operators.dedup import deduplicate
from millrace.streaming.feeds import drop_repeats, fold_batches

T0 = dt.datetime(2013, 7, 1)
KIND = "id long, at timestamp, seq long"


def test_batches_fold_and_merge(spark, tmp_path):
    data = [(i % 40, T0 + dt.timedelta(seconds=i), i) for i in range(120)]
    for k in range(3):
        spark.createDataFrame(data[k * 40 : k * 40 + 40], KIND).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for _ in range(2):  # a second start finds nothing new
        fold_batches(stream, lambda b: deduplicate(b, "id", ["seq"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    parts = spark.read.parquet(str(tmp_path / "out"))
    assert parts.select("batch").distinct().count() == 3 and parts.count() == 120
    assert rows(deduplicate(parts.drop("batch"), "id", ["seq"]), "seq") == [(i,) for i in range(40)]


def test_repeats_within_the_delay(spark, tmp_path):
    spark.createDataFrame([(1, T0, 1), (1, T0 + dt.timedelta(seconds=5), 2), (2, T0, 3)], KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = drop_repeats(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), "id", "at", "1 minute")
    q = stream.writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("SELECT id, count(*) FROM kept GROUP BY id")) == [(1, 1), (2, 1)]


def test_late_messages_and_null_keys_are_sent_on(spark, tmp_path):
    kind = KIND + ", big long, tags array<long>, m map<string,int>, d decimal(20,3), n timestamp_ntz"
    more = (2**62 + 1, [2**60 + 1, None], {"a": None}, Decimal("1.125"), T0)
    none = (None,) * 5
    s = lambda x: T0 + dt.timedelta(seconds=x)
    batches = [
        [(1, s(0), 1, *more), (None, s(0), 2, *none), (None, s(0), 2, *none)],
        [(2, s(600), 3, *none), (2, s(599), 4, *none), (1, s(20), 14, *none)],
        [(5, s(700), 5, *none), (None, s(5), 6, *more)],
        [(3, s(1), 7, *more), (2, s(601), 8, *none), (4, None, 9, *none), (4, None, 9, *none)],
        [(3, s(2), 10, *none), (6, s(700), 11, *none), (4, None, 12, *none)],
        [(6, s(5), 13, *none)],
        [(7, s(5000), 15, *none)],
        [(8, s(5001), 16, *none)],
    ]
    seen = []

    def keep(df, n):
        seen.extend(tuple(r) for r in df.collect())

    for k, b in enumerate(batches):
        spark.createDataFrame(b, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = drop_repeats(spark.readStream.schema(kind).parquet(str(tmp_path / "in/*")), "id", "at", "1 minute")
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r[2] for r in seen) == [1, 2, 2, 4, 5, 6, 7, 9, 11, 15, 16]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # 7 and 8: the others are forgotten
    assert {r[2]: r[3:] for r in seen if r[2] in (1, 6, 7)} == {1: more, 6: more, 7: more}
