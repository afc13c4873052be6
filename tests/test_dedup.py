from conftest import rows
from millrace.operators.dedup import deduplicate, merge_batch, surplus

KIND = "id long, at int, seq long, body string, __row int, tags map<string,int>"


def feed(spark, data):
    return spark.createDataFrame(data, KIND)


DATA = [
    (1, 5, 10, "late", 0, {"a": 1}), (1, 3, 11, "early", 0, None), (1, 3, 12, None, 0, None), (2, None, 13, "x", None, None), (2, 9, 14, "y", None, None),
    (None, 1, 15, "lost", 0, None), (None, 1, 16, "lost", 0, None), (3, 1, 17, "same", 0, {}), (3, 1, 17, "same", 0, {}),
]


def test_first_copy_wins(spark):
    out = deduplicate(feed(spark, DATA), "id", ["at", "seq"])
    assert [f.dataType for f in out.schema] == [f.dataType for f in feed(spark, []).schema]
    assert rows(out, "id", "seq", "body") == [(None, 15, "lost"), (None, 16, "lost"), (1, 11, "early"), (2, 14, "y"), (3, 17, "same")]


def test_ties_don_t_depend_on_order(spark):
    a, b = deduplicate(feed(spark, DATA), "id", ["at"]), deduplicate(feed(spark, DATA[::-1]).repartition(3), "id", ["at"])
    assert rows(a, "id", "seq", "body") == rows(b, "id", "seq", "body")


def test_surplus_is_the_rest(spark):
    df = feed(spark, DATA[:-1])
    assert rows(surplus(df, "id", ["seq"], "seq"), "seq") == [(11,), (12,), (14,)]
    assert rows(surplus(df, "id", ["at"], "seq"), "seq") == [(10,), (12,), (13,)]


def test_batches_merge(spark):
    whole = deduplicate(feed(spark, DATA), "id", ["at", "seq"])
    first = deduplicate(feed(spark, DATA[:2]), "id", ["at", "seq"])
    assert rows(merge_batch(first, feed(spark, DATA[2:]), "id", ["at", "seq"]), "id", "seq") == rows(whole, "id", "seq")


def test_a_message_with_very_many_copies(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS id", "id AS seq", "repeat('x', 100) AS body")
    out = deduplicate(df, "id", ["seq"])
    assert out.count() == df.select("id").distinct().count() and out.filter("id = 7").first().seq == 0


def test_empty(spark):
    assert rows(deduplicate(feed(spark, []), "id", ["at"]), "id") == []
    assert rows(surplus(feed(spark, []), "id", ["at"], "seq"), "id") == []
