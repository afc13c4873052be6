import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from millrace.llm.repetition import adaptive_thresholds, flag_repetitive, group_thresholds, repetition, share_sketches


def brute(ws, n=4):
    runs = {}
    for i in range(len(ws) - n + 1):
        runs.setdefault(tuple(ws[i : i + n]), []).append(i)
    return len({i + k for at in runs.values() if len(at) > 1 for i in at for k in range(n)})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=20))
def test_against_brute_force(spark, docs):
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id int, text string").coalesce(1)
    assert rows(repetition(df, ["id"]), "id", "words", "repeated") == [(i, len(d), brute(d)) for i, d in enumerate(docs)]


def test_null_empty_long_and_clashing(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "a b c d " * 50_000, "k"), (4, "A b, C d. a <b>B</b> c&nbsp;d", "k"), (4, "x", None)], "id int, text string, k0 string")
    assert rows(repetition(df, ["id", "k0"])) == [(1, "k", 0, 0, 0.0), (2, "k", 0, 0, 0.0), (3, "k", 200_000, 200_000, 1.0), (4, None, 1, 0, 0.0), (4, "k", 8, 8, 1.0)]
    assert rows(repetition(df.limit(0), ["id"])) == []
    with pytest.raises(ValueError):
        repetition(df.withColumn("words", F.lit(1)), ["words"])


def test_thresholds_adapt(spark):
    low = [("en", "a", i / 1000) for i in range(300)]
    high = [("de", "a", 0.3 + i / 2000) for i in range(300)]
    few = [("fr", "b", 0.9)] * 3
    s = share_sketches(spark.createDataFrame(low + high + few, "lang string, source string, share double"), ["lang", "source"])
    every = sorted(x for *_, x in low + high + few)

    def blend(own, n, above):
        return above + (own - above) * n / (n + 200)

    got = {r.lang: (r.documents, r.threshold) for r in adaptive_thresholds(s, ["lang", "source"], quantile=0.9).collect()}
    common = every[-(-len(every) * 9 // 10) - 1]
    assert {k: n for k, (n, _) in got.items()} == {"en": 300, "de": 300, "fr": 3}
    assert abs(got["en"][1] - blend(0.269, 300, blend(0.269, 300, common))) < 1e-6
    assert abs(got["de"][1] - blend(0.4345, 300, blend(0.4345, 300, common))) < 1e-6
    assert abs(got["fr"][1] - blend(0.9, 3, blend(0.9, 3, common))) < 1e-6
    tight = {r.lang: r.threshold for r in adaptive_thresholds(s, ["lang", "source"], quantile=0.9, floor=0.33, ceiling=0.4).collect()}
    assert tight["en"] == 0.33 and tight["de"] == 0.4
    with pytest.raises(ValueError):
        adaptive_thresholds(s, [])


def test_small_groups_fall_back_on_their_language_by_degrees(spark):
    """Sources of one language with own quantile 0.4, another language with 0.2: no step as a source grows."""
    sizes = (1, 20, 100, 199, 200, 201, 2000)
    data = [("x", f"s{n}", 0.4) for n in sizes for _ in range(n)] + [("y", "a", 0.2)] * 60_000
    s = share_sketches(spark.createDataFrame(data, "lang string, source string, share double"), ["lang", "source"])
    got = {r.source: r.threshold for r in adaptive_thresholds(s, ["lang", "source"], quantile=0.9).collect()}
    lang = 0.2 + 0.2 * sum(sizes) / (sum(sizes) + 200)
    assert all(abs(got[f"s{n}"] - (lang + (0.4 - lang) * n / (n + 200))) < 1e-6 for n in sizes) and got["a"] == 0.2


def test_sketches_of_loads_merge(spark):
    df = spark.range(1000).selectExpr("'en' AS lang", "'a' AS source", "id / 1000 AS share")
    parts = share_sketches(df.filter("share < 0.5"), ["lang", "source"]).union(share_sketches(df.filter("share >= 0.5"), ["lang", "source"]))
    merged = parts.groupBy("lang", "source").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    assert abs(adaptive_thresholds(merged, ["lang", "source"], 0.5).first().threshold - 0.5) < 0.03


def test_flags(spark):
    data = [(i, "EN " if i % 2 else "en", "board", f"word{i} other{i} thing{i} stuff{i} more{i}") for i in range(40)] + [(100, None, None, "a b c d e " * 9), (101, "en", "board", "spam is here now " * 10)]
    df = spark.createDataFrame(data, "id int, lang string, source string, text string").withColumn("threshold", F.lit(1))
    out = flag_repetitive(df, ["id"], quantile=0.9, least=5)
    assert rows(out, "id", "lang_key", "source_key") == [(100, "und", ""), (101, "en", "board")]
    assert rows(flag_repetitive(df.limit(0), ["id"])) == []


def test_names_of_the_result(spark):
    df = spark.createDataFrame([(1, "en", "b", "x y", "k", 9.0)], "id int, lang string, source string, text string, lang_key string, threshold double")
    assert rows(flag_repetitive(df, ["id"])) == [] and rows(group_thresholds(df)) == [("en", "b", 1, 0.0)]
    for taken in ("lang_key", "threshold", "share"):
        with pytest.raises(ValueError):
            flag_repetitive(df.withColumnRenamed("id", taken) if taken == "share" else df, [taken])


def test_planted_groups_with_habits_of_their_own(spark):
    """Verses repeat by habit, prose doesn't: the same share stands out in one source alone."""
    def doc(i, k):
        return " ".join(f"w{i}x{j}" for j in range(40)) + f" la{i} li lo lu" * k

    data = [(i, "en", "verse", doc(i, 5)) for i in range(600)] + [(1000 + i, "en", "prose", doc(i, 0)) for i in range(600)]
    data += [(5000, "en", "verse", doc(1, 5)), (5001, "en", "prose", doc(1, 5)), (5002, "en", "verse", doc(2, 60))]
    df = spark.createDataFrame(data, "id int, lang string, source string, text string")
    out = {r.id for r in flag_repetitive(df.filter("id < 5 or id >= 1000 or id % 2 = 0"), ["id"], quantile=0.99, least=1).collect()}
    assert {5001, 5002} <= out and not any(1000 <= i < 5000 for i in out)
    limits = {r.source_key: r.threshold for r in group_thresholds(df, quantile=0.95).collect()}
    assert limits["verse"] > limits["prose"]
