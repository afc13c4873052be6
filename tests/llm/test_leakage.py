import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from millrace.llm.leakage import SEED, Index, SeedFilter, leaks, matched_parts, tile
from millrace.llm.words import PIECE, plain, windows, word_hashes


def brute(doc, item, least):
    """Greedy string tiling by trying all places."""
    d, t, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best, found = least, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and t[i + k] and d[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((j, i))
        if not found:
            return tiles
        for j, i in found:
            if all(t[i : i + best]) and all(d[j : j + best]):
                t[i : i + best] = d[j : j + best] = [False] * best
                tiles.append((j, i, best))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=18), st.integers(1, 4))
def test_tiles_against_brute_force(doc, item, least):
    code = np.random.default_rng(0).integers(0, 2**63, 4, dtype=np.uint64)
    got = tile(code[np.array(doc, int)], code[np.array(item, int)], least)
    want = brute(doc, item, least)
    assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
    marked = [q + k for q, _, n in got for k in range(n)], [p + k for _, p, n in got for k in range(n)]
    assert all(len(m) == len(set(m)) for m in marked) and all(doc[q : q + n] == item[p : p + n] for q, p, n in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 2), max_size=30))
def test_matched_parts_hold_all_tiles(doc, item):
    code = np.random.default_rng(0).integers(0, 2**63, 3, dtype=np.uint64)
    d, t = code[np.array(doc, int)], code[np.array(item, int)]
    index = Index([t])
    places, seeds = index.seeds(windows(d, SEED))
    got = tile(matched_parts(d, places), t, SEED) if len(places) else []
    assert sorted(n for *_, n in got) == sorted(n for *_, n in tile(d, t, SEED))
    if any(n >= 13 for *_, n in got) or got and sum(n for *_, n in got) * 2 >= len(t):
        assert index.candidates(np.unique(seeds)) == [0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=25), min_size=1, max_size=8), st.lists(st.integers(0, 2), max_size=60))
def test_no_pair_is_lost_among_many_items(items, doc):
    """Seeds that many items share are no entries, yet whatever meets a condition is a candidate."""
    code = np.random.default_rng(1).integers(0, 2**63, 3, dtype=np.uint64)
    d, t = code[np.array(doc, int)], [code[np.array(i, int)] for i in items]
    index = Index(t)
    got = index.candidates(np.unique(index.seeds(windows(d, SEED))[1])) if len(d) else []
    for i, item in enumerate(t):
        n = [k for *_, k in tile(d, item, min(SEED, len(item)))]
        if len(item) >= SEED and (any(k >= 13 for k in n) or sum(n) * 2 >= len(item)):
            assert i in got
        assert (i in list(index.whole(d))) == (len(item) < SEED and bool(n))


def test_a_passage_of_all_items_is_no_entry():
    common = np.arange(1, 12, dtype=np.uint64)
    own = [np.concatenate([common, np.arange(1000 * i, 1000 * i + 60, dtype=np.uint64)]) for i in range(1, 50)]
    index = Index(own)
    assert index.candidates(index.seeds(windows(common, SEED))[1]) == []
    assert index.candidates(np.unique(index.seeds(windows(own[7][:20], SEED))[1])) == [7]


def test_the_filter_never_denies_a_seed():
    rng = np.random.default_rng(5)
    items = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 3, 5, 40, 2000)]
    known = SeedFilter(sum(map(len, items)))
    known.add(items)
    assert known.lengths == {1, 3, 5}
    assert all(len(known.holds(windows(v, min(len(v), SEED)))) == max(1, len(v) - SEED + 1) for v in items)
    assert len(known.holds(rng.integers(0, 2**63, 100_000, dtype=np.uint64))) < 200


def test_very_repetitive_texts_stay_cheap():
    a, b = np.full(200_000, 7, np.uint64), np.full(3000, 7, np.uint64)
    assert tile(a, b, 5) == [(0, 0, 3000)]


W = [f"w{i}" for i in range(60)]
ITEMS = [(1, " ".join(W[:30])), (2, " ".join(W[30:60])), (3, "tiny item"), (4, None), (5, ""), (6, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]
DOCS = [
    (10, "x y " + " ".join(W[:13]) + " z"), (11, "x " + " ".join(W[:12]) + " z"), (12, " ".join(W[15:30] + ["q"] + W[:15])), (13, None), (14, ""),
    (15, "<b>ONE</b>, two&nbsp;three [i]four[/i] five; six > seven eight\nnine - ten 'eleven' twelve &#8230; Thirteen!"), (16, "tiny item"),
    (17, " ".join(" ".join(W[30 + 6 * k : 36 + 6 * k]) + " - zz" for k in range(5))), (18, "pad " * 50_000 + " ".join(W)), (10, "x y " + " ".join(W[:13]) + " z"),
]


def run(spark, docs=DOCS, items=ITEMS, **kw):
    d = spark.createDataFrame([(i, t, "a", 0) for i, t in docs], "doc_id long, text string, id string, item_id int")
    e = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc long")
    return rows(leaks(d, e, **kw), "doc_id", "item_id", "longest", "tiles", "matched")


WANT = [(10, 1, 13, 1, 13), (10, 1, 13, 1, 13), (12, 1, 15, 2, 30), (15, 6, 13, 1, 13), (16, 3, 2, 1, 2), (17, 2, 6, 5, 30), (18, 1, 30, 1, 30), (18, 2, 30, 1, 30)]


def test_leaks(spark):
    assert run(spark) == WANT


def test_items_in_blocks(spark):
    assert run(spark, block_words=20) == WANT


def test_many_blocks_read_the_corpus_once(spark, tmp_path):
    """Texts are touched by one job alone, which the seed filter feeds."""
    items = [(i, " ".join(f"i{i}w{k}" for k in range(30))) for i in range(12)]
    docs = [(100 + i, f"start {t} end") for i, t in items] + [(1, "nothing of it")] * 30
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    texts = spark.read.parquet(str(tmp_path / "docs"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = texts.mapInArrow(count, texts.schema)
    out = leaks(counted, spark.createDataFrame(items, "item_id long, text string"), block_words=30)
    assert rows(out, "doc_id", "item_id", "longest") == [(100 + i, i, 30) for i in range(12)]
    assert seen.value == len(docs)


def test_an_item_of_four_words(spark):
    docs = [(1, "see what IS the [b]answer[/b] now"), (2, "what is an answer the"), (3, "what is the"), (4, "what is the answer. what is the answer")]
    assert run(spark, docs, [(9, "what is the answer"), (8, "what is the answer then")]) == [(1, 9, 4, 1, 4), (4, 9, 4, 1, 4)]


def test_runs_alone(spark):
    assert [r[:3] for r in run(spark, coverage=2.0)] == [(10, 1, 13), (10, 1, 13), (12, 1, 15), (15, 6, 13), (18, 1, 30), (18, 2, 30)]


def test_empty_tables(spark):
    assert run(spark, docs=[]) == [] and run(spark, items=[]) == [] and run(spark, items=ITEMS[3:5]) == []
    with pytest.raises(ValueError):
        run(spark, run=3)


def hashed(texts):
    out = []
    for first, flat, sizes in word_hashes(pa.array(texts, pa.string())):
        assert first == len(out)
        out += [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    return out


def test_words():
    text = "[quote=a b]Über <a href=\"http://x.y\n/z\">Straße</a>&amp;No_1 x&y 3.14 don't[/quote] < 5 and 6 > 7 &#x2019;é"
    want = ["über", "straße", "no", "1", "x", "y", "3", "14", "don", "t", "7", "é"]
    got, same, none, empty = hashed([text, " ".join(want).upper().replace("STRASSE", "STRAßE"), None, ""])
    assert len(got) == 12 and got == same and none == empty == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZÉé1٣ß<>[]&;#x _-\n世Я\0", max_size=30)), max_size=8))
def test_words_are_those_of_a_pattern(texts):
    want = [[w for w in re.findall(r"[^\W_]+", plain(t or "").lower())] for t in texts]
    names = {}
    for ws, hs in zip(want, hashed(texts), strict=True):
        assert len(ws) == len(hs) and all(names.setdefault(w, h) == h for w, h in zip(ws, hs))
    assert len(set(names.values())) == len(names)


def test_long_texts_and_long_words():
    long_word, end = "x" * (2 * PIECE + 5), "end"
    got = hashed(["ab " * PIECE, f"q {long_word} {end}", end, "q " + "é" * (PIECE + 1)])
    assert len(got[0]) == PIECE and len(set(got[0])) == 1
    assert len(got[1]) == 3 and got[1][2] == got[2][0] and got[1][0] == got[3][0] and len(got[3]) == 2
