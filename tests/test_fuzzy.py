"""Fuzzy scores of many texts at once against one at a time, bounds of the score, and pages that score few rows."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import fuzzy, search
from threadloom.sources.tables import MESSAGES, shaped

ALPHABETS = ["abAB -_.1", "carogtCR /", "eéÉé nN\r\n", "かが한글 aA", "तिa ‍👩👨1 "]
QUERIES = ["ab", "abc", "cargo tst", "a1", "-a.", "en n", "が한", "1a1", "é", "ति"]


def texts(count, seed, longest=40):
    r = random.Random(seed)
    out = [None, "", " ", "a", "\r\n", "Cargo test", "my_cargoTest1 cargo-test", "x" * 300 + "ab"]
    for _ in range(count):
        out.append("".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.randrange(longest))))
    return out


@pytest.mark.parametrize("slice_size", [fuzzy.SLICE, 50])
def test_many_at_once_equal_one_at_a_time(monkeypatch, slice_size):
    monkeypatch.setattr(fuzzy, "SLICE", slice_size)
    given = texts(400, 1)
    for q in QUERIES:
        assert fuzzy.match_all(q, given) == [fuzzy.match(q, t) for t in given], q
    assert fuzzy.match_all("ab", []) == [] and fuzzy.match_all("ab", [None, ""]) == [None, None]


def test_clusters_are_the_units():
    # the mark belongs to its letter: no gap after it, and the range covers it
    marked, plain = fuzzy.match("cafes", "cafés"), fuzzy.match("cafes", "cafes")
    assert marked == (plain[0], [0, 1, 2, 3, 4, 5]) and fuzzy.match("cafes", "cafés")[0] == plain[0]
    assert fuzzy.match("xy", "x‍́ y")[1] == [0, 1, 2, 4]
    # letters of other scripts are members too, and syllables aren't taken apart
    assert fuzzy.match("한글", "한국 글") is not None and fuzzy.match("한글", "학교 글") is None


def test_simple_texts_have_a_cluster_each():
    r = random.Random(6)
    plain = [chr(c) for c in range(0xD800) if fuzzy.SIMPLE.fullmatch(chr(c))] + [chr(c) for c in range(0xE000, 0x10000) if fuzzy.SIMPLE.fullmatch(chr(c))]
    r.shuffle(plain)
    text = "".join(plain).replace("\r\n", "\n")
    assert len(fuzzy.clusters(text)) == len(text) + 1 and fuzzy.single(text)


def test_members(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(600, 2))], "i int, t string")
    for q in QUERIES:
        rows = df.select("t", fuzzy.membership(q, F.col("t")).alias("m")).collect()
        # where letters have no marks of their own, members are just the texts with a score
        plain = [r for r in rows if r.t is None or fuzzy.single(r.t)]
        assert [r.m for r in plain] == [fuzzy.match(q, r.t) is not None for r in plain] and any(r.m for r in rows), q


def messages(spark, given):
    rows = [(i, f"s{i % 7}", i // 7, "user", "conversation", t) for i, t in enumerate(given)]
    return shaped(spark.createDataFrame(rows, "id long, session_id string, seq long, role string, kind string, content string"), MESSAGES)


def test_page_equals_scoring_one_by_one(spark):
    given = texts(300, 3, 60) + ["cargo test"] * 20 + ["run cargo tst"] * 3
    rows = messages(spark, given)
    place = lambda i: (f"s{i % 7}", i // 7)
    for q in ["abc", "cargo tst", "en n"]:
        found = [(fuzzy.match(q, t), t, i) for i, t in enumerate(given)]
        best = sorted((-f[0], q.lower() not in t.lower(), *place(i), f[1]) for f, t, i in found if f)
        for limit, offset in [(5, 0), (5, 4), (900, 0)]:
            r = search.SearchRequest(query=q, mode="fuzzy", limit=limit, offset=offset)
            got = search.page(search.matching(rows, r), r).select("fuzzy_score", "session_id", "seq", "fuzzy_places").collect()
            assert [(-x.fuzzy_score, x.session_id, x.seq, x.fuzzy_places) for x in got] == [(s, k, n, p) for s, _, k, n, p in best[offset : offset + limit + 1]], (q, limit, offset)
    r = search.SearchRequest(query="cargo tst", mode="fuzzy", limit=2)
    assert [x.field_text for x in search.search(rows, r).rows] == ["run cargo tst"] * 2


def test_no_rows_and_null_keys(spark):
    r = search.SearchRequest(query="abc", mode="fuzzy", limit=3)
    assert search.search(messages(spark, ["zzz", None]), r).rows == []
    assert search.search(messages(spark, ["abc"]).limit(0), r).rows == []
    rows = messages(spark, ["abc", "abc", "abc", "abc", "abc"]).withColumn("session_id", F.lit(None).cast("string"))
    assert [x.seq for x in search.search(rows, r).rows] == [0, 0, 0]


def test_ranges_cover_whole_clusters(spark):
    marked = "the cafe\u0301s"
    row = search.search(messages(spark, [marked]), search.SearchRequest(query="cafes", mode="fuzzy", limit=1)).rows[0]
    assert [tuple(x) for x in row.match_ranges] == [(4, 10)] and marked[row.match_start : row.match_end] == "cafe\u0301s"
