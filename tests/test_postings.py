"""Stored posting lists: the code, the crossing, and searches that read only the blocks of their terms."""

import json
import os
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import patterns
from threadloom.operators import search
from threadloom.sources import postings
from threadloom.sources.tables import MESSAGES, shaped
from threadloom.streaming import ingest


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**62), unique=True, max_size=40), max_size=12))
def test_code(lists):
    lists = [sorted(x) for x in lists]
    coded = postings.encode(pa.array(lists, pa.list_(pa.int64()))).to_pylist()
    assert [postings.decode(x).tolist() for x in coded] == lists


def test_code_is_small():
    dense = pa.array([list(range(10_000, 60_000))], pa.list_(pa.int64()))
    assert len(postings.encode(dense)[0].as_py()) == 50_001


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60)), min_size=1, max_size=5))
def test_cross(sets):
    got = postings.cross([np.array(sorted(s), dtype=np.int64) for s in sets])
    assert got.tolist() == sorted(set.intersection(*sets))


def corpus(spark, n=400):
    rnd = random.Random(4)
    words = "permission denied granted here per mission ÀÉ foo bar baz1 Istanbul".split()
    rows = [(i, f"s{i % 9}", i, " ".join(rnd.choices(words, k=rnd.randint(0, 7))) if i % 50 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, session_id string, seq long, content string")
    return shaped(df.selectExpr("*", "'user' AS role", "'conversation' AS kind"), MESSAGES)


REQUESTS = [
    search.SearchRequest(query="PERMISSION d"), search.SearchRequest(query="ission d|granted", mode="regex"), search.SearchRequest(query="(?:foo|bar) baz[0-9]", mode="regex"), search.SearchRequest(query="(?i)ISTAN|zzz", mode="regex"),
    search.SearchRequest(query="(foo |bar )+here", mode="regex"), search.SearchRequest(query="d"), search.SearchRequest(query="p.*d", mode="regex"), search.SearchRequest(query="nowhere"), search.SearchRequest(query="pmd", mode="fuzzy", limit=5),
]


def ids(df):
    return sorted(x["id"] for x in df.select("id").collect())


@pytest.mark.parametrize("block", [1 << 16, 8])
def test_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(postings, "BLOCK", block)
    m = corpus(spark)
    postings.build(m.repartition(3), str(tmp_path / "index"))
    rows, lists = postings.opened(spark, str(tmp_path / "index"))
    assert lists.agg(F.max("n")).first()[0] <= block
    hits = 0
    for r in REQUESTS:
        want = ids(search.matching(m, r))
        assert ids(search.indexed(rows, lists, r)) == want, r
        hits += len(want)
    assert hits > 100
    assert postings.candidates(lists.limit(0), [["abc"]]).count() == 0


def test_only_blocks_of_the_terms_are_read(spark, tmp_path):
    """The filter on terms is pushed to the scan, and most row groups cannot hold the terms asked for."""
    rnd = random.Random(2)
    rows = [(i, "s", i, "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, session_id string, seq long, content string")
    monkey = postings.ROW_GROUP_BYTES
    postings.ROW_GROUP_BYTES = 1 << 14
    try:
        postings.build(shaped(df.selectExpr("*", "'user' AS role", "'conversation' AS kind"), MESSAGES), str(tmp_path / "index"))
    finally:
        postings.ROW_GROUP_BYTES = monkey
    _, lists = postings.opened(spark, str(tmp_path / "index"))
    wanted = patterns.literal_trigrams("qzx7")
    plan = postings.candidates(lists, [wanted])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan
    total = read = 0
    for f in Path(tmp_path / "index/postings").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for i in range(meta.num_row_groups):
            s = meta.row_group(i).column(0).statistics
            total += 1
            read += any(s.min <= t <= s.max for t in wanted)
    assert total >= 20 and read <= len(wanted) * 2


def line(session, i, text):
    return json.dumps({"sessionId": session, "cwd": "/w", "type": "user", "timestamp": f"2026-06-01T10:00:{i:02d}Z", "message": {"role": "user", "content": text}}) + "\n"


def test_lists_follow_the_store(spark, tmp_path):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()

    def put(name, lines, when):
        (folder / name).write_text("".join(lines))
        os.utime(folder / name, (when, when))

    def check():
        found = {}
        for q in (search.SearchRequest(query="needle"), search.SearchRequest(query="(?:foo|bar)baz[0-9]", mode="regex"), search.SearchRequest(query="x")):
            got = sorted((r.session_id, r.seq, r.content) for r in ingest.search_stored(spark, store, q).collect())
            assert got == sorted((r.session_id, r.seq, r.content) for r in search.matching(ingest.stored(spark, store, "messages"), q).collect())
            found[q.query] = len(got)
        return found

    a, b = [line("A", 0, "a needle"), line("A", 1, "foobaz1")], [line("B", 0, "no such thing")]
    put("A.jsonl", a, 1000)
    put("B.jsonl", b, 1000)
    ingest.refresh(spark, {"claude": str(folder)}, store)
    assert check() == {"needle": 1, "(?:foo|bar)baz[0-9]": 1, "x": 0}
    put("A.jsonl", [*a, line("A", 2, "more needles, x")], 2000)  # grows
    put("B.jsonl", [line("B", 5, "barbaz2 instead")], 2000)  # is replaced
    ingest.refresh(spark, {"claude": str(folder)}, store)
    assert check() == {"needle": 2, "(?:foo|bar)baz[0-9]": 2, "x": 1}
    ingest.compact(spark, store)
    assert check() == {"needle": 2, "(?:foo|bar)baz[0-9]": 2, "x": 1}
    ingest.vacuum(spark, store, keep=1)
    assert check()["needle"] == 2 and len(list(Path(store, "_lists").iterdir())) == 1


def test_no_batch_holds_wide_lists(spark, tmp_path, monkeypatch):
    """Workers get single postings and coded pieces of bounded lists, never arrays of numbers; the lists are those of the rows."""
    plan = postings.posting_rows(spark.range(10).select(F.col("id").alias("doc"), F.lit("some text").alias("content")))._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    monkeypatch.setattr(postings, "HELD", 50)
    rnd = random.Random(9)
    given = [("".join(rnd.choices("abé", k=3)), d >> 6, d) for d in rnd.sample(range(1000), 900)] + [("zzz", 2**40 >> 6, 2**40)]
    kinds = pa.schema([("term", pa.string()), ("block", pa.int64()), ("doc", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in given[i : i + 7]], kinds) for i in range(0, len(given), 7)]
    made = [r for p in postings.pieces(iter(batches)) for r in p.to_pylist()]
    assert sum(r["n"] for r in made) == len(given) and max(r["n"] for r in made) <= 56
    made.sort(key=lambda r: (r["term"], r["block"], r["first"]))
    coded = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("docs", pa.binary())])
    sorted_batches = [pa.RecordBatch.from_pylist([{c: r[c] for c in coded.names} for r in made[i : i + 11]], coded) for i in range(0, len(made), 11)]
    got = [(r["term"], r["block"], r["n"], postings.decode(r["docs"]).tolist()) for p in postings.joined(iter(sorted_batches)) for r in p.to_pylist()]
    want = {}
    for term, block, doc in given:
        want.setdefault((term, block), []).append(doc)
    assert got == [(t, b, len(d), sorted(d)) for (t, b), d in sorted(want.items())]
    assert list(postings.joined(iter([]))) == [] and list(postings.pieces(iter([]))) == []
