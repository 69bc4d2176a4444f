"""Packs against the tokenizer itself; plans place every piece once and leave little padding."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_model())


def check(rows, docs, size=2048, end_id=1, most=None):
    """``rows`` hold the ids of ``docs`` piece by piece, in sequences without gaps; padding over all ids padded."""
    t = tokenizer()
    want = sorted(([*t.encode(text or "", add_special_tokens=False).ids, end_id], doc_id) for doc_id, text in docs)
    by_doc, by_seq = {}, {}
    for r in rows:
        assert 0 < r["length"] <= size and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r["length"]
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    got = []
    for (doc_id, n), parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        same = sum(r.start == 0 for r in parts)  # rows alike in id and length
        if same > 1:
            continue
        assert [r.start for r in parts] == np.cumsum([0, *(r["length"] for r in parts)])[:-1].tolist()
        ids = [i for r in parts for i in r.ids]
        assert len(ids) == n
        got.append((ids, doc_id))
    alone = [w for w in want if sum(x[1] == w[1] and len(x[0]) == len(w[0]) for x in want) == 1]
    assert sorted(got) == alone
    assert sum(r["length"] for r in rows) == sum(len(w[0]) for w in want)
    pads = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        ends = np.cumsum([0, *(r["length"] for r in parts)]).tolist()
        assert [r.offset for r in parts] == ends[:-1] and ends[-1] <= size
        pads += packing.padding(size - ends[-1], size)
    total = sum(r["length"] for r in rows) + pads
    assert most is None or pads <= most * total + size
    return pads


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = packing.pack(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    check(rows, docs, most=0.01)
    got = packing.query(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() == len(rows)


ODD = ["", None, " ", "  two  blanks ", "a <|endoftext|> b<|endoftext|>", "é è", "x\n y", "日本 語　 文", "word " * 9000, "z" * 9000, "end ", " lead", "tab\t x", "  nb"]


def test_edges(spark):
    rng = np.random.default_rng(2)
    docs = list(enumerate(ODD)) + [(100 + i, " ".join(rng.choice(["one", "Two", "été", "3"], int(rng.integers(1, 900))))) for i in range(120)] + [(None, "null id"), (None, "null id again")]
    docs += [(9, "again"), (9, "again")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, length int, doc_key string")
    check(packing.pack(df).collect(), docs, most=0.02)
    check(packing.pack(df, size=64).collect(), docs, size=64, most=0.02)
    assert packing.pack(df.limit(0)).collect() == []


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(packing, "PART_BYTES", 7)
    e = packing.Encoder(packing.default_model())
    t = tokenizer()
    for text in [x for x in ODD if x]:
        assert e.whole(text).tolist() == t.encode(text, add_special_tokens=False).ids
    flat, ends = e.ids(pa.array([x or "" for x in ODD]))
    for i, text in enumerate(ODD):
        assert flat[ends[i] : ends[i + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids


def plain_padding(histogram, size):
    total = sum(k * n for k, n in histogram.items())
    return -(-total // size) * size - total


@pytest.mark.parametrize("seed", range(12))
def test_plans(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([16, 64, 2048]))
    histogram = {int(k): int(rng.integers(1, 10 ** int(rng.integers(1, 6)))) for k in rng.integers(1, size + 1, int(rng.integers(1, 40)))}
    if seed % 3 == 0:
        histogram = {size * 55 // 100: 1000, **({size // 3: 7} if seed % 2 else {})}
    plan = packing.Plan(histogram, size)
    places = []
    for length, n in histogram.items():
        rank = np.unique(np.concatenate([np.arange(min(n, 3000)), np.arange(max(0, n - 300), n)]))
        row, at = plan.place(np.full(len(rank), length), rank)
        assert (np.bincount(row, weights=at[:, 2]) == length).all()
        places.append(at)
    at = np.concatenate(places)
    assert (at[:, 3] + at[:, 2] <= size).all() and (at[:, 0] < plan.sequences).all() and (at[:, 0] >= 0).all()
    if max(histogram.values()) <= 3000:
        order = np.lexsort((at[:, 3], at[:, 0]))
        s, o, n = at[order, 0], at[order, 3], at[order, 2]
        same = s[1:] == s[:-1]
        assert (o[1:][same] == (o + n)[:-1][same]).all() and (o[1:][~same] == 0).all()
        held = np.bincount(s, weights=n).astype(int)
        pads = sum(packing.padding(size - h, size) for h in held.tolist())
        assert pads <= plain_padding(histogram, size) + packing.SLACK * plan.sequences * size + size


def test_shortest_pack_first_takes_the_emptiest_pack():
    packs = packing.pack_histogram({10: 2, 9: 1, 5: 2, 1: 3}, 16)
    assert sum(p.count * (16 - p.room) for p in packs) == 20 + 9 + 10 + 3
    assert {tuple(p.parts): p.count for p in packs if p.parts[0][0] == 9} == {((9, 1), (5, 1)): 1}
    assert {tuple(p.parts) for p in packs if p.parts[0][0] == 10} == {((10, 1), (5, 1)), ((10, 1), (1, 3))}


def test_big_histogram_is_quick():
    import time

    began = time.perf_counter()
    plan = packing.Plan({k: 10**9 // k for k in range(1, 2049)})
    assert time.perf_counter() - began < 30 and len(plan.keys) < 100_000
