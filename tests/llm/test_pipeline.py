"""The pipeline against a plain version of each stage, on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import mixing, quality_trees, registry

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fingerprint(text):
    w = words_of(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """What each stage leaves, as rows; the documents before them first."""
    place = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        out.append((name, docs.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    return [rows for _, rows in out]


def test_quality_stage(spark, tables):
    scored = {r["doc_id"]: r["score"] for r in quality_trees.query(spark, SF).collect()}
    assert {r["doc_id"] for r in tables[1]} == {d for d, s in scored.items() if s >= 0.7}


def test_exact_stage(tables):
    last = {}
    for r in tables[1]:
        last[lower(r["text"])] = max(last.get(lower(r["text"]), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in tables[2]) == sorted(last.values())


def test_near_stage(tables):
    rows = sorted(tables[2], key=lambda r: r["doc_id"])
    fps = [fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert sorted(r["doc_id"] for r in tables[3]) == [rows[g]["doc_id"] for g in sorted(set(group))]


def test_mixing_stage(spark, tables):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(tables[3], spark.read.parquet(f"{SF}/documents.parquet").schema)).collect()}
    got = Counter(r["doc_id"] for r in tables[4])
    size, target = defaultdict(int), defaultdict(int)
    for r in tables[3]:
        size[r["source"]] += len(words_of(r["text"]))
    for r in tables[4]:
        target[r["source"]] += len(words_of(r["text"]))
    assert set(got) <= set(want) and max(got.values()) <= 3
    assert abs(sum(target.values()) - sum(size.values())) < 0.05 * sum(size.values())


def test_codec_stage(tables):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in tables[4]}
    assert len(tables[5]) == len(tables[4])
    for r in tables[5]:
        ids = sp.encode(text[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text", "en", "a", 9), (3, "same text", "en", "a", 9), (None, "SAME text", "en", None, 9), (4, "far " * 30000, "en", "b", 5)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, schema)
        for extra in ("row", "digest", "size", "copies", "fp", "score"):
            docs = docs.withColumn(extra, F.lit("clash"))
        out = stage(spark, docs, SF)
        assert out.count() <= 3 * len(rows)
        if name != "sentencepiece_codec":
            assert out.columns == docs.columns


def test_names_are_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) <= set(names)
