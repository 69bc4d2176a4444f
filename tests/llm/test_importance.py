"""Importance resampling against counting feature by feature, and the radix selection against sorting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text):
    words = WORD.findall(lower(text))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature, m=10_000):
    return zlib.crc32(feature.encode()) % m


def brute(docs, target, share=(5, 100), least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))

    rows = []
    for i, (doc_id, text) in enumerate(docs):
        words, found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    pool = [r for r in rows if r[4] >= least]
    pool.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = pool[: share[0] * len(pool) // share[1]]
    rank = {id(r): n + 1 for n, r in enumerate(drawn)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert result(importance.query(spark, folder)) == brute(docs, target)


def test_edges(spark):
    rng = np.random.default_rng(5)
    words = ["Foo", "bar", "İstanbul", "ß", "x" * 5000, "été", "a1", " ", "mot", "ZULU"]
    texts = [None, "", " \t", "?!", "one", "A-B_c{d", "\x7f\x00", "日本 語"]
    texts += [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(150)]
    docs = [(None if i % 17 == 3 else int(i) - 80, t) for i, t in enumerate(texts)]
    docs += [(-7, "same words here " * 9), (-7, "same words here " * 9), (2**62, "far away id " * 10), (-(2**62), "far away id " * 10)]
    target = ["Foo bar mot", None, "été a1 " * 40]
    df = spark.createDataFrame([(*d, 0, "k", 1) for d in docs], "doc_id bigint, text string, weight int, doc_key string, rank int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, aim, share=(30, 100))
    assert result(got) == brute(docs, target, (30, 100))
    empty = importance.resample(df.limit(0), aim)
    assert empty.collect() == []
    assert sorted(r.weight for r in importance.resample(df.limit(2), aim.limit(0)).collect())[0] == 0


def test_hashes_of_long_words():
    texts = ["a" * 70_000 + " b " + "c" * 123, "x", ""]
    runs = importance.Runs(pa.array(texts))
    got = sorted(int(c) for _, part in runs.hashes() for c in part)
    assert got == sorted(zlib.crc32(f.encode()) for t in texts for f in features(t)[1])


@pytest.mark.parametrize("k", [0, 1, 2, 499, 500, 1500, 2999, 3000, 4000])
def test_radix_selection(spark, k):
    df = spark.range(3000).select(
        (F.lit(2**62) - F.col("id") % 3).alias("k0"), F.expr("CASE WHEN id % 5 = 0 THEN 0 ELSE (id * 7919) % 100000000000 END").alias("k1"), (F.col("id") << 33 if False else F.col("id") * F.lit(2**33)).alias("k2")
    )
    rows = sorted(tuple(r) for r in df.collect())
    bound = importance.kth_key(df, k, digit=5) if k else [-1, -1, -1]
    got = df.filter(importance.up_to(df.columns, bound)) if bound else df
    assert sorted(tuple(r) for r in got.collect()) == rows[:k]


def test_ranks_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select((F.lit(1000) - F.col("id")).alias("k"), F.col("id").alias("n"))
    got = importance.ranked(df, ["k"], "n")
    assert all(r["rank"] == 1000 - r.n for r in got.collect())
