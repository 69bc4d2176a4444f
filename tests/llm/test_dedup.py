"""Exact and near dedup against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import exact_dedup as X
from threadloom.llm import simhash as H

SCHEMA = "doc_id long, text string, kept string, row string"


def sample(n: int = 120) -> list[tuple]:
    rnd = random.Random(4)
    words = ["alpha", "Beta", "gamma", "É", "é", "delta", "\n", "omega"]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(n // 3)]
    rows = [(i, rnd.choice(base) if rnd.random() < 0.7 else " ".join(rnd.choice(words) for _ in range(40)), "x", "y") for i in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "x", "y"), (n + 2, "ALPHA", "", ""), (n + 3, "alpha", "", ""), (n + 4, "É", "", ""), (n + 5, "é", "", ""), (n + 6, "long " * 20000, "", "")]
    return rows


def norm(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    return {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("weak", [False, True])
def test_exact_classes(spark, weak):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    # a digest of one byte collides all the time: bytes must decide
    options = {"digest": lambda c: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(c), F.lit(5))), 2, "0"))} if weak else {}
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in X.dedup(df, **options).collect()}
    assert got == brute_exact(rows)


def test_exact_beyond_the_broadcast_bound(spark):
    rows = sample(60)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in X.dedup(spark.createDataFrame(rows, SCHEMA), screen_digests=0).collect()}
    assert got == brute_exact(rows)


def test_exact_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(7, "a"), (7, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    out = X.dedup(df).collect()
    assert len(out) == 4 and sum(r["kept"] for r in out) == 2
    assert {(r["doc_id"], r["keep_id"]) for r in out} == {(7, 7), (None, 7), (None, None)}
    assert X.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 40_000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = X.FuseFilter.load(X.FuseFilter.build(np.concatenate([keys, keys])).dump())
    assert f.contains(keys).all()
    if n > 100:
        assert f.contains(keys + np.uint64(12345)).mean() < 0.02
        # the published sizing rule, rounded up to whole segments
        factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
        assert n * factor <= len(f.table) < n * factor + f.segment


def test_batches_against_a_stored_snapshot(spark, tmp_path):
    rows = sample(90)
    old, new = rows[:50], rows[50:] + rows[10:20]
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    path = str(tmp_path / "snapshot")
    assert X.save_snapshot(frame(old), path, bucket_digests=8) > 1
    stored, fresh = defaultdict(list), defaultdict(list)
    for part, held in ((old, stored), (new, fresh)):
        for i, t, *_ in part:
            held[norm(t)].append(i)
    for _ in range(2):  # the filters outlive a batch
        got = {r["text_sha256"]: (r["batch_id"], r["n"], r["stored_id"]) for r in X.screen_batch(spark, path, frame(new)).collect()}
        assert got == {hashlib.sha256(t.encode()).hexdigest(): (max(ids), len(ids), max(stored[t]) if t in stored else None) for t, ids in fresh.items()}
    assert X.screen_batch(spark, path, frame(new).limit(0)).count() == 0
    empty = str(tmp_path / "empty")
    X.save_snapshot(frame(old).limit(0), empty)
    assert {r["stored_id"] for r in X.screen_batch(spark, empty, frame(new)).collect()} == {None}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", norm(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    best = {}
    for i, d in enumerate(ids):
        best[find(i)] = min(best.get(find(i), d), d)
    return {d: best[find(i)] for i, d in enumerate(ids)}


def near_rows():
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(80)] for _ in range(25)]
    rows = []
    for i in range(140):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    return rows + [(200, None), (201, ""), (202, "\n"), (203, "one"), (204, "ONE two"), (205, "x y z q r " * 9000)]


def test_near_components(spark):
    rows = near_rows()
    out = H.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [fingerprint(t) for _, t in rows]
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {i: f"{f:016x}" for (i, _), f in zip(rows, fps)}
    assert {r["doc_id"]: r["component_id"] for r in out} == brute_components([i for i, _ in rows], fps)
    assert H.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def chains(seed=2, centres=3, steps=120):
    """Fingerprints in chains around few centres, which share most of their blocks."""
    rnd = np.random.default_rng(seed)
    fps = set()
    for c in rnd.integers(0, 2**63, centres):
        x = int(c)
        for _ in range(steps):
            fps.add(x)
            x ^= 1 << int(rnd.integers(0, 63))
    return sorted(fps)


def subcube():
    """All fingerprints that differ in eight bits: every block but one is shared by all."""
    return sorted({(0x0123456789ABCD00 | i) - 2**63 for i in range(256)} | {5, 7, -1, -2})


@pytest.mark.parametrize(("fps", "hot", "levels"), [(chains(), 10, 1), (chains(), 10, 3), (subcube(), 20, 1), (subcube(), 20, 3)])
def test_near_hot_blocks(spark, fps, hot, levels):
    """Subtrees dealt out again and cut into pages lose no link."""
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in H.components(H.links(nodes, hot_nodes=hot, levels=levels)).collect()}
    plain = {r["node"]: r["root"] for r in H.components(H.links(nodes)).collect()}
    bits = [f % 2**64 for f in fps]
    want = brute_components(fps, bits)
    assert got == plain == {d: r for d, r in want.items() if any(d != o and ((d ^ o) % 2**64).bit_count() <= 4 for o in fps)}


def test_no_task_holds_a_hot_subtree(spark):
    fps = subcube()
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    rows = H.dealt(nodes.selectExpr("fp", "fp AS v", "0 AS fixed", "0L AS path"), 4)
    assert rows.groupBy("path", "top").count().agg(F.max("count")).first()[0] > 100
    hot = rows.filter("path = 1 AND top = 2066")  # what the cube shares: 0x812
    tasks = H.page_tasks(hot, 4, 16)
    assert tasks.groupBy("task").count().agg(F.max("count")).first()[0] <= 32
    again = H.dealt(rows, 4)
    kept = again.selectExpr("fp", "bit_count(fp ^ v) AS d", "bit_count(fp) - bit_count(v) AS same", "fixed").collect()
    assert len(kept) == 25 * len(fps) and all(r["same"] == 0 for r in kept)


@pytest.mark.parametrize("part_bytes", [1, 7, 64, 1 << 20])
def test_votes_of_long_texts_add_up(part_bytes):
    rnd = random.Random(part_bytes)
    texts = ["", " ", "one", "a b c", "a b c d", "A b C d é"] + ["".join(rnd.choice(["aa", "Bé", "c", " ", "\n", "\t "]) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    assert H.fingerprint_texts(texts, step=50, part_bytes=part_bytes).tolist() == [fingerprint(t) for t in texts]


@pytest.mark.parametrize("budget", [0, 2, 4])
def test_trie_join(budget):
    rnd = np.random.default_rng(budget)
    base = rnd.integers(0, 2**64, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(rnd.integers(0, 64))) ^ np.uint64(1 << int(rnd.integers(0, 64))) for _ in range(6)]))
    links = set()
    for start, width in H.blocks(budget):
        turned = H.rotate(values, start)
        a, b = H.task_forest(values, (turned >> np.uint64(64 - width)).astype(np.int64), turned, width, budget)
        links |= set(zip(a.tolist(), b.tolist()))
    joined = H.Forest(len(values))
    at = {v: i for i, v in enumerate(values.tolist())}
    joined.link(np.array([at[a] for a, _ in links], dtype=np.int64), np.array([at[b] for _, b in links], dtype=np.int64))
    brute = H.Forest(len(values))
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= budget)
    brute.link(i, j)
    assert np.array_equal(joined.roots(np.arange(len(values))), brute.roots(np.arange(len(values))))


@pytest.mark.parametrize("crowded,together", [(3, 7), (50_000, 1)])
def test_hot_keys_and_one_partition(spark, monkeypatch, crowded, together):
    """Nine of ten texts empty, one shuffle partition, and every key counted as crowded: the same classes."""
    rnd = random.Random(8)
    words = "a b c d e f g h".split()
    near = " ".join(rnd.choice(words) for _ in range(300))
    texts = [""] * 900 + [near] * 30 + [near.replace("a b", f"b {i}", 1) for i in range(30)] + [f"alone {i} " * 30 for i in range(40)]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    for module in (X, H):
        monkeypatch.setattr(module, "CROWDED_ROWS", crowded)
    monkeypatch.setattr(H, "TOGETHER", together)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        exact = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in X.dedup(df).collect()}
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in H.dedup(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert exact == brute_exact(rows)
    fps = [fingerprint(t) for t in texts]
    want = brute_components(list(range(len(texts))), fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(texts))}


def test_stored_bytes_decide(spark, tmp_path):
    """Digests that collide don't make a text of the batch one of the snapshot."""
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1).cast("binary")
    old = [(i, f"text {i}", "x", "y") for i in range(40)]
    new = [(100 + i, f"Text {i}", "x", "y") for i in range(20, 80)]
    path = str(tmp_path / "weak")
    X.save_snapshot(spark.createDataFrame(old, SCHEMA), path, bucket_digests=4, digest=weak)
    got = {r["batch_id"]: r["stored_id"] for r in X.screen_batch(spark, path, spark.createDataFrame(new, SCHEMA), digest=weak).collect()}
    assert got == {100 + i: i if i < 40 else None for i in range(20, 80)}
