"""Repairs against an exhaustive search of the edits, whole and in blocks."""

import hashlib
import re
import sys
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest

from threadloom.llm import conversation_repair as cr


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate <= 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text, fate == 0)] * (2 if fate == 3 else 1)
    return out


sys.setrecursionlimit(100_000)


def cheapest(faults, initials):
    """Least (cost, edits) over all edits, by plain recursion over (row, state)."""

    @lru_cache(None)
    def best(i, s, inserts):
        found = []
        if i == len(faults):
            if s in "0a":
                found.append((0, ""))
        due = "a" if s == "u" else "u"
        if inserts < 3:  # more in a row can be shortened by two
            c, e = best(i, due, inserts + 1)
            found.append((c + 2, "I" + e))
        if i < len(faults):
            c, e = best(i + 1, s, 0)
            found.append((c + 3, "D" + e))
            if faults[i] not in (1, 2):
                extra = int(faults[i] == 3)
                c, e = best(i + 1, due, 0)
                found.append((c + 2 + extra, "R" + e))
                if initials[i] == due or (initials[i] == "s" and s == "0"):
                    c, e = best(i + 1, initials[i], 0)
                    found.append((c + extra, "K" + e))
        return min(found, default=(10**9, ""))

    return best(0, "0", 0)


def brute(damaged):
    out = {}
    for conv in {r[0] for r in damaged}:
        rows = [r for r in damaged if r[0] == conv and not r[4]]
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for _, _, role, text, _ in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[2][:1] for r in rows]
        turns = {r[1] for r in rows} - {None}
        cost, edits = cheapest(tuple(faults), tuple(initials))
        lines, s, i = [], "0", 0
        for e in edits:
            due = "a" if s == "u" else "u"
            if e == "I":
                lines.append({"u": "user:", "a": "assistant:"}[due])
                s = due
                continue
            if e == "R":
                lines.append({"u": "user:", "a": "assistant:"}[due] + rows[i][3])
                s = due
            elif e == "K":
                lines.append(f"{rows[i][2]}:{rows[i][3]}")
                s = initials[i]
            i += 1
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, edits, sha)
    return out


def result(df):
    rows = df.select("conv_id", *cr.RESULT).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(cr.query(spark, folder)) == brute(brute_damage(rows))


def test_sql_says_the_same(tmp_path):
    """The recursive SQL against the plain recursion, over the table and over rows with nulls and ties."""
    con = duckdb.connect()
    for rows in ([tuple(r) for r in con.execute("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.01/conversations.parquet'").fetchall()], made(60, 24) + made(2, 60, 9)):
        con.execute("CREATE OR REPLACE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        found = con.execute(cr.ORACLE_SQL)
        assert [c[0] for c in found.description] == ["conv_id", *cr.RESULT]
        assert {r[0]: tuple(r[1:]) for r in found.fetchall()} == brute(brute_damage(rows))


def made(n_convs, longest, seed=3):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "no", "Why?", " ", "", None, "Well!\n ", "日本。", "a.b", "x" * 3000]
    rows = []
    for c in range(n_convs):
        for t in range(int(rng.integers(1, longest))):
            turn = None if rng.random() < 0.08 else int(t + rng.integers(0, 3))
            text = rng.choice(texts, p=[0.2, 0.1, 0.1, 0.05, 0.05, 0.1, 0.1, 0.1, 0.1, 0.1])
            extra = f" {rng.integers(0, 30)}." if rng.random() < 0.5 and text else ""
            rows.append((None if c == 0 else c, turn, rng.choice(roles, p=[0.35, 0.35, 0.1, 0.1, 0.05, 0.05]), None if text is None else text + extra))
    return rows


@pytest.mark.parametrize("block_rows,partitions", [(512, "4"), (3, "5"), (1, "1")])
def test_edges_and_blocks(spark, block_rows, partitions):
    rows = made(60, 24) + made(2, 300, 9)
    df = spark.createDataFrame([(*r, True, 7) for r in rows], "conv_id bigint, turn bigint, role string, text string, gone boolean, number int")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = result(cr.repair(cr.damage(df), block_rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == brute(brute_damage(rows))


def test_empty_and_gone(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cr.repair(cr.damage(df)).collect() == []
    gone = spark.createDataFrame([(1, 1, "user", "a.", True), (2, 1, "user", "a.", False)], "conv_id bigint, turn bigint, role string, text string, gone boolean")
    got = result(cr.repair(gone))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][5:7] == (2, "KI")


def test_heuristic_never_exceeds_the_rest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        faults = rng.integers(0, 4, 8).tolist()
        initials = rng.choice(["u", "a", "s", "t"], 8).tolist()
        ((cost, edits),) = cr.search(faults, initials, cr.START, False).values()
        assert (cost, edits) == cheapest(tuple(faults), tuple(initials))
        assert cr.unavoidable(faults)[0] <= cost
