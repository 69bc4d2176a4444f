"""Evidence of sessions against a plain version, session by session."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import evidence
from threadloom.operators.filters import FilterError
from threadloom.sources.tables import FILE_EDITS, MESSAGES, shaped


def quotas(sizes, total):
    given = [0] * len(sizes)
    left = min(total, sum(sizes))
    while left:
        for i, n in enumerate(sizes):
            if left and given[i] < n:
                given[i] += 1
                left -= 1
    return given


def test_quotas_go_round(spark):
    r = random.Random(1)
    cases = [([5, 1, 9], 9), ([2, 2], 100), ([3, 3, 3], 4), ([0, 4], 2), ([], 3)] + [([r.randrange(9) for _ in range(r.randrange(1, 6))], 7) for _ in range(60)]
    for total in {t for _, t in cases}:
        sizes = [s for s, t in cases if t == total]
        df = spark.createDataFrame([(s,) for s in sizes], "s array<int>")
        for row in df.select("s", evidence.fair_quotas(F.col("s"), total).alias("q")).collect():
            assert row.q == quotas(row.s, total)


def plain(rows, edits, limit, latest):
    out = {}
    for s in {r[0] for r in rows} | {e[0] for e in edits}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1], reverse=latest)
        links = lambda t: [w for w in dict.fromkeys((t or "").split(" ")) if w.startswith("https://")]
        files = sorted({e[1] for e in edits if e[0] == s})
        parts = [[r for r in own if r[2] == "user"], [r for r in own if r[2] == "tool"], [r for r in own if links(r[4])], files]
        given = quotas([len(p) for p in parts], limit) if limit else [len(p) for p in parts]
        kept = [p[:n] for p, n in zip(parts, given)]
        sizes = [len(links(r[4])) for r in kept[2]]
        inner = quotas(sizes, limit) if limit else sizes
        cut = [evidence.SECTIONS[i] for i in range(3) if given[i] < len(parts[i])] + (["references"] if inner != sizes else []) + (["changed_files"] if given[3] < len(parts[3]) else [])
        for i in range(2):
            for r in kept[i]:
                out[s, evidence.SECTIONS[i], r[1], None] = (None, tuple(cut))
        for r, n in zip(kept[2], inner):
            out[s, "reference_messages", r[1], None] = (tuple(links(r[4])[:n]), tuple(cut))
        for f in kept[3]:
            out[s, "changed_files", None, f] = (None, tuple(cut))
    return out


@pytest.fixture(scope="module")
def given():
    r = random.Random(2)
    rows, edits = [], []
    for s in ["a", "b", "c", "d", "hot", None]:
        for i in range(90 if s == "hot" else r.randrange(9)):
            text = r.choice([None, "", "hello", "see main.rs:12", "https://h.example/0 " + " ".join(f"https://h.example/{r.randrange(5)}" for _ in range(r.randrange(12)))])
            rows.append((s, i, r.choice(["user", "assistant", "tool"]), r.choice(["conversation", "tool_call", "tool_result"]), text))
        edits += [(s, f"f{r.randrange(6)}.py") for _ in range(r.randrange(12))]
    return rows, edits + [("only files", "x.py")]


@pytest.mark.parametrize(("limit", "window"), [(1, "first"), (5, "first"), (5, "latest"), (12, "latest"), (None, "first")])
def test_equals_the_plain_version(spark, given, limit, window):
    rows, edits = given
    m = shaped(spark.createDataFrame(rows, "session_id string, seq long, role string, kind string, content string"), MESSAGES)
    e = shaped(spark.createDataFrame(edits, "session_id string, file_path string"), FILE_EDITS)
    got = evidence.evidence(m, e, limit, window).collect()
    found = {(x.session_id, x.section, x.seq, x.name if x.section == "changed_files" else None): (tuple(v.value for v in x.refs) if x.refs is not None else None, tuple(x.truncated)) for x in got}
    assert len(found) == len(got) and found == plain(rows, edits, limit, window == "latest")


def test_columns_profile_and_edges(spark):
    rows = [("s", 0, "user", "conversation", "2026-01-01 00:00:00", "word " * 99), ("s", 1, "tool", "tool_call", "2026-01-01 00:01:00", "www.example.com www.example.com/x example.org/y")]
    m = shaped(spark.createDataFrame(rows, "session_id string, seq long, role string, kind string, ts string, content string"), MESSAGES)
    got = {x.section: x for x in evidence.evidence(m, preview_chars=20, profile=True).collect()}
    assert set(got) == {"user_intent", "tool_activity", "reference_messages"}
    assert got["tool_activity"].kind == "call" and got["user_intent"].chars == 495 and len(got["user_intent"].preview) <= 21
    assert got["reference_messages"].ref_summary == "3 urls" and got["reference_messages"].kind == "tool"
    assert got["user_intent"].time_profile.span_seconds == 60
    assert evidence.evidence(m.limit(0), shaped(m.limit(0), FILE_EDITS)).collect() == []
    for bad in [{"limit": 0}, {"window": "middle"}, {"preview_chars": 0}]:
        with pytest.raises(FilterError):
            evidence.evidence(m, **bad)


def test_rows_beyond_the_budget_do_not_reach_the_shuffle(spark, given):
    m = shaped(spark.createDataFrame(given[0], "session_id string, seq long, role string, kind string, content string"), MESSAGES)
    plan = evidence.evidence(m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Python" not in plan
