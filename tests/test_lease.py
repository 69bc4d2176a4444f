"""Refreshers take turns; batches that are closed leave no job behind."""

import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from threadloom.operators import search
from threadloom.sources.tables import MESSAGES, shaped
from threadloom.streaming import ingest
from threadloom.streaming.lease import Busy, Lease, claim


def test_a_file_is_made_once(spark, tmp_path):
    path = str(tmp_path / "deep/one")
    wins = []
    threads = [threading.Thread(target=lambda i=i: wins.append((i, claim(spark, path, b"%d" % i)))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [i for i, ok in wins if ok]
    assert len(wins) == 8 and len(won) == 1 and open(path, "rb").read() == b"%d" % won[0]
    assert [f for f in os.listdir(tmp_path / "deep") if f.startswith("_")] == []


def test_leases_take_turns_and_run_out(spark, tmp_path):
    store = str(tmp_path / "s")
    inside, most = [0], [0]

    def work():
        with Lease(spark, store, seconds=2, poll=0.05):
            inside[0] += 1
            most[0] = max(most[0], inside[0])
            time.sleep(0.3)
            inside[0] -= 1

    threads = [threading.Thread(target=work) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert most == [1] and inside == [0]
    held = Lease(spark, store, seconds=30)
    token = held.__enter__()
    assert token == 5
    with pytest.raises(Busy):
        Lease(spark, store, wait=0.3, poll=0.05).__enter__()
    held.__exit__(None, None, None)
    dead = Lease(spark, store, seconds=0.6)  # its owner dies: nobody renews it
    dead._renew = lambda: None
    dead.__enter__()
    began = time.time()
    with Lease(spark, store, poll=0.05) as token:
        assert token == 7 and time.time() - began >= 0.3
    # the dead one's end doesn't take the lease from anybody
    with Lease(spark, store, poll=0.05):
        dead._done.set()
        dead.__exit__(None, None, None)
        with pytest.raises(Busy):
            Lease(spark, store, wait=0.2, poll=0.05).__enter__()


def test_two_refreshers_one_works(spark, tmp_path):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    for name in "AB":
        (folder / f"{name}.jsonl").write_text(json.dumps({"sessionId": name, "type": "user", "timestamp": "2026-06-01T10:00:00Z", "message": {"role": "user", "content": name}}) + "\n")
    both = [ingest.Refresh(spark, {"claude": str(folder)}, store, lease_seconds=30.0) for _ in range(2)]
    reports = [r.wait(300) for r in both]
    assert [r["state"] for r in reports] == ["done", "done"], reports
    assert sorted((r["counts"]["new"], r["counts"]["current"]) for r in reports) == [(0, 2), (2, 0)]
    assert ingest.snapshot(spark, store) == 1


def test_closed_batches_leave_no_job(spark):
    @F.pandas_udf("string")
    def slow(x):
        time.sleep(0.5)
        return x

    rows = spark.range(0, 2000, 1, 200).select("id", F.lit("s").alias("session_id"), F.col("id").alias("seq"), slow(F.concat(F.lit("hit "), F.col("id").cast("string"))).alias("content"))
    messages = shaped(rows.selectExpr("*", "'user' AS role", "'conversation' AS kind"), MESSAGES)
    tracker = spark.sparkContext.statusTracker()
    with search.Batches(messages.select("id", "content"), 5) as batches:
        first = next(batches)
        assert len(first) == 5
    end = time.time() + 20
    while tracker.getActiveJobsIds() and time.time() < end:
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds() and not batches._thread.is_alive()
    with pytest.raises(StopIteration):
        next(batches)
    all_rows = list(search.search_batches(shaped(spark.range(0, 23, 1, 3).selectExpr("id", "'s' AS session_id", "id AS seq", "'user' AS role", "'conversation' AS kind", "concat('hit ', id) AS content"), MESSAGES), search.SearchRequest(query="hit", limit=0), 5))
    assert [len(b) for b in all_rows] == [5, 5, 5, 5, 3] and [r.seq for b in all_rows for r in b] == list(range(23))


def test_errors_come_to_the_caller(spark):
    bad = spark.range(3).select(F.raise_error(F.lit("no such luck")).alias("x"))
    with pytest.raises(Exception, match="no such luck"):
        list(search.Batches(bad, 2))
