"""Incremental ingest equals a full parse; event-time windows on streams."""

import json
import os

import pytest

from threadloom.sources import logs
from threadloom.streaming import ingest, windows


def line(session, i, role, content):
    return json.dumps({"sessionId": session, "cwd": "/w", "type": role, "timestamp": f"2026-06-01T10:00:{i:02d}Z", "message": {"role": role, "content": content}})


def session_lines(session):
    return [
        line(session, 0, "user", f"start {session}"),
        line(session, 1, "assistant", [{"type": "tool_use", "id": "t", "name": "Write", "input": {"file_path": "/w/f", "content": "x"}}]),
        line(session, 2, "user", [{"type": "tool_result", "tool_use_id": "t", "content": "done"}]),
        line(session, 3, "user", "thanks"),
    ]


def put(folder, session, lines, when):
    path = folder / f"{session}.jsonl"
    path.write_text("\n".join(lines))
    os.utime(path, (when, when))


def contents(spark, store):
    return sorted(map(tuple, ingest.stored(spark, store, "messages").select("session_id", "seq", "kind", "content").collect()))


def full(spark, folder):
    return sorted(map(tuple, logs.claude(spark, str(folder)).messages.select("session_id", "seq", "kind", "content").collect()))


def test_refresh_equals_full_parse(spark, tmp_path):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    put(folder, "A", session_lines("A")[:2], 1000)
    put(folder, "B", session_lines("B"), 1000)
    assert ingest.refresh(spark, {"claude": str(folder)}, store)["new"] == 2
    assert contents(spark, store) == full(spark, folder)
    put(folder, "A", session_lines("A"), 2000)  # the tool result comes after the split
    counts = ingest.refresh(spark, {"claude": str(folder)}, store)
    assert (counts["new"], counts["changed_file"], counts["current"]) == (0, 1, 1)
    assert contents(spark, store) == full(spark, folder)
    assert ingest.stored(spark, store, "file_edits").count() == 2
    (folder / "B.jsonl").unlink()  # vanished files keep their rows
    assert ingest.refresh(spark, {"claude": str(folder)}, store)["current"] == 1
    assert {s for s, *_ in contents(spark, store)} == {"claude:A", "claude:B"}
    assert set(ingest.refresh(spark, {"claude": str(folder)}, store, policy="existing_only").values()) == {0}
    with pytest.raises(ValueError):
        ingest.refresh(spark, {}, store, policy="sometimes")


def test_follow_takes_new_files_once(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "logs", str(tmp_path / "store"), str(tmp_path / "cp")
    folder.mkdir()
    batches = []
    for session in ("A", "B"):
        put(folder, session, session_lines(session), 1000)
        q = ingest.follow(spark, "claude", str(folder), store, checkpoint, batches.append)
        assert q.awaitTermination(90)
    assert contents(spark, store) == full(spark, folder) and len(batches) == 2
    # a refresh of the same store has nothing left to parse
    assert ingest.refresh(spark, {"claude": str(folder)}, store) == {"new": 0, "changed_file": 0, "changed_parser": 0, "current": 2}


def test_snapshots_and_failed_runs(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    put(folder, "A", session_lines("A")[:2], 1000)
    ingest.refresh(spark, {"claude": str(folder)}, store)
    first, rows = ingest.snapshot(spark, store), contents(spark, store)
    put(folder, "A", session_lines("A"), 2000)
    put(folder, "B", session_lines("B"), 2000)
    # a run that dies before its manifest changes nothing
    monkeypatch.setattr(ingest, "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.refresh(spark, {"claude": str(folder)}, store)
    monkeypatch.undo()
    assert contents(spark, store) == rows and ingest.snapshot(spark, store) == first
    assert ingest.refresh(spark, {"claude": str(folder)}, store)["new"] == 1
    assert contents(spark, store) == full(spark, folder)
    # the old snapshot is still whole, and of two runs one wins
    old = ingest.stored(spark, store, "messages", first)
    assert sorted(map(tuple, old.select("session_id", "seq", "kind", "content").collect())) == rows
    with pytest.raises(FileExistsError):
        ingest.publish(spark, store, {}, first)
    assert ingest.refresh(spark, {"claude": str(folder)}, store, policy="before_query", max_age_seconds=3600) == dict.fromkeys(["new", "changed_file", "changed_parser", "current"], 0)
    ingest.compact(spark, store)
    assert contents(spark, store) == full(spark, folder)
    assert ingest.Refresh(spark, {"claude": str(folder)}, store).wait(120)["counts"]["current"] == 2
    assert ingest.Refresh(spark, {"claude": str(tmp_path / "nowhere")}, store).wait(120)["state"] == "failed"
    assert ingest.vacuum(spark, store, keep=1)
    assert contents(spark, store) == full(spark, folder) and ingest.manifests(spark, store) == [ingest.snapshot(spark, store)]


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"

    def rows(name, times):
        data = [(i, f"2024-01-01 {t}:00", 1, "click", 1.0) for i, t in enumerate(times)]
        spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double").coalesce(1).write.json(str(folder / name))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(folder))
        q = windows.tumbling(stream, "10 minutes", "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(90)

    rows("a", ["10:01", "10:02", "11:30"])
    run()
    rows("b", ["10:03", "12:30"])  # 10:03 is behind the watermark
    run()
    got = {str(r["window_start"]): r["events"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01 10:00:00"] == 2
