"""Logs that grow: what is parsed from a byte on equals a full parse; layers merge on read; lines as a stream."""

import json
import os
import random

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from threadloom.sources import logs, tail
from threadloom.streaming import ingest


def record(session, i, rnd):
    stamp = f"2026-06-01T10:{i // 60:02d}:{i % 60:02d}Z"
    base = {"sessionId": session, "cwd": "/w", "timestamp": stamp}
    kind = rnd.randrange(6)
    if kind == 0:
        return {**base, "type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": f"t{i}", "name": "Write", "input": {"file_path": f"/w/f{i}", "content": "é" * rnd.randrange(9)}}, {"type": "text", "text": f"writing {i}"}]}}
    if kind == 1:
        return {**base, "type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"t{rnd.randrange(i + 1)}", "content": f"done {i}", "is_error": rnd.random() < 0.2}]}}
    if kind == 2:
        return {**base, "type": "user", "isMeta": True, "message": {"role": "user", "content": f"notice {i}"}}
    if kind == 3:
        return "{broken" if rnd.random() < 0.5 else ""
    return {**base, "type": rnd.choice(["user", "assistant"]), "message": {"role": rnd.choice(["user", "assistant"]), "content": f"日本 line {i} " + "x" * rnd.randrange(200)}}


def log_bytes(session, n, seed):
    rnd = random.Random(seed)
    rows = [{"sessionId": session, "cwd": "/w", "timestamp": "2026-06-01T09:00:00Z", "type": "user", "message": {"role": "user", "content": f"start {session}"}}]
    rows += [record(session, i, rnd) for i in range(n)]
    return b"".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)).encode() + b"\n" for r in rows)


def write(path, data, when):
    path.write_bytes(data)
    os.utime(path, (when, when))


COLUMNS = {
    "messages": ["session_id", "seq", "id", "role", "kind", "ts", "tool_name", "tool_call_id", "content", "authorship", "correlation"],
    "file_edits": ["session_id", "seq", "ts", "tool", "file_path", "new_content", "edits"],
    "transcripts": ["session_id", "transcript_text"],
    "sessions": ["id", "title", "summary", "cwd", "created_at", "updated_at", "preview_text", "message_count", "parse_warning", "raw_metadata_json", "parent_session_id"],
}


def of_store(spark, store, at=None):
    return {t: sorted(map(repr, ingest.stored(spark, store, t, at).select(c).collect())) for t, c in COLUMNS.items()}


def of_parse(spark, folder):
    p = logs.claude(spark, str(folder))
    return {t: sorted(map(repr, getattr(p, t).select(c).collect())) for t, c in COLUMNS.items()}


def test_tail_equals_full_parse_at_random_cuts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK_BYTES", 4000)
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    rnd = random.Random(5)
    whole = {s: log_bytes(s, 60, i) for i, s in enumerate("ABC")}
    cuts = {s: sorted(rnd.randrange(200, len(d)) for _ in range(2)) + [len(d)] for s, d in whole.items()}
    for step in range(3):
        for s, d in whole.items():
            write(folder / f"{s}.jsonl", d[: cuts[s][step]], 1000 + step)
        ingest.refresh(spark, {"claude": str(folder)}, store)
        if step == 1:  # what isn't a whole line waits
            waiting = {s: cuts[s][1] - (whole[s][: cuts[s][1]].rfind(b"\n") + 1) for s in whole}
            seen = {r.source_path[-7]: r for r in ingest.stored(spark, store, "files_seen").collect()}
            assert all(seen[s].size_bytes - seen[s].parsed_bytes == waiting[s] for s in whole) and any(waiting.values())
    assert of_store(spark, store) == of_parse(spark, folder)


def test_rotated_and_shrunk_files_are_parsed_anew(spark, tmp_path):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    write(folder / "A.jsonl", log_bytes("A", 30, 1), 1000)
    write(folder / "B.jsonl", log_bytes("B", 30, 2), 1000)
    write(folder / "C.jsonl", log_bytes("C", 30, 3), 1000)
    ingest.refresh(spark, {"claude": str(folder)}, store)
    write(folder / "A.jsonl", log_bytes("A2", 50, 4), 2000)  # longer, but another head and another session
    write(folder / "B.jsonl", log_bytes("B", 30, 2)[:900].rpartition(b"\n")[0] + b"\n", 2000)  # cut off
    assert ingest.refresh(spark, {"claude": str(folder)}, store)["changed_file"] == 2
    assert of_store(spark, store) == of_parse(spark, folder)
    assert {r.id for r in ingest.stored(spark, store, "sessions").collect()} == {"claude:A2", "claude:B", "claude:C"}


def test_codex_and_pi_grow(spark, tmp_path):
    stamp = "2026-06-01T10:00:0{}Z"
    rows = [
        {"type": "session_meta", "timestamp": stamp.format(0), "payload": {"id": "x1", "cwd": "/w", "timestamp": stamp.format(0)}},
        {"type": "response_item", "timestamp": stamp.format(1), "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}},
        {"type": "response_item", "timestamp": stamp.format(2), "payload": {"type": "function_call", "name": "shell", "call_id": "c1", "arguments": '{"command": "ls"}'}},
        {"type": "response_item", "timestamp": stamp.format(3), "payload": {"type": "function_call_output", "call_id": "c1", "output": "files"}},
        {"type": "response_item", "timestamp": stamp.format(4), "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}},
    ]
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    data = [json.dumps(r).encode() + b"\n" for r in rows]
    for step, n in enumerate((3, 5)):
        write(folder / "r.jsonl", b"".join(data[:n]), 1000 + step)
        ingest.refresh(spark, {"codex": str(folder)}, store)
    want = logs.codex(spark, str(folder))
    for name, columns in COLUMNS.items():
        assert sorted(map(repr, ingest.stored(spark, store, name).select(columns).collect())) == sorted(map(repr, getattr(want, name).select(columns).collect())), name
    assert {r.tool_name for r in ingest.stored(spark, store, "messages").filter("kind = 'tool_result'").collect()} == {"shell"}


def test_what_a_refresh_writes_is_in_proportion(spark, tmp_path):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    for i in range(12):
        write(folder / f"S{i}.jsonl", log_bytes(f"S{i}", 200, i), 1000)
    ingest.refresh(spark, {"claude": str(folder)}, store)
    first = ingest.manifest(spark, store)
    write(folder / "S7.jsonl", log_bytes("S7", 200, 7) + json.dumps({"sessionId": "S7", "timestamp": "2026-06-01T12:00:00Z", "type": "user", "message": {"role": "user", "content": "one more line"}}).encode() + b"\n", 2000)
    ingest.refresh(spark, {"claude": str(folder)}, store)
    base, delta = ingest.manifest(spark, store)
    rows = {t: spark.read.parquet(p.rows).count() for t, p in delta.parts.items() if p.rows}
    assert rows == {"sessions": 1, "messages": 1, "transcripts": 1, "file_edits": 0, "files_seen": 1}
    assert base == first[0] and delta.parts["messages"].bytes < base.parts["messages"].bytes / 4
    assert delta.parts["messages"].dead_rows == 0 and delta.parts["sessions"].dead_rows == 1
    assert of_store(spark, store) == of_parse(spark, folder)
    before = of_store(spark, store)
    at = ingest.snapshot(spark, store)
    ingest.merge_due(spark, store, fanout=2)  # both are of the smallest size
    assert len(ingest.manifest(spark, store)) == 1 and of_store(spark, store) == before == of_store(spark, store, at)


def test_which_layers_are_due():
    def layer(n, size):
        return ingest.Layer(n, {"messages": ingest.Part("f", size)})

    mb = 1 << 20
    assert ingest.due([]) is None and ingest.due([layer(i, mb) for i in range(3)]) is None
    assert ingest.due([layer(0, 999 * mb), *(layer(i, mb) for i in range(1, 5))]) == 1
    assert ingest.due([layer(i, 20 * mb) for i in range(4)] + [layer(5, mb)]) == 0
    # a row is written anew a few times: with n refreshes of a size there are few layers at any time
    layers, written, most = [], 0, 0
    for n in range(400):
        layers.append(layer(n, 4 * mb))
        while (first := ingest.due(layers)) is not None:
            size = sum(x.parts["messages"].bytes for x in layers[first:])
            written += size
            layers = [*layers[:first], layer(n, size)]
        most = max(most, len(layers))
    assert most <= 16 and written <= 400 * 4 * mb * 6


def test_unreadable_files_have_a_stub(spark, tmp_path, monkeypatch):
    folder, store = tmp_path / "logs", str(tmp_path / "store")
    folder.mkdir()
    write(folder / "A.jsonl", log_bytes("A", 5, 1), 1000)
    found = ingest.discover(spark, "claude", str(folder))
    gone = found.unionByName(found.withColumn("source_path", F.replace("source_path", F.lit("A.jsonl"), F.lit("gone.jsonl"))))
    ingest.apply(spark, "claude", gone, store, repos=spark.createDataFrame([("/w",), ("/",)], "path string"))
    got = {r.id: (r.parse_warning, r.repo_root) for r in ingest.stored(spark, store, "sessions").collect()}
    assert got["claude:gone"][0].startswith("unreadable") and got["claude:A"][1] == "/w"
    assert ingest.refresh(spark, {"claude": str(folder)}, store)["current"] == 1


def test_whole_lines(tmp_path, monkeypatch):
    path = tmp_path / "x.jsonl"
    cases = {b"": 0, b"abc": 0, b"abc\n": 4, b"abc\n{": 4, b'abc\n{"a":1}': 11, b"\n\n\n": 3, b"a\n" + b"b" * 200_000: 2, b"a\n12": 2}
    for data, end in cases.items():
        path.write_bytes(data)
        with pafs.LocalFileSystem().open_input_file(str(path)) as f:
            assert tail.complete_bytes(f, len(data)) == end, data[:20]
    rnd = random.Random(1)
    for _ in range(60):
        lines = [bytes(rnd.choice(b"ab\xff") for _ in range(rnd.randrange(0, 30))) for _ in range(rnd.randrange(1, 20))]
        data = b"\n".join(lines) + b"\n"
        path.write_bytes(data)
        step = rnd.randrange(1, 25)
        got = [(n, t) for a in range(0, len(data), step) for ns, ts in tail.lines_between(str(path), a, min(a + step, len(data)), len(data)) for n, t in zip(ns.to_pylist(), ts.to_pylist())]
        starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
        assert got == [(s, x.decode("utf-8", "replace")) for s, x in zip(starts, lines)]


def test_lines_as_a_stream(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    tail.register(spark)

    def run():
        stream = spark.readStream.format("log_lines").option("path", str(folder)).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
        assert q.awaitTermination(90) and q.exception() is None

    def held():
        return sorted((os.path.basename(r.path), r.generation, r.line_no, r.line) for r in spark.read.parquet(out).collect())

    (folder / "a.jsonl").write_bytes(b"one\ntwo\nthr")
    (folder / "b.jsonl").write_bytes(b"x\n")
    run()
    assert held() == [("a.jsonl", 0, 0, "one"), ("a.jsonl", 0, 4, "two"), ("b.jsonl", 0, 0, "x")]
    (folder / "a.jsonl").write_bytes(b"one\ntwo\nthree\n")
    (folder / "b.jsonl").write_bytes(b"new head\n")  # rotated
    run()  # from the checkpoint
    assert held()[2:] == [("a.jsonl", 0, 8, "three"), ("b.jsonl", 0, 0, "x"), ("b.jsonl", 1, 0, "new head")]
    run()
    assert len(held()) == 5


@pytest.mark.parametrize("path", ["file:/tmp/a b.jsonl", "file:///tmp/a b.jsonl", "/tmp/a b.jsonl"])
def test_paths(path):
    assert tail.file_system(path)[1] == "/tmp/a b.jsonl" and tail.readable(path) and not tail.readable("viewfs://x/y")
