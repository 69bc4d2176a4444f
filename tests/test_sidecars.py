"""Titles, folders and labels from what agents keep beside their logs."""

import json
import sqlite3

from threadloom.sources import logs, sidecars
from threadloom.streaming import ingest

STAMP = "2026-08-04T00:00:0{}Z"


def rollout(home, session, cwd, prompt):
    folder = home / "sessions/2026"
    folder.mkdir(parents=True, exist_ok=True)
    rows = [
        {"type": "session_meta", "timestamp": STAMP.format(0), "payload": {"id": session, **({"cwd": cwd} if cwd else {}), "timestamp": STAMP.format(0)}},
        {"type": "response_item", "timestamp": STAMP.format(1), "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": prompt}]}},
    ]
    (folder / f"rollout-{session}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))


def threads(home, rows, columns="id TEXT, title TEXT, cwd TEXT, created_at INTEGER, updated_at INTEGER, first_user_message TEXT, model TEXT"):
    with sqlite3.connect(home / sidecars.THREAD_FILE) as db:
        db.execute(f"CREATE TABLE threads ({columns})")
        db.executemany(f"INSERT INTO threads VALUES ({', '.join('?' * len(rows[0]))})", rows)


def test_homes_do_not_mix(spark, tmp_path):
    """The same session id in four homes: database, index, both missing, a broken database."""
    a, b, c, d = (tmp_path / f"home-{x}" for x in "abcd")
    for home in (a, b, c, d):
        rollout(home, "s1", None if home == a else f"/rollout/{home.name}", f"prompt {home.name}")
    rollout(a, "s2", "/own", "other prompt")
    threads(a, [("s1", "title a", "/from/db", 1, 2, "asked first", "m1"), ("s2", None, "/not/used", 1, 2, None, None)])
    (a / sidecars.TITLE_FILE).write_text('{"id":"s1","thread_name":"not this"}\n{"id":"s2","thread_name":"old"}\n{broken\n{"id":"s2","thread_name":"index a"}\n')
    (b / sidecars.TITLE_FILE).write_text('{"id":"s1","thread_name":"title b"}\n')
    (d / sidecars.THREAD_FILE).write_bytes(b"SQLite format 3\0 but not really")
    got = {}
    for home in (a, b, c, d):
        for r in logs.ingest(spark, {"codex": str(home / "sessions")}).sessions.collect():
            got[home.name[-1], r.provider_session_id] = (r.title, r.cwd, r.summary, r.parse_warning)
    assert got["a", "s1"] == ("title a", "/from/db", "asked first", None)
    assert got["a", "s2"] == ("index a", "/own", "other prompt", None)
    assert got["b", "s1"] == ("title b", "/rollout/home-b", "prompt home-b", None)
    assert got["c", "s1"] == ("prompt home-c", "/rollout/home-c", "prompt home-c", None)
    assert got["d", "s1"][:3] == ("prompt home-d", "/rollout/home-d", "prompt home-d") and got["d", "s1"][3].startswith("sidecar: DatabaseError")


def test_all_homes_at_once_a_partition_each(spark, tmp_path):
    homes = []
    for i in range(5):
        home = tmp_path / f"h{i}"
        home.mkdir()
        threads(home, [(f"t{i}", f"title {i}", None, 1_700_000_000 + i, None, None, "m")])
        homes.append(str(home))
    df = sidecars.codex_threads(spark, [*homes, str(tmp_path / "nowhere")])
    assert df.rdd.getNumPartitions() == 6
    assert sorted((r.home.rsplit("/", 1)[1], r.thread, r.title, r.created_at.timestamp() - 1_700_000_000, json.loads(r.raw)["model"]) for r in df.collect()) == [(f"h{i}", f"t{i}", f"title {i}", i, "m") for i in range(5)]


def test_bytes_of_a_database(tmp_path):
    """What isn't a local file is read from its bytes, also one that was written ahead."""
    path = tmp_path / "x.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA journal_mode=WAL")
        db.execute("CREATE TABLE threads (id TEXT)")
        db.execute("INSERT INTO threads VALUES ('a')")
    db.close()
    assert path.read_bytes()[18:20] == b"\x02\x02"

    class Elsewhere:
        type_name = "mock"

        def open_input_file(self, where):
            return open(where, "rb")

    held, sidecars.tail.file_system = sidecars.tail.file_system, lambda p: (Elsewhere(), p)
    try:
        assert sidecars.connected(str(path)).execute("SELECT id FROM threads").fetchall() == [("a",)]
    finally:
        sidecars.tail.file_system = held


def claude_line(text, **more):
    return json.dumps({"sessionId": "P", "cwd": "/w", "type": "user", "timestamp": STAMP.format(5), "message": {"role": "user", "content": text}, **more}) + "\n"


def test_metadata_files_of_agents_and_desktop_sessions(spark, tmp_path):
    root = tmp_path / "projects"
    agents = root / "p/P/subagents"
    agents.mkdir(parents=True)
    (root / "p/P.jsonl").write_text(claude_line("hello"))
    (agents / "agent-1.jsonl").write_text(claude_line("a long task"))
    (agents / "agent-1.meta.json").write_text(json.dumps({"agentType": "Explore", "description": "look around"}))
    (agents / "agent-2.jsonl").write_text(claude_line("another task", agentId="two"))
    (agents / "agent-2.meta.json").write_text("{broken")
    store = str(tmp_path / "store")
    ingest.refresh(spark, {"claude": str(root)}, store)
    got = {r.id: (r.title, r.agent_label) for r in ingest.stored(spark, store, "sessions").collect()}
    assert got == {"claude:P": ("hello", None), "claude:P/agent-1": ("look around", "Explore"), "claude:P/agent-2": ("another task", "two")}
    desk = tmp_path / "local-agent-mode-sessions/user"
    (desk / "local_abc").mkdir(parents=True)
    (desk / "local_abc/audit.jsonl").write_text(claude_line("first words", _audit_timestamp="2026-08-05T00:00:00Z"))
    (desk / "local_abc.json").write_text(json.dumps({"title": "Desk talk", "cwd": "/desk", "createdAt": "2026-08-01T00:00:00Z", "lastActivityAt": "2026-08-06T00:00:00Z"}))
    (desk / "local_def").mkdir()
    (desk / "local_def/audit.jsonl").write_text(claude_line("no sidecar"))
    ingest.refresh(spark, {"claude_desktop": str(desk)}, store)
    got = {r.id: (r.title, r.cwd, r.created_at.day, r.updated_at.day) for r in ingest.stored(spark, store, "sessions").filter("provider = 'claude_desktop'").collect()}
    assert got == {"claude_desktop:abc": ("Desk talk", "/desk", 1, 6), "claude_desktop:def": ("no sidecar", "/w", 4, 4)}
    assert [r.ts.day for r in ingest.stored(spark, store, "messages").filter("session_id = 'claude_desktop:abc'").collect()] == [5]
