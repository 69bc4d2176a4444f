"""Golden cases: functions, filters, search contract, file versions, classification, SQL guard, log formats."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from threadloom.functions import dates, jsonptr, patterns, refs, text
from threadloom.operators import analytics, classify, files, fuzzy, search
from threadloom.operators.filters import AccessScope, FilterError, MessageFilters, PathScope, SessionFilters, attributable_human, resolve_session_id
from threadloom.plans import sqlapi
from threadloom.sources import logs, sinks
from threadloom.sources import tables as T

NOW = datetime(2026, 6, 15, 12, tzinfo=UTC)


def values(spark, column, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i long, t string")
    return [r["v"] for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def messages(spark, rows):
    """Rows as dicts; what they leave out takes usual values."""
    usual = {"session_id": "s", "provider": "claude", "role": "user", "kind": "conversation", "authorship": "human", "record_relation": "original"}
    full = [{**usual, "id": i, "seq": i, **r} for i, r in enumerate(rows)]
    lines = [(json.dumps(r, ensure_ascii=False),) for r in full]
    parsed = spark.createDataFrame(lines, "j string").select(F.from_json("j", T.MESSAGES).alias("m")).select("m.*")
    return T.shaped(parsed, T.MESSAGES)


# --- functions --------------------------------------------------------------


def test_caseless(spark):
    cases = [("anything", "", True), ("Hello", "hELLO", True), ("ÉCOLE", "école", True), ("ПРИВЕТ", "привет", True), ("ΟΔΟΣ", "οδος", True), ("οδός", "ΟΔΌΣ", True), ("straße", "STRASSE", False), ("a😀b", "😀B", True), ("abc", "abd", False)]
    for hay, needle, want in cases:
        assert values(spark, lambda t, n=needle: text.contains_caseless(t, n), [hay]) == [want], (hay, needle)
    assert values(spark, lambda t: text.contains_caseless(t, "a"), [None]) == [False]


def test_slash_commands(spark):
    got = values(spark, text.slash_command, ["/plan go", "/Users/foo/bar", "/a:b.c-d", "\n\t /é x", "say /plan", None, ""])
    assert [g or None for g in got] == ["/plan", None, "/a:b.c-d", "/é", None, None, None]


def test_regex(spark):
    assert values(spark, lambda t: patterns.regex_match("^h.llo$", t), ["hello", "yellow", None]) == [True, False, False]
    assert values(spark, lambda t: patterns.regex_match(r"\w+ \d", t), ["é ٣", "- 3"]) == [True, False]
    for bad in ("[", r"(a)\1", "(?=x)", "(?<!x)y"):
        with pytest.raises(patterns.PatternError):
            patterns.to_java(bad)


def test_json_pointer(spark):
    doc = '{"args":{"cmd":"echo hi","request":{"path":"/tmp/a"},"n":2,"nil":null,"a/b":"s"}}'
    want = {"/cmd": "echo hi", "/request": '{"path":"/tmp/a"}', "/n": "2", "/nil": "null", "/missing": None, "/a~1b": "s"}
    for pointer, value in want.items():
        assert values(spark, lambda t, p=pointer: jsonptr.value_at(t, p), [doc, "not json", None]) == [value, None, None], pointer
    with pytest.raises(ValueError):
        jsonptr.parse("no-slash")


@pytest.mark.parametrize(
    ("given", "start", "end"),
    [
        ("2026-01", "2026-01-01T00:00", "2026-02-01T00:00"), ("202X", "2020-01-01T00:00", "2030-01-01T00:00"), ("19XX", "1900-01-01T00:00", "2000-01-01T00:00"),
        ("2026-01-1X", "2026-01-10T00:00", "2026-01-20T00:00"), ("2026-01-15T14", "2026-01-15T14:00", "2026-01-15T15:00"), ("2024-02/2024-03", "2024-02-01T00:00", "2024-04-01T00:00"),
        ("yesterday", "2026-06-14T00:00", "2026-06-15T00:00"), ("3 days ago", "2026-06-12T00:00", "2026-06-13T00:00"), ("2026-XX", "2026-01-01T00:00", "2027-01-01T00:00"),
    ],
)
def test_date_spans(given, start, end):
    span = dates.parse_span(given, NOW)
    assert (span.start, span.end) == tuple(datetime.fromisoformat(x).replace(tzinfo=UTC) for x in (start, end))


def test_durations_and_bounds():
    for given, hours in [("7d", 168), ("2w", 336), ("24h", 24), ("30min", 0.5), ("1m", 720), ("1y", 8760)]:
        span = dates.parse_span(given, NOW)
        assert span.end == NOW and (NOW - span.start).total_seconds() == hours * 3600
    for bad in ("", "gibberish words", "99999999999999d", "2026-13-01"):
        with pytest.raises(dates.DateError):
            dates.parse_span(bad, NOW)
    with pytest.raises(dates.DateError):
        dates.resolve("2026-02-01", "2026-01-01", now=NOW)
    assert dates.parse_span("2026-01-15T14:30:00.5+02:00", NOW).start == datetime(2026, 1, 15, 12, 30, 0, 500000, tzinfo=UTC)


def test_text_helpers(spark):
    assert values(spark, text.count_lines, ["", "a", "a\n", "a\nb", "\n\n"]) == [0, 1, 1, 2, 2]
    assert values(spark, lambda t: text.select_lines(t, -2), ["a\nb\nc", "a"]) == ["b\nc", "a"]
    assert values(spark, lambda t: text.truncate_for_display(t, 8), ["short", "a  b\n c d e f g"]) == ["short", "a b c..."]
    assert values(spark, text.markdown_fence, ["plain", "```x```", "````"]) == ["```", "````", "`````"]
    assert values(spark, text.basename, ["/a/b.rs", "c:\\d\\e.py", "f"]) == ["b.rs", "e.py", "f"]


def test_refs(spark):
    found = values(spark, refs.extract, ["See https://Example.com/a?b=1, and main.rs:12. Then https://example.com/a?b=1"])[0]
    assert [r["host"].lower() for r in found] == ["example.com"] * len(found) and len(found) >= 1


def test_fuzzy_members():
    assert fuzzy.match("crgo tst", "cargo test --workspace") is not None
    assert fuzzy.match("xyz", "cargo test") is None
    score, places = fuzzy.match("ct", "cargo test")
    assert places == [0, 6] and score > fuzzy.match("ct", "xcxxxt")[0]
    assert fuzzy.ranges([1, 2, 5]) == [(1, 3), (5, 6)] and fuzzy.densest_start([0, 10, 11, 12], 4) == 10


# --- filters ----------------------------------------------------------------


def test_requests_that_cannot_match_are_refused():
    for bad in (
        lambda: search.SearchRequest(query=" "), lambda: search.SearchRequest(mode="regex"), lambda: search.SearchRequest(query="ab", mode="fuzzy", limit=5),
        lambda: search.SearchRequest(query="abc", mode="fuzzy", limit=None), lambda: search.SearchRequest(match_chars=5), lambda: search.SearchRequest(window="latest"),
        lambda: search.SearchRequest(query="a", argument_path="/x"), lambda: MessageFilters(sequence=(1, 2)), lambda: MessageFilters(providers=()),
        lambda: SessionFilters(parent="p", session_kinds=("user",)), lambda: MessageFilters(kinds=("nonsense",)),
    ):
        with pytest.raises(FilterError):
            bad()


def test_paths_and_scope(spark):
    rows = [("a", "/w/x", None, "/logs/1"), ("b", "/w/xy", None, "/logs/2"), ("c", None, "/w/x/deep", "/logs/3"), ("d", None, None, "/w/x/4")]
    s = T.shaped(spark.createDataFrame(rows, "id string, cwd string, repo_root string, source_path string"), T.SESSIONS)
    ids = lambda f: sorted(r["id"] for r in f.apply(s).collect())
    assert ids(SessionFilters(paths=PathScope(workspace="/w/x"))) == ["a", "c"]
    assert ids(SessionFilters(paths=PathScope(legacy="/w/x/"))) == ["a", "c", "d"]
    assert ids(SessionFilters(paths=PathScope(transcript="/logs"))) == ["a", "b", "c"]
    assert ids(SessionFilters(paths=PathScope(exclude_workspace=("/w/x",)))) == ["b", "d"]
    scope = AccessScope(("/w/x",))
    assert sorted(r["id"] for r in scope.sessions(s).collect()) == ["a", "c"]
    with pytest.raises(PermissionError):
        sqlapi.query(spark, "select 1", scope=scope)


def test_session_ids(spark):
    s = T.shaped(spark.createDataFrame([("claude:abc1", "abc1"), ("claude:abd2", "abd2")], "id string, provider_session_id string"), T.SESSIONS)
    assert resolve_session_id(s, "ABC") == "claude:abc1"
    for bad in ("ab", "zzz"):
        with pytest.raises(FilterError):
            resolve_session_id(s, bad)


def test_human_fragments(spark):
    m = messages(spark, [
        {"content": "whole"}, {"content": "agent", "authorship": "agent"}, {"content": "copy", "record_relation": "mirror"},
        {"content": "mine|generated", "authorship": "mixed", "content_parts": [{"ordinal": 0, "start_char": 0, "end_char": 5, "authorship": "human", "origin": "x"}, {"ordinal": 1, "start_char": 5, "end_char": 14, "authorship": "generated", "origin": "y"}]},
    ])
    assert [(r["seq"], r["content"]) for r in attributable_human(m).orderBy("seq").collect()] == [(0, "whole"), (3, "mine|")]


# --- search -----------------------------------------------------------------


def contract(spark):
    call = lambda name, cmd: json.dumps({"args": {"cmd": cmd}, "kind": "tool_call", "tool_name": name})
    tool = {"role": "tool", "kind": "tool_call", "authorship": "agent"}
    return messages(spark, [
        {**tool, "tool_name": "exec_command", "content": call("exec_command", "cargo test --workspace")}, {**tool, "tool_name": "read_file", "content": call("read_file", "x")},
        {**tool, "tool_name": "exec_command", "content": call("exec_command", "cargo test --workspace")}, {"content": "please run the tests"},
    ])


@pytest.mark.parametrize(
    ("field", "mode", "query"),
    [(f, m, q) for f, qs in {"content": ("cargo test", r"cargo\s+test", "crgo tst"), "tool_argument": ("cargo test", r"cargo\s+test", "crgo tst"), "tool_name": ("exec", "^exec_", "excmd")}.items() for m, q in zip(search.MODES, qs, strict=True)],
)
def test_modes_and_fields(spark, field, mode, query):
    r = search.SearchRequest(query=query, mode=mode, field=field, argument_path="/cmd" if field == "tool_argument" else None, limit=10)
    page = search.search(contract(spark), r)
    assert sorted(x["seq"] for x in page.rows) == [0, 2] and page.next_offset is None


def test_paging_and_windows(spark):
    m = contract(spark)
    page = search.search(m, search.SearchRequest(query="cargo", offset=1, limit=1))
    assert [r["seq"] for r in page.rows] == [2] and page.next_offset is None
    needles = messages(spark, [{"content": c} for c in ("needle zero", "unrelated", "needle two", "needle three")])
    page = search.search(needles, search.SearchRequest(query="needle", window="latest", limit=2, filters=MessageFilters(session_id="s")))
    assert [r["seq"] for r in page.rows] == [2, 3] and page.next_offset == 2
    batches = list(search.search_batches(needles, search.SearchRequest(query="needle"), 2))
    assert [[r["seq"] for r in b] for b in batches] == [[0, 2], [3]]


def test_context_and_evidence(spark):
    m = messages(spark, [{"content": f"row {i}"} for i in range(5)])
    around = lambda *a: [r["seq"] for r in search.context_of(m, "s", *a).orderBy("seq").collect()]
    assert around(1, 1, 1) == [0, 1, 2] and around(0, 2, 2) == [0, 1, 2]
    text_ = "always explore before edits; avoid semantic duplication in code; see https://example.com"
    r = search.SearchRequest(query="semantic duplication", match_chars=20)
    row = search.evidence(search.matching(messages(spark, [{"content": text_}]), r), r).first()
    assert (row["match_start"], row["match_end"], row["match_view"]) == (35, 55, "semantic duplication")
    assert (row["marker_start"], row["marker_end"]) == (0, 20)


# --- analytics, files, classification ---------------------------------------


def test_role_counts(spark):
    m = messages(spark, [{"role": "user"}, {"role": "assistant"}, {"role": "user"}, {"role": "slash"}, {"role": "user", "kind": "harness_notice"}])
    assert [tuple(r) for r in analytics.role_counts(m).collect()] == [("assistant", 1), ("slash", 1), ("user", 2)]


def edits(spark):
    rows = [
        ("s1", 0, "Write", "/a/app.py", "line1\nline2\nline3", None), ("s1", 1, "Edit", "/a/app.py", None, [("line2", "LINE2", False)]),
        ("s1", 2, "MultiEdit", "/a/app.py", None, [("line", "L", True)]), ("s1", 3, "Write", "/a/util.py", "u", None), ("s2", 0, "Write", "/a/app.py", "x", None), ("s1", 4, "Edit", "/a/app.py", None, [("absent", "y", False)]),
    ]
    df = spark.createDataFrame(rows, "session_id string, seq long, tool string, file_path string, new_content string, edits array<struct<old:string,new:string,replace_all:boolean>>")
    return T.shaped(df.withColumn("file_name", text.basename(F.col("file_path"))), T.FILE_EDITS)


def test_versions(spark):
    e = edits(spark)
    own = files.all_versions(e).filter("session_id = 's1' AND file_path = '/a/app.py'").orderBy("version").collect()
    assert [r["content"] for r in own] == ["line1\nline2\nline3", "line1\nLINE2\nline3", "L1\nLINE2\nL3", None]
    assert files.reconstruct(e, "s1", "/a/app.py", 2) == "line1\nLINE2\nline3"
    top = files.file_summary(e).collect()
    assert [(r["file_name"], r["edits"], r["sessions"]) for r in top] == [("app.py", 5, 2), ("util.py", 1, 1)]


def test_leftmost_match(spark):
    hits = classify.classify(messages(spark, [{"content": "you missed X, and you forgot Y"}, {"content": "fine"}]), limit=None).collect()
    assert [(r["seq"], r["matched"]) for r in hits] == [(0, "you missed")]


def test_sql_guard(spark):
    sqlapi.register(spark, {"guarded_messages": messages(spark, [{"content": "a;b"}, {"content": "c"}])})
    ok = sqlapi.query(spark, "SELECT content, content FROM guarded_messages WHERE content = 'a;b'")
    assert ok.columns == ["content", "content_2"] and ok.rows == [["a;b", "a;b"]]
    for bad in ("SELECT 1; SELECT 2", "INSERT INTO guarded_messages VALUES (1)", "DROP VIEW guarded_messages", "SELECT * FROM guarded_messages WHERE kind = 'harness-notice'", "", "SET x = 1"):
        with pytest.raises(sqlapi.SqlRefused):
            sqlapi.query(spark, bad)
    assert sqlapi.query(spark, "SELECT * FROM guarded_messages", limit=1).truncated


def test_publication(spark, tmp_path):
    m = messages(spark, [{"content": "x"}])
    target = str(tmp_path / "bundle")
    receipt = sinks.publish_bundle({"messages": m.select("session_id", "seq", "content")}, target, {"messages": ["session_id", "seq"]})
    assert receipt["messages"]["rows"] == 1
    with pytest.raises(FileExistsError):
        sinks.publish_bundle({"messages": m.select("session_id", "seq", "content")}, target, {"messages": ["session_id", "seq"]})
    body = sinks.export_sessions(spark.createDataFrame([], T.SESSIONS), m, "markdown").first()["body"]
    assert "### user\n\n```\nx\n```" in body


# --- log formats ------------------------------------------------------------


def write(folder, name, records):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records).encode())
    return str(folder)


def test_claude_log(spark, tmp_path):
    head = {"sessionId": "S1", "cwd": "/w"}
    at = lambda i: f"2026-06-01T10:00:{i:02d}Z"
    folder = write(tmp_path, "p/S1.jsonl", [
        {**head, "type": "user", "timestamp": at(0), "message": {"role": "user", "content": "Please build it"}},
        {**head, "type": "assistant", "timestamp": at(1), "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Write", "input": {"file_path": "/w/a.py", "content": "x\ny"}}]}},
        {**head, "type": "user", "timestamp": at(2), "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "done"}]}},
        {**head, "type": "assistant", "timestamp": at(3), "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "t2", "name": "Write", "input": {"file_path": "/w/b.py", "content": "z"}}]}},
        {**head, "type": "user", "timestamp": at(4), "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t2", "is_error": True, "content": "failed"}]}},
        "not json", {**head, "type": "user", "isMeta": True, "timestamp": at(5), "message": {"role": "user", "content": "hook feedback"}},
    ])
    p = logs.claude(spark, folder)
    s = p.sessions.first()
    assert (s["id"], s["cwd"], s["title"]) == ("claude:S1", "/w", "Please build it") and s["parse_warning"]
    rows = p.messages.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(len(rows)))
    assert [(r["role"], r["kind"]) for r in rows][0] == ("user", "conversation")
    assert {r["kind"] for r in rows} == {"conversation", "tool_call", "tool_result", "harness_notice"}
    assert {r["tool_name"] for r in rows if r["kind"] == "tool_result"} == {"Write"}
    assert [(r["file_path"], r["new_content"]) for r in p.file_edits.collect()] == [("/w/a.py", "x\ny")]


def test_codex_log(spark, tmp_path):
    item = lambda i, **p: {"timestamp": f"2026-06-02T00:00:{i:02d}Z", "type": "response_item", "payload": p}
    folder = write(tmp_path, "rollout-1.jsonl", [
        {"timestamp": "2026-06-02T00:00:00Z", "type": "session_meta", "payload": {"id": "C1", "timestamp": "2026-06-02T00:00:00Z", "cwd": "/c"}},
        item(1, type="message", role="user", content=[{"type": "input_text", "text": "fix the bug"}]),
        item(2, type="function_call", name="exec_command", call_id="k", arguments='{"cmd":"ls"}'), item(3, type="function_call_output", call_id="k", output="a.txt"),
        item(4, type="message", role="assistant", content=[{"type": "output_text", "text": "fixed"}]),
    ])
    p = logs.codex(spark, folder)
    assert p.sessions.first()["id"] == "codex:C1"
    rows = p.messages.orderBy("seq").collect()
    assert [(r["role"], r["kind"], r["tool_name"]) for r in rows] == [("user", "conversation", None), ("tool", "tool_call", "exec_command"), ("tool", "tool_result", "exec_command"), ("assistant", "conversation", None)]
    assert json.loads(rows[1]["content"]) == {"args": {"cmd": "ls"}, "kind": "tool_call", "tool_name": "exec_command"}


def test_bad_bytes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b"\xff\xfe\xfa\x80\x81")
    for parser in (logs.claude, logs.codex, logs.cursor, logs.pi):
        assert parser(spark, str(tmp_path)).messages.count() == 0


def test_other_formats(spark, tmp_path):
    write(tmp_path / "g", "s.json", [{"messages": [{"type": "user", "id": "1", "timestamp": "2026-01-01T00:00:00Z", "content": "hi"}, {"type": "gemini", "id": "2", "timestamp": "2026-01-01T00:00:01Z", "content": "hello"}]}])
    write(tmp_path / "a", "s.json", [{"chunkedPrompt": {"chunks": [{"role": "user", "text": "q"}, {"role": "model", "text": "r"}]}}])
    write(tmp_path / "c", "x.jsonl", [{"role": "user", "message": {"content": [{"type": "text", "text": "cursor says"}]}}])
    write(tmp_path / "p", "x.jsonl", [{"type": "session", "version": 3, "id": "P", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/p"}, {"type": "message", "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "user", "content": [{"type": "text", "text": "pi says"}]}}])
    write(tmp_path / "v", "x.jsonl", [{"step_index": 0, "source": "USER_EXPLICIT", "type": "USER_INPUT", "status": "DONE", "created_at": "2026-01-01T00:00:00Z", "content": "<USER_REQUEST>go</USER_REQUEST>"}])
    roots = {"gemini_cli": "g", "aistudio": "a", "cursor": "c", "pi": "p", "antigravity": "v"}
    p = logs.ingest(spark, {k: str(tmp_path / v) for k, v in roots.items()})
    got = {(r["provider"], r["role"], r["content"]) for r in p.messages.collect()}
    assert {("gemini_cli", "user", "hi"), ("aistudio", "assistant", "r"), ("cursor", "user", "cursor says"), ("pi", "user", "pi says")} <= got
    assert ("antigravity", "user") in {(a, b) for a, b, _ in got}
