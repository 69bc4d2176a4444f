"""Conversation logs of several agents as sessions, messages, transcripts and file edits.

Logs are read schemaless: a line is a variant, null if it isn't JSON, and what a
format knows of it is taken by path. All parsing is columns; state that runs
over a file's lines is in ``operators.normalize``. Files are parallel, and so are
the splits of a large one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import deep_text
from ..operators import normalize as N
from .tables import FILE_EDITS, shaped


@dataclass
class Parsed:
    sessions: DataFrame
    messages: DataFrame
    transcripts: DataFrame
    file_edits: DataFrame


def lines(spark: SparkSession, path: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """(path, mtime, line_no, line, v): lines of all files below ``path`` (or of a list), bad bytes replaced.

    A large file is split, so its lines come from several tasks. ``line_no`` orders
    the lines of a file: its split's first byte, then the place within the split.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    split = F.col("_metadata.file_block_start").cast("decimal(18,0)") * F.lit(2**62).cast("decimal(19,0)")
    order = (split + F.monotonically_increasing_id().cast("decimal(19,0)")).cast("decimal(38,0)")
    return read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), order.alias("line_no"), F.col("value").alias("line"), F.try_parse_json("value").alias("v")
    )


def text_at(v: Column, path: str) -> Column:
    """A string at the path; null for other values."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))


def json_at(v: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(v, path, "variant"))


def array_at(v: Column, path: str) -> Column:
    """An array of variants at the path; empty for other values."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def time_at(v: Column, path: str) -> Column:
    return F.try_to_timestamp(text_at(v, path))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _join(parts: Column) -> Column:
    """Non-blank parts, trimmed, by newlines."""
    return F.array_join(F.filter(F.transform(parts, lambda p: trimmed(p)), lambda p: p != ""), "\n")


def _block_text(b: Column, depth: int) -> Column:
    """Text of a content block: itself if a string, else what text, content, message, input and output hold."""
    own = F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string"))
    parts = [own, text_at(b, "$.text")]
    for key in ("content", "message", "input", "output"):
        parts.append(text_at(b, f"$.{key}"))
        if depth:
            parts.append(_join(F.transform(array_at(b, f"$.{key}"), lambda x: _block_text(x, depth - 1))))
    return _join(F.array_compact(F.array(*parts)))


def content_text(v: Column, path: str, depth: int = 1) -> Column:
    """Text of a string or of blocks at the path, nested to any depth."""
    shallow = F.coalesce(trimmed(text_at(v, path)), _join(F.transform(array_at(v, path), lambda b: _block_text(b, depth))))
    return F.coalesce(deep_text(json_at(v, path)), shallow)


def _event(**columns: Column) -> Column:
    """One event as a struct of EVENTS without path and line_no."""
    kinds = {"part": "int", "role": "string", "kind": "string", "ts": "timestamp", "tool_name": "string", "tool_call_id": "string", "content": "string",
             "authorship": "string", "authority": "string", "event_id": "string", "in_transcript": "boolean"}
    return F.struct(*[F.coalesce(columns[c], F.lit(None)).cast(k).alias(c) if c in columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def _exploded(parsed: DataFrame, *arrays: Column) -> DataFrame:
    """Events of arrays of structs (null structs dropped), in the order of part."""
    return parsed.select("path", "line_no", F.explode(F.array_compact(F.concat(*arrays))).alias("e")).select("path", "line_no", "e.*")


#: How facts of a file's lines are put together: the first one, the least, the greatest.
_FOLDS = {"first": lambda c: _first(c), "least": F.min, "greatest": F.max}

#: Columns that a file's session has even where the format knows nothing of them.
_DEFAULTS = (("provider_session_id", "string"), ("title", "string"), ("cwd", "string"), ("created_at", "timestamp"), ("updated_at", "timestamp"), ("parent_session_id", "string"), ("agent_label", "string"))


def accumulated(parsed: DataFrame, facts: dict[str, tuple[str, Column]]) -> DataFrame:
    """A row a file: path, mtime, malformed, line_count, valid_count and ``facts``, name: (how, column)."""
    bad = F.count_if(F.col("v").isNull() & (F.trim("line") != ""))
    return parsed.groupBy("path").agg(
        F.max("mtime").alias("mtime"), bad.alias("malformed"), F.count("*").alias("line_count"), F.count("v").alias("valid_count"),
        *[_FOLDS[how](c).alias(k) for k, (how, c) in facts.items()],
    )


def described(acc: DataFrame) -> DataFrame:
    """``accumulated`` rows with the warning, the counts as JSON and all columns of a file's session."""
    warn = F.when(F.col("malformed") > 0, F.concat(F.col("malformed").cast("string"), F.lit(" malformed JSONL lines")))
    out = acc.withColumns({"parse_warning": warn, "raw_metadata_json": F.to_json(F.struct("line_count", F.col("valid_count").alias("valid_record_count")))})
    missing = {c: F.lit(None).cast(k) for c, k in _DEFAULTS if c not in acc.columns}
    return out.withColumns({**missing, "repo_root": F.lit(None).cast("string")}).drop("malformed", "line_count", "valid_count")


def _file_sessions(parsed: DataFrame, **facts: tuple[str, Column]) -> DataFrame:
    return described(accumulated(parsed, facts))


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _first(value: Column) -> Column:
    """The first non-null of a file, by line."""
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def _calls(v: Column, content: str, ts: Column) -> Column:
    """Events of tool_use blocks, one each, before the line's own text."""
    blocks = F.filter(array_at(v, content), lambda b: (text_at(b, "$.type") == "tool_use") & text_at(b, "$.name").isNotNull())
    return F.transform(
        blocks,
        lambda b, i: _event(
            part=i, role=F.lit("tool"), kind=F.lit("tool_call"), ts=ts, tool_name=text_at(b, "$.name"), tool_call_id=text_at(b, "$.id"),
            content=N.tool_call_content(text_at(b, "$.name"), json_at(b, "$.input")),
        ),
    )


def _edit_payload(name: Column, b: Column, at: str) -> Column:
    """struct(file_path, new_content, edits) of a file-changing call; null for others."""
    path = text_at(b, f"{at}.file_path")
    edit = F.struct(
        F.coalesce(text_at(b, f"{at}.old_string"), F.lit("")).alias("old"),
        F.coalesce(text_at(b, f"{at}.new_string"), F.lit("")).alias("new"),
        F.coalesce(F.try_variant_get(b, f"{at}.replace_all", "boolean"), F.lit(False)).alias("replace_all"),
    )
    many = F.transform(
        F.filter(array_at(b, f"{at}.edits"), lambda e: text_at(e, "$.old_string").isNotNull() & text_at(e, "$.new_string").isNotNull()),
        lambda e: F.struct(text_at(e, "$.old_string").alias("old"), text_at(e, "$.new_string").alias("new"), F.coalesce(F.try_variant_get(e, "$.replace_all", "boolean"), F.lit(False)).alias("replace_all")),
    )
    none = F.array().cast("array<struct<old:string,new:string,replace_all:boolean>>")
    other = F.coalesce(text_at(b, f"{at}.notebook_path"), text_at(b, f"{at}.path"), path)
    whole = F.coalesce(text_at(b, f"{at}.content"), F.lit(""))
    made = (
        F.when(name == "Write", F.struct(path.alias("file_path"), whole.alias("new_content"), none.alias("edits")))
        .when(name == "Edit", F.struct(path.alias("file_path"), F.lit(None).cast("string").alias("new_content"), F.array(edit).alias("edits")))
        .when(name == "MultiEdit", F.struct(path.alias("file_path"), F.lit(None).cast("string").alias("new_content"), many.alias("edits")))
        .when(name.isin("NotebookEdit", "ApplyPatch"), F.struct(other.alias("file_path"), F.lit(None).cast("string").alias("new_content"), none.alias("edits")))
    )
    return F.when(made["file_path"].isNotNull(), made)


def _file_edits(mutations: DataFrame, ids: DataFrame, provider: str, first: str | None = None) -> DataFrame:
    """Numbered edits of rows (path, line_no, part, ts, tool, file_path, new_content, edits), from 0 or from what the column ``first`` of ``ids`` says."""
    from pyspark.sql import Window

    seq = (F.row_number().over(Window.partitionBy("path").orderBy("line_no", "part")) - 1).cast("bigint")
    named = mutations.withColumns({"seq": seq, "file_name": N.file_name(F.col("file_path")), "provider": F.lit(provider)}).join(ids, "path")
    return shaped(named.withColumn("seq", F.col("seq") + F.col(first)) if first else named, FILE_EDITS)


def _ids(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.col("source_path").alias("path"), F.col("id").alias("session_id"))


def _confirmed(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Mutations whose result came and was no error; they take the result's place in order."""
    good = results.filter(~F.coalesce("is_error", F.lit(False))).groupBy("path", "id").agg(F.min("line_no").alias("line_no"), F.min_by("ts", "line_no").alias("result_ts"))
    return calls.drop("line_no").join(good, ["path", "id"]).withColumn("ts", F.coalesce("result_ts", "ts"))


@dataclass
class Told:
    """What a line format makes of lines: events, facts of files and how they name sessions, and confirmed file edits."""

    raw: DataFrame
    events: DataFrame
    facts: dict[str, tuple[str, Column]]
    named: Callable[[DataFrame], DataFrame]
    edits: DataFrame


def _whole(told: Told, provider: str) -> Parsed:
    """Whole files, from what their lines tell."""
    files = told.named(described(accumulated(told.raw, told.facts)))
    sessions, messages, transcripts = N.finished(told.events, files, provider)
    return Parsed(sessions, messages, transcripts, _file_edits(told.edits, _ids(sessions), provider))


def claude_lines(raw: DataFrame, provider: str = "claude") -> Told:
    """Anthropic-style session files; files named agent-* or below subagents/ are spawned sessions.

    The desktop application's files have a folder each, which names the session,
    and times of their own.
    """
    v = F.col("v")
    desktop = provider == "claude_desktop"
    ts = F.coalesce(time_at(v, "$._audit_timestamp"), time_at(v, "$.timestamp")) if desktop else time_at(v, "$.timestamp")
    message = F.try_variant_get(v, "$.message", "variant")
    text = F.when(message.isNotNull(), content_text(v, "$.message.content")).otherwise(F.coalesce(trimmed(text_at(v, "$.content")), F.lit("")))
    role = F.coalesce(text_at(v, "$.message.role"), text_at(v, "$.type"))
    result = F.filter(array_at(v, "$.message.content"), lambda b: text_at(b, "$.type") == "tool_result")
    # what is used again and again is a column, so it is planned and computed once
    raw = raw.withColumns({"__ts": ts, "__text": text, "__role": role, "__result": result})
    ts, text, role, result = F.col("__ts"), F.col("__text"), F.col("__role"), F.col("__result")
    notice = F.coalesce(F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False)) | text.rlike(r"^<(task-notification|local-command-(stdout|stderr|caveat)>)")
    no_args = text.contains("<command-name>") & (F.trim(N.tag_content(text, "command-args")) == "")
    skip = no_args | (F.lower(text) == "resume cancelled")
    event = {"part": F.lit(10_000), "ts": ts, "authority": F.lit("anthropic"), "event_id": F.when(F.trim(text_at(v, "$.uuid")) != "", text_at(v, "$.uuid"))}
    said = N.strip_command_markup(text)
    compacted = F.coalesce(F.try_variant_get(v, "$.isCompactSummary", "boolean"), F.lit(False))
    own = (
        F.when(notice, F.when(text != "", _event(**event, role=F.lit("user"), kind=F.lit("harness_notice"), content=text)))
        .when(skip | ~role.isin("user", "assistant") | (said == ""), F.lit(None))
        .when(compacted, _event(**event, role=F.lit("compaction"), kind=F.lit("compaction"), content=said))
        .when(F.size(result) > 0, _event(**event, role=F.lit("tool"), kind=F.lit("tool_result"), content=said, tool_call_id=text_at(result[0], "$.tool_use_id")))
        .otherwise(_event(**event, role=role, content=said, in_transcript=F.lit(True)))
    )
    events = _exploded(raw, _calls(v, "$.message.content", ts), F.array(own))
    session_id = F.coalesce(text_at(v, "$.session_id"), text_at(v, "$.sessionId"))
    nested = F.regexp_extract("path", r"/([^/]+)/subagents/", 1)
    sub = (nested != "") | F.col("path").rlike(r"/agent-[^/]*\.jsonl$")
    talk = F.when(role.isin("user", "assistant") & ~notice & (F.size(result) == 0), ts)
    facts = {"provider_session_id": ("first", session_id), "cwd": ("first", text_at(v, "$.cwd")), "created_at": ("least", talk), "updated_at": ("greatest", talk), "agent_label": ("first", text_at(v, "$.agentId"))}

    def named(files: DataFrame) -> DataFrame:
        parent = F.when(nested != "", nested).otherwise(F.col("provider_session_id"))
        files = files.withColumn("parent_session_id", F.when(sub & parent.isNotNull(), F.concat(F.lit(f"{provider}:"), parent)))
        if desktop:
            return files.withColumn("provider_session_id", F.regexp_extract("path", r"/(?:local_(?=[^/]))?([^/]+)/[^/]+$", 1))
        own_id = F.when(sub, F.concat_ws("/", parent, _stem(F.col("path")))).otherwise(F.coalesce("provider_session_id", _stem(F.col("path"))))
        return files.withColumns({"provider_session_id": own_id, "agent_label": F.when(sub, F.col("agent_label"))})

    blocks = raw.select("path", "line_no", ts.alias("ts"), F.posexplode(array_at(v, "$.message.content")).alias("part", "b"))
    calls = blocks.filter(text_at(F.col("b"), "$.type") == "tool_use").select(
        "path", "line_no", "part", "ts", text_at(F.col("b"), "$.id").alias("id"), text_at(F.col("b"), "$.name").alias("tool"), _edit_payload(text_at(F.col("b"), "$.name"), F.col("b"), "$.input").alias("m")
    )
    results = blocks.filter(text_at(F.col("b"), "$.type") == "tool_result").select(
        "path", "line_no", "ts", text_at(F.col("b"), "$.tool_use_id").alias("id"), F.try_variant_get(F.col("b"), "$.is_error", "boolean").alias("is_error")
    )
    return Told(raw, events, facts, named, _confirmed(calls.filter("m IS NOT NULL").select("path", "line_no", "part", "ts", "id", "tool", "m.*"), results))


def claude(spark: SparkSession, path: str) -> Parsed:
    return _whole(claude_lines(lines(spark, path)), "claude")


def claude_desktop(spark: SparkSession, path: str) -> Parsed:
    return _whole(claude_lines(lines(spark, path, "audit.jsonl"), "claude_desktop"), "claude_desktop")


#: Beginnings of user rows that a program put there.
_INJECTED = (
    "The following is the Codex agent history", "# AGENTS.md instructions", "<goal_context", "<codex_internal_context", "<hook_prompt", "<environment_context", "<turn_aborted",
)


def codex_lines(raw: DataFrame) -> Told:
    """Rollout files: session_meta first, then response items with calls and their outputs."""
    v = F.col("v")
    ts, kind = time_at(v, "$.timestamp"), text_at(v, "$.payload.type")
    item = text_at(v, "$.type") == "response_item"
    raw = raw.withColumns({"__ts": ts, "__kind": kind, "__role": text_at(v, "$.payload.role"), "__text": content_text(v, "$.payload.content")})
    ts, kind, role, text = F.col("__ts"), F.col("__kind"), F.col("__role"), F.col("__text")
    injected = F.lit(False)
    for head in _INJECTED:
        injected = injected | F.startswith(F.ltrim(text), F.lit(head))
    event = {"part": F.lit(0), "ts": ts, "authority": F.lit("openai"), "event_id": F.when(F.trim(text_at(v, "$.payload.id")) != "", text_at(v, "$.payload.id"))}
    name, call_id = text_at(v, "$.payload.name"), text_at(v, "$.payload.call_id")
    # arguments are JSON text, input is plain text
    args_text = F.coalesce(text_at(v, "$.payload.arguments"), json_at(v, "$.payload.arguments"))
    args = F.coalesce(F.to_json(F.try_parse_json(args_text)), F.to_json(F.struct(text_at(v, "$.payload.input").alias("input"))))
    output = F.coalesce(text_at(v, "$.payload.output"), deep_text(json_at(v, "$.payload.output")), _block_text(F.try_variant_get(v, "$.payload.output", "variant"), 1), F.lit(""))
    is_call, is_output = kind.isin("function_call", "custom_tool_call"), kind.isin("function_call_output", "custom_tool_call_output")
    own = (
        F.when(item & (kind == "message") & (role == "user") & injected, _event(**event, role=F.lit("user"), kind=F.lit("harness_notice"), content=text))
        .when(item & (kind == "message") & role.isin("user", "assistant") & (text != ""), _event(**event, role=role, content=text, in_transcript=F.lit(True)))
        .when(item & is_call & name.isNotNull(), _event(**event, role=F.lit("tool"), kind=F.lit("tool_call"), tool_name=name, tool_call_id=call_id, content=N.tool_call_content(name, args)))
        .when(item & is_output & (F.trim(output) != ""), _event(**event, role=F.lit("tool"), kind=F.lit("tool_result"), tool_call_id=call_id, content=output))
    )
    events = _exploded(raw, F.array(own))
    meta = text_at(v, "$.type") == "session_meta"
    spawn = F.try_parse_json(text_at(v, "$.payload.source"))
    ended = F.when(item & ((kind == "message") | is_output), ts)
    facts = {
        "provider_session_id": ("first", F.when(meta, text_at(v, "$.payload.id"))), "cwd": ("first", F.when(meta, text_at(v, "$.payload.cwd"))),
        "created_at": ("first", F.when(meta, time_at(v, "$.payload.timestamp"))), "updated_at": ("greatest", ended),
        "parent_session_id": ("first", F.concat(F.lit("codex:"), F.when(meta, text_at(spawn, "$.subagent.thread_spawn.parent_thread_id")))),
        "agent_label": ("first", F.when(meta, F.coalesce(text_at(spawn, "$.subagent.thread_spawn.agent_nickname"), text_at(spawn, "$.subagent.other")))),
    }

    def named(files: DataFrame) -> DataFrame:
        return files.withColumn("provider_session_id", F.coalesce("provider_session_id", _stem(F.col("path"))))

    patch = F.coalesce(text_at(v, "$.payload.input"), text_at(F.try_parse_json(args_text), "$.input"), text_at(F.try_parse_json(args_text), "$.patch"))
    staged = raw.filter(item & is_call & (name == "apply_patch")).select("path", "line_no", ts.alias("ts"), call_id.alias("id"), F.lit("apply_patch").alias("tool"), F.posexplode(N.patch_files(patch)).alias("part", "f"))
    out = F.coalesce(F.try_parse_json(text_at(v, "$.payload.output")), F.try_variant_get(v, "$.payload.output", "variant"))
    code = F.try_variant_get(out, "$.metadata.exit_code", "bigint")
    structured = (code == 0) & F.startswith(text_at(out, "$.output"), F.lit("Success. Updated the following files:"))
    plain = text_at(v, "$.payload.output")
    rendered = plain.startswith("Exit code: 0\n") & plain.contains("\nOutput:\nSuccess. Updated the following files:")
    ok = F.coalesce(F.when(code.isNotNull(), structured).otherwise(rendered), F.lit(False))
    results = raw.filter(item & is_output).select("path", "line_no", ts.alias("ts"), call_id.alias("id"), (~ok).alias("is_error"))
    return Told(raw, events, facts, named, _confirmed(staged.select("path", "line_no", "part", "ts", "id", "tool", "f.file_path", "f.new_content"), results))


def codex(spark: SparkSession, path: str) -> Parsed:
    return _whole(codex_lines(lines(spark, path)), "codex")


def cursor(spark: SparkSession, path: str) -> Parsed:
    """Transcripts without times: the file's time ends the session, the folder names the workspace."""
    v = F.col("v")
    raw = lines(spark, path)
    ts, role = F.col("mtime"), text_at(v, "$.role")
    result = F.filter(array_at(v, "$.message.content"), lambda b: text_at(b, "$.type") == "tool_result")
    plain = F.filter(array_at(v, "$.message.content"), lambda b: text_at(b, "$.type") == "text")
    text = F.coalesce(trimmed(text_at(v, "$.message.content")), _join(F.transform(plain, lambda b: text_at(b, "$.text"))))
    full = content_text(v, "$.message.content")
    said = role.isin("user", "assistant")
    event = {"part": F.lit(10_000), "ts": ts}
    own = (
        F.when(~F.coalesce(said, F.lit(False)), F.lit(None))
        .when((role == "user") & (F.size(result) > 0), F.when(full != "", _event(**event, role=F.lit("tool"), kind=F.lit("tool_result"), tool_call_id=text_at(result[0], "$.tool_use_id"), content=full)))
        .when(N.substantive(text), _event(**event, role=role, content=text, in_transcript=F.lit(True)))
    )
    calls = F.when(said, _calls(v, "$.message.content", ts))
    events = _exploded(raw, F.coalesce(calls, F.array().cast("array<struct<part:int,role:string,kind:string,ts:timestamp,tool_name:string,tool_call_id:string,content:string,authorship:string,authority:string,event_id:string,in_transcript:boolean>>")), F.array(own))
    parent = F.regexp_extract("path", r"/([^/]+)/subagents/", 1)
    folder = F.regexp_extract("path", r"/projects/([^/]+)/", 1)
    files = _file_sessions(raw, updated_at=("greatest", F.col("mtime")))
    own_id = F.when(parent != "", F.concat_ws("/", parent, _stem(F.col("path")))).otherwise(_stem(F.col("path")))
    files = files.withColumns(
        {
            "provider_session_id": own_id,
            "parent_session_id": F.when(parent != "", F.concat(F.lit("cursor:"), parent)),
            "cwd": F.when(folder != "", F.concat(F.lit("/"), F.replace(folder, F.lit("-"), F.lit("/")))),
        }
    )
    sessions, messages, transcripts = N.finished(events, files, "cursor")
    blocks = raw.filter(said).select("path", "line_no", ts.alias("ts"), F.posexplode(array_at(v, "$.message.content")).alias("part", "b"))
    done = blocks.filter(text_at(F.col("b"), "$.type") == "tool_use").select(
        "path", "line_no", "part", "ts", text_at(F.col("b"), "$.name").alias("tool"), _edit_payload(text_at(F.col("b"), "$.name"), F.col("b"), "$.input").alias("m")
    )
    return Parsed(sessions, messages, transcripts, _file_edits(done.filter("m IS NOT NULL").select("path", "line_no", "part", "ts", "tool", "m.*"), _ids(sessions), "cursor"))


def antigravity(spark: SparkSession, path: str) -> Parsed:
    """Step logs: a step's type and source give its role; the conversation's folder is the id."""
    v = F.col("v")
    raw = lines(spark, path)
    ts = time_at(v, "$.created_at")
    kind, source = F.coalesce(text_at(v, "$.type"), F.lit("")), F.coalesce(text_at(v, "$.source"), F.lit(""))
    by_user = source.isin("USER_EXPLICIT", "USER")
    role = (
        F.when((kind == "USER_INPUT") | ((kind == "") & by_user), "user")
        .when((kind == "PLANNER_RESPONSE") | ((kind == "") & (source == "MODEL")), "assistant")
        .when(kind.isin("CONVERSATION_HISTORY", ""), F.lit(None))
        .otherwise(F.when(by_user, "user").otherwise("tool"))
    )
    text = F.coalesce(trimmed(text_at(v, "$.content")), F.lit(""))
    tool = role == "tool"
    step = F.try_variant_get(v, "$.step_index", "bigint").cast("string")
    request = text.rlike(r"(?s)^<USER_REQUEST>\n.+\n</USER_REQUEST>$")
    author = F.when((role == "user") & (source == "USER_EXPLICIT"), F.when(request, "mixed").otherwise("human"))
    own = F.when(
        role.isNotNull() & (text != ""),
        _event(part=F.lit(0), role=role, kind=F.when(tool, F.lit("tool_result")), ts=ts, tool_name=F.when(tool, F.lower(kind)), content=text, authorship=author,
               authority=F.lit("google"), event_id=step, in_transcript=~tool),
    )
    calls = F.transform(
        F.filter(array_at(v, "$.tool_calls"), lambda c: text_at(c, "$.name").isNotNull()),
        lambda c, i: _event(part=i + 1, role=F.lit("tool"), kind=F.lit("tool_call"), ts=ts, tool_name=text_at(c, "$.name"), content=N.tool_call_content(text_at(c, "$.name"), json_at(c, "$.args"))),
    )
    events = _exploded(raw, F.array(own), calls)
    cwd = F.try_element_at(F.array_compact(F.transform(array_at(v, "$.tool_calls"), lambda c: F.coalesce(text_at(c, "$.args.Cwd"), text_at(c, "$.args.cwd")))), F.lit(1))
    files = _file_sessions(raw, cwd=("first", cwd), created_at=("least", ts), updated_at=("greatest", ts))
    files = files.withColumn("provider_session_id", F.regexp_extract("path", r"/([^/]+)/[^/]+/[^/]+/[^/]+$", 1))
    sessions, messages, transcripts = N.finished(events, files, "antigravity")
    n = F.length("content")
    part = lambda i, a, b, who, origin: F.struct(F.lit(i).alias("ordinal"), a.cast("bigint").alias("start_char"), b.cast("bigint").alias("end_char"), F.lit(who).alias("authorship"), F.lit(origin).alias("origin"))
    parts = F.array(part(0, F.lit(0), F.lit(15), "harness", "harness_context"), part(1, F.lit(15), n - 16, "human", "direct_input"), part(2, n - 16, n, "harness", "harness_context"))
    messages = messages.withColumn("content_parts", F.when(F.col("authorship") == "mixed", parts))
    empty = spark.createDataFrame([], FILE_EDITS)
    return Parsed(sessions, messages, transcripts, empty)


def pi_lines(raw: DataFrame, provider: str = "pi") -> Told:
    """Session header, then messages whose calls are toolCall blocks and whose results are rows of their own."""
    v = F.col("v")
    ts, kind, role = time_at(v, "$.timestamp"), text_at(v, "$.type"), text_at(v, "$.message.role")
    text = content_text(v, "$.message.content")
    event = {"part": F.lit(10_000), "ts": ts, "authority": F.lit(provider), "event_id": F.when(F.trim(text_at(v, "$.id")) != "", text_at(v, "$.id"))}
    result = role == "toolResult"
    own = F.when(
        (kind == "message") & (text != ""),
        F.when(result, _event(**event, role=F.lit("tool"), kind=F.lit("tool_result"), tool_name=text_at(v, "$.message.toolName"), tool_call_id=text_at(v, "$.message.toolCallId"), content=text)).when(
            role.isin("user", "assistant"), _event(**event, role=role, content=text, in_transcript=F.lit(True))
        ),
    )
    called = F.filter(array_at(v, "$.message.content"), lambda b: (text_at(b, "$.type") == "toolCall") & text_at(b, "$.name").isNotNull() & (role == "assistant"))
    calls = F.transform(
        called,
        lambda b, i: _event(part=i, role=F.lit("tool"), kind=F.lit("tool_call"), ts=ts, tool_name=text_at(b, "$.name"), tool_call_id=text_at(b, "$.id"), content=N.tool_call_content(text_at(b, "$.name"), json_at(b, "$.arguments"))),
    )
    events = _exploded(raw, calls, F.array(own))
    head, talk = kind == "session", F.when((kind == "session") | ((kind == "message") & role.isin("user", "assistant") & (text != "")), ts)
    ended = F.when((kind == "message") & role.isin("user", "assistant", "toolResult") & (text != ""), ts)
    facts = {"provider_session_id": ("first", F.when(head, text_at(v, "$.id"))), "cwd": ("first", F.when(head, text_at(v, "$.cwd"))), "created_at": ("least", talk), "updated_at": ("greatest", ended)}

    def named(files: DataFrame) -> DataFrame:
        return files.withColumn("provider_session_id", F.coalesce("provider_session_id", _stem(F.col("path"))))

    b = F.col("b")
    name = F.lower(text_at(b, "$.name"))
    path_of = F.coalesce(text_at(b, "$.arguments.path"), text_at(b, "$.arguments.file_path"))
    edit = F.array(F.struct(F.coalesce(text_at(b, "$.arguments.oldText"), F.lit("")).alias("old"), F.coalesce(text_at(b, "$.arguments.newText"), F.lit("")).alias("new"), F.lit(False).alias("replace_all")))
    staged = raw.filter(role == "assistant").select("path", "line_no", ts.alias("ts"), F.posexplode(array_at(v, "$.message.content")).alias("part", "b")).filter((text_at(b, "$.type") == "toolCall") & name.isin("write", "edit") & path_of.isNotNull()).select(
        "path", "line_no", "part", "ts", text_at(b, "$.id").alias("id"), name.alias("tool"), path_of.alias("file_path"),
        F.when(name == "write", F.coalesce(text_at(b, "$.arguments.content"), F.lit(""))).alias("new_content"), F.when(name == "edit", edit).alias("edits"),
    )
    error = F.coalesce(F.try_variant_get(v, "$.message.isError", "boolean"), F.lit(True))
    results = raw.filter(result).select("path", "line_no", ts.alias("ts"), text_at(v, "$.message.toolCallId").alias("id"), error.alias("is_error"))
    return Told(raw, events, facts, named, _confirmed(staged, results))


def pi(spark: SparkSession, path: str, provider: str = "pi") -> Parsed:
    return _whole(pi_lines(lines(spark, path), provider), provider)


def _documents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, mtime, line_no, line, v): whole files as one line each."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.lit(0).cast("bigint").alias("line_no"), F.col("value").alias("line"), F.try_parse_json("value").alias("v")
    )


def gemini_cli(spark: SparkSession, path: str) -> Parsed:
    """Chat snapshots: messages with tool calls; user turns that only echo results are dropped."""
    v, m = F.col("v"), F.col("m")
    raw = _documents(spark, path, "*.json")
    turns = raw.select("path", F.posexplode(array_at(v, "$.messages")).alias("line_no", "m")).withColumn("line_no", F.col("line_no").cast("bigint"))
    ts, kind = time_at(m, "$.timestamp"), text_at(m, "$.type")
    role = F.when(kind == "user", "user").when(kind == "gemini", "assistant")
    blocks = array_at(m, "$.content")
    echo = (F.size(blocks) > 0) & F.forall(blocks, lambda b: F.try_variant_get(b, "$.functionResponse", "variant").isNotNull())
    text = F.coalesce(text_at(m, "$.content"), F.array_join(F.transform(blocks, lambda b: F.coalesce(text_at(b, "$.text"), F.lit(""))), " "))
    said = trimmed(F.regexp_replace(text, r"(?s)--- Content from referenced files ---.*?--- End of content ---", ""))
    event = {"part": F.lit(0), "ts": ts, "authority": F.lit("google"), "event_id": F.when(F.trim(text_at(m, "$.id")) != "", text_at(m, "$.id"))}
    own = F.when(kind.isin("warning", "info", "error") & (F.trim(text) != ""), _event(part=F.lit(0), ts=ts, role=F.lit("user"), kind=F.lit("harness_notice"), content=text)).when(
        role.isNotNull() & (said != "") & ~((role == "user") & echo), _event(**event, role=role, content=said, in_transcript=F.lit(True))
    )
    calls = F.filter(array_at(m, "$.toolCalls"), lambda c: text_at(c, "$.name").isNotNull() & role.isNotNull())
    at = lambda c: F.coalesce(time_at(c, "$.timestamp"), ts)
    made = F.transform(calls, lambda c, i: _event(part=2 * i + 1, role=F.lit("tool"), kind=F.lit("tool_call"), ts=at(c), tool_name=text_at(c, "$.name"), tool_call_id=text_at(c, "$.id"), content=N.tool_call_content(text_at(c, "$.name"), json_at(c, "$.args"))))
    response = lambda c: F.try_element_at(F.filter(array_at(c, "$.result"), lambda p: F.try_variant_get(p, "$.functionResponse", "variant").isNotNull()), F.lit(1))
    outcome = lambda c: F.coalesce(F.when(F.trim(text_at(c, "$.resultDisplay")) != "", trimmed(text_at(c, "$.resultDisplay"))), text_at(response(c), "$.functionResponse.response.output"), json_at(response(c), "$.functionResponse.response.output"))
    results = F.transform(calls, lambda c, i: F.when(outcome(c).isNotNull(), _event(part=2 * i + 2, role=F.lit("tool"), kind=F.lit("tool_result"), ts=at(c), tool_name=text_at(c, "$.name"), tool_call_id=text_at(c, "$.id"), content=outcome(c))))
    events = _exploded(turns, F.array(own), made, results)
    files = _file_sessions(raw, provider_session_id=("first", text_at(v, "$.sessionId")), created_at=("first", time_at(v, "$.startTime")), updated_at=("first", time_at(v, "$.lastUpdated")))
    named = F.try_to_timestamp(F.nullif(F.regexp_extract("path", r"session-(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    files = files.withColumns({"provider_session_id": F.coalesce("provider_session_id", _stem(F.col("path"))), "created_at": F.coalesce("created_at", named)})
    sessions, messages, transcripts = N.finished(events, files, "gemini_cli")
    return Parsed(sessions, messages, transcripts, spark.createDataFrame([], FILE_EDITS))


def aistudio(spark: SparkSession, path: str) -> Parsed:
    """Prompt files: chunks of a JSON document, or a Markdown file as one user turn."""
    v = F.col("v")
    raw = _documents(spark, path, "*")
    md = F.lower("path").endswith(".md")
    chunks = F.transform(
        array_at(v, "$.chunkedPrompt.chunks"),
        lambda c, i: F.when(
            text_at(c, "$.role").isin("user", "model", "assistant") & (text_at(c, "$.text") != ""),
            _event(part=i, role=F.when(text_at(c, "$.role") == "user", "user").otherwise("assistant"), content=text_at(c, "$.text"), in_transcript=F.lit(True)),
        ),
    )
    whole = F.array(F.when(md & (F.trim("line") != ""), _event(part=F.lit(0), role=F.lit("user"), content=F.col("line"), in_transcript=F.lit(True))))
    events = _exploded(raw, F.when(md, whole).otherwise(chunks))
    files = _file_sessions(raw)
    files = files.withColumns({"provider_session_id": N.file_name(F.col("path")), "parse_warning": F.when(F.lower("path").endswith(".md"), F.lit(None)).otherwise(F.col("parse_warning"))})
    sessions, messages, transcripts = N.finished(events, files, "aistudio")
    return Parsed(sessions, messages, transcripts, spark.createDataFrame([], FILE_EDITS))


PARSERS: dict[str, Callable[[SparkSession, str], Parsed]] = {
    "claude": claude, "codex": codex, "cursor": cursor, "antigravity": antigravity, "pi": pi, "claude_desktop": claude_desktop, "gemini_cli": gemini_cli, "aistudio": aistudio,
    "prime_agent": lambda spark, path: pi(spark, path, "prime_agent"),
}


#: Formats of lines that only ever grow, which can be parsed from a byte offset.
LINE_FORMATS: dict[str, Callable[[DataFrame], Told]] = {"claude": claude_lines, "codex": codex_lines, "pi": pi_lines, "prime_agent": lambda raw: pi_lines(raw, "prime_agent"), "claude_desktop": lambda raw: claude_lines(raw, "claude_desktop")}


def union(parsed: list[Parsed]) -> Parsed:
    """Several formats' rows together."""
    out = parsed[0]
    for p in parsed[1:]:
        out = Parsed(*[getattr(out, f).unionByName(getattr(p, f)) for f in ("sessions", "messages", "transcripts", "file_edits")])
    return out


def ingest(spark: SparkSession, roots: dict[str, str]) -> Parsed:
    """All formats of ``roots`` (provider: folder), with what the agents keep beside the logs."""
    from . import sidecars

    parsed = {p: PARSERS[p](spark, path) for p, path in roots.items()}
    return union([replace(x, sessions=sidecars.enriched(spark, p, roots[p], x.sessions)) for p, x in parsed.items()])
