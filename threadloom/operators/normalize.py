"""Normalisation of parsed events into messages, sessions and file edits.

Parsers give one row per event: path, line_no, part (order within the line),
role, text and what they know besides. Fold state of a log becomes windows and
joins here: sequence numbers, first-bound ids, tool names, titles and spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, slash_command, truncate_for_display

#: Commands that carry no text of their own.
BOOKKEEPING = ("/exit", "/clear", "/compact", "resume cancelled", "i'll start by studying")

EVENTS = (
    "path string, line_no decimal(38,0), part int, role string, kind string, ts timestamp, tool_name string, tool_call_id string, content string, "
    "authorship string, authority string, event_id string, in_transcript boolean"
)


def role_of(role: Column, text: Column) -> Column:
    """Stored role: spellings unified; a user's text that begins with a command is slash."""
    low = F.lower(role)
    return (
        F.when(low.isin("assistant", "model"), "assistant")
        .when(low.isin("tool", "toolresult", "tool_result"), "tool")
        .when(low == "compaction", "compaction")
        .when(slash_command(text).isNotNull(), "slash")
        .otherwise("user")
    )


def kind_of(role: Column, content: Column) -> Column:
    """Kind by role; a tool row is a call if its JSON says so."""
    call = F.try_variant_get(F.try_parse_json(content), "$.kind", "string") == "tool_call"
    return F.when(role == "compaction", "compaction").when(role == "tool", F.when(call, "tool_call").otherwise("tool_result")).otherwise("conversation")


def authorship_of(role: Column, kind: Column) -> Column:
    """Authorship that follows from role and kind; a user's stays unknown until the session is known."""
    return (
        F.when(kind == "harness_notice", "harness")
        .when(kind == "tool_call", "agent")
        .when(kind.isin("compaction", "tool_result"), "generated")
        .when(role == "assistant", "agent")
        .when(role.isin("user", "slash"), "unknown")
        .otherwise("generated")
    )


def resolved_authorship(authorship: Column, role: Column, kind: Column, spawned: Column) -> Column:
    """Unknown user rows are a person's in started sessions and the agent's in spawned ones; null spawned: unknown."""
    own = (authorship == "unknown") & role.isin("user", "slash") & kind.isin("conversation", "unknown")
    return F.when(own & spawned, "agent").when(own & ~spawned, "human").otherwise(authorship)


def tool_call_content(name: Column, args: Column) -> Column:
    """The canonical envelope of a call; ``args`` is JSON text (null: JSON null)."""
    quoted = F.to_json(F.struct(name.alias("n")))
    return F.concat(F.lit('{"args":'), F.coalesce(args, F.lit("null")), F.lit(',"kind":"tool_call","tool_name":'), F.regexp_extract(quoted, r'^\{"n":(.*)\}$', 1), F.lit("}"))


def substantive(text: Column) -> Column:
    """Not blank, not a command's bookkeeping."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return (bare != "") & ~bare.contains("<local-command-") & ~bare.contains("<command-name>/") & ~F.lower(bare).isin(*BOOKKEEPING)


def tag_content(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def strip_command_markup(text: Column) -> Column:
    """``/name args`` for a command's markup; other texts stay."""
    name, args = F.trim(tag_content(text, "command-name")), F.trim(tag_content(text, "command-args"))
    slashed = F.when((name != "") & ~name.startswith("/"), F.concat(F.lit("/"), name)).otherwise(name)
    return F.when(~text.contains("<command-name>"), text).otherwise(F.trim(F.concat_ws(" ", slashed, args)))


def sequenced(events: DataFrame) -> DataFrame:
    """``seq`` from 0 in each file, by line and part."""
    order = Window.partitionBy("path").orderBy("line_no", "part")
    return events.withColumn("seq", (F.row_number().over(order) - 1).cast("bigint"))


def with_tool_names(events: DataFrame) -> DataFrame:
    """Results named after the call with their id, in the same file."""
    calls = events.filter("kind = 'tool_call' AND tool_call_id IS NOT NULL").groupBy("path", "tool_call_id").agg(F.max_by("tool_name", F.struct("line_no", "part")).alias("__call"))
    return events.join(calls, ["path", "tool_call_id"], "left").withColumn("tool_name", F.coalesce("tool_name", "__call")).drop("__call")


def titles(events: DataFrame) -> DataFrame:
    """(path, first_user, last_user): a file's first and last substantive user texts."""
    order = F.struct("line_no", "part")
    user = events.filter((F.col("role") == "user") & (F.coalesce("kind", F.lit("")) != "harness_notice") & substantive(F.col("content")))
    return user.groupBy("path").agg(F.min_by("content", order).alias("first_user"), F.max_by("content", order).alias("last_user"))


def dated_sessions(sessions: DataFrame) -> DataFrame:
    """Missing dates filled: end from the file's time, start from the end; a reversed span is swapped and warned of."""
    end = F.coalesce("updated_at", "mtime")
    start = F.coalesce("created_at", end)
    swapped = start > end
    warn = F.when(swapped, F.concat_ws("; ", "parse_warning", F.lit("reversed session dates"))).otherwise(F.col("parse_warning"))
    return sessions.withColumns(
        {"created_at": F.least(start, end), "updated_at": F.greatest(start, end), "last_message_at": F.coalesce("last_message_at", F.greatest(start, end)), "parse_warning": warn}
    )


def dated_events(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages without a time take the session's last, end, or start."""
    side = sessions.select(F.col("id").alias("session_id"), F.coalesce("last_message_at", "updated_at", "created_at").alias("__ts"))
    return messages.join(side, "session_id", "left").withColumn("ts", F.coalesce("ts", "__ts")).drop("__ts")


def parts_valid(content: Column, parts: Column) -> Column:
    """Parts in order, non-empty, side by side, covering the content, by two authors or more."""
    n = F.size(parts)
    ordered = F.forall(
        F.sequence(F.lit(0), n - 1),
        lambda i: (parts[i]["ordinal"] == i)
        & (parts[i]["start_char"] < parts[i]["end_char"])
        & (parts[i]["start_char"] == F.when(i == 0, F.lit(0).cast("bigint")).otherwise(parts[F.greatest(i - 1, F.lit(0))]["end_char"])),
    )
    whole = parts[n - 1]["end_char"] == F.length(content)
    return F.when(n < 2, F.lit(False)).otherwise(ordered & whole & (F.size(F.array_distinct(F.transform(parts, lambda p: p["authorship"]))) > 1))


def patch_files(patch: Column) -> Column:
    """Array of struct(file_path, new_content) of a patch: added files whole, others by path only."""
    lines = F.split(patch, "\n")
    kind = r"^\*\*\* (Add|Update|Delete) File: (.*)$"
    none = F.array().cast("array<struct<file_path:string,new_content:string,adding:boolean>>")

    def step(acc: Column, line: Column) -> Column:
        line = F.regexp_replace(line, r"\r$", "")
        verb, path = F.regexp_extract(line, kind, 1), F.trim(F.regexp_extract(line, kind, 2))
        last = F.element_at(acc, -1)
        start = F.struct(path.alias("file_path"), F.when(verb == "Add", F.lit("")).alias("new_content"), (verb == "Add").alias("adding"))
        grown = F.struct(
            last["file_path"].alias("file_path"),
            F.when(last["new_content"] == "", F.concat(F.substring(line, 2, 2**30), F.lit("\0"))).otherwise(F.concat(last["new_content"], F.substring(line, 2, 2**30), F.lit("\0"))).alias("new_content"),
            last["adding"].alias("adding"),
        )
        closed = F.struct(last["file_path"].alias("file_path"), last["new_content"].alias("new_content"), F.lit(False).alias("adding"))
        rest = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        inside = (F.size(acc) > 0) & F.coalesce(last["adding"], F.lit(False))
        return (
            F.when(verb != "", F.concat(acc, F.array(start)))
            .when(line.rlike(r"^\*\*\* (Begin|End) Patch") & inside, F.concat(rest, F.array(closed)))
            .when(inside & line.startswith("+"), F.concat(rest, F.array(grown)))
            .otherwise(acc)
        )

    found = F.aggregate(lines, none, step)
    # added lines were closed by a mark each; between them it is a newline
    text = lambda f: F.replace(F.regexp_replace(f["new_content"], "\0$", ""), F.lit("\0"), F.lit("\n"))
    return F.transform(found, lambda f: F.struct(f["file_path"].alias("file_path"), text(f).alias("new_content")))


def finished(events: DataFrame, sessions: DataFrame, provider: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, transcripts) in the engine's shape.

    ``sessions`` has a row a file: path, provider_session_id, cwd, created_at,
    updated_at, mtime, parse_warning, parent_session_id, agent_label, title.
    """
    from ..sources.sinks import transcripts

    rows = sequenced(with_tool_names(events))
    summed = titles(events).join(rows.groupBy("path").agg(F.count("*").alias("message_count")), "path", "full")
    made, messages, said = stored_rows(rows, sessions.join(summed, "path", "left"), provider)
    return made, messages, transcripts(said)


def grown(events: DataFrame, since: DataFrame) -> DataFrame:
    """Events from line ``from_line`` on, numbered from ``next_seq``; earlier ones only name tools."""
    named = with_tool_names(events).join(since.select("path", "from_line", "next_seq"), "path").filter(F.col("line_no") >= F.col("from_line"))
    return sequenced(named).withColumn("seq", F.col("seq") + F.col("next_seq")).drop("from_line", "next_seq")


def stored_rows(seqd: DataFrame, base: DataFrame, provider: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, the transcript's messages) of numbered events and files with their first and last user texts and message_count."""
    from ..sources.tables import MESSAGES, SESSIONS, shaped

    made = base.select(
        F.concat(F.lit(f"{provider}:"), "provider_session_id").alias("id"),
        "path",
        F.lit(provider).alias("provider"),
        "provider_session_id",
        F.coalesce("title", truncate_for_display(F.coalesce("last_user", "first_user"), 100)).alias("title"),
        truncate_for_display(F.col("first_user"), 180).alias("summary"),
        "cwd",
        "repo_root",
        "created_at",
        "updated_at",
        F.lit(None).cast("timestamp").alias("last_message_at"),
        "mtime",
        F.coalesce(truncate_for_display(F.coalesce("last_user", "first_user"), 140), F.lit("(no preview available)")).alias("preview_text"),
        F.col("path").alias("source_path"),
        F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.lit("1").alias("parse_version"),
        "raw_metadata_json",
        "parse_warning",
        F.lit(provider).alias("discovery_source"),
        "parent_session_id",
        "agent_label",
    )
    dated = dated_sessions(made)
    ids = dated.select("path", F.col("id").alias("session_id"), F.col("parent_session_id").isNotNull().alias("spawned"))
    joined = seqd.join(ids, "path")
    role = F.when(F.col("kind") == "harness_notice", F.lit("user")).otherwise(role_of(F.col("role"), F.col("content")))
    stored = joined.withColumn("role", role)
    kind = F.coalesce("kind", kind_of(F.col("role"), F.col("content")))
    stored = stored.withColumn("kind", kind)
    author = F.coalesce("authorship", resolved_authorship(authorship_of(F.col("role"), F.col("kind")), F.col("role"), F.col("kind"), F.col("spawned")))
    messages = stored.select(
        F.xxhash64("session_id", "seq").alias("id"), "session_id", F.lit(provider).alias("provider"), "seq", "role", "kind", "ts", "tool_name", "tool_call_id",
        (F.col("kind") == "compaction").alias("is_compaction"), "content", author.alias("authorship"),
        F.when(F.col("event_id").isNotNull(), "original").otherwise("unknown").alias("record_relation"),
        F.when(F.col("event_id").isNotNull(), F.struct("authority", F.lit("session").alias("scope"), F.col("event_id").alias("id"))).alias("correlation"),
        "in_transcript",
    )
    # only what a person and the model said to one another is in the transcript
    return shaped(dated, SESSIONS), shaped(dated_events(messages, dated), MESSAGES), messages.filter("in_transcript")


def file_name(path: Column) -> Column:
    return basename(path)


def with_repo_roots(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """Sessions with ``repo_root``: the longest of the known ``roots`` (path; perhaps root, what to store for it) that the working folder is or lies below.

    Every folder above the working folder is looked up by equality, so no prefix is compared with all roots.
    """
    parts = F.split(F.regexp_replace("cwd", "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    folders = sessions.filter(F.col("cwd").isNotNull()).select("id", F.explode(above).alias("path"))
    path = F.regexp_replace("path", "/+$", "")
    known = roots.select(path.alias("path"), (F.col("root") if "root" in roots.columns else path).alias("__name")).dropDuplicates(["path"])
    found = folders.join(known, "path").groupBy("id").agg(F.max_by("__name", F.length("path")).alias("__root"))
    return sessions.join(found, "id", "left").withColumn("repo_root", F.coalesce("__root", "repo_root")).drop("__root")
