"""The engine's tables, and views of general tables in their shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSIONS = (
    "id string not null, provider string, provider_session_id string, title string, summary string, cwd string, repo_root string, "
    "created_at timestamp, updated_at timestamp, last_message_at timestamp, preview_text string, source_path string, message_count bigint, "
    "parse_version string, raw_metadata_json string, parse_warning string, discovery_source string, parent_session_id string, agent_label string"
)
MESSAGES = (
    "id bigint, session_id string, provider string, seq bigint, role string, kind string, ts timestamp, tool_name string, tool_call_id string, "
    "is_compaction boolean, content string, authorship string, record_relation string, correlation struct<authority:string,scope:string,id:string>, "
    "content_parts array<struct<ordinal:int,start_char:bigint,end_char:bigint,authorship:string,origin:string>>"
)
FILE_EDITS = (
    "session_id string, provider string, seq bigint, ts timestamp, tool string, file_path string, file_name string, new_content string, "
    "edits array<struct<old:string,new:string,replace_all:boolean>>"
)
TRANSCRIPTS = "session_id string, transcript_text string"

PROVIDERS = ("claude", "codex", "cursor", "antigravity", "pi", "prime_agent", "gemini_cli", "aistudio", "claude_desktop")
ROLES = ("user", "assistant", "tool", "slash", "compaction")
KINDS = ("conversation", "compaction", "tool_call", "tool_result", "harness_notice", "unknown")
AUTHORSHIPS = ("human", "agent", "harness", "generated", "mixed", "unknown")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shaped(df: DataFrame, columns: str) -> DataFrame:
    """All columns of the DDL text, in order; missing ones null."""
    have, schema = set(df.columns), T.StructType.fromDDL(columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages: a session a conversation, system turns as harness notices."""
    c = table(spark, sf_dir, "conversations")
    system = F.col("role") == "system"
    return shaped(
        c.select(
            (F.col("conv_id") * 100000 + F.col("turn")).alias("id"),
            F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("session_id"),
            F.lit("claude").alias("provider"),
            F.col("turn").alias("seq"),
            F.when(system, "user").otherwise(F.col("role")).alias("role"),
            F.when(system, "harness_notice").otherwise("conversation").alias("kind"),
            F.lit(False).alias("is_compaction"),
            F.col("text").alias("content"),
            F.when(system, "harness").when(F.col("role") == "user", "human").otherwise("agent").alias("authorship"),
            F.lit("original").alias("record_relation"),
        ),
        MESSAGES,
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as timed tool calls: a session a user, the properties as arguments."""
    e = table(spark, sf_dir, "events")
    return shaped(
        e.select(
            F.col("event_id").alias("id"),
            F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("session_id"),
            F.lit("codex").alias("provider"),
            (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("seq"),
            F.lit("tool").alias("role"),
            F.lit("tool_call").alias("kind"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("tool_name"),
            F.concat(F.lit('{"args":'), F.col("props"), F.lit(',"kind":"tool_call"}')).alias("content"),
            F.lit("agent").alias("authorship"),
            F.lit("original").alias("record_relation"),
        ),
        MESSAGES,
    )


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session a user of ``events``: its span and number of events; a parent for every third user."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    uid = F.col("user_id").cast("string")
    return shaped(
        e.select(
            F.concat(F.lit("user:"), uid).alias("id"),
            F.lit("codex").alias("provider"),
            uid.alias("provider_session_id"),
            F.concat(F.lit("session of user "), uid).alias("title"),
            F.concat(F.lit("/home/u"), (F.col("user_id") % 7).cast("string"), F.lit("/p"), (F.col("user_id") % 3).cast("string")).alias("cwd"),
            F.concat(F.lit("/home/u"), (F.col("user_id") % 7).cast("string")).alias("repo_root"),
            F.col("a").cast("timestamp").alias("created_at"),
            F.col("b").cast("timestamp").alias("updated_at"),
            F.col("b").cast("timestamp").alias("last_message_at"),
            F.col("n").alias("message_count"),
            F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("user:"), (F.col("user_id") + 1).cast("string"))).alias("parent_session_id"),
            F.when(F.col("n") < 60, F.lit("few events")).alias("parse_warning"),
        ),
        SESSIONS,
    )


def document_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as searchable sessions: title the first line, summary the second, transcript the text."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("provider"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"),
        F.split_part(text, F.lit("\n"), F.lit(2)).alias("summary"),
        F.concat(F.lit("/src/"), F.coalesce("source", F.lit(""))).alias("cwd"),
        F.col("lang").alias("repo_root"),
        F.lit(None).cast("string").alias("preview_text"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        text.alias("transcript_text"),
    )


def lineitem_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as file edits: a session an order, a file a part."""
    li = table(spark, sf_dir, "lineitem")
    return shaped(
        li.select(
            F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("session_id"),
            F.lit("claude").alias("provider"),
            F.col("l_linenumber").cast("bigint").alias("seq"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.when(F.col("l_returnflag") == "A", "Write").otherwise("Edit").alias("tool"),
            F.concat(F.lit("/repo/src/part"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, ".rs").otherwise(".py")).alias("file_path"),
            F.concat(F.lit("part"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, ".rs").otherwise(".py")).alias("file_name"),
        ),
        FILE_EDITS,
    )
