"""What agents keep about sessions beside their logs: thread databases, title indexes, metadata files.

A thread database is read by ``sqlite_table``, a data source with one partition a
file, opened on the executor; a file that is missing gives no row, one that is
locked or broken gives a row that says so. Titles and folders are joined to
sessions by the agent's home and the session's id, so homes don't mix.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import truncate_for_display
from . import tail

#: Columns of a thread database; databases of other versions lack some of them.
THREAD_COLUMNS = ("id", "title", "cwd", "created_at", "updated_at", "created_at_ms", "updated_at_ms", "first_user_message", "rollout_path", "source", "model_provider", "git_branch", "git_sha", "cli_version", "agent_nickname", "model")

#: Files in an agent's home.
THREAD_FILE, TITLE_FILE = "state_5.sqlite", "session_index.jsonl"

#: How long a reader waits for a database that is being written.
BUSY_SECONDS = 5


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def connected(path: str) -> sqlite3.Connection:
    """A read-only connection: of a local or mounted file in place, else of its bytes in memory."""
    fs, where = tail.file_system(path)
    if fs.type_name == "local":
        return sqlite3.connect(f"file:{quote(where)}?mode=ro", uri=True, timeout=BUSY_SECONDS)
    with fs.open_input_file(where) as f:
        raw = bytearray(f.read())
    # what a write-ahead log beside the file holds isn't there; the header must not ask for it
    if raw[18:20] == b"\x02\x02":
        raw[18:20] = b"\x01\x01"
    db = sqlite3.connect(":memory:")
    db.deserialize(bytes(raw))
    return db


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, columns: list[str]):
        self.paths, self.table, self.columns = paths, table, columns

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        none = (None,) * len(self.columns)
        fs, where = tail.file_system(partition.path)
        if fs.get_file_info(where).type.name == "NotFound":
            return
        try:
            db = connected(partition.path)
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            have = {r[1] for r in db.execute(f'PRAGMA table_info("{self.table}")')}
            picked = ", ".join(f'CAST("{c}" AS TEXT)' if c in have else "NULL" for c in self.columns)
            for row in db.execute(f'SELECT {picked} FROM "{self.table}"'):
                yield partition.path, None, *row
        except (sqlite3.Error, OSError) as e:
            yield partition.path, f"{type(e).__name__}: {e}", *none


class SqliteTable(DataSource):
    """Options: paths (a JSON list), table, columns (a JSON list; those that a file lacks are null). All values are text."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def columns(self) -> list[str]:
        return json.loads(self.options["columns"])

    def schema(self) -> str:
        return "path string, problem string, " + ", ".join(f"`{c}` string" for c in self.columns())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]), self.options["table"], self.columns())


def sqlite_table(spark: SparkSession, paths: list[str], table: str, columns: tuple[str, ...]) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(paths=json.dumps(paths), table=table, columns=json.dumps(columns)).load()


def bare(path: Column) -> Column:
    """A path without the scheme of local files, which readers spell differently."""
    return F.regexp_replace(path, "^file:/+", "/")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def codex_threads(spark: SparkSession, homes: list[str]) -> DataFrame:
    """(home, thread, problem, title, cwd, created_at, updated_at, first_user_message, raw) of all homes' databases."""
    rows = sqlite_table(spark, [f"{h.rstrip('/')}/{THREAD_FILE}" for h in homes], "threads", THREAD_COLUMNS)

    def at(name: str) -> Column:
        whole = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
        return F.coalesce(F.timestamp_millis(whole(f"{name}_ms")), F.timestamp_seconds(whole(name)))

    raw = F.to_json(F.struct(*[F.col(c) for c in THREAD_COLUMNS if c not in ("id", "title", "cwd", "first_user_message")]))
    return rows.select(bare(folder_of(F.col("path"))).alias("home"), F.col("id").alias("thread"), "problem", "title", "cwd", at("created_at").alias("created_at"), at("updated_at").alias("updated_at"), "first_user_message", raw.alias("raw"))


def codex_titles(spark: SparkSession, homes: list[str]) -> DataFrame:
    """(home, thread, title) of all homes' title indexes; of several lines for a thread the last counts, broken lines are passed over."""
    from . import logs

    found = None
    for h in homes:
        read = logs.lines(spark, h, TITLE_FILE)
        found = read if found is None else found.unionByName(read)
    v = F.col("v")
    named = found.select(bare(folder_of(F.col("path"))).alias("home"), logs.text_at(v, "$.id").alias("thread"), logs.text_at(v, "$.thread_name").alias("title"), "line_no").filter("thread IS NOT NULL AND trim(title) <> ''")
    return named.groupBy("home", "thread").agg(F.max_by("title", "line_no").alias("title"))


def with_threads(sessions: DataFrame, threads: DataFrame, titles: DataFrame) -> DataFrame:
    """Codex sessions with titles, dates and folders of their home's sidecars.

    A title of the database comes first, then one of the index; what the log says
    of folder and dates comes before what the database says. A database that
    couldn't be read is named in its sessions' warnings.
    """
    names = sessions.columns
    home = F.regexp_extract(bare(F.col("source_path")), "^(.*?)/[^/]*sessions/", 1)
    own = sessions.withColumn("__home", home)
    good = threads.filter("thread IS NOT NULL").groupBy("home", "thread").agg(*[F.max_by(c, F.struct(F.coalesce("updated_at", F.timestamp_seconds(F.lit(0))), F.coalesce(c, F.lit("")) if c in ("title", "cwd", "first_user_message", "raw") else F.lit(""))).alias(f"__{c}") for c in ("title", "cwd", "created_at", "updated_at", "first_user_message", "raw")])
    bad = threads.filter("problem IS NOT NULL").groupBy("home").agg(F.min("problem").alias("__problem"))
    joined = (
        own.join(good.withColumnsRenamed({"home": "__home", "thread": "provider_session_id"}), ["__home", "provider_session_id"], "left")
        .join(titles.withColumnsRenamed({"home": "__home", "thread": "provider_session_id", "title": "__index"}), ["__home", "provider_session_id"], "left")
        .join(F.broadcast(bad.withColumnRenamed("home", "__home")), "__home", "left")  # a row a home
    )
    merged_raw = F.when(F.col("__raw").isNull(), F.col("raw_metadata_json")).when(F.col("raw_metadata_json").isNull(), F.col("__raw")).otherwise(
        F.concat(F.regexp_replace("raw_metadata_json", r"\}$", ""), F.lit(","), F.regexp_replace("__raw", r"^\{", ""))
    )
    return joined.withColumns(
        {
            "title": truncate_for_display(F.coalesce("__title", "__index", "title"), 100),
            "summary": F.coalesce(truncate_for_display(F.col("__first_user_message"), 180), "summary"),
            "cwd": F.coalesce("cwd", "__cwd"),
            "created_at": F.coalesce("created_at", "__created_at"),
            "updated_at": F.coalesce("updated_at", "__updated_at"),
            "raw_metadata_json": merged_raw,
            "parse_warning": F.nullif(F.concat_ws("; ", "parse_warning", F.concat(F.lit("sidecar: "), "__problem")), F.lit("")),
        }
    ).select(names)


def _json_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, v) of whole JSON files below ``root``."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return read.select(bare(F.col("_metadata.file_path")).alias("path"), F.try_parse_json("value").alias("v"))


def with_metadata_files(sessions: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """Claude sessions with their metadata files.

    Beside a spawned agent's log lies ``agent-<id>.meta.json`` with its task and
    kind; beside a desktop session's folder ``<folder>.json`` with its title,
    folder and dates, which come before what the log says.
    """
    from .logs import text_at, time_at

    names, v = sessions.columns, F.col("v")
    said = lambda *paths: F.coalesce(*[F.nullif(F.trim(text_at(v, p)), F.lit("")) for p in paths])
    tasks = _json_files(spark, root, "agent-*.meta.json").select(
        F.regexp_replace("path", r"\.meta\.json$", ".jsonl").alias("__at"), said("$.description").alias("__task"), said("$.agentType").alias("__kind")
    )
    desktop = _json_files(spark, root, "*.json").filter(F.col("path").contains("/local-agent-mode-sessions/") & ~F.col("path").endswith(".meta.json")).select(
        F.regexp_replace("path", r"\.json$", "").alias("__dir"), said("$.title").alias("__title"), said("$.cwd").alias("__cwd"), said("$.initialMessage").alias("__first"),
        time_at(v, "$.createdAt").alias("__created"), F.coalesce(time_at(v, "$.lastActivityAt"), time_at(v, "$.updatedAt")).alias("__updated"),
    )
    own = sessions.withColumns({"__at": bare(F.col("source_path")), "__dir": F.when(F.col("source_path").endswith("/audit.jsonl"), bare(folder_of(F.col("source_path"))))})
    joined = own.join(tasks, "__at", "left").join(desktop, "__dir", "left")
    return joined.withColumns(
        {
            "title": truncate_for_display(F.coalesce("__title", "__task", "title"), 100),
            "summary": F.coalesce("summary", truncate_for_display(F.col("__first"), 180)),
            "agent_label": F.coalesce("__kind", "agent_label"),
            "cwd": F.coalesce("__cwd", "cwd"),
            "created_at": F.coalesce("__created", "created_at"),
            "updated_at": F.coalesce("__updated", "updated_at"),
        }
    ).select(names)


def enriched(spark: SparkSession, provider: str, root: str | list[str], sessions: DataFrame) -> DataFrame:
    """Sessions with what the provider keeps beside the logs below ``root``."""
    roots = [root] if isinstance(root, str) else root
    if provider == "codex":
        homes = sorted({r.rstrip("/").rsplit("/", 1)[0] for r in roots})
        return with_threads(sessions, codex_threads(spark, homes), codex_titles(spark, homes))
    if provider in ("claude", "claude_desktop"):
        for r in roots:
            sessions = with_metadata_files(sessions, spark, r)
    return sessions
