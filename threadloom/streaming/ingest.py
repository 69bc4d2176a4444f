"""Incremental ingest: what changed since last time, and only that written.

State is a table of files seen: time, size, parser version and, for logs of lines,
the bytes parsed, the head's fingerprint and what the lines so far said of their
session. A refresh compares it with the folder. A log that grew is parsed from
its last byte on (``sources.tail``), its new rows are appended and its session's
row is replaced; a new file, one whose head changed or that shrank is parsed as a
whole and its sessions are replaced; files that have vanished keep their rows.
The result is the one a full parse gives. Lists of files and their state stay in
tables; only the names of files of whole documents come to the driver, where
Spark's reader keeps them as well.

The store is layers, merged when read. A refresh writes one layer: for each table
the new rows, and the keys (sessions, files) whose older rows are dead. A row is
seen unless its key died in a later layer. Messages have posting lists of their
trigrams beside them, layer by layer (``search_stored``). When there are FANOUT layers of a size
they are merged into one, so a row is written anew a few times in all, and what a
refresh writes is in proportion to what changed.

Nothing that is stored is ever overwritten. A layer's folders are its own, and
one manifest names the layers of all tables; the manifest with the highest number
is the store. So all tables change at once, a run that dies leaves no trace but
unused folders, of two runs at a time the second fails instead of losing the
first one's rows, and a reader that holds a manifest's number (``snapshot``) sees
the same rows in every step.

``follow`` does the same for a folder that gets new files, as a stream: Spark's
checkpoint knows the files it has taken, and every micro-batch is one refresh
of the same store, files seen included.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators.search import SearchRequest, indexed
from ..sources import logs, places, postings, sidecars, tail
from ..sources.session import cut
from ..sources.sinks import transcripts
from ..sources.tables import FILE_EDITS, MESSAGES, SESSIONS, shaped
from .lease import Lease, claim
from .lease import file_system as _fs

#: What is known of a file's lines so far; null for files of whole documents.
PROGRESS = (
    "session_id string, parsed_bytes bigint, head string, next_seq bigint, next_edit bigint, undated bigint, first_user string, last_user string, "
    "malformed bigint, line_count bigint, valid_count bigint, provider_session_id string, cwd string, created_at timestamp, updated_at timestamp, parent_session_id string, agent_label string"
)
SEEN = f"provider string, source_path string, mtime timestamp, size_bytes bigint, parse_version string, {PROGRESS}"

#: Raised when a parser's rows change, so that files it parsed before are parsed again.
PARSE_VERSION = "2"

#: A transcript is stored in pieces, one for each time its session grew.
PIECES = "session_id string, seq bigint, transcript_text string"

TABLES = {"sessions": (SESSIONS, "id"), "messages": (MESSAGES, "session_id"), "transcripts": (PIECES, "session_id"), "file_edits": (FILE_EDITS, "session_id"), "files_seen": (SEEN, "source_path")}

#: So many layers of a size are merged; sizes grow by the same factor from SMALL_BYTES on.
FANOUT = 4
SMALL_BYTES = 16 << 20

#: Dead keys up to which they are broadcast to a reader (some 50 MB).
BROADCAST_DEAD = 500_000


#: File names of the formats that are not JSON lines or JSON alone.
GLOBS = {"aistudio": "*.{json,md}", "claude": "*.jsonl", "codex": "*.jsonl", "claude_desktop": "audit.jsonl"}


def discover(spark: SparkSession, provider: str, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Files below ``path`` with time and size, each once under whatever links it has; contents are not read."""
    glob = glob or GLOBS.get(provider, "*.json*")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    listed = read.select(
        F.lit(provider).alias("provider"), F.col("path").alias("source_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), F.lit(PARSE_VERSION).alias("parse_version")
    )
    return places.unique_sources(listed)


def changes(discovered: DataFrame, seen: DataFrame) -> DataFrame:
    """``discovered`` with state: new, changed_file, changed_parser or current."""
    old = seen.select("provider", "source_path", F.col("mtime").alias("__mtime"), F.col("size_bytes").alias("__size"), F.col("parse_version").alias("__version"))
    state = (
        F.when(F.col("__size").isNull(), "new")
        .when((F.col("__mtime") != F.col("mtime")) | (F.col("__size") != F.col("size_bytes")), "changed_file")
        .when(F.col("__version") != F.col("parse_version"), "changed_parser")
        .otherwise("current")
    )
    return discovered.join(old, ["provider", "source_path"], "left").withColumn("state", state).drop("__mtime", "__size", "__version")


# --- the store: layers and numbered manifests ---------------------------------


def manifests(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the store's manifests, in order."""
    fs, folder = _fs(spark, f"{store}/_manifests")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def snapshot(spark: SparkSession, store: str) -> int:
    """The number of the present manifest, 0 before the first refresh; give it to ``stored`` for steps that must agree."""
    return max(manifests(spark, store), default=0)


@dataclass
class Part:
    """A table's share of a layer: the folder of its rows, and of the keys whose older rows are dead."""

    rows: str | None = None
    bytes: int = 0
    dead: str | None = None
    dead_rows: int = 0
    #: Posting lists of the rows' texts.
    lists: str | None = None


@dataclass
class Layer:
    number: int
    parts: dict[str, Part] = field(default_factory=dict)

    @property
    def level(self) -> int:
        size = sum(p.bytes for p in self.parts.values())
        return 0 if size < SMALL_BYTES else 1 + int(math.log(size / SMALL_BYTES, FANOUT))


def manifest(spark: SparkSession, store: str, at: int | None = None) -> list[Layer]:
    """The layers of a manifest, oldest first."""
    at = snapshot(spark, store) if at is None else at
    if not at:
        return []
    row = spark.read.text(f"{store}/_manifests/{at:010d}.json", wholetext=True).first()
    return [Layer(x["number"], {k: Part(**p) for k, p in x["parts"].items()}) for x in json.loads(row[0])]


def publish(spark: SparkSession, store: str, held: list[Layer], after: int) -> int:
    """Make the layers ``held`` the store, if ``after`` is still its manifest; raises FileExistsError if another run was faster.
    """
    if not claim(spark, f"{store}/_manifests/{after + 1:010d}.json", json.dumps([asdict(x) for x in held], sort_keys=True).encode()):
        raise FileExistsError(f"manifest {after + 1} of {store} is there already")
    return after + 1


def visible(spark: SparkSession, layers: list[Layer], name: str) -> DataFrame:
    """A table's rows in these layers, without those whose key died in a later one of them; with ``layer`` (messages: and ``doc``)."""
    key, schema = TABLES[name][1], f"{TABLES[name][0]}, layer bigint{', doc bigint' if name == 'messages' else ''}"
    parts = [x.parts[name] for x in layers if name in x.parts]
    folders = [p.rows for p in parts if p.rows]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*folders)
    if any(p.dead for p in parts):
        dead = spark.read.schema("key string, layer bigint").parquet(*[p.dead for p in parts if p.dead]).groupBy("key").agg(F.max("layer").alias("__dead"))
        dead = F.broadcast(dead) if sum(p.dead_rows for p in parts) <= BROADCAST_DEAD else dead
        alive = F.col("__dead").isNull() | (F.col("layer") >= F.col("__dead"))
        rows = rows.join(dead.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left").filter(alive).drop("__key", "__dead")
    return rows


def stored(spark: SparkSession, store: str, name: str, at: int | None = None) -> DataFrame:
    """A table of the store, by default the present one; empty before the first refresh."""
    rows = visible(spark, manifest(spark, store, at), name).drop("layer", "doc")
    if name != "transcripts":
        return rows
    pieces = F.array_sort(F.collect_list(F.struct("seq", "transcript_text")))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(pieces, lambda x: x["transcript_text"]), "\n\n").alias("transcript_text"))


def search_stored(spark: SparkSession, store: str, request: SearchRequest, at: int | None = None) -> DataFrame:
    """``search.matching`` over the store's messages by way of their posting lists."""
    layers = manifest(spark, store, at)
    folders = [x.parts["messages"].lists for x in layers if "messages" in x.parts and x.parts["messages"].lists]
    lists = spark.read.schema(f"{postings.POSTINGS}, layer bigint").parquet(*folders) if folders else spark.createDataFrame([], f"{postings.POSTINGS}, layer bigint")
    return indexed(visible(spark, layers, "messages"), lists, request, stored(spark, store, "sessions", at), ("layer",))


def _written(spark: SparkSession, rows: DataFrame, place: str, *keys: str, number: bool = False) -> int:
    """Rows dealt out and sorted by key; Spark's adaptive plan makes as many files as their size asks for. Returns the bytes."""
    placed = rows.repartition(keys[0]).sortWithinPartitions(*keys)
    (postings.numbered(placed) if number else placed).write.parquet(place)
    return _bytes(spark, place)


def _bytes(spark: SparkSession, place: str) -> int:
    fs, folder = _fs(spark, place)
    return fs.getContentSummary(folder).getLength()


def write_layer(spark: SparkSession, store: str, number: int, rows: dict[str, DataFrame], dead: dict[str, DataFrame]) -> Layer:
    """A layer of ``rows`` and ``dead`` keys (key) by table; empty parts are left out."""
    run = f"layer-{number:010d}-{uuid.uuid4().hex[:8]}"
    out = Layer(number)
    for name, (schema, key) in TABLES.items():
        part = Part()
        if name in rows:
            place = f"{store}/{name}/{run}"
            order = [key, "seq"] if " seq bigint" in schema else [key]
            layer = F.lit(number).cast("bigint").alias("layer")
            part.bytes = _written(spark, rows[name].select("*", layer), place, *order, number=name == "messages")
            part.rows = place
            if name == "messages":
                part.lists = f"{store}/_lists/{run}"
                postings.write(postings.posting_rows(spark.read.parquet(place)).select("*", layer), part.lists)
                part.bytes += _bytes(spark, part.lists)
        if name in dead:
            place = f"{store}/_dead/{name}/{run}"
            part.bytes += _written(spark, dead[name].select("key").distinct().withColumn("layer", F.lit(number).cast("bigint")), place, "key")
            part.dead, part.dead_rows = place, spark.read.parquet(place).count()
        if part.rows or part.dead:
            out.parts[name] = part
    return out


def merged(spark: SparkSession, store: str, layers: list[Layer], oldest: bool) -> Layer:
    """Several neighbouring layers as one; what died in the ``oldest`` ones needs no more mention."""
    rows = {name: visible(spark, layers, name).drop("layer", "doc") for name in TABLES if any(name in x.parts and x.parts[name].rows for x in layers)}
    dead = {}
    for name in TABLES:
        folders = [x.parts[name].dead for x in layers if name in x.parts and x.parts[name].dead]
        if folders and not oldest:
            dead[name] = spark.read.schema("key string, layer bigint").parquet(*folders)
    return write_layer(spark, store, layers[-1].number, rows, dead)


def due(layers: list[Layer], fanout: int = FANOUT) -> int | None:
    """From which layer on all are to be merged: the last ones, if ``fanout`` of a size are among them."""
    for level in range(max((x.level for x in layers), default=-1) + 1):
        first = len(layers)
        while first and layers[first - 1].level <= level:
            first -= 1
        if sum(x.level == level for x in layers[first:]) >= fanout:
            return first
    return None


def merge_due(spark: SparkSession, store: str, fanout: int = FANOUT) -> int:
    """Merge layers for as long as any are due; returns the present manifest's number."""
    at = snapshot(spark, store)
    layers = manifest(spark, store, at)
    while (first := due(layers, fanout)) is not None:
        layers = layers[:first] + [merged(spark, store, layers[first:], first == 0)]
        at = publish(spark, store, layers, at)
    return at


def compact(spark: SparkSession, store: str) -> int:
    """All layers as one; returns the new manifest's number."""
    at = snapshot(spark, store)
    layers = manifest(spark, store, at)
    return publish(spark, store, [merged(spark, store, layers, True)] if layers else [], at)


# --- one refresh ----------------------------------------------------------------


def _folded(how: str, old: Column, new: Column) -> Column:
    return {"first": F.coalesce(old, new), "least": F.least(old, new), "greatest": F.greatest(old, new)}[how]


@dataclass
class Delta:
    """What one refresh adds: rows by table, and keys whose older rows die."""

    rows: dict[str, DataFrame]
    dead: dict[str, DataFrame]


def lines_delta(spark: SparkSession, provider: str, work: DataFrame, store: str, at: int) -> Delta:
    """Logs of lines: ``work`` has the columns of SEEN, what is known of each file, and ``again``, true for those to be parsed as a whole.

    Lines are parsed once: they are cut as variants, which all tables are made from.
    """
    known = work.withColumnsRenamed({"source_path": "path", "size_bytes": "size", "head": "known_head"})
    probed = tail.probe(known)
    goes_on = F.coalesce(~F.col("again") & F.col("same_head") & (F.col("size") >= F.col("parsed_bytes")) & (F.col("undated") == 0) & F.col("provider_session_id").isNotNull(), F.lit(False))
    since = cut(
        probed.withColumn("goes_on", goes_on).withColumns(
            {"from_line": F.when(F.col("goes_on"), F.col("parsed_bytes")).otherwise(0), **{c: F.when(F.col("goes_on"), F.col(c)).otherwise(0) for c in ("next_seq", "next_edit")}}
        )
    )
    ranges = since.filter("problem IS NULL AND complete > from_line").select("path", "mtime", F.greatest(F.col("from_line") - tail.OVERLAP_BYTES, F.lit(0)).alias("start"), F.col("complete").alias("end"))
    read = tail.lines(ranges)
    raw = cut(read.withColumn("line", F.when(F.col("v").isNull(), F.trim("line")).otherwise("")))
    told = logs.LINE_FORMATS[provider](raw)
    events = cut(N.grown(told.events, since))
    new = told.raw.join(since.select("path", "from_line"), "path").filter("line_no >= from_line")
    acc = logs.accumulated(new, told.facts).alias("n")
    summed = N.titles(events).join(events.groupBy("path").agg(F.count("*").alias("n_events"), F.count_if(F.col("ts").isNull()).alias("n_undated")), "path", "full")
    old = since.alias("o")
    before = lambda c: F.when(F.col("o.goes_on"), F.col(f"o.{c}"))
    both = acc.join(old, "path").join(summed.alias("s"), "path", "left")
    files = cut(
        both.select(
            "path", F.col("n.mtime").alias("mtime"),
            *[(F.coalesce(before(c), F.lit(0)) + F.col(f"n.{c}")).alias(c) for c in ("malformed", "line_count", "valid_count")],
            *[_folded(how, before(c), F.col(f"n.{c}")).alias(c) for c, (how, _) in told.facts.items()],
            F.coalesce(before("first_user"), F.col("s.first_user")).alias("first_user"), F.coalesce(F.col("s.last_user"), before("last_user")).alias("last_user"),
            (F.col("o.next_seq") + F.coalesce("s.n_events", F.lit(0))).alias("message_count"), F.coalesce("s.n_undated", F.lit(0)).alias("undated"),
        )
    )
    sessions, messages, said = N.stored_rows(events, told.named(logs.described(files)), provider)
    ids = cut(logs._ids(sessions).join(since.select("path", "goes_on", "next_edit"), "path"))
    numbered = logs._file_edits(told.edits.join(since.select("path", "from_line"), "path").filter("line_no >= from_line").drop("from_line"), ids.select("path", "session_id", "next_edit"), provider, "next_edit")
    edits = cut(numbered)
    pieces = transcripts(said).join(said.groupBy("session_id").agg(F.min("seq").alias("seq")), "session_id")
    # files that can't be read have a session that says so, unless they have one already
    stubs = since.filter("problem IS NOT NULL AND session_id IS NULL").select(
        F.concat(F.lit(f"{provider}:"), logs._stem(F.col("path"))).alias("id"), F.lit(provider).alias("provider"), logs._stem(F.col("path")).alias("provider_session_id"), F.col("path").alias("source_path"),
        F.col("mtime").alias("created_at"), F.col("mtime").alias("updated_at"), F.lit(0).alias("message_count"), F.col("problem").alias("parse_warning"), F.lit(PARSE_VERSION).alias("parse_version"),
    )
    n_edits = edits.join(ids.select("path", "session_id"), "session_id").groupBy("path").agg(F.count("*").alias("n_edits"))
    own = files.join(ids.select("path", "session_id"), "path", "left").join(n_edits, "path", "left").withColumnRenamed("mtime", "__mtime").alias("f")
    facts = ("provider_session_id", "cwd", "created_at", "updated_at", "parent_session_id", "agent_label")
    counts = ("undated", "first_user", "last_user", "malformed", "line_count", "valid_count")
    kept = lambda c, now: F.when(F.col("f.line_count").isNotNull(), now).otherwise(F.when(F.col("o.goes_on"), F.col(f"o.{c}"))).alias(c)
    seen = since.filter("problem IS NULL").alias("o").join(own, "path", "left").select(
        "provider", F.col("path").alias("source_path"), F.col("o.mtime").alias("mtime"), F.col("o.size").alias("size_bytes"), F.lit(PARSE_VERSION).alias("parse_version"),
        kept("session_id", F.col("f.session_id")), F.greatest("o.complete", "o.from_line").alias("parsed_bytes"), F.col("o.head").alias("head"),
        kept("next_seq", F.col("f.message_count")), kept("next_edit", F.col("o.next_edit") + F.coalesce("f.n_edits", F.lit(0))),
        *[kept(c, F.col(f"f.{c}")) for c in counts], *[kept(c, F.col(f"f.{c}") if c in told.facts else F.lit(None)) for c in facts],
    )
    replaced = ids.filter("NOT goes_on").select(F.col("session_id").alias("key"))
    gone = stored(spark, store, "sessions", at).join(since.filter("NOT goes_on AND problem IS NULL").select(F.col("path").alias("source_path")), "source_path", "left_semi").select(F.col("id").alias("key"))
    whole = cut(replaced.unionByName(gone).distinct())
    return Delta(
        {"sessions": sessions.unionByName(shaped(stubs, SESSIONS)), "messages": messages, "transcripts": pieces.select("session_id", "seq", "transcript_text"), "file_edits": edits, "files_seen": shaped(seen, SEEN)},
        {"sessions": whole.unionByName(ids.select(F.col("session_id").alias("key"))), "messages": whole, "transcripts": whole, "file_edits": whole, "files_seen": seen.select(F.col("source_path").alias("key"))},
    )


def documents_delta(spark: SparkSession, provider: str, work: DataFrame, store: str, at: int) -> Delta:
    """Files that are parsed as wholes, through the format's parser: their sessions are replaced."""
    paths = sorted(r[0] for r in work.select("source_path").collect())
    parsed = logs.PARSERS[provider](spark, paths)
    sessions, messages = cut(parsed.sessions), cut(parsed.messages)
    old = stored(spark, store, "sessions", at).join(sessions.select("source_path"), "source_path", "left_semi").select(F.col("id").alias("key"))
    whole = cut(sessions.select(F.col("id").alias("key")).unionByName(old).distinct())
    pieces = parsed.transcripts.withColumn("seq", F.lit(0).cast("bigint")).select("session_id", "seq", "transcript_text")
    seen = shaped(work.select("provider", "source_path", "mtime", "size_bytes").withColumn("parse_version", F.lit(PARSE_VERSION)), SEEN)
    dead = {name: whole for name in ("sessions", "messages", "transcripts", "file_edits")}
    return Delta(
        {"sessions": sessions, "messages": messages, "transcripts": pieces, "file_edits": parsed.file_edits, "files_seen": seen}, {**dead, "files_seen": seen.select(F.col("source_path").alias("key"))}
    )


def apply(spark: SparkSession, provider: str, found: DataFrame, store: str, again: bool = False, repos: DataFrame | str | None = None, root: str | None = None) -> dict[str, int]:
    """Take the files ``found`` into the store as one layer, those that it has seen as they are left out; returns files by state.

    ``again`` parses all of them as wholes. Sessions get what the agent keeps of them
    below ``root`` (``sources.sidecars``) and, with ``repos`` (path), known roots of
    repositories, the one that their working folder lies in; ``repos`` "found" looks
    for the roots above the working folders, which executors must be able to read.
    """
    at = snapshot(spark, store)
    seen = stored(spark, store, "files_seen", at)
    states = cut(changes(found, seen.limit(0) if again else seen))
    counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
    if not set(counts) - {"current"}:
        return counts
    names = [c.split(" ")[0] for c in PROGRESS.split(", ")]
    work = states.filter("state <> 'current'").join(seen.select("source_path", *names), "source_path", "left").withColumn("again", (F.col("state") != "changed_file") | F.lit(again))
    # all paths of a listing are in one kind of store
    by_lines = provider in logs.LINE_FORMATS and tail.readable(work.select("source_path").first()[0])
    delta = (lines_delta if by_lines else documents_delta)(spark, provider, work, store, at)
    if root is not None:
        delta.rows["sessions"] = shaped(sidecars.enriched(spark, provider, root, delta.rows["sessions"]), SESSIONS)
    if isinstance(repos, str):
        if repos != "found":
            raise ValueError('repos is a table of paths or "found"')
        delta.rows["sessions"] = cut(delta.rows["sessions"])
        repos = cut(places.repository_roots(delta.rows["sessions"]))
    if repos is not None:
        delta.rows["sessions"] = shaped(N.with_repo_roots(delta.rows["sessions"], repos), SESSIONS)
    layer = write_layer(spark, store, at + 1, delta.rows, delta.dead)
    publish(spark, store, [*manifest(spark, store, at), layer], at)
    merge_due(spark, store)
    return counts


def refresh(spark: SparkSession, roots: dict[str, str], store: str, policy: str = "auto", full: bool = False, max_age_seconds: float = 60.0, repos: DataFrame | str | None = None, lease_seconds: float | None = None) -> dict[str, int]:
    """Bring the store up to date; returns how many files were in each state.

    policy ``existing_only`` leaves the store as it is; ``before_query`` does if its
    manifest is younger than ``max_age_seconds``. ``full`` parses all files as wholes.
    With ``lease_seconds`` one refresher works at a time: others stand in line and
    then see its result, so they find nothing left to parse.
    """
    if lease_seconds is not None:
        with Lease(spark, store, lease_seconds):
            return refresh(spark, roots, store, policy, full, max_age_seconds, repos)
    counts = {"new": 0, "changed_file": 0, "changed_parser": 0, "current": 0}
    if policy not in ("auto", "before_query", "existing_only"):
        raise ValueError("policy is auto, before_query or existing_only")
    if policy == "existing_only" or policy == "before_query" and age_seconds(spark, store) < max_age_seconds:
        return counts
    for provider, path in roots.items():
        for state, n in apply(spark, provider, discover(spark, provider, path), store, full, repos, path).items():
            counts[state] += n
    return counts


class Refresh:
    """A refresh in the background: its state, counts, seconds and error, and a wait for its end."""

    def __init__(self, spark: SparkSession, roots: dict[str, str], store: str, **options):
        self.state, self.counts, self.error, self._began, self._took = "running", {}, None, time.monotonic(), None

        def run() -> None:
            try:
                self.counts = refresh(spark, roots, store, **options)
                self.state = "done"
            except Exception as e:  # told by the report
                self.error, self.state = f"{type(e).__name__}: {e}", "failed"
            self._took = time.monotonic() - self._began

        self._thread = InheritableThread(target=run, session=spark, daemon=True)
        self._thread.start()

    def report(self) -> dict:
        took = time.monotonic() - self._began if self._took is None else self._took
        return {"state": self.state, "counts": dict(self.counts), "seconds": round(took, 3), "error": self.error}

    def wait(self, seconds: float | None = None) -> dict:
        self._thread.join(seconds)
        return self.report()


def age_seconds(spark: SparkSession, store: str) -> float:
    """How long ago the store changed; infinite before the first refresh."""
    at = snapshot(spark, store)
    if not at:
        return float("inf")
    fs, path = _fs(spark, f"{store}/_manifests/{at:010d}.json")
    return max(0.0, time.time() - fs.getFileStatus(path).getModificationTime() / 1000)


def vacuum(spark: SparkSession, store: str, keep: int = 2) -> list[str]:
    """Delete what none of the last ``keep`` manifests names, older manifests included; returns the folders deleted.

    Not to be run next to a refresh, whose folders no manifest names yet.
    """
    if keep < 1:
        raise ValueError("the present manifest is always kept")
    numbers = manifests(spark, store)
    used = {folder for n in numbers[-keep:] for x in manifest(spark, store, n) for p in x.parts.values() for folder in (p.rows, p.dead, p.lists) if folder}
    gone = []
    for place in [f"{store}/{name}" for name in TABLES] + [f"{store}/_dead/{name}" for name in TABLES] + [f"{store}/_lists"]:
        fs, folder = _fs(spark, place)
        for f in fs.listStatus(folder) if fs.exists(folder) else ():
            if f"{place}/{f.getPath().getName()}" not in used:
                gone.append(f.getPath().toString())
                fs.delete(f.getPath(), True)
    for n in numbers[:-keep]:
        fs, path = _fs(spark, f"{store}/_manifests/{n:010d}.json")
        fs.delete(path, False)
    return gone


def follow(spark: SparkSession, provider: str, path: str, store: str, checkpoint: str, after: Callable[[int], None] | None = None):
    """A stream over files that arrive below ``path``; stops when it has taken all there are now."""
    arriving = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", GLOBS.get(provider, "*.json*"))
        .load(path)
    )

    def take(batch: DataFrame, number: int) -> None:
        # a batch that runs twice changes nothing the second time: its files are seen as they are
        found = batch.dropDuplicates(["path"]).select(
            F.lit(provider).alias("provider"), F.col("path").alias("source_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), F.lit(PARSE_VERSION).alias("parse_version")
        )
        apply(batch.sparkSession, provider, found, store, root=path)
        if after:
            after(number)

    listed = arriving.select("path", "modificationTime", "length")
    return listed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
