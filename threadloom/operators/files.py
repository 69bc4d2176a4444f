"""File history: summaries, versions, and contents replayed from edits."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_lines
from .filters import FileQuery


def file_summary(edits: DataFrame, query: FileQuery = FileQuery(), limit: int | None = 50) -> DataFrame:
    """(file_path, file_name, edits, sessions, last_edited), most edited first."""
    out = edits.filter(query.predicate()).groupBy("file_path", "file_name").agg(
        F.count("*").alias("edits"), F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("last_edited")
    )
    out = out.filter(query.having(F.col("edits"))).orderBy(F.desc("edits"), "file_path")
    return out.limit(limit) if limit else out


def file_cross_ref(edits: DataFrame, query: FileQuery = FileQuery()) -> DataFrame:
    """(file_path, session_id, provider, edits)."""
    return edits.filter(query.predicate()).groupBy("file_path", "session_id", "provider").agg(F.count("*").alias("edits")).orderBy("file_path", "session_id")


def versions(edits: DataFrame) -> DataFrame:
    """Edits with ``version`` from 1 in each (session, file), in order of seq."""
    return edits.withColumn("version", F.row_number().over(Window.partitionBy("session_id", "file_path").orderBy("seq", "ts", "tool")))


def edited(content: str | None, edits: list[tuple[str | None, str, bool]]) -> str | None:
    """The content after replacements (old, new, all of them or the first) in order; null if it was null, or if a text to replace isn't there."""
    if content is None or not edits:
        return None
    for old, new, every in edits:
        if not old or old not in content:
            return None
        content = content.replace(old, new) if every else content.replace(old, new, 1)
    return content


#: Bytes of a batch up to which its rows are taken out together; of a larger one 64 at a time.
WHOLE_BATCH = 16 << 20


def replayed(batches: Iterator[pa.RecordBatch], batch_bytes: int) -> Iterator[pa.RecordBatch]:
    """Every version of rows (session_id, file_path, seq, ts, new_content, edits) in order; other columns stay Arrow's."""
    key, version, content = None, 0, None
    for batch in batches:
        # a batch's rows are taken out a few at a time if they are wide: each may hold a whole file
        step = max(batch.num_rows, 1) if batch.nbytes <= WHOLE_BATCH else 64
        for part in (batch.slice(start, step) for start in range(0, batch.num_rows, step)):
            kept = [part.column(c) for c in ("session_id", "file_path")]
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in kept]
            fresh = [False, *((codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])).tolist()]
            if (own := tuple(c[0].as_py() for c in kept)) != key:
                fresh[0] = True
            key = tuple(c[-1].as_py() for c in kept) if len(part) else own
            changes = part.column("edits")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(changes), 0).to_numpy()).tolist()
            flat = changes.flatten()
            steps = list(zip(*(pc.struct_field(flat, c).to_pylist() for c in ("old", "new", "replace_all"))))
            versions, contents, size, given, at = [], [], 0, 0, 0
            for i, (starts, new, end) in enumerate(zip(fresh, part.column("new_content").to_pylist(), ends), 1):
                if starts:
                    version, content = 0, None
                version += 1
                content = new if new is not None else edited(content, steps[at:end])
                at = end
                versions.append(version)
                contents.append(content)
                size += 100 + len(content or "")
                if size >= batch_bytes or i == part.num_rows:
                    rows = part.slice(given, i - given)
                    columns = [rows.column("session_id"), rows.column("file_path"), pa.array(versions, pa.int32()), rows.column("seq"), rows.column("ts"), pa.array(contents, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["session_id", "file_path", "version", "seq", "ts", "content"])
                    versions, contents, size, given = [], [], 0, i


def all_versions(edits: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """(session_id, file_path, version, seq, ts, content, lines): every version, null where it can't be known.

    A snapshot replaces the content, edits are replayed in order, neither leaves a
    gap. The edits of a (session, file) come to a task in order and one by one; it
    holds the present content and some ``batch_bytes`` of versions to give out, so
    a history may be of any length.
    """
    order = ["session_id", "file_path", "seq", "ts", "tool"]
    rows = edits.select(*order, "new_content", "edits").repartition("session_id", "file_path").sortWithinPartitions(*order).drop("tool")
    made = rows.mapInArrow(lambda batches: replayed(batches, batch_bytes), "session_id string, file_path string, version int, seq bigint, ts timestamp, content string")
    return made.withColumn("lines", count_lines(F.col("content")))


def reconstruct(edits: DataFrame, session_id: str, file_path: str, version: int | None = None) -> str | None:
    """One file's content at a version (the last by default); replays from the nearest snapshot."""
    own = versions(edits.filter((F.col("session_id") == session_id) & (F.col("file_path") == file_path)))
    if version is not None:
        own = own.filter(F.col("version") <= version)
    last = all_versions(own.drop("version")).orderBy(F.desc("version")).limit(1).collect()
    return last[0]["content"] if last else None


def history(edits: DataFrame, file_glob: str, limit: int = 50) -> DataFrame:
    """Versions of matching files with their line counts, newest first."""
    return all_versions(edits.filter(FileQuery(glob=file_glob).predicate())).orderBy(F.desc_nulls_last("ts"), "session_id", "file_path", F.desc("version")).limit(limit)


def publish_versions(edits: DataFrame, query: FileQuery, path: str) -> dict:
    """All known versions of matching files as one bundle of JSON lines with a receipt; an existing path is never replaced."""
    from ..sources.sinks import publish_bundle

    known = all_versions(edits.filter(query.predicate())).filter(F.col("content").isNotNull())
    return publish_bundle({"versions": known}, path, {"versions": ["session_id", "file_path", "version"]})


def restore(edits: DataFrame, session_id: str, file_path: str, target: str, version: int | None = None) -> int:
    """Write one version to the new file ``target``; returns its bytes. FileExistsError if it is there, LookupError if the version isn't known."""
    content = reconstruct(edits, session_id, file_path, version)
    if content is None:
        raise LookupError(f"no known content of {file_path} in {session_id}")
    with open(target, "x", encoding="utf-8", newline="") as f:
        f.write(content)
    return len(content.encode())


def version_stream(edits: DataFrame, query: FileQuery, form: str = "jsonl") -> Iterator[str]:
    """Known versions in order, one at a time: JSON lines, or ``framed`` by a head line with the length in bytes."""
    if form not in ("jsonl", "framed"):
        raise ValueError("form is jsonl or framed")
    known = all_versions(edits.filter(query.predicate())).filter(F.col("content").isNotNull())
    for r in known.orderBy("session_id", "file_path", "version").toLocalIterator():
        head = {"session_id": r["session_id"], "file_path": r["file_path"], "version": r["version"]}
        body = r["content"]
        yield json.dumps(head | {"content": body}, ensure_ascii=False) + "\n" if form == "jsonl" else json.dumps(head | {"bytes": len(body.encode())}, ensure_ascii=False) + "\n" + body + "\n"
