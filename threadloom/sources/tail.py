"""Lines of growing logs by byte range.

A log of lines only grows, so what was parsed up to a byte needn't be read again.
``probe`` looks at each file's head and end: the fingerprint of the head tells a
file that grew from one that was written anew, and a last line that isn't whole
yet waits. ``lines`` reads byte ranges, the numbers of lines being their first
bytes, so a range read later gives the same numbers. All of it runs on the
executors over a table of files; paths are opened by pyarrow's file systems.

``LogLines`` is the same as a stream: ``spark.readStream.format("log_lines")``
gives the whole lines that were added below a folder since the last batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file's head in its fingerprint.
FINGERPRINT_BYTES = 4096

#: Bytes before a grown file's new part that are read again, for calls whose results come after it.
OVERLAP_BYTES = 1 << 20

#: Bytes that one task reads at a time.
CHUNK_BYTES = 32 << 20

#: A last line without a line feed is parsed, to see if it is whole, up to so many bytes.
LAST_LINE_BYTES = 16 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def readable(path: str) -> bool:
    """Whether pyarrow knows the path's kind of store."""
    try:
        file_system(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def fingerprint(head: bytes) -> str:
    return f"{len(head)}:{hashlib.sha256(head).hexdigest()}"


def same_head(f, size: int, known: str) -> bool:
    """Whether the file still begins with what ``known`` was made of."""
    n = int(known.split(":")[0])
    return size >= n and fingerprint(f.read_at(n, 0)) == known


def complete_bytes(f, size: int, block: int = 1 << 16) -> int:
    """Bytes up to the end of the last whole line: one with a line feed, or a last one that is a whole JSON object."""
    end = size
    while end > 0:
        start = max(0, end - block)
        at = f.read_at(end - start, start).rfind(b"\n")
        if at >= 0:
            end = start + at + 1
            break
        end = start
    if 0 < size - end <= LAST_LINE_BYTES:
        try:
            if isinstance(json.loads(f.read_at(size - end, end)), dict):
                return size
        except ValueError:
            pass
    return end


def probe(files: DataFrame) -> DataFrame:
    """``files`` (path, size, known_head) with head, same_head (null: nothing known), complete (bytes) and problem."""
    names = files.columns
    kinds = dict(files.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "head string", "same_head boolean", "complete bigint", "problem string"])

    def look(path: str, size: int, known: str | None) -> tuple:
        try:
            fs, where = file_system(path)
            with fs.open_input_file(where) as f:
                same = same_head(f, size, known) if known else None
                return fingerprint(f.read_at(min(size, FINGERPRINT_BYTES), 0)), same, complete_bytes(f, size), None
        except OSError as e:
            return None, None, 0, f"unreadable: {type(e).__name__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [look(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "known_head")))]
            made = [pa.array([s[i] for s in seen], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "head", "same_head", "complete", "problem"])

    return files.mapInArrow(run, ddl)


def text_array(raw: pa.Array) -> pa.Array:
    """Strings, bad bytes replaced."""
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def lines_between(path: str, first: int, last: int, end: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(numbers, lines) of the lines that begin in [first, last); the last of them may go on up to ``end``."""
    fs, where = file_system(path)
    with fs.open_input_file(where) as f:
        start = max(0, first - 1)
        held = f.read_at(last - start, start)
        if first > 0:
            at = held.find(b"\n")
            if at < 0 or start + at + 1 >= last:
                return
            held, start = held[at + 1 :], start + at + 1
        parts, stop = [held], last
        while stop < end and not parts[-1].endswith(b"\n"):
            more = f.read_at(min(1 << 20, end - stop), stop)
            if not more:
                break
            at = more.find(b"\n")
            parts.append(more if at < 0 else more[: at + 1])
            stop += len(more)
    data = b"".join(parts)
    lines = pc.split_pattern(pa.array([data.removesuffix(b"\n")], pa.binary()), b"\n").flatten()
    sizes = pc.add(pc.binary_length(lines).cast(pa.int64()), 1)
    numbers = pc.add(pc.subtract(pc.cumulative_sum(sizes), sizes), start)
    for i in range(0, len(lines), 1024):
        yield numbers.slice(i, 1024), text_array(lines.slice(i, 1024))


def lines(ranges: DataFrame) -> DataFrame:
    """(path, mtime, line_no, line, v) of ``ranges`` (path, mtime, start, end); ``line_no`` is a line's first byte."""
    chunk = F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(CHUNK_BYTES).cast("bigint"))).alias("first")
    chunks = ranges.filter(F.col("end") > F.col("start")).select("path", "mtime", "end", chunk)
    parts = max(1, min(chunks.count(), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, mtime, end, first in zip(batch.column("path").to_pylist(), batch.column("mtime"), batch.column("end").to_pylist(), batch.column("first").to_pylist()):
                for numbers, found in lines_between(path, first, min(first + CHUNK_BYTES, end), end):
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([mtime.as_py()] * n, mtime.type), numbers, found], names=["path", "mtime", "line_no", "line"])

    read = chunks.repartition(parts).mapInArrow(run, "path string, mtime timestamp, line_no bigint, line string")
    return read.withColumn("line_no", F.col("line_no").cast("decimal(38,0)")).withColumn("v", F.try_parse_json("line"))


# --- as a stream ----------------------------------------------------------------


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, end: int, generation: int):
        self.path, self.first, self.last, self.end, self.generation = path, first, last, end, generation


class _Reader(DataSourceStreamReader):
    """Offsets are, for each file below the folder, its fingerprint, the bytes taken and how often it began anew.

    The offset has an entry for each file, so this is for folders of live logs;
    ``streaming.ingest.refresh`` keeps its state in a table instead.
    """

    def __init__(self, root: str, ending: str):
        self.root, self.ending = root, ending
        self.last: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, where = file_system(self.root)
        scheme = self.root[: len(self.root) - len(where)] if self.root.endswith(where) else "file:"
        out = dict(self.last)
        for info in fs.get_file_info(pafs.FileSelector(where, recursive=True)):
            if info.type != pafs.FileType.File or not info.path.endswith(self.ending):
                continue
            path = f"{scheme}{info.path}" if "://" in self.root else info.path
            old = out.get(path)
            try:
                with fs.open_input_file(info.path) as f:
                    anew = old is not None and (info.size < old["end"] or not same_head(f, info.size, old["head"]))
                    start = 0 if old is None or anew else old["end"]
                    end = max(start, complete_bytes(f, info.size))
                    generation = 0 if old is None else old["generation"] + int(anew)
                    out[path] = {"head": fingerprint(f.read_at(min(end, FINGERPRINT_BYTES), 0)), "end": end, "generation": generation}
            except OSError:
                continue  # it goes on from the old offset once it can be read
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = {**start, **self.last} if self.last else dict(end)
        out = []
        for path, now in end.items():
            old = start.get(path)
            first = old["end"] if old and old["generation"] == now["generation"] else 0
            for a in range(first, now["end"], CHUNK_BYTES):
                out.append(_Range(path, a, min(a + CHUNK_BYTES, now["end"]), now["end"], now["generation"]))
        return out or [_Range("", 0, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.end:
            for numbers, found in lines_between(partition.path, partition.first, partition.last, partition.end):
                for n, line in zip(numbers.to_pylist(), found.to_pylist()):
                    yield partition.path, partition.generation, n, line

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    """Options: path (a folder), ending (of file names, by default .jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "path string, generation int, line_no bigint, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("ending", ".jsonl"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogLines)
