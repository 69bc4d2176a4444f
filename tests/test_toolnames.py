"""Results named in later micro-batches, over a restart, and forgotten in time."""

import json
import time

from pyspark.sql import functions as F

from threadloom.functions.text import ngrams, tokens
from threadloom.streaming import toolnames

SCHEMA = "session_id string, line_no bigint, part int, kind string, tool_call_id string, tool_name string, content string"


def row(session, n, kind, call, name=None):
    return {"session_id": session, "line_no": n, "part": 0, "kind": kind, "tool_call_id": call, "tool_name": name, "content": f"{kind} {n}"}


def run(spark, folder, out, checkpoint, rows, keep_hours=24.0):
    """One run of the stream, until it has taken ``rows`` new rows; timers by the clock keep it from ending by itself."""
    stream = spark.readStream.schema(SCHEMA).json(str(folder))
    q = toolnames.named(stream, keep_hours).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
    end = time.time() + 90
    while sum(p["numInputRows"] for p in q.recentProgress) < rows and time.time() < end and q.isActive:
        time.sleep(0.2)
    q.stop()
    assert q.exception() is None and time.time() < end


def test_names_cross_batches_and_restarts(spark, tmp_path):
    toolnames.prepare(spark)
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()

    def put(i, rows):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        run(spark, folder, out, checkpoint, len(rows))

    put(0, [row("A", 0, "tool_call", "c1", "shell"), row("A", 1, "tool_result", "c1"), row("A", 2, "tool_call", "c2", "edit"), row("B", 0, "conversation", None)])
    # from the checkpoint: a result of a later batch, the same id in another session, one without a call, a second result
    put(1, [row("A", 3, "tool_result", "c2"), row("B", 1, "tool_result", "c2"), row("A", 4, "tool_result", "c9"), row("A", 5, "tool_result", "c1")])
    got = {(r.session_id, r.line_no): r.tool_name for r in spark.read.parquet(out).collect()}
    assert got == {("A", 0): "shell", ("A", 1): "shell", ("A", 2): "edit", ("B", 0): None, ("A", 3): "edit", ("B", 1): None, ("A", 4): None, ("A", 5): "shell"}


def test_state_expires(spark, tmp_path):
    toolnames.prepare(spark)
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()
    for i, made in enumerate([row("A", 0, "tool_call", "c1", "shell"), row("A", 1, "tool_result", "c1")]):
        (folder / f"{i}.json").write_text(json.dumps(made))
        run(spark, folder, out, checkpoint, 1, 1 / 3600)
        time.sleep(1.5)
    assert {r.line_no: r.tool_name for r in spark.read.parquet(out).collect()} == {0: "shell", 1: None}


def test_windows_of_words_made_in_place(spark):
    """The words of a long text are made once, also where they aren't a column."""
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20_000)),), (None,), ("one",)], "t string")
    began = time.time()
    got = [r[0] for r in df.select(F.size(ngrams(tokens(F.col("t")), 2, 3))).collect()]
    assert got == [19_999 + 19_998, 0, 0] and time.time() - began < 30
