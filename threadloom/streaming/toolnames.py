"""Tool names of results that come in a later micro-batch than their calls.

A call's name is kept by session and call id until ``keep_hours`` after it was
last needed; a result takes the name of its call, or waits for nothing and goes
on without one. State is in Spark's store, so a stream that starts again from its
checkpoint knows the calls of before; it needs the RocksDB store (``prepare``).
Names expire by the clock, so such a stream runs until it is stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

NAMED = "session_id string, line_no bigint, part int, kind string, tool_call_id string, tool_name string, content string"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class ToolNames(StatefulProcessor):
    """By session: rows in their order, results with the name of their call."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "tool_call_id string", "tool_name string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a batch's rows of one session: its new lines
        for r in sorted(rows, key=lambda r: (r.line_no, r.part)):
            name = r.tool_name
            if r.tool_call_id is not None:
                if r.kind == "tool_call" and name is not None:
                    self.names.updateValue((r.tool_call_id,), (name,))
                elif r.kind == "tool_result" and name is None and self.names.containsKey((r.tool_call_id,)):
                    name = self.names.getValue((r.tool_call_id,))[0]
                    self.names.updateValue((r.tool_call_id,), (name,))  # it may have more results
            yield Row(session_id=r.session_id, line_no=r.line_no, part=r.part, kind=r.kind, tool_call_id=r.tool_call_id, tool_name=name, content=r.content)

    def close(self) -> None:
        pass


def named(events: DataFrame, keep_hours: float = 24.0) -> DataFrame:
    """A stream (columns of NAMED) with the names of results, whatever batch their calls came in."""
    columns = [c.split(" ")[0] for c in NAMED.split(", ")]
    rows = events.select(*columns)
    return rows.groupBy("session_id").transformWithState(ToolNames(int(keep_hours * 3_600_000)), NAMED, "append", "processingTime")
