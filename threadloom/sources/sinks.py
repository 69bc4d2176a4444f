"""Outputs: rendered rows, session exports, published bundles and index tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import rows_digest
from ..functions.text import csv_escape, markdown_fence, transcript_line

FORMATS = ("table", "json", "jsonl", "csv", "plain")


def rendered(df: DataFrame, form: str) -> DataFrame:
    """One text column ``value``: a line a row (JSON lines, CSV cells, tab-separated)."""
    if form == "jsonl":
        return df.select(F.to_json(F.struct("*")).alias("value"))
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    if form == "csv":
        return df.select(F.concat_ws(",", *[csv_escape(c) for c in cells]).alias("value"))
    if form == "plain":
        return df.select(F.concat_ws("\t", *[F.regexp_replace(c, r"[\t\r\n]+", " ") for c in cells]).alias("value"))
    raise ValueError(f"lines have a form of jsonl, csv or plain, not {form}")


def render(df: DataFrame, form: str, limit: int = 1000) -> str:
    """At most ``limit`` rows as text, for people."""
    if form not in FORMATS:
        raise ValueError(f"form is one of {FORMATS}")
    if form == "table":
        return df.limit(limit)._jdf.showString(limit, 80, False)
    if form == "json":
        return json.dumps([json.loads(r["value"]) for r in rendered(df, "jsonl").limit(limit).collect()], ensure_ascii=False, indent=2)
    head = ",".join(df.columns) + "\n" if form == "csv" else ""
    return head + "".join(r["value"] + "\n" for r in rendered(df, form).limit(limit).collect())


def write_lines(df: DataFrame, form: str, path: str) -> None:
    """All rows as text files, written by the executors; an existing path is an error."""
    rendered(df, form).write.mode("errorifexists").text(path)


def transcripts(messages: DataFrame) -> DataFrame:
    """(session_id, transcript_text): a session's lines in order, joined by blank lines."""
    line = transcript_line(F.col("ts"), F.col("role"), F.coalesce("content", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("transcript_text"))


def export_sessions(sessions: DataFrame, messages: DataFrame, form: str) -> DataFrame:
    """(session_id, file_name, body) of each session as text, markdown or JSON."""
    side = sessions.select(F.col("id").alias("session_id"), "provider", "title", "cwd", "created_at")
    if form == "json":
        body = F.to_json(F.struct("session_id", F.array_sort(F.collect_list(F.struct("seq", "role", "kind", "ts", "content"))).alias("messages")))
        out = messages.groupBy("session_id").agg(body.alias("body"))
        ending = "json"
    else:
        text = F.coalesce("content", F.lit(""))
        if form == "markdown":
            fence = markdown_fence(text)
            line: Column = F.concat(F.lit("### "), F.col("role"), F.lit("\n\n"), fence, F.lit("\n"), text, F.lit("\n"), fence)
        elif form == "text":
            line = transcript_line(F.col("ts"), F.col("role"), text)
        else:
            raise ValueError("form is text, markdown or json")
        ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
        out = messages.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("body"))
        ending = "md" if form == "markdown" else "txt"
    named = out.join(side, "session_id", "left")
    head = F.when(F.lit(form == "markdown"), F.concat(F.lit("# "), F.coalesce("title", "session_id"), F.lit("\n\n"))).otherwise(F.lit(""))
    name = F.concat(F.regexp_replace("session_id", r"[^A-Za-z0-9._-]+", "_"), F.lit(f".{ending}"))
    return named.select("session_id", name.alias("file_name"), F.concat(head, "body").alias("body"))


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    to = jvm.org.apache.hadoop.fs.Path(target)
    return not fs.exists(to) and fs.rename(path, to)


def publish_bundle(tables: dict[str, DataFrame], path: str, order: dict[str, list[str]]) -> dict:
    """Write tables as JSON lines beside ``path``, then rename the folder into place.

    Readers see the whole bundle or none; an existing path is never replaced.
    Returns the receipt that is also in the bundle: rows and digest by table.
    """
    spark = next(iter(tables.values())).sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex[:12]}"
    receipt = {}
    for name, df in tables.items():
        df.write.json(f"{staging}/{name}")
        d = rows_digest(spark.read.schema(df.schema).json(f"{staging}/{name}"), order[name], df.columns).first()
        receipt[name] = {"rows": d["n"], "sha256": d["digest"]}
    spark.createDataFrame([(json.dumps(receipt, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/receipt")
    if not _rename(spark, staging, path):
        raise FileExistsError(path)
    return receipt


def upsert_sessions(stored: DataFrame, fresh: DataFrame, key: str, superseded: DataFrame | None = None) -> DataFrame:
    """``stored`` with the sessions of ``fresh`` replaced as wholes, and superseded ids gone."""
    ids = fresh.select(key).distinct()
    if superseded is not None:
        ids = ids.unionByName(superseded.select(key)).distinct()
    return stored.join(ids, key, "left_anti").unionByName(fresh)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """Parquet by bucket of the key, sorted inside; dynamic overwrite replaces only touched buckets."""
    keyed = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    writer = keyed.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket")
    writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
