"""Evidence of sessions: what people asked, what tools did, references and changed files, within a budget.

A session's budget is dealt out over its sections in turn, one row at a time, and
the references that the shown messages hold share a budget of the same size in
the same way. Any number of sessions is inspected in one run. Rows beyond the
budget are left out before the shuffle, so a session with a third of all rows
costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import refs
from ..functions.text import truncate_for_display
from .analytics import time_profile
from .filters import FilterError

SECTIONS = ("user_intent", "tool_activity", "reference_messages", "changed_files")
CALLS = {"tool_call": "call", "tool_result": "result"}

#: A text without any of these holds no reference that can be followed.
CANDIDATE = r"(?i)https?://|file://|www\.|[\p{Alnum}.-]\.\p{Alpha}{2,}/"


def actionable(found: Column) -> Column:
    """Those of ``refs.extract`` that can be opened: with scheme or www., or a host with a path."""

    def opens(r: Column) -> Column:
        return r["value"].rlike(r"(?i)^(?:https?://|file://|www\.)") | (r["value"].contains("/") & r["host"].isNotNull())

    return F.filter(found, opens)


def fair_quotas(sizes: Column, total: int) -> Column:
    """Array of how many of each size are given of ``total``, one at a time in turn and none beyond its size.

    All get the highest level that fits; what is left goes to the first ones that have more.
    """
    given = lambda level: F.aggregate(sizes, F.lit(0).cast("bigint"), lambda n, s: n + F.least(s, level).cast("bigint"))
    # one-element arrays bind what is used more than once
    levels = F.transform(F.array(F.array_max(F.filter(F.sequence(F.lit(0), F.lit(total)), lambda t: given(t) <= total))), lambda t: F.struct(t.alias("level"), (F.lit(total) - given(t)).alias("left")))

    def dealt(x: Column) -> Column:
        wants = F.transform(sizes, lambda s: s > x["level"])
        earlier = lambda i: F.size(F.filter(F.slice(wants, F.lit(1), i), lambda w: w))
        return F.transform(sizes, lambda s, i: F.least(s, x["level"]).cast("int") + F.when((s > x["level"]) & (earlier(i) < x["left"]), 1).otherwise(0))

    return F.transform(levels, dealt)[0]


def candidates(messages: DataFrame, edits: DataFrame | None, preview_chars: int, newest: bool) -> DataFrame:
    """All evidence, a row each: session_id, section (its number), by (order within the section; of files path and provider) and what is shown."""
    text = F.coalesce("content", F.lit(""))
    held = F.when(text.rlike(CANDIDATE), actionable(refs.extract(text))).otherwise(F.array().cast("array<struct<value:string,normalized_value:string,host:string>>"))
    sections = F.array_compact(F.array(F.when(F.col("role") == "user", 0), F.when(F.col("role") == "tool", 1), F.when(F.size("__refs") > 0, 2)))
    call = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in CALLS.items()], F.lit("other"))
    said = messages.select("session_id", "seq", "ts", "role", "kind", "tool_name", text.alias("content"), held.alias("__refs")).withColumn("section", F.explode(sections))
    own, none = F.col("section") == 2, F.lit(None).cast("string")
    found = said.select(
        "session_id", "section", F.struct((-F.col("seq") if newest else F.col("seq")).alias("seq"), none.alias("path"), none.alias("provider")).alias("by"), "seq", "ts",
        F.when(F.col("section") > 0, F.col("tool_name")).alias("name"), F.when(F.col("section") == 1, call).when(own, F.col("role")).alias("kind"), F.length("content").cast("bigint").alias("chars"),
        truncate_for_display(F.col("content"), preview_chars).alias("preview"), F.when(own, F.col("__refs")).alias("refs"), F.lit(None).cast("bigint").alias("edits"),
    )
    if edits is None:
        return found
    touched = edits.groupBy("session_id", "file_path", "provider").agg(F.count("*").alias("edits"))
    # a file's name and provider are in its order and stand nowhere else: most rows are files
    changed = touched.select("session_id", F.lit(3).alias("section"), F.struct(F.lit(0).cast("bigint").alias("seq"), F.col("file_path").alias("path"), "provider").alias("by"), "edits")
    return found.unionByName(changed, allowMissingColumns=True)


def evidence(messages: DataFrame, edits: DataFrame | None = None, limit: int | None = 12, window: str = "first", preview_chars: int = 220, profile: bool = False) -> DataFrame:
    """A row for each piece of evidence shown, any number of sessions.

    session_id, section, seq, ts, name (tool or file), kind (call, result or other;
    of references the role, of files the provider), chars, preview, refs,
    ref_summary, edits, truncated (sections that have more than is shown) and, with
    ``profile``, the session's time_profile. ``limit`` rows a session, from its
    first or latest messages on; None: all, in order of seq, files by path. A file
    is one row for each provider that edited it. Sessions without evidence have no row;
    null contents count as empty, rows without a session are one session, and
    among messages with one seq any may be left out.
    """
    if limit is not None and limit < 1 or window not in ("first", "latest") or preview_chars < 1:
        raise FilterError("limit and preview_chars are positive, window is first or latest")
    rows = candidates(messages, edits, preview_chars, window == "latest")
    if limit is None:
        shown = rows.withColumns({"__quota": F.size("refs"), "truncated": F.array().cast("array<string>")})
    else:
        ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("session_id", "section").orderBy("by"))).filter(F.col("__rank") <= limit + 1)
        # one at a time in turn: the first ``limit`` rows by rank, then section, are shown
        place = F.row_number().over(Window.partitionBy("session_id").orderBy("__rank", "section"))
        session = Window.partitionBy("session_id")
        placed = ranked.withColumn("__shown", place <= limit)
        left_out = F.collect_set(F.when(~F.col("__shown"), F.col("section"))).over(session)
        sizes = F.sort_array(F.collect_list(F.when(F.col("__shown") & (F.col("section") == 2), F.struct(F.col("__rank").alias("rank"), F.size("refs").alias("size")))).over(session))
        told = placed.withColumns({"__out": left_out, "__sizes": F.transform(sizes, lambda s: s["size"])}).filter("__shown")
        dealt = told.withColumn("__quotas", F.when(F.size("__sizes") > 0, fair_quotas(F.col("__sizes"), limit)))
        more = [F.when(F.array_contains("__out", i), name) for i, name in enumerate(SECTIONS)]
        nested = F.when(F.exists(F.arrays_zip("__sizes", "__quotas"), lambda z: z["__sizes"] > z["__quotas"]), "references")
        shown = dealt.withColumns(
            {"__quota": F.when(F.col("section") == 2, F.try_element_at("__quotas", F.col("__rank"))), "truncated": F.array_compact(F.array(*more[:3], nested, more[3]))}
        )
    named = F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("section") + 1)
    file = F.col("section") == 3
    out = shown.select(
        "session_id", named.alias("section"), "seq", "ts", F.when(file, F.col("by.path")).otherwise(F.col("name")).alias("name"), F.when(file, F.col("by.provider")).otherwise(F.col("kind")).alias("kind"), "chars", "preview", F.slice("refs", F.lit(1), F.col("__quota")).alias("refs"),
        F.when(F.col("section") == 2, refs.summary(F.col("refs"))).alias("ref_summary"), "edits", "truncated",
    )
    if profile:
        times = time_profile(messages)
        side = times.select(F.col("session_id").alias("__id"), F.struct(*[c for c in times.columns if c != "session_id"]).alias("time_profile"))
        out = out.join(side, F.col("session_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    return out
