"""Message search and session search.

A search is a lazy DataFrame: structural filters first, then the content match
of one mode (literal, regex, fuzzy) on one field, then order and page. Context,
metadata and references are joined to the page, which is small, not to the
corpus. Coordinates are 0-based code points, ends excluded.
"""

from __future__ import annotations

import queue
import threading
import uuid
from collections.abc import Iterator
from dataclasses import MISSING, dataclass, fields
from dataclasses import field as attribute

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import jsonptr, refs
from ..functions.digests import rows_digest
from ..functions.patterns import literal_trigrams, prefiltered_regex, regex_span, regex_trigrams, to_java
from ..functions.text import contains_caseless, fold, fold_literal, select_lines, snippet, truncate_for_display, unfolded_place
from ..sources import postings
from . import fuzzy
from .filters import FilterError, MessageFilters, SessionFilters

FIELDS = ("content", "tool_name", "tool_argument")
MODES = ("literal", "regex", "fuzzy")


@dataclass(frozen=True)
class SearchRequest:
    query: str | None = None
    mode: str = "literal"
    field: str = "content"
    argument_path: str | None = None
    filters: MessageFilters = attribute(default_factory=MessageFilters)
    #: Rows of a page. None or 0: unlimited, which only ``search_batches`` and lazy results may be.
    limit: int | None = 50
    offset: int = 0
    #: "first" or "latest" rows of the one session.
    window: str = "first"
    #: Rows before and after each hit.
    context: tuple[int, int] = (0, 0)
    #: Head (positive) or tail (negative) lines, then characters, of the field shown.
    lines: int = 0
    view_chars: int | None = None
    #: Width of the evidence around the match.
    match_chars: int | None = None
    include: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in MODES or self.field not in FIELDS:
            raise FilterError(f"mode is one of {MODES}, field one of {FIELDS}")
        if self.query is not None and not self.query.strip():
            raise FilterError("the query is blank")
        if self.query is None and self.mode != "literal":
            raise FilterError(f"{self.mode} search needs a query")
        if self.query is None and self.match_chars is not None:
            raise FilterError("a match view needs a query")
        if self.match_chars is not None and self.match_chars <= 0 or self.view_chars is not None and self.view_chars < 0:
            raise FilterError("view widths are positive")
        if self.argument_path is not None and self.field != "tool_argument":
            raise FilterError("argument_path belongs to field tool_argument")
        if self.field == "tool_argument":
            if self.filters.kinds is not None and "tool_call" not in self.filters.kinds:
                raise FilterError("tool arguments are in tool calls only")
            jsonptr.parse(self.argument_path or "")
        if self.mode == "fuzzy":
            if not self.limit:
                raise FilterError("fuzzy search needs a finite limit")
            if len(self.query.strip()) < 3:
                raise FilterError("a fuzzy query has three characters or more")
            if self.window != "first":
                raise FilterError("fuzzy search is ordered by score, it has no window")
        if self.mode == "regex":
            to_java(self.query)
        if self.window == "latest" and self.filters.session_id is None:
            raise FilterError("a latest window needs a session")
        if self.window not in ("first", "latest"):
            raise FilterError("window is first or latest")
        if self.offset < 0 or (self.limit or 0) < 0 or min(self.context) < 0:
            raise FilterError("offset, limit and context are not negative")
        wrong = set(self.include) - {"metadata", "refs", "raw_metadata"}
        if wrong:
            raise FilterError(f"include has no {sorted(wrong)}")

    def effective(self) -> dict[str, tuple[object, str]]:
        """Each parameter with its value and whether it was given or is the default."""
        usual = {f.name: f.default_factory() if f.default is MISSING else f.default for f in fields(self)}
        return {name: (value := getattr(self, name), "default" if value == usual[name] else "given") for name in usual}

    def field_column(self) -> Column:
        if self.field == "content":
            return F.col("content")
        if self.field == "tool_name":
            return F.col("tool_name")
        call = F.col("kind") == "tool_call"
        return F.when(call, jsonptr.value_at(F.col("content"), self.argument_path or ""))


def matching(messages: DataFrame, request: SearchRequest, sessions: DataFrame | None = None) -> DataFrame:
    """All matching rows with ``field_text``, unordered; fuzzy ones with score and places."""
    rows = request.filters.apply(messages, sessions).withColumn("field_text", request.field_column())
    if request.query is None:
        return rows.filter(F.col("field_text").isNotNull())
    if request.mode == "literal":
        return rows.filter(contains_caseless(F.col("field_text"), request.query))
    if request.mode == "regex":
        return rows.filter(prefiltered_regex(request.query, F.col("field_text")))
    return fuzzy.scored(rows, request.query, "field_text")


def ordered(rows: DataFrame, request: SearchRequest) -> DataFrame:
    if request.mode == "fuzzy":
        exact = contains_caseless(F.col("field_text"), request.query)
        return rows.orderBy(F.desc("fuzzy_score"), F.desc(exact), "session_id", "seq")
    if request.window == "latest":
        return rows.orderBy("session_id", F.desc("seq"))
    return rows.orderBy("session_id", "seq")


def page(rows: DataFrame, request: SearchRequest) -> DataFrame:
    """The page and one row more, in order; the last tells whether there is a next page."""
    out = ordered(rows, request)
    if request.offset:
        out = out.offset(request.offset)
    return out.limit(request.limit + 1) if request.limit else out


# --- evidence ---------------------------------------------------------------


def evidence(rows: DataFrame, request: SearchRequest) -> DataFrame:
    """Adds match_start, match_end (null without query) and, with match_chars, match_view and its markers."""
    text = F.col("field_text")
    if request.query is None:
        none = F.lit(None).cast("bigint")
        return rows.withColumns({"match_start": none, "match_end": none})
    if request.mode == "literal":
        folded = fold_literal(request.query)
        at = F.locate(folded, fold(text))
        # a match that ends inside the folding of a letter has the whole letter
        start, end = unfolded_place(text, at - 1), unfolded_place(text, at - 2 + len(folded)) + 1
    elif request.mode == "regex":
        start, end = regex_span(request.query, text)
    else:
        start, end = F.array_min("fuzzy_places"), F.array_max("fuzzy_places") + 1
        rows = rows.withColumn("match_ranges", fuzzy.match_ranges(F.col("fuzzy_places")))
    out = rows.withColumns({"match_start": start.cast("bigint"), "match_end": end.cast("bigint")})
    if request.match_chars is None:
        return out
    width = request.match_chars
    size, first, last = F.length(text), F.col("match_start"), F.col("match_end")
    if request.mode == "fuzzy":
        # letters of a fuzzy match may be far apart: the view shows where most of them are
        out = out.withColumn("__dense", fuzzy.densest(F.col("fuzzy_places"), width))
        first, last = F.col("__dense.first"), F.col("__dense.last") + 1
    shown = F.least(last - first, F.lit(width))
    left = F.least(F.greatest(first - F.floor((width - shown) / 2), F.lit(0)), F.greatest(size - width, F.lit(0)))
    out = out.withColumn("view_start", left.cast("bigint"))
    view = F.substr(text, (F.col("view_start") + 1).cast("int"), F.lit(width))
    return out.withColumns(
        {
            "match_view": view,
            "marker_start": first - F.col("view_start"),
            "marker_end": F.least(last - F.col("view_start"), F.lit(width).cast("bigint")),
            "view_before": F.col("view_start") > 0,
            "view_after": F.col("view_start") + width < size,
        }
    ).drop("__dense")


def field_view(rows: DataFrame, request: SearchRequest) -> DataFrame:
    """Adds field_view (lines first, then characters) and whether text was left out before and after."""
    text = F.col("field_text")
    kept = select_lines(text, request.lines)
    cut = kept if request.view_chars is None else F.substring(kept, 1, request.view_chars)
    return rows.withColumn("field_view", cut).withColumns(
        {
            "field_before": F.lit(request.lines < 0) & (F.length(kept) < F.length(text)),
            "field_after": (F.length(cut) < F.length(kept)) | (F.lit(request.lines > 0) & (F.length(kept) < F.length(text))),
        }
    )


# --- context ----------------------------------------------------------------


def context_rows(messages: DataFrame, hits: DataFrame, before: int, after: int) -> DataFrame:
    """Rows within ``before`` and ``after`` places of a hit, each once, with is_match.

    Only sessions with a hit are read; overlapping windows merge because a row
    asks whether a hit lies within its reach instead of hits collecting rows.
    """
    keys = hits.select("session_id", "seq").distinct()
    near = messages.join(keys.select("session_id").distinct(), "session_id", "left_semi")
    marked = near.join(keys.withColumn("__hit", F.lit(1)), ["session_id", "seq"], "left")
    reach = Window.partitionBy("session_id").orderBy("seq").rangeBetween(-after, before)
    return marked.withColumn("__near", F.max("__hit").over(reach)).filter("__near = 1").withColumn("is_match", F.col("__hit").isNotNull()).drop("__hit", "__near")


def read_session(messages: DataFrame, session_id: str, filters: MessageFilters | None = None, newest_first: bool = False) -> DataFrame:
    """One session's rows that the filters leave, in order of sequence; the session's filter reaches the scan."""
    own = messages.filter(F.col("session_id") == session_id)
    kept = filters.apply(own) if filters else own
    return kept.orderBy(F.desc("seq") if newest_first else "seq")


def timeline(messages: DataFrame, request: SearchRequest, preview_chars: int = 160) -> DataFrame:
    """(session_id, seq, ts, role, kind, tool_name, preview) of matching rows, by time and undated ones last; ``window`` latest turns the order round."""
    rows = matching(messages, request)
    preview = truncate_for_display(F.coalesce("field_text", F.lit("")), preview_chars)
    newest = request.window == "latest"
    order = [F.desc_nulls_last("ts"), F.desc("session_id"), F.desc("seq")] if newest else [F.asc_nulls_last("ts"), "session_id", "seq"]
    out = rows.select("session_id", "seq", "ts", "role", "kind", "tool_name", preview.alias("preview")).orderBy(*order)
    out = out.offset(request.offset) if request.offset else out
    return out.limit(request.limit) if request.limit else out


def inspect(sessions: DataFrame, messages: DataFrame, edits: DataFrame | None = None, preview_chars: int = 160) -> DataFrame:
    """A row for each session: counts by role and kind, its span, first and last rows of a person, references and files touched.

    All counts come from one aggregate of messages and one of edits, so any number
    of sessions is inspected in one run; filter the sessions to inspect few.
    """
    own = messages.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    human = (F.col("role") == "user") & (F.coalesce("kind", F.lit("")) == "conversation")
    preview = truncate_for_display(F.coalesce("content", F.lit("")), preview_chars)
    counted = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    per = own.groupBy("session_id").agg(
        F.count("*").alias("messages"),
        *[counted(F.col("role") == r).alias(f"{r}_rows") for r in ("user", "assistant", "tool", "slash")],
        counted(F.col("kind") == "tool_call").alias("tool_calls"), counted(F.col("kind") == "tool_result").alias("tool_results"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"),
        F.min_by(F.when(human, preview), F.when(human, F.col("seq"))).alias("first_request"), F.max_by(F.when(human, preview), F.when(human, F.col("seq"))).alias("last_request"),
        F.sum(F.size(refs.extract(F.coalesce("content", F.lit(""))))).alias("references"),
    )
    out = sessions.select("id", "title", "cwd", "repo_root", "parent_session_id", "parse_warning").join(per.withColumnRenamed("session_id", "id"), "id", "left")
    if edits is not None:
        touched = edits.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("edits"), F.countDistinct("file_path").alias("files"))
        out = out.join(touched, "id", "left")
    return out.fillna(0, [c for c in ("messages", "tool_calls", "tool_results", "references", "edits", "files", "user_rows", "assistant_rows", "tool_rows", "slash_rows") if c in out.columns])


def needed_trigrams(request: SearchRequest) -> list[list[str]] | None:
    """Groups of trigrams: a hit has all of some group. None if all rows must be tested (a short literal, an optional pattern, a fuzzy query, another field)."""
    if request.query is None or request.field != "content":
        return None
    if request.mode == "regex":
        return regex_trigrams(request.query)
    if request.mode == "literal" and len(request.query) > 2:
        return [literal_trigrams(request.query)]
    return None


def indexed(rows: DataFrame, lists: DataFrame, request: SearchRequest, sessions: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """``matching`` by way of stored posting lists (``sources.postings``): only rows with the trigrams that a match needs are tested.

    ``rows`` have ``doc`` (and the columns ``also``) as numbered by the index. A
    query that needs no trigram tests all rows.
    """
    groups = needed_trigrams(request)
    if groups:
        rows = rows.join(postings.candidates(lists, groups, also), [*also, "doc"], "left_semi")
    return matching(rows.drop("doc", *also), request, sessions)


def context_of(messages: DataFrame, session_id: str, seq: int, before: int, after: int) -> DataFrame:
    """Rows around one message, in order; the filter reaches the scan."""
    return messages.filter((F.col("session_id") == session_id) & F.col("seq").between(seq - before, seq + after)).orderBy("seq")


# --- enrichment -------------------------------------------------------------


def with_metadata(hits: DataFrame, sessions: DataFrame, raw: bool = False) -> DataFrame:
    """Hits with their session's columns as struct ``session`` (null if unknown)."""
    names = ["title", "cwd", "repo_root", "created_at", "updated_at", "parent_session_id"] + (["raw_metadata_json"] if raw else [])
    side = sessions.select(F.col("id").alias("session_id"), F.struct(*names).alias("session")).dropDuplicates(["session_id"])
    return hits.join(side, "session_id", "left")


def with_refs(hits: DataFrame) -> DataFrame:
    found = refs.extract(F.col("content"))
    return hits.withColumn("refs", found).withColumn("ref_summary", refs.summary(F.col("refs")))


@dataclass
class Page:
    rows: list[Row]
    offset: int
    next_offset: int | None
    extent: str
    context: DataFrame | None = None

    @property
    def has_more(self) -> bool:
        return self.next_offset is not None


def enriched(rows: DataFrame, request: SearchRequest, sessions: DataFrame | None = None) -> DataFrame:
    out = field_view(evidence(rows, request), request)
    if "refs" in request.include:
        out = with_refs(out)
    if "metadata" in request.include or "raw_metadata" in request.include:
        if sessions is None:
            raise FilterError("metadata needs the sessions")
        out = with_metadata(out, sessions, "raw_metadata" in request.include)
    return out


def search(messages: DataFrame, request: SearchRequest, sessions: DataFrame | None = None) -> Page:
    """One page; at most limit + 1 rows come to the driver."""
    if not request.limit:
        raise FilterError("a page has a limit; all hits come from search_batches")
    found = page(matching(messages, request, sessions), request)
    rows = enriched(found, request, sessions).collect()
    order = (lambda r: (r["session_id"], r["seq"])) if request.mode != "fuzzy" else None
    more = bool(request.limit) and len(rows) > request.limit
    if request.mode == "fuzzy":
        rows.sort(key=lambda r: (-r["fuzzy_score"], fold_literal(request.query) not in fold_literal(r["field_text"]), r["session_id"], r["seq"]))
    else:
        rows.sort(key=order, reverse=request.window == "latest")
    rows = rows[: request.limit] if more else rows
    if request.window == "latest":
        rows.reverse()
    next_offset = request.offset + len(rows) if more else None
    context = None
    if any(request.context) and rows:
        keys = messages.sparkSession.createDataFrame([(r["session_id"], r["seq"]) for r in rows], "session_id string, seq bigint")
        context = context_rows(messages, keys, *request.context)
    extent = "partial" if more or request.offset else "complete"
    return Page(rows, request.offset, next_offset, extent, context)


class Batches(Iterator[list[Row]]):
    """Rows of ``df`` in order, ``batch_rows`` at a time, fetched ``ahead`` batches before they are asked for.

    One partition at a time comes to the driver, in a thread of its own. ``close``
    (or the end of a ``with`` block) stops it and ends its jobs; so does an error.
    """

    def __init__(self, df: DataFrame, batch_rows: int, ahead: int = 2):
        self._context, self._group = df.sparkSession.sparkContext, f"threadloom-{uuid.uuid4().hex}"
        self._queue: queue.Queue = queue.Queue(maxsize=ahead)
        self._stop, self._ended = threading.Event(), False

        def put(item: object) -> bool:
            while not self._stop.is_set():
                try:
                    self._queue.put(item, timeout=0.1)
                    return True
                except queue.Full:
                    continue
            return False

        def run() -> None:
            self._context.setJobGroup(self._group, "batches of rows", interruptOnCancel=True)
            try:
                held: list[Row] = []
                for row in df.toLocalIterator(prefetchPartitions=True):
                    held.append(row)
                    if len(held) == batch_rows:
                        if not put(held):
                            return
                        held = []
                put(held)
                put(None)
            except Exception as e:  # raised to the caller
                put(e)

        self._thread = InheritableThread(target=run, session=df.sparkSession, daemon=True)
        self._thread.start()

    def __iter__(self) -> Batches:
        return self

    def __next__(self) -> list[Row]:
        while not self._ended:
            item = self._queue.get()
            if item is None:
                self.close()
            elif isinstance(item, Exception):
                self.close()
                raise item
            elif item:
                return item
        raise StopIteration

    def close(self) -> None:
        if not self._ended:
            self._ended = True
            self._stop.set()
            self._context.cancelJobGroup(self._group)
            self._thread.join()

    def __enter__(self) -> Batches:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def search_batches(messages: DataFrame, request: SearchRequest, batch_rows: int, sessions: DataFrame | None = None) -> Batches:
    """All hits in order, in batches; closing them ends the search."""
    if batch_rows <= 0:
        raise FilterError("batch_rows is positive")
    return Batches(enriched(ordered(matching(messages, request, sessions), request), request, sessions), batch_rows)


def corpus_count(messages: DataFrame, filters: MessageFilters, sessions: DataFrame | None = None) -> int:
    """Rows that the structural filters leave, for receipts."""
    return filters.apply(messages, sessions).count()


def result_digest(rows: DataFrame) -> DataFrame:
    """Digest of a result's rows in order, whatever is shown of them."""
    return rows_digest(rows, ["session_id", "seq"], ["session_id", "seq", "role", "kind", "content"])


# --- sessions ---------------------------------------------------------------


@dataclass(frozen=True)
class Scoring:
    """Weights of the session ranker."""

    title: int = 600
    summary: int = 450
    path: int = 350
    preview: int = 250
    other: int = 100
    token_bonus: int = 40
    all_tokens_bonus: int = 150
    recency_weight: int = 2
    recency_max_days: int = 90
    current_repo_bonus: int = 200


def list_sessions(sessions: DataFrame, filters: SessionFilters = SessionFilters(), limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Newest first; sessions without a date last."""
    out = filters.apply(sessions).orderBy(F.desc_nulls_last("updated_at"), "id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def rank_sessions(sessions: DataFrame, query: str, now: Column, current_repo: str | None = None, weights: Scoring = Scoring(), snippet_chars: int = 160) -> DataFrame:
    """Sessions (with transcript_text) that match, with score, match_source and match_snippet.

    A field counts its weight if it has the whole query, and the token bonus for
    each word it has; recency and the current repository only add to a match.
    """
    if not query.strip():
        raise FilterError("the query is blank")
    folded = fold_literal(query.strip())
    words = list(dict.fromkeys(folded.split()))
    fields = [
        ("title", F.col("title"), weights.title), ("summary", F.col("summary"), weights.summary), ("path", F.col("cwd"), weights.path),
        ("path", F.col("repo_root"), weights.path), ("preview", F.col("preview_text"), weights.preview), ("transcript", F.col("transcript_text"), weights.other),
    ]
    # each field is folded once, as a column of its own; a field with the query has its words
    sessions = sessions.withColumns({f"__f{i}": fold(text) for i, (_, text, _) in enumerate(fields)})
    has = lambda i, needle: F.coalesce(F.contains(F.col(f"__f{i}"), F.lit(needle)), F.lit(False))
    sessions = sessions.withColumns({f"__h{i}": F.array(has(i, folded), *[has(i, w) for w in words]) for i in range(len(fields))})
    scores, tokens_in = [], {w: F.lit(False) for w in words}
    for i, (_, _, weight) in enumerate(fields):
        part = F.when(F.col(f"__h{i}")[0], weight).otherwise(0)
        for k, w in enumerate(words, 1):
            part = part + F.when(F.col(f"__h{i}")[k], weights.token_bonus).otherwise(0)
            tokens_in[w] = tokens_in[w] | F.col(f"__h{i}")[k]
        scores.append(part)
    every = F.lit(True)
    for w in words:
        every = every & tokens_in[w]
    table = sessions.withColumns({f"__s{i}": s for i, s in enumerate(scores)}).withColumn("__all", every)
    match = sum((F.col(f"__s{i}") for i in range(1, len(scores))), F.col("__s0"))
    age = F.date_diff(now, F.col("updated_at"))
    recency = F.when(F.col("updated_at").isNull(), 0).otherwise(F.greatest(F.lit(weights.recency_max_days) - age, F.lit(0)) * weights.recency_weight)
    repo = F.when(F.coalesce(F.col("repo_root") == F.lit(current_repo), F.lit(False)), weights.current_repo_bonus).otherwise(0) if current_repo else F.lit(0)
    out = table.withColumn("__match", match).filter("__match > 0")
    top = F.greatest(*[F.col(f"__s{i}") for i in range(len(scores))])
    source = F.lit(None).cast("string")
    text = F.lit(None).cast("string")
    for i in reversed(range(len(scores))):
        source = F.when(F.col(f"__s{i}") == top, F.lit(fields[i][0])).otherwise(source)
        text = F.when(F.col(f"__s{i}") == top, fields[i][1]).otherwise(text)
    total = F.col("__match") + F.when(F.col("__all"), weights.all_tokens_bonus).otherwise(0) + recency + repo
    made = out.withColumns({"score": total.cast("bigint"), "match_source": source, "match_snippet": snippet(text, query, snippet_chars)})
    return made.drop("__all", "__match", *[f"__{k}{i}" for i in range(len(scores)) for k in "sfh"])


def search_sessions(sessions: DataFrame, query: str, now: Column, filters: SessionFilters = SessionFilters(), limit: int = 50, **options) -> DataFrame:
    """The best ``limit`` sessions; ties: newest, then id."""
    ranked = rank_sessions(filters.apply(sessions), query, now, **options)
    return ranked.orderBy(F.desc("score"), F.desc_nulls_last("updated_at"), "id").limit(limit)
