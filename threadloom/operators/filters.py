"""Structural filters of sessions, messages and file edits.

A filter set is checked when it is made: what no row could satisfy raises
``FilterError`` instead of giving an empty result. Predicates are built-in
columns, so they reach the scan where the source can use them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.patterns import path_glob, under_path
from ..functions.text import contains_caseless
from ..sources.tables import KINDS, PROVIDERS, ROLES


class FilterError(ValueError):
    """The filters contradict one another or name what doesn't exist."""


def all_of(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def any_of(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def _known(name: str, values: Sequence[str] | None, allowed: Sequence[str], empty_ok: bool = False) -> None:
    if values is None:
        return
    if not values and not empty_ok:
        raise FilterError(f"{name}: an empty list selects nothing")
    wrong = [v for v in values if v not in allowed]
    if wrong:
        raise FilterError(f"{name}: no such value {wrong}; there are {list(allowed)}")


@dataclass(frozen=True)
class PathScope:
    """Prefixes by whole components: workspace is cwd or repo_root, transcript is source_path."""

    legacy: str | None = None
    workspace: str | None = None
    transcript: str | None = None
    exclude_workspace: tuple[str, ...] = ()
    exclude_transcript: tuple[str, ...] = ()

    def empty(self) -> bool:
        return self == PathScope()

    def predicate(self) -> Column:
        cwd, repo, source = F.col("cwd"), F.col("repo_root"), F.col("source_path")
        parts = []
        if self.legacy:
            parts.append(any_of([under_path(c, self.legacy) for c in (cwd, repo, source)]))
        if self.workspace:
            parts.append(any_of([under_path(c, self.workspace) for c in (cwd, repo)]))
        if self.transcript:
            parts.append(under_path(source, self.transcript))
        parts += [~any_of([under_path(c, p) for c in (cwd, repo)]) for p in self.exclude_workspace]
        parts += [~under_path(source, p) for p in self.exclude_transcript]
        return all_of(parts)


@dataclass(frozen=True)
class SessionFilters:
    ids: tuple[str, ...] | None = None
    providers: tuple[str, ...] | None = None
    paths: PathScope = PathScope()
    exclude_ids: tuple[str, ...] = ()
    bounds: dates.Bounds = dates.Bounds()
    #: "user" (no parent), "subagent" (a parent); None: both; (): none.
    session_kinds: tuple[str, ...] | None = None
    parent: str | None = None
    warnings_only: bool = False

    def __post_init__(self):
        _known("session_kinds", self.session_kinds, ("user", "subagent"), empty_ok=True)
        if self.providers is not None and not self.providers:
            raise FilterError("providers: an empty list selects nothing")
        if self.parent is not None and self.session_kinds == ("user",):
            raise FilterError("a session with a parent is no user session")

    def predicate(self) -> Column:
        parts = [self.paths.predicate()] if not self.paths.empty() else []
        if self.ids is not None:
            parts.append(F.col("id").isin(*self.ids))
        if self.providers is not None:
            parts.append(F.col("provider").isin(*self.providers))
        if self.exclude_ids:
            parts.append(~F.col("id").isin(*self.exclude_ids))
        if self.bounds != dates.Bounds():
            parts.append(self.bounds.overlaps(F.col("created_at"), F.col("updated_at")))
        if self.session_kinds is not None:
            parts.append(any_of([F.col("parent_session_id").isNull() if k == "user" else F.col("parent_session_id").isNotNull() for k in self.session_kinds]))
        if self.parent is not None:
            parts.append(F.coalesce(F.col("parent_session_id") == self.parent, F.lit(False)))
        if self.warnings_only:
            parts.append(F.col("parse_warning").isNotNull())
        return all_of(parts)

    def apply(self, sessions: DataFrame) -> DataFrame:
        return sessions.filter(self.predicate())


@dataclass(frozen=True)
class MessageFilters:
    roles: tuple[str, ...] | None = None
    #: None: every kind but harness notices, unknown ones included; else just these.
    kinds: tuple[str, ...] | None = None
    include_compaction: bool = True
    providers: tuple[str, ...] | None = None
    session_id: str | None = None
    exclude_session_ids: tuple[str, ...] = ()
    bounds: dates.Bounds = dates.Bounds()
    #: Inclusive; only within one session.
    sequence: tuple[int | None, int | None] | None = None
    tool_name_contains: str | None = None
    #: Session-level conditions, applied by a semi join with the sessions.
    sessions: SessionFilters | None = field(default=None)

    def __post_init__(self):
        _known("roles", self.roles, ROLES)
        _known("kinds", self.kinds, KINDS)
        if self.providers is not None and not self.providers:
            raise FilterError("providers: an empty list selects nothing")
        if self.kinds == ("compaction",) and not self.include_compaction:
            raise FilterError("kinds: compaction is left out by include_compaction")
        if self.roles == ("compaction",) and (not self.include_compaction or (self.kinds is not None and "compaction" not in self.kinds)):
            raise FilterError("role compaction needs kind compaction")
        if self.sequence is not None:
            low, high = self.sequence
            if self.session_id is None:
                raise FilterError("sequence bounds need a session")
            if (low or 0) < 0 or (high or 0) < 0 or (low is not None and high is not None and low > high):
                raise FilterError("sequence bounds are not ordered or negative")

    def kind_predicate(self) -> Column:
        if self.kinds is None:
            left_out = ["harness_notice"] + ([] if self.include_compaction else ["compaction"])
            return ~F.coalesce(F.col("kind").isin(*left_out), F.lit(False))
        return F.col("kind").isin(*[k for k in self.kinds if self.include_compaction or k != "compaction"])

    def predicate(self) -> Column:
        parts = [self.kind_predicate()]
        if self.roles is not None:
            parts.append(F.col("role").isin(*self.roles))
        if self.providers is not None:
            parts.append(F.col("provider").isin(*self.providers))
        if self.session_id is not None:
            parts.append(F.col("session_id") == self.session_id)
        if self.exclude_session_ids:
            parts.append(~F.col("session_id").isin(*self.exclude_session_ids))
        if self.bounds != dates.Bounds():
            parts.append(self.bounds.holds(F.col("ts")))
        if self.sequence is not None:
            low, high = self.sequence
            parts += [F.col("seq") >= low] if low is not None else []
            parts += [F.col("seq") <= high] if high is not None else []
        if self.tool_name_contains:
            parts.append(contains_caseless(F.col("tool_name"), self.tool_name_contains))
        return all_of(parts)

    def apply(self, messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
        out = messages.filter(self.predicate())
        if self.sessions is None:
            return out
        if sessions is None:
            raise FilterError("session conditions need the sessions")
        ids = self.sessions.apply(sessions).select(F.col("id").alias("session_id"))
        return out.join(ids, "session_id", "left_semi")


@dataclass(frozen=True)
class FileQuery:
    glob: str | None = None
    session_id: str | None = None
    providers: tuple[str, ...] | None = None
    bounds: dates.Bounds = dates.Bounds()
    min_edits: int | None = None
    max_edits: int | None = None

    def __post_init__(self):
        if self.min_edits is not None and self.max_edits is not None and self.min_edits > self.max_edits:
            raise FilterError("min_edits is above max_edits")

    def predicate(self) -> Column:
        parts = []
        if self.glob:
            parts.append(path_glob(self.glob, F.col("file_path"), F.col("file_name")))
        if self.session_id is not None:
            parts.append(F.col("session_id") == self.session_id)
        if self.providers is not None:
            parts.append(F.col("provider").isin(*self.providers))
        if self.bounds != dates.Bounds():
            parts.append(self.bounds.holds(F.col("ts")))
        return all_of(parts)

    def having(self, edits: Column) -> Column:
        return all_of(([edits >= self.min_edits] if self.min_edits is not None else []) + ([edits <= self.max_edits] if self.max_edits is not None else []))


@dataclass(frozen=True)
class AccessScope:
    """Row-level security: only sessions under the roots, and no raw SQL."""

    roots: tuple[str, ...] | None = None

    def sessions(self, sessions: DataFrame) -> DataFrame:
        if self.roots is None:
            return sessions
        return sessions.filter(any_of([under_path(F.col(c), r) for r in self.roots for c in ("cwd", "repo_root")]))

    def rows(self, rows: DataFrame, sessions: DataFrame) -> DataFrame:
        """Rows with a session_id, of visible sessions only."""
        if self.roots is None:
            return rows
        return rows.join(self.sessions(sessions).select(F.col("id").alias("session_id")), "session_id", "left_semi")

    def check_raw_sql(self) -> None:
        if self.roots is not None:
            raise PermissionError("raw SQL is off while access is scoped to workspace roots")


def resolve_session_id(sessions: DataFrame, text: str, show: int = 8) -> str:
    """The id itself, else the only one that starts with it (or whose native id does).

    At most ``show`` candidates come to the driver.
    """
    exact = sessions.filter(F.col("id") == text).select("id").limit(1).collect()
    if exact:
        return text
    starts = F.startswith(F.lower("id"), F.lit(text.lower())) | F.startswith(F.lower("provider_session_id"), F.lit(text.lower()))
    found = [r["id"] for r in sessions.filter(starts).select("id").distinct().orderBy("id").limit(show + 1).collect()]
    if not found:
        raise FilterError(f"no session {text!r}")
    if len(found) > 1:
        more = ", ..." if len(found) > show else ""
        raise FilterError(f"{text!r} is ambiguous: {', '.join(found[:show])}{more}")
    return found[0]


def attributable_human(messages: DataFrame) -> DataFrame:
    """Original rows of a person's own text; of mixed ones just the person's parts, joined."""
    parts = F.filter("content_parts", lambda p: p["authorship"] == "human")
    text = F.array_join(F.transform(parts, lambda p: F.substr(F.col("content"), (p["start_char"] + 1).cast("int"), (p["end_char"] - p["start_char"]).cast("int"))), "")
    mixed = F.col("authorship") == "mixed"
    kept = messages.filter((F.col("record_relation") == "original") & ((F.col("authorship") == "human") | (mixed & (F.size(parts) > 0))))
    return kept.withColumn("content", F.when(mixed, text).otherwise(F.col("content")))
