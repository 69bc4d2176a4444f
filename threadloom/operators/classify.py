"""Rule-based classification of messages: ordered policies of ordered categories, first hit wins.

Each category is one caseless alternation, so its evidence is the leftmost match
of any of its patterns. Only a person's own original text is judged, in the
user turns of sessions that a person started.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PatternError, regex_match, regex_span, to_java
from .filters import FilterError, attributable_human

#: The categories of corrections and their patterns, in order.
CORRECTIONS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("regression", (
        r"\byou (deleted|removed|reverted|lost|regressed|undid|rolled back|broke)\b",
        r"\b(that|this|it) (reverted|deleted|removed|undid|regressed)\b",
        r"\bbroke the (build|tests?|code|app)\b",
        r"\bregressed\b",
    )),
    ("skip_step", (r"\byou forgot\b", r"\byou missed\b", r"\byou skipped\b", r"\bdon'?t forget\b", r"\bmissing step\b", r"\byou didn'?t\b")),
    ("misunderstanding", (
        r"\b(that is|that'?s|it is|it'?s) (actually )?(wrong|incorrect|not correct|not right|not what|a mistake)\b",
        r"\byou'?re wrong\b",
        r"\byou (misunderstood|got it wrong|misread)\b",
        r"\bnono\b",
        r"\bno,?\s+that'?s\b",
        r"\bno,?\s+i (meant|asked|said)\b",
        r"\bwait,?\s+(no|that'?s)\b",
        r"\bwrong approach\b",
    )),
    ("incomplete", (r"\balso need\b", r"\bmust also\b", r"\bnot done\b", r"\bnot finished\b", r"\bstill need\b", r"\byou should have\b", r"\bbut you\b")),
    ("other", (
        r"^\s*(?:ok,?\s+|no,?\s+|wait,?\s+|please\s+|just\s+)?stop\b",
        r"\bjust stop\b",
        r"\bplease stop\b",
        r"\bstop doing\b",
        r"\bstop that\b",
        r"\bstop it\b",
        r"\bstop changing\b",
        r"\bstop making\b",
        r"\bstop breaking\b",
    )),
)


@dataclass(frozen=True)
class Policy:
    """A named list of categories; patterns that match empty text are refused."""

    id: str
    categories: tuple[tuple[str, tuple[str, ...]], ...]

    def __post_init__(self):
        if not self.id.strip() or not self.categories:
            raise FilterError("a policy has an id and categories")
        names = [c for c, _ in self.categories]
        if len(set(names)) < len(names) or not all(n.strip() for n in names):
            raise FilterError(f"policy {self.id}: category names are unique and not blank")
        for name, patterns in self.categories:
            if not patterns:
                raise FilterError(f"category {name} has no pattern")
            for p in patterns:
                refuse_empty(p)

    def alternations(self) -> list[tuple[str, str]]:
        """(category, pattern of the dialect)."""
        return [(name, "(?i)" + "|".join(f"(?:{p})" for p in patterns)) for name, patterns in self.categories]


def refuse_empty(pattern: str) -> None:
    """Raises PatternError for a pattern that every text has."""
    to_java(pattern)
    try:
        empty = re.search(pattern, "") is not None
    except re.error:
        empty = False  # valid in the dialect, not in Python's
    if empty:
        raise PatternError(f"{pattern!r} matches empty text")


DEFAULT_POLICY = Policy("corrections", CORRECTIONS)


def label(text: Column, policies: Sequence[Policy]) -> Column:
    """struct(policy, category, start, end, matched) of the first hit; null without one."""
    out = None
    for policy in policies:
        for name, pattern in policy.alternations():
            start, end = regex_span(pattern, text)
            hit = F.struct(
                F.lit(policy.id).alias("policy"),
                F.lit(name).alias("category"),
                start.cast("bigint").alias("start"),
                end.cast("bigint").alias("end"),
                F.substr(text, (start + 1).cast("int"), (end - start).cast("int")).alias("matched"),
            )
            fits = regex_match(pattern, text)
            out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def classify(messages: DataFrame, sessions: DataFrame | None = None, policies: Sequence[Policy] = (DEFAULT_POLICY,), limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Hits, newest first (undated last), ties by session and sequence."""
    rows = messages.filter(F.col("role") == "user")
    if sessions is not None:
        started = sessions.filter(F.col("parent_session_id").isNull()).select(F.col("id").alias("session_id"))
        rows = rows.join(started, "session_id", "left_semi")
    rows = attributable_human(rows).withColumn("hit", label(F.col("content"), policies)).filter(F.col("hit").isNotNull())
    out = rows.select("session_id", "seq", "ts", "content", "hit.*").orderBy(F.desc_nulls_last("ts"), "session_id", "seq")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def category_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("policy", "category").agg(F.count("*").alias("messages"), F.countDistinct("session_id").alias("sessions")).orderBy("policy", "category")
