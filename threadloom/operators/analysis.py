"""Analysis runs: rule scores and phrases of sessions, relationships, and the session graph."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.digests import rows_digest
from ..functions.patterns import regex_match, to_java
from ..functions.text import char_prefix, fold_literal, ngrams, phrase_words, prose_only, tokens
from .classify import refuse_empty
from .filters import FilterError, attributable_human

TARGETS = ("title", "summary", "first_user_text", "user_text", "any")


@dataclass(frozen=True)
class Rule:
    dimension: str
    label: str
    pattern: str
    target: str = "any"
    weight: int = 1

    def __post_init__(self):
        if self.target not in TARGETS:
            raise FilterError(f"target is one of {TARGETS}")
        if not self.dimension.strip() or not self.label.strip():
            raise FilterError("a rule has a dimension and a label")
        refuse_empty(self.pattern)


@dataclass(frozen=True)
class Relationship:
    """A pattern over titles whose group ``parent`` names the other session's title."""

    id: str
    kind: str
    pattern: str

    def __post_init__(self):
        if "(?P<parent>" not in self.pattern:
            raise FilterError(f"relationship {self.id} has no group parent")
        refuse_empty(self.pattern)


@dataclass(frozen=True)
class PhraseSpec:
    least: int = 2
    most: int = 4
    prose: bool = False
    min_document_tokens: int = 0
    exclude_numeric: bool = True
    excluded: tuple[str, ...] = ()
    max_unique: int = 100_000


class TooManyPhrases(ValueError):
    """The vocabulary is larger than the policy allows; nothing is cut silently."""


def session_texts(messages: DataFrame) -> DataFrame:
    """(session_id, user_text, first_user_text, message_count, user_message_count) of a person's own text."""
    human = attributable_human(messages.filter(F.col("role") == "user"))
    joined = human.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "content"))), lambda m: m["content"]), " ").alias("user_text"),
        F.min_by("content", "seq").alias("first_user_text"),
        F.count("*").alias("user_message_count"),
    )
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    return counts.join(joined, "session_id", "left")


def rule_hits(documents: DataFrame, rules: list[Rule], max_chars: int | None = None) -> DataFrame:
    """documents with classifications (array of struct) and score (sum of weights)."""
    user, first = char_prefix(F.col("user_text"), max_chars), char_prefix(F.col("first_user_text"), max_chars)
    columns = {"title": [F.col("title")], "summary": [F.col("summary")], "first_user_text": [first], "user_text": [user]}
    columns["any"] = [c[0] for c in columns.values()]
    parts = []
    for r in sorted(rules, key=lambda r: (r.dimension, r.label)):
        hit = F.lit(False)
        for c in columns[r.target]:
            hit = hit | regex_match(r.pattern, c)
        parts.append(F.when(hit, F.struct(F.lit(r.dimension).alias("dimension"), F.lit(r.label).alias("label"), F.lit(r.weight).cast("bigint").alias("weight"))))
    found = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<struct<dimension:string,label:string,weight:bigint>>")
    return documents.withColumn("classifications", found).withColumn("score", F.aggregate("classifications", F.lit(0).cast("bigint"), lambda a, c: a + c["weight"]))


def phrase_counts(documents: DataFrame, spec: PhraseSpec, text: str = "user_text") -> DataFrame:
    """(session_id, phrase, occurrences) of each document."""
    body = prose_only(F.col(text)) if spec.prose else F.col(text)
    words = documents.select("session_id", tokens(body).alias("w")).filter(F.size("w") >= max(1, spec.min_document_tokens))
    per = words.select("session_id", F.explode(ngrams(F.col("w"), spec.least, spec.most)).alias("phrase"))
    if spec.exclude_numeric:
        per = per.filter(~F.col("phrase").rlike(r"\p{N}"))
    if spec.excluded:
        out = [fold_literal(x) for x in spec.excluded]
        parts = F.split("phrase", " ")
        per = per.filter(~F.element_at(parts, 1).isin(out) & ~F.forall(parts, lambda w: w.isin(out)))
    return per.groupBy("session_id", "phrase").agg(F.count("*").alias("occurrences"))


def phrase_vocabulary(documents: DataFrame, spec: PhraseSpec, text: str = "user_text") -> DataFrame:
    """(phrase, words, documents, occurrences), most frequent first."""
    per = phrase_counts(documents, spec, text)
    out = per.groupBy("phrase").agg(F.count("*").alias("documents"), F.sum("occurrences").alias("occurrences"))
    return out.withColumn("words", phrase_words(F.col("phrase"))).orderBy(F.desc("occurrences"), F.desc("documents"), F.desc("words"), "phrase")


def checked_vocabulary(documents: DataFrame, spec: PhraseSpec) -> DataFrame:
    """``phrase_vocabulary``, or TooManyPhrases if it is above the policy's bound."""
    out = phrase_vocabulary(documents, spec)
    # counted without its order: a limited sort would hold max_unique rows in one task
    if phrase_counts(documents, spec).select("phrase").distinct().count() > spec.max_unique:
        raise TooManyPhrases(f"more than max_unique={spec.max_unique} phrases")
    return out


def relationship_hints(sessions: DataFrame, rules: list[Relationship]) -> DataFrame:
    """(session_id, rule_id, kind, parent_title, candidates, parent, resolution): a row per matched rule.

    candidates are the other sessions with the title, parent is the only one;
    resolution is resolved, ambiguous or unresolved. Titles are summed up before
    the join, so a title that very many sessions share is one row.
    """
    parts = []
    for r in rules:
        java = to_java(r.pattern)
        names = _groups(r.pattern)
        parent = F.trim(F.regexp_extract("title", java, names.index("parent") + 1))
        parts.append(
            sessions.filter(F.col("title").rlike(java)).select(F.col("id").alias("session_id"), F.lit(r.id).alias("rule_id"), F.lit(r.kind).alias("kind"), parent.alias("parent_title"), F.col("title").alias("own_title"))
        )
    if not parts:
        raise FilterError("no relationship rules")
    hints = parts[0]
    for p in parts[1:]:
        hints = hints.unionByName(p)
    titled = sessions.filter(F.col("title").isNotNull()).groupBy(F.col("title").alias("parent_title")).agg(
        F.countDistinct("id").alias("__n"), F.min("id").alias("__first"), F.max("id").alias("__last")
    )
    own = F.coalesce((F.col("own_title") == F.col("parent_title")).cast("bigint"), F.lit(0))
    joined = hints.distinct().join(titled, "parent_title", "left").withColumn("candidates", F.coalesce(F.col("__n") - own, F.lit(0)))
    other = F.when(F.col("__first") != F.col("session_id"), F.col("__first")).otherwise(F.col("__last"))
    n = F.col("candidates")
    resolution = F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    return joined.select("session_id", "rule_id", "kind", "parent_title", "candidates", F.when(n == 1, other).alias("parent"), resolution.alias("resolution"))


def _groups(pattern: str) -> list[str | None]:
    """Names of the capturing groups in order, None for unnamed ones."""
    marks = re.finditer(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?:\?P<(?P<name>\w+)>|(?!\?))", pattern)
    return [m["name"] for m in marks if m[0].startswith("(")]


def graph_edges(hints: DataFrame) -> DataFrame:
    """(source, target, kind, rule_id) of resolved hints: parent to session."""
    return hints.filter("resolution = 'resolved'").select(F.col("parent").alias("source"), F.col("session_id").alias("target"), "kind", "rule_id").distinct()


def graph_groups(sessions: DataFrame) -> DataFrame:
    """(dimension, key, sessions): working folders and repositories of two sessions or more."""
    place = F.array(
        F.struct(F.lit("working_directory").alias("dimension"), F.trim("cwd").alias("key")), F.struct(F.lit("repository").alias("dimension"), F.trim("repo_root").alias("key"))
    )
    per = sessions.select("id", F.explode(place).alias("p")).select("id", "p.*").filter(F.col("key").isNotNull() & (F.col("key") != ""))
    return per.groupBy("dimension", "key").agg(F.countDistinct("id").alias("sessions")).filter("sessions > 1")


def graph_memberships(sessions: DataFrame) -> DataFrame:
    """(dimension, key, id): the groups' members, a row each."""
    place = F.array(
        F.struct(F.lit("working_directory").alias("dimension"), F.trim("cwd").alias("key")), F.struct(F.lit("repository").alias("dimension"), F.trim("repo_root").alias("key"))
    )
    per = sessions.select("id", F.explode(place).alias("p")).select("id", "p.*").filter(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
    return per.join(graph_groups(sessions).select("dimension", "key"), ["dimension", "key"], "left_semi")


@dataclass
class SessionGraph:
    """Sessions as nodes, parent links (started from, and by rule) as edges, shared places as groups."""

    nodes: DataFrame
    edges: DataFrame
    groups: DataFrame
    memberships: DataFrame


def session_graph(sessions: DataFrame, relationships: Sequence[Relationship] = ()) -> SessionGraph:
    """The graph of all sessions; edges of kind spawn come from the logs, the others from the rules' resolved hints."""
    spawned = child_sessions(sessions).select(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit("spawn").alias("kind"), F.lit(None).cast("string").alias("rule_id"))
    edges = spawned.unionByName(graph_edges(relationship_hints(sessions, list(relationships)))) if relationships else spawned
    nodes = sessions.select("id", "provider", "title", "cwd", "repo_root", "parent_session_id", "created_at", "updated_at")
    return SessionGraph(nodes, edges, graph_groups(sessions), graph_memberships(sessions))


def publish_analysis(analysis: Analysis, graph: SessionGraph, path: str) -> dict:
    """One bundle with the scores, the taxonomy (if asked for) and the graph as JSON lines, and a receipt of rows and digests."""
    from ..sources.sinks import publish_bundle

    tables = {"sessions": analysis.sessions.select("session_id", "score"), "nodes": graph.nodes, "edges": graph.edges, "groups": graph.groups, "memberships": graph.memberships}
    order = {"sessions": ["session_id"], "nodes": ["id"], "edges": ["source", "target", "kind"], "groups": ["dimension", "key"], "memberships": ["dimension", "key", "id"]}
    if analysis.vocabulary is not None:
        tables["taxonomy"], order["taxonomy"] = analysis.vocabulary, ["phrase"]
    return publish_bundle(tables, path, order)


def documents_page(sessions: DataFrame, after: str | None = None, limit: int = 50) -> DataFrame:
    """Keyset page in order of id."""
    out = sessions.filter(F.col("id") > after) if after is not None else sessions
    return out.orderBy("id").limit(limit)


@dataclass
class Analysis:
    sessions: DataFrame
    vocabulary: DataFrame | None
    hints: DataFrame | None
    policy_digest: str

    def corpus_digest(self) -> DataFrame:
        return rows_digest(self.sessions, ["session_id"], ["session_id", "message_count", "user_text", "score"])


def run(
    sessions: DataFrame, messages: DataFrame, rules: Sequence[Rule] = (), phrases: PhraseSpec | None = None, relationships: Sequence[Relationship] = (), max_chars: int | None = None
) -> Analysis:
    """Scores, vocabulary and relationship hints of all sessions; results don't depend on batches."""
    side = sessions.select(F.col("id").alias("session_id"), "provider", "title", "summary", "cwd", "repo_root", "created_at", "updated_at")
    documents = side.join(session_texts(messages), "session_id", "left")
    scored = rule_hits(documents, list(rules), max_chars)
    policy = json.dumps([[vars(r) for r in rules], vars(phrases) if phrases else None, [vars(r) for r in relationships], max_chars], sort_keys=True)
    return Analysis(
        scored,
        checked_vocabulary(documents, phrases) if phrases else None,
        relationship_hints(sessions, list(relationships)) if relationships else None,
        hashlib.sha256(policy.encode()).hexdigest(),
    )


def child_sessions(sessions: DataFrame) -> DataFrame:
    """(parent, child): sessions with the sessions that were started from them, where both are known."""
    pairs = sessions.select(F.col("parent_session_id").alias("parent"), F.col("id").alias("child")).filter(F.col("parent").isNotNull())
    return pairs.join(sessions.select(F.col("id").alias("parent")), "parent", "left_semi")
