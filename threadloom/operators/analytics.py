"""Counts and mined phrases over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import regex_match, trigrams
from ..functions.text import fold, informative_ngrams, ngrams, phrase_words, slash_command, tokens, user_request_body, word_mark
from ..sources.session import cut


def role_counts(messages: DataFrame) -> DataFrame:
    """(role, messages) by role; harness notices don't count."""
    kept = messages.filter(F.coalesce(F.col("kind") != "harness_notice", F.lit(True)))
    return kept.groupBy("role").agg(F.count("*").alias("messages")).orderBy("role")


def command_usage(messages: DataFrame, sessions: DataFrame | None = None, patterns: tuple[str, ...] = (), limit: int | None = 50) -> DataFrame:
    """(command, uses, unique_sessions, unique_projects), most used first.

    A project is the session's repository, else its working folder. Counts per
    (command, session) are summed before sessions are looked up, so the join
    sees a row per pair and not per message.
    """
    used = messages.select("session_id", slash_command(F.col("content")).alias("command")).filter(F.col("command").isNotNull())
    if patterns:
        wanted = F.lit(False)
        for p in patterns:
            wanted = wanted | regex_match(f"(?i){p}", F.col("command"))
        used = used.filter(wanted)
    pairs = used.groupBy("command", "session_id").agg(F.count("*").alias("n"))
    if sessions is not None:
        side = sessions.select(F.col("id").alias("session_id"), F.coalesce("repo_root", "cwd").alias("project"))
        pairs = pairs.join(side, "session_id", "left")
    else:
        pairs = pairs.withColumn("project", F.lit(None).cast("string"))
    out = pairs.groupBy("command").agg(F.sum("n").alias("uses"), F.count("*").alias("unique_sessions"), F.countDistinct("project").alias("unique_projects"))
    out = out.orderBy(F.desc("uses"), "command")
    return out.limit(limit) if limit else out


def vocabulary(messages: DataFrame, prefix: str | None = None, by_trigram: bool = False, limit: int | None = None) -> DataFrame:
    """(term, documents, occurrences), commonest first; of trigrams both are documents."""
    split = trigrams(F.col("content")) if by_trigram else tokens(F.col("content"))
    per = messages.select("id", F.explode(split).alias("term"))
    if prefix:
        per = per.filter(F.startswith("term", fold(F.lit(prefix))))
    if by_trigram:
        out = per.groupBy("term").agg(F.count("*").alias("documents"), F.count("*").alias("occurrences"))
    else:
        # two steps, so that a common word is counted in parts before it meets
        out = per.groupBy("term", "id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))
    out = out.orderBy(F.desc("occurrences"), F.desc("documents"), "term")
    return out.limit(limit) if limit else out


def trigram_postings(messages: DataFrame) -> DataFrame:
    """(term, id): the index behind substring candidates, a row a posting."""
    return messages.select(F.explode(trigrams(F.col("content"))).alias("term"), "id")


def trigram_candidates(postings: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Ids that have all trigrams of some group: unions of intersections."""
    out = None
    for group in groups:
        terms = list(dict.fromkeys(group))
        ids = postings.filter(F.col("term").isin(*terms)).groupBy("id").agg(F.countDistinct("term").alias("n")).filter(F.col("n") == len(terms)).select("id")
        out = ids if out is None else out.unionByName(ids)
    if out is None:
        raise ValueError("no group of trigrams")
    return out.distinct()


def merged_candidates(words: DataFrame, grams: DataFrame) -> DataFrame:
    """(id, score): candidates by word and by trigram together, each id once with its better score."""
    return words.select("id", "score").unionByName(grams.select("id", "score")).groupBy("id").agg(F.max("score").alias("score"))


def phrase_rows(messages: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """(id, session_id, seq, phrase): the informative phrases of each message, once each."""
    # columns of their own: inside the windows' lambdas the expressions would run once a window
    split = messages.select("id", "session_id", "seq", tokens(user_request_body(F.col("content"))).alias("w")).filter(F.size("w") >= least)
    marked = split.withColumn("marks", F.transform("w", word_mark))
    return marked.select("id", "session_id", "seq", F.explode(F.array_distinct(informative_ngrams(F.col("w"), F.col("marks"), least, most))).alias("phrase"))


def repeated_phrases(messages: DataFrame, min_matches: int = 2, least: int = 2, most: int = 5, max_groups: int | None = 50, max_examples: int = 3) -> DataFrame:
    """(phrase, words, matches, sessions, examples): phrases that several messages share.

    A phrase inside a longer one of the same messages is dropped. Supports are
    compared by an order-free fingerprint (count, sums of both halves and xor of
    id hashes), so no list of ids is gathered; every longer phrase names the
    phrases inside it. The repeated phrases are written once and then read, as
    plans that need fewer of their columns would split all messages again.
    """
    if min_matches < 1 or least < 1 or most < least:
        raise ValueError("min_matches and word counts are positive and ordered")
    rows = phrase_rows(messages, least, most)
    h = F.xxhash64("id")
    support = rows.groupBy("phrase").agg(
        F.count("*").alias("matches"),
        F.countDistinct("session_id").alias("sessions"),
        F.sum(F.shiftright(h, 32)).alias("__high"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("__low"),
        F.bit_xor(h).alias("__xor"),
    )
    kept = support.filter(F.col("matches") >= min_matches).withColumn("words", phrase_words(F.col("phrase")))
    kept, same = cut(kept), ["matches", "__high", "__low", "__xor"]
    longer = kept.filter(F.col("words") > least).withColumn("w", F.split("phrase", " "))
    inside = longer.select(
        F.explode(ngrams(F.col("w"), least, most)).alias("phrase"), "words", *same
    ).filter(phrase_words(F.col("phrase")) < F.col("words")).select("phrase", *same).distinct()
    groups = kept.join(inside, ["phrase", *same], "left_anti")
    out = groups.orderBy(F.desc("matches"), F.desc("words"), "phrase")
    out = (out.limit(max_groups) if max_groups else out).select("phrase", "words", "matches", "sessions")
    if not max_examples:
        return out
    # examples are looked up for the groups that are shown
    out = cut(out)
    place = F.row_number().over(Window.partitionBy("phrase").orderBy("session_id", "seq"))
    shown = rows.join(out.select("phrase"), "phrase").withColumn("place", place).filter(F.col("place") <= max_examples)
    examples = shown.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("session_id", "seq"))).alias("examples"))
    return out.join(examples, "phrase", "left").orderBy(F.desc("matches"), F.desc("words"), "phrase")


def time_profile(messages: DataFrame) -> DataFrame:
    """Per session: messages, dated and undated ones, first and last time, span and longest gap in seconds, tool calls and results."""
    lag = F.lag("ts").over(Window.partitionBy("session_id").orderBy("ts"))
    gapped = messages.withColumn("gap", F.when(F.col("ts").isNotNull(), (F.unix_micros("ts") - F.unix_micros(lag)) / 1e6))
    first, last = F.min("ts"), F.max("ts")
    return gapped.groupBy("session_id").agg(
        F.count("*").alias("messages"),
        F.count("ts").alias("dated"),
        F.count_if(F.col("ts").isNull()).alias("undated"),
        first.alias("first_ts"),
        last.alias("last_ts"),
        ((F.unix_micros(last) - F.unix_micros(first)) / 1e6).alias("span_seconds"),
        F.max("gap").alias("max_gap_seconds"),
        F.count_if(F.col("kind") == "tool_call").alias("tool_calls"),
        F.count_if(F.col("kind") == "tool_result").alias("tool_results"),
    )


def parser_health(sessions: DataFrame, current: dict[str, str]) -> DataFrame:
    """(provider, total, current, stale, warnings): sessions by the parser version that made them."""
    version = F.lit(None).cast("string")
    for provider, v in current.items():
        version = F.when(F.col("provider") == provider, F.lit(v)).otherwise(version)
    fresh = F.coalesce(F.col("parse_version") == version, F.lit(False))
    return sessions.groupBy("provider").agg(
        F.count("*").alias("total"), F.count_if(fresh).alias("current"), F.count_if(~fresh).alias("stale"), F.count_if(F.col("parse_warning").isNotNull()).alias("warnings")
    ).orderBy("provider")


def index_status(discovered: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: files found, indexed, not yet indexed, changed since, and rows whose file is gone."""
    d, i = discovered.alias("d"), indexed.alias("i")
    joined = d.join(i, F.col("d.source_path") == F.col("i.source_path"), "full_outer")
    new, gone = F.col("i.source_path").isNull(), F.col("d.source_path").isNull()
    changed = ~((F.col("d.mtime_ns") == F.col("i.mtime_ns")) & (F.col("d.size_bytes") == F.col("i.size_bytes")))
    return joined.agg(
        F.count("d.source_path").alias("discovered"),
        F.count("i.source_path").alias("indexed"),
        F.count_if(new).alias("unindexed"),
        F.count_if(~new & ~gone & changed).alias("changed"),
        F.count_if(gone).alias("retained_missing"),
    )


def unindexed(discovered: DataFrame, indexed: DataFrame) -> DataFrame:
    return discovered.join(indexed.select("source_path"), "source_path", "left_anti").orderBy("source_path")


def bm25(messages: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of messages with a word of the query, by BM25 over folded tokens."""
    words = sorted({w for w in query.lower().split() if w})
    sized = messages.select("id", tokens(F.col("content")).alias("t")).select("id", "t", F.size("t").alias("n"))
    docs, mean = sized.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    hit = sized.select("id", "n", F.explode("t").alias("term")).filter(F.col("term").isin(*words)).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    joined = hit.join(df, "term")
    idf: Column = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.lit(mean or 1.0)))
    return joined.groupBy("id").agg(F.sum(part).alias("score"))
