"""Registered queries of the engine's own operators, each with SQL that checks it.

``QUERIES`` maps a name to (query, SQL or None). The SQL runs on the same
tables and says the operator's meaning by other means.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, jsonptr, patterns, refs, text
from ..functions.digests import framed_digest
from ..operators import analysis, analytics, classify, evidence, files, fuzzy, normalize, search
from ..operators.filters import FileQuery, MessageFilters, PathScope, SessionFilters, attributable_human
from ..sources import postings, sinks
from ..sources import tables as T
from ..sources.session import shared_folder
from ..streaming import windows
from . import sqlapi

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


# --- views that the SQL shares ----------------------------------------------

MESSAGES = """
WITH m AS (SELECT conv_id * 100000 + turn AS id, 'conv:' || conv_id AS session_id, turn AS seq,
                  CASE WHEN role = 'system' THEN 'user' ELSE role END AS role,
                  CASE WHEN role = 'system' THEN 'harness_notice' ELSE 'conversation' END AS kind,
                  CASE WHEN role = 'system' THEN 'harness' WHEN role = 'user' THEN 'human' ELSE 'agent' END AS authorship,
                  text AS content
           FROM conversations)
"""

EVENT_MESSAGES = """
WITH m AS (SELECT event_id AS id, 'user:' || user_id AS session_id,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
                  ts, event_type AS tool_name, '{"args":' || props || ',"kind":"tool_call"}' AS content
           FROM events)
"""

SESSIONS = """
WITH s AS (SELECT 'user:' || user_id AS id, user_id, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS message_count,
                  '/home/u' || user_id % 7 || '/p' || user_id % 3 AS cwd, '/home/u' || user_id % 7 AS repo_root,
                  'session of user ' || user_id AS title,
                  CASE WHEN user_id % 3 = 0 THEN 'user:' || (user_id + 1) END AS parent_session_id,
                  CASE WHEN count(*) < 60 THEN 'few events' END AS parse_warning
           FROM events GROUP BY user_id)
"""

EDITS = """
WITH e AS (SELECT 'o:' || l_orderkey AS session_id, l_linenumber AS seq, l_shipdate AS ts,
                  '/repo/src/part' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN '.rs' ELSE '.py' END AS file_path,
                  'part' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN '.rs' ELSE '.py' END AS file_name
           FROM lineitem)
"""

FOLD = "translate(lower({}), 'ς', 'σ')"

#: Lines of a text: none of an empty one, a last newline ends the last line, carriage returns before newlines go.
_LINES = "CASE WHEN {0} = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(string_split(regexp_replace({0}, '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '\\r$', '')) END"

#: White space as Unicode has it.
_BLANK = "[\\s\\x0b\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def plain_time(c: str) -> Column:
    """A zoned time as the tables' zone-less one."""
    return F.col(c).cast("timestamp_ntz").alias(c)


def said_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of ``conversations`` but the system's, whole texts, timed by their place; each third turn's first word is a command."""
    c = T.table(spark, sf_dir, "conversations").filter("role <> 'system'")
    author = F.when((F.col("role") == "user") & (F.col("conv_id") % 4 != 0), "human").otherwise("agent")
    return T.shaped(
        c.select(
            (F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.concat(F.lit("conv:"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("seq"), "role",
            F.lit("conversation").alias("kind"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60 + F.col("turn")).alias("ts"),
            F.when(F.col("turn") % 3 == 0, F.concat(F.lit("/"), F.col("text"))).otherwise(F.col("text")).alias("content"), author.alias("authorship"), F.lit("original").alias("record_relation"), F.lit("claude").alias("provider"),
        ),
        T.MESSAGES,
    )


def said_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session a conversation; every third was started by the next one."""
    c = T.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    name = lambda n: F.concat(F.lit("conv:"), n.cast("string"))
    n = F.col("conv_id")
    return T.shaped(
        c.select(
            name(n).alias("id"), F.concat(F.lit("talk "), n.cast("string")).alias("title"), F.concat(F.lit("/home/c"), (n % 7).cast("string")).alias("repo_root"), F.when(n % 3 == 0, name(n + 1)).alias("parent_session_id")
        ),
        T.SESSIONS,
    )


SAID = """
WITH n AS (SELECT conv_id * 100000 + turn AS id, 'conv:' || conv_id AS session_id, turn AS seq, role, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS ts,
                  CASE WHEN turn % 3 = 0 THEN '/' || text ELSE text END AS content,
                  CASE WHEN role = 'user' AND conv_id % 4 <> 0 THEN 'human' ELSE 'agent' END AS authorship
           FROM conversations WHERE role <> 'system'),
s AS (SELECT DISTINCT 'conv:' || conv_id AS id, 'talk ' || conv_id AS title, '/home/c' || conv_id % 7 AS repo_root, CASE WHEN conv_id % 3 = 0 THEN 'conv:' || (conv_id + 1) END AS parent_session_id FROM conversations)
"""


# --- message search ---------------------------------------------------------


@query("search_literal", MESSAGES + f"SELECT session_id, seq, role, content FROM m WHERE kind <> 'harness_notice' AND contains({FOLD.format('content')}, 'tion')")
def search_literal(spark, d):
    r = search.SearchRequest(query="TION")
    return search.matching(T.conversation_messages(spark, d), r).select("session_id", "seq", "role", "content")


@query("search_literal_page", MESSAGES + f"SELECT session_id, seq, content FROM m WHERE kind <> 'harness_notice' AND role = 'user' AND contains({FOLD.format('content')}, 'en') ORDER BY session_id, seq LIMIT 21 OFFSET 10")
def search_literal_page(spark, d):
    r = search.SearchRequest(query="en", filters=MessageFilters(roles=("user",)), limit=20, offset=10)
    return search.page(search.matching(T.conversation_messages(spark, d), r), r).select("session_id", "seq", "content")


@query("search_regex", MESSAGES + "SELECT session_id, seq, regexp_extract(content, '[Tt]he[a-z]+ing') AS matched FROM m WHERE kind <> 'harness_notice' AND regexp_matches(content, '[Tt]he[a-z]+ing')")
def search_regex(spark, d):
    r = search.SearchRequest(query="[Tt]he[a-z]+ing", mode="regex")
    rows = search.matching(T.conversation_messages(spark, d), r)
    return rows.select("session_id", "seq", F.regexp_extract("content", "[Tt]he[a-z]+ing", 0).alias("matched"))


@query("search_regex_prefiltered", MESSAGES + "SELECT session_id, seq FROM m WHERE kind <> 'harness_notice' AND regexp_matches(content, 'tion.ing|ment')")
def search_regex_prefiltered(spark, d):
    r = search.SearchRequest(query="tion.ing|ment", mode="regex")
    return search.matching(T.conversation_messages(spark, d), r).select("session_id", "seq")


@query("search_regex_repetition", MESSAGES + "SELECT session_id, seq FROM m WHERE kind <> 'harness_notice' AND regexp_matches(content, 'en.{0,12}ation|t{2,300}e|\\x74hen[a-z]{1,4}')")
def search_regex_repetition(spark, d):
    r = search.SearchRequest(query=r"en.{0,12}ation|t{2,300}e|\x74hen[a-z]{1,4}", mode="regex")
    return search.matching(T.conversation_messages(spark, d), r).select("session_id", "seq")


#: Folders of indexes by session and tables: an index is made once and then read.
_INDEXES: dict[tuple[str, str], str] = {}


def message_index(spark, d) -> tuple:
    """(numbered messages, posting lists) of ``conversations``, stored in the shared folder by the first query that asks."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        postings.build(T.conversation_messages(spark, d), folder)
        _INDEXES[key] = folder
    return postings.opened(spark, _INDEXES[key])


@query("search_indexed_regex", MESSAGES + "SELECT session_id, seq FROM m WHERE kind <> 'harness_notice' AND regexp_matches(content, 'ation .*ing|ment[a-z]')")
def search_indexed_regex(spark, d):
    return search.indexed(*message_index(spark, d), search.SearchRequest(query="ation .*ing|ment[a-z]", mode="regex")).select("session_id", "seq")


@query("search_indexed_groups", MESSAGES + "SELECT session_id, seq FROM m WHERE kind <> 'harness_notice' AND regexp_matches(content, '(?:ther|thou)(on|ed)[a-z]* (is|in)')")
def search_indexed_groups(spark, d):
    return search.indexed(*message_index(spark, d), search.SearchRequest(query="(?:ther|thou)(on|ed)[a-z]* (is|in)", mode="regex")).select("session_id", "seq")


@query("search_indexed_literal", MESSAGES + f"SELECT session_id, seq FROM m WHERE kind <> 'harness_notice' AND contains({FOLD.format('content')}, 'ation')")
def search_indexed_literal(spark, d):
    return search.indexed(*message_index(spark, d), search.SearchRequest(query="ATION")).select("session_id", "seq")


@query("search_regex_groups", MESSAGES + "SELECT session_id, seq FROM m WHERE kind <> 'harness_notice' AND regexp_matches(content, '(?:(?:th|er|on|in)+ ){2}(a|e)[a-z]*\\.')")
def search_regex_groups(spark, d):
    request = search.SearchRequest(query=r"(?:(?:th|er|on|in)+ ){2}(a|e)[a-z]*\.", mode="regex")
    return search.matching(T.conversation_messages(spark, d), request).select("session_id", "seq")


@query("read_session", EVENT_MESSAGES + "SELECT seq, tool_name FROM m WHERE session_id = 'user:7'")
def read_session(spark, d):
    return search.read_session(T.event_messages(spark, d), "user:7").select("seq", "tool_name")


@query("timeline", EVENT_MESSAGES + "SELECT session_id, seq, ts FROM m WHERE contains(tool_name, 'err') ORDER BY ts, session_id, seq LIMIT 40 OFFSET 5")
def timeline(spark, d):
    r = search.SearchRequest(query="err", field="tool_name", limit=40, offset=5)
    return search.timeline(T.event_messages(spark, d), r).select("session_id", "seq", plain_time("ts"))


@query("inspect_sessions", SESSIONS + """
, k AS (SELECT user_id, count(*) AS messages, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id)
SELECT s.id, s.title, k.messages, k.messages AS tool_calls, 0::BIGINT AS user_rows, k.first_at, k.last_at FROM s JOIN k USING (user_id)""")
def inspect_sessions(spark, d):
    out = search.inspect(T.event_sessions(spark, d), T.event_messages(spark, d))
    return out.select("id", "title", "messages", "tool_calls", "user_rows", plain_time("first_at"), plain_time("last_at"))


@query("inspect_files", EDITS + "SELECT session_id AS id, count(*) AS edits, count(DISTINCT file_path) AS files FROM e GROUP BY session_id")
def inspect_files(spark, d):
    e = T.lineitem_edits(spark, d)
    s = T.shaped(e.select(F.col("session_id").alias("id")).distinct(), T.SESSIONS)
    return search.inspect(s, spark.createDataFrame([], T.MESSAGES), e).select("id", "edits", "files")


def _session_evidence(limit: int, latest: bool) -> str:
    """SQL of ``inspect_evidence``: turns as a person's messages, events as tool calls, pages as results with 1 to 20 addresses, order lines as edits."""
    way = "DESC" if latest else ""
    return f"""
WITH m AS (SELECT 'conv:' || conv_id AS session_id, turn AS seq, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, 'conversation' AS kind, NULL AS tool_name, coalesce(text, '') AS content, 0 AS n FROM conversations
           UNION ALL SELECT 'conv:' || user_id, 1000000 + event_id, 'tool', 'tool_call', event_type, '{{"args":' || props || ',"kind":"tool_call"}}', 0 FROM events
           UNION ALL SELECT 'conv:' || (page_id - page_id % 8), 1000000000 + page_id, 'tool', 'tool_result', 'fetch', array_to_string([url || '/' || i FOR i IN range(1, page_id % 20 + 2)], ' '), page_id % 20 + 1 FROM pages),
p AS (SELECT session_id, 0 AS section, seq, NULL AS name, NULL AS kind, length(content) AS chars, 0 AS n, NULL::BIGINT AS edits FROM m WHERE role = 'user'
      UNION ALL SELECT session_id, 1, seq, tool_name, CASE kind WHEN 'tool_call' THEN 'call' ELSE 'result' END, length(content), 0, NULL FROM m WHERE role = 'tool'
      UNION ALL SELECT session_id, 2, seq, tool_name, role, length(content), n, NULL FROM m WHERE n > 0
      UNION ALL SELECT 'conv:' || l_orderkey, 3, NULL, '/repo/src/part' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN '.rs' ELSE '.py' END AS name, 'claude', NULL, 0, count(*) FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id, section ORDER BY seq {way}, name) AS rank FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank, section) <= {limit} AS shown FROM r),
u AS (SELECT session_id, rank, unnest(range(n)) AS i FROM k WHERE shown AND section = 2),
v AS (SELECT session_id, rank, row_number() OVER (PARTITION BY session_id ORDER BY i, rank) <= {limit} AS held FROM u),
w AS (SELECT session_id, rank, count_if(held) AS refs, count_if(NOT held) AS lost FROM v GROUP BY ALL),
t AS (SELECT session_id, bool_or(section = 0 AND NOT shown) AS a, bool_or(section = 1 AND NOT shown) AS b, bool_or(section = 2 AND NOT shown) AS c, bool_or(section = 3 AND NOT shown) AS e FROM k GROUP BY session_id),
x AS (SELECT session_id, bool_or(lost > 0) AS d FROM w GROUP BY session_id)
SELECT k.session_id, ['user_intent', 'tool_activity', 'reference_messages', 'changed_files'][section + 1] AS section, seq, name, kind, chars, CASE WHEN section = 2 THEN w.refs END AS refs, edits,
       concat_ws(' ', CASE WHEN a THEN 'user_intent' END, CASE WHEN b THEN 'tool_activity' END, CASE WHEN c THEN 'reference_messages' END, CASE WHEN d THEN 'references' END, CASE WHEN e THEN 'changed_files' END) AS truncated
FROM k JOIN t USING (session_id) LEFT JOIN x USING (session_id) LEFT JOIN w ON w.session_id = k.session_id AND w.rank = k.rank AND section = 2 WHERE shown"""


def _active_messages(spark: SparkSession, d: str) -> DataFrame:
    turns = T.conversation_messages(spark, d).withColumn("kind", F.lit("conversation"))
    calls = T.event_messages(spark, d).withColumns({"session_id": F.regexp_replace("session_id", "^user:", "conv:"), "seq": F.col("id") + 1_000_000})
    page = F.col("page_id")
    links = F.array_join(F.transform(F.sequence(F.lit(1), (page % 20 + 1).cast("int")), lambda i: F.concat("url", F.lit("/"), i.cast("string"))), " ")
    read = T.table(spark, d, "pages").select(
        F.concat(F.lit("conv:"), (page - page % 8).cast("string")).alias("session_id"), (page + 1_000_000_000).alias("seq"), F.lit("tool").alias("role"), F.lit("tool_result").alias("kind"), F.lit("fetch").alias("tool_name"), links.alias("content")
    )
    return turns.unionByName(calls).unionByName(T.shaped(read, T.MESSAGES))


def _evidence(spark: SparkSession, d: str, limit: int, window: str) -> DataFrame:
    edits = T.lineitem_edits(spark, d).withColumn("session_id", F.regexp_replace("session_id", "^o:", "conv:"))
    found = evidence.evidence(_active_messages(spark, d), edits, limit, window)
    return found.select("session_id", "section", "seq", "name", "kind", "chars", F.size("refs").cast("bigint").alias("refs"), "edits", F.array_join("truncated", " ").alias("truncated"))


@query("inspect_evidence", _session_evidence(12, False))
def inspect_evidence(spark, d):
    return _evidence(spark, d, 12, "first")


@query("inspect_evidence_latest", _session_evidence(5, True))
def inspect_evidence_latest(spark, d):
    return _evidence(spark, d, 5, "latest")


_FUZZY = "thing"
_FUZZY_SQL = "".join("[^{0}]*[{0}]".format(fuzzy.letter_class(c)) for c in _FUZZY)


@query("search_fuzzy", MESSAGES + f"SELECT session_id, seq FROM m WHERE kind <> 'harness_notice' AND regexp_matches(content, '(?s)^{_FUZZY_SQL}')")
def search_fuzzy(spark, d):
    r = search.SearchRequest(query=_FUZZY, mode="fuzzy", limit=100)
    return search.matching(T.conversation_messages(spark, d), r).select("session_id", "seq")


@query("search_fuzzy_top")
def search_fuzzy_top(spark, d):
    r = search.SearchRequest(query="enti on", mode="fuzzy", limit=50)
    return search.page(search.matching(T.conversation_messages(spark, d), r), r).select("session_id", "seq", "fuzzy_score")


@query("search_tool_name", EVENT_MESSAGES + "SELECT session_id, seq, tool_name FROM m WHERE contains(lower(tool_name), 'ick')")
def search_tool_name(spark, d):
    r = search.SearchRequest(query="ICK", field="tool_name")
    return search.matching(T.event_messages(spark, d), r).select("session_id", "seq", "tool_name")


@query("search_tool_argument", EVENT_MESSAGES + "SELECT session_id, seq, json_extract(content, '$.args.k')::VARCHAR AS field_text FROM m WHERE contains(json_extract(content, '$.args.k')::VARCHAR, '7')")
def search_tool_argument(spark, d):
    r = search.SearchRequest(query="7", field="tool_argument", argument_path="/k", filters=MessageFilters(kinds=("tool_call",)))
    return search.matching(T.event_messages(spark, d), r).select("session_id", "seq", "field_text")


@query("search_evidence", MESSAGES + f"""
, h AS (SELECT *, strpos({FOLD.format('content')}, 'ation') - 1 AS match_start FROM m WHERE kind <> 'harness_notice' AND contains({FOLD.format('content')}, 'ation')),
v AS (SELECT *, match_start + 5 AS match_end, least(greatest(match_start - 7, 0), greatest(length(content) - 20, 0)) AS view_start FROM h)
SELECT session_id, seq, match_start::BIGINT AS match_start, match_end::BIGINT AS match_end, view_start::BIGINT AS view_start, substr(content, view_start + 1, 20) AS match_view,
       (match_start - view_start)::BIGINT AS marker_start, least(match_end - view_start, 20)::BIGINT AS marker_end FROM v""")
def search_evidence(spark, d):
    r = search.SearchRequest(query="ation", match_chars=20)
    rows = search.evidence(search.matching(T.conversation_messages(spark, d), r), r)
    return rows.select("session_id", "seq", "match_start", "match_end", "view_start", "match_view", "marker_start", "marker_end")


@query("search_field_view", MESSAGES + f"""
, l AS (SELECT *, list_slice({_LINES.format('content')}, 1, 2) AS x FROM m WHERE kind <> 'harness_notice' AND content IS NOT NULL), v AS (SELECT *, coalesce(array_to_string(x, chr(10)), '') AS head FROM l)
SELECT session_id, seq, substr(head, 1, 60) AS field_view, length(head) > 60 OR length(head) < length(content) AS field_after FROM v""")
def search_field_view(spark, d):
    r = search.SearchRequest(lines=2, view_chars=60)
    return search.field_view(search.matching(T.conversation_messages(spark, d), r), r).select("session_id", "seq", "field_view", "field_after")


@query("search_context", MESSAGES + f"""
, h AS (SELECT session_id, seq FROM m WHERE kind <> 'harness_notice' AND contains({FOLD.format('content')}, 'heou'))
SELECT DISTINCT m.session_id, m.seq, m.role, EXISTS (SELECT 1 FROM h WHERE h.session_id = m.session_id AND h.seq = m.seq) AS is_match
FROM m JOIN h ON m.session_id = h.session_id AND m.seq BETWEEN h.seq - 1 AND h.seq + 2""")
def search_context(spark, d):
    m = T.conversation_messages(spark, d)
    hits = search.matching(m, search.SearchRequest(query="heou"))
    return search.context_rows(m, hits, 1, 2).select("session_id", "seq", "role", "is_match")


@query("context_of_message", MESSAGES + "SELECT session_id, seq, role FROM m WHERE session_id = 'conv:3' AND seq BETWEEN 0 AND 2")
def context_of_message(spark, d):
    return search.context_of(T.conversation_messages(spark, d), "conv:3", 1, 1, 1).select("session_id", "seq", "role")


@query("search_latest_window", EVENT_MESSAGES + "SELECT session_id, seq FROM m WHERE session_id = (SELECT 'user:' || min(user_id) FROM events) ORDER BY seq DESC LIMIT 4")
def search_latest_window(spark, d):
    first = T.table(spark, d, "events").agg(F.min("user_id")).first()[0]
    r = search.SearchRequest(filters=MessageFilters(session_id=f"user:{first}"), window="latest", limit=3)
    return search.page(search.matching(T.event_messages(spark, d), r), r).select("session_id", "seq")


@query("search_with_metadata", SESSIONS + ", m AS (SELECT event_id, 'user:' || user_id AS session_id FROM events WHERE event_type = 'error') SELECT event_id AS id, session_id, s.title, s.cwd FROM m LEFT JOIN s ON s.id = m.session_id")
def search_with_metadata(spark, d):
    hits = search.matching(T.event_messages(spark, d), search.SearchRequest(query="error", field="tool_name"))
    out = search.with_metadata(hits, T.event_sessions(spark, d))
    return out.select("id", "session_id", F.col("session.title").alias("title"), F.col("session.cwd").alias("cwd"))


@query("corpus_count", MESSAGES + "SELECT count(*) AS corpus FROM m WHERE kind <> 'harness_notice' AND role = 'assistant'")
def corpus_count(spark, d):
    return MessageFilters(roles=("assistant",)).apply(T.conversation_messages(spark, d)).agg(F.count("*").alias("corpus"))


@query("search_session_ranked", """
WITH d AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, split_part(coalesce(text, ''), chr(10), 2) AS summary, '/src/' || coalesce(source, '') AS cwd, lang AS repo_root, coalesce(text, '') AS body FROM documents),
f AS (SELECT doc_id, contains(lower(title), 'on the') AS t, contains(lower(summary), 'on the') AS s, contains(lower(body), 'on the') AS b,
             contains(lower(title), 'on') AS t1, contains(lower(title), 'the') AS t2, contains(lower(summary), 'on') AS s1, contains(lower(summary), 'the') AS s2,
             contains(lower(cwd), 'on') AS c1, contains(lower(body), 'on') AS b1, contains(lower(body), 'the') AS b2 FROM d),
g AS (SELECT doc_id, 600 * t::INT + 450 * s::INT + 100 * b::INT + 40 * (t1::INT + t2::INT + s1::INT + s2::INT + b1::INT + b2::INT) AS base,
             ((t1 OR s1 OR b1) AND (t2 OR s2 OR b2)) AS every FROM f)
SELECT doc_id AS id, (base + CASE WHEN every THEN 150 ELSE 0 END)::BIGINT AS score FROM g WHERE base > 0""")
def search_session_ranked(spark, d):
    return search.rank_sessions(T.document_transcripts(spark, d), "On The", F.lit(datetime(2026, 1, 1, tzinfo=UTC))).select("id", "score")


@query("search_session_top", """
WITH d AS (SELECT doc_id, lower(split_part(coalesce(text, ''), chr(10), 1)) AS title, lower(split_part(coalesce(text, ''), chr(10), 2)) AS summary, lower('/src/' || coalesce(source, '')) AS cwd, lower(coalesce(lang, '')) AS repo, lower(coalesce(text, '')) AS body FROM documents),
f AS (SELECT doc_id, unnest([{'o': 0, 'n': 'title', 'w': 600, 't': title}, {'o': 1, 'n': 'summary', 'w': 450, 't': summary}, {'o': 2, 'n': 'path', 'w': 350, 't': cwd}, {'o': 3, 'n': 'path', 'w': 350, 't': repo}, {'o': 4, 'n': 'transcript', 'w': 100, 't': body}]) AS x FROM d),
g AS (SELECT doc_id, x.o AS o, x.n AS n, contains(x.t, 'the') AS a, contains(x.t, 'thing') AS b, x.w * contains(x.t, 'the thing')::INT + 40 * (contains(x.t, 'the')::INT + contains(x.t, 'thing')::INT) AS s FROM f)
SELECT doc_id AS id, (sum(s) + CASE WHEN bool_or(a) AND bool_or(b) THEN 150 ELSE 0 END)::BIGINT AS score, arg_max(n, s * 10 - o) AS match_source FROM g GROUP BY doc_id HAVING sum(s) > 0 ORDER BY score DESC, id LIMIT 20""")
def search_session_top(spark, d):
    docs = T.document_transcripts(spark, d).withColumn("parent_session_id", F.lit(None).cast("string"))
    return search.search_sessions(docs, "the thing", F.lit(datetime(2026, 1, 1, tzinfo=UTC)), limit=20).select("id", "score", "match_source")


# --- structural filters -----------------------------------------------------


def _session_query(name: str, where: str, filters: SessionFilters):
    @query(name, SESSIONS + f"SELECT id, message_count FROM s WHERE {where}")
    def run(spark, d):
        return filters.apply(T.event_sessions(spark, d)).select("id", "message_count")


_DAY = lambda y, m, dd: datetime(y, m, dd, tzinfo=UTC)
_session_query("filter_user_sessions", "parent_session_id IS NULL", SessionFilters(session_kinds=("user",)))
_session_query("filter_subagents", "parent_session_id IS NOT NULL", SessionFilters(session_kinds=("subagent",)))
_session_query("filter_warnings", "parse_warning IS NOT NULL", SessionFilters(warnings_only=True))
_session_query("filter_parent", "parent_session_id = 'user:4'", SessionFilters(parent="user:4"))
_session_query("filter_workspace", "cwd = '/home/u3' OR starts_with(cwd, '/home/u3/') OR repo_root = '/home/u3'", SessionFilters(paths=PathScope(workspace="/home/u3/")))
_session_query("filter_path_component", "cwd = '/home/u3/p1'", SessionFilters(paths=PathScope(workspace="/home/u3/p1")))
_session_query("filter_exclusions", "id NOT IN ('user:1', 'user:2') AND NOT starts_with(cwd, '/home/u2/')", SessionFilters(exclude_ids=("user:1", "user:2"), paths=PathScope(exclude_workspace=("/home/u2",))))
_session_query("filter_span_overlap", "updated_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-10'", SessionFilters(bounds=dates.resolve("2024-01-05", "2024-01-09")))


@query("filter_no_session_kind", SESSIONS + "SELECT 'none' AS kinds, 0::BIGINT AS sessions UNION ALL SELECT 'user', count(*) FROM s WHERE parent_session_id IS NULL UNION ALL SELECT 'all', count(*) FROM s")
def filter_no_session_kind(spark, d):
    s = T.event_sessions(spark, d)
    made = {"none": (), "user": ("user",), "all": ("user", "subagent")}
    counts = [SessionFilters(session_kinds=k).apply(s).agg(F.lit(name).alias("kinds"), F.count("*").alias("sessions")) for name, k in made.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("repo_roots", SESSIONS + """
, r AS (SELECT '/home/u' || r_regionkey AS path FROM region UNION ALL SELECT '/home/u1/p' || r_regionkey FROM region)
SELECT s.id, coalesce(arg_max(r.path, length(r.path)), '') AS repo_root FROM s LEFT JOIN r ON s.cwd = r.path OR starts_with(s.cwd, r.path || '/') GROUP BY s.id""")
def repo_roots(spark, d):
    r = T.table(spark, d, "region")
    roots = r.select(F.concat(F.lit("/home/u"), F.col("r_regionkey").cast("string"), F.lit("/")).alias("path")).unionByName(r.select(F.concat(F.lit("/home/u1/p"), F.col("r_regionkey").cast("string")).alias("path")))
    s = T.event_sessions(spark, d).withColumn("repo_root", F.lit(None).cast("string"))
    return normalize.with_repo_roots(s, roots).select("id", F.coalesce("repo_root", F.lit("")).alias("repo_root"))


@query("list_sessions", SESSIONS + "SELECT id, title, message_count FROM s ORDER BY updated_at DESC, id LIMIT 50")
def list_sessions(spark, d):
    return search.list_sessions(T.event_sessions(spark, d)).select("id", "title", "message_count")


@query("list_sessions_offset", SESSIONS + "SELECT id FROM s ORDER BY updated_at DESC, id LIMIT 10 OFFSET 30")
def list_sessions_offset(spark, d):
    return search.list_sessions(T.event_sessions(spark, d), limit=10, offset=30).select("id")


@query("session_keyset_page", SESSIONS + "SELECT id FROM s WHERE id > 'user:2' ORDER BY id LIMIT 25")
def session_keyset_page(spark, d):
    return analysis.documents_page(T.event_sessions(spark, d), "user:2", 25).select("id")


@query("filter_event_time", EVENT_MESSAGES + "SELECT id, ts FROM m WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06'")
def filter_event_time(spark, d):
    return MessageFilters(bounds=dates.resolve("2024-01-03", "2024-01-05")).apply(T.event_messages(spark, d)).select("id", plain_time("ts"))


@query("filter_sequence", EVENT_MESSAGES + "SELECT id, seq FROM m WHERE session_id = 'user:5' AND seq BETWEEN 1 AND 3")
def filter_sequence(spark, d):
    return MessageFilters(session_id="user:5", sequence=(1, 3)).apply(T.event_messages(spark, d)).select("id", "seq")


@query("filter_kinds", MESSAGES + "SELECT id, role FROM m WHERE kind = 'harness_notice'")
def filter_kinds(spark, d):
    return MessageFilters(kinds=("harness_notice",)).apply(T.conversation_messages(spark, d)).select("id", "role")


@query("filter_tool_name", EVENT_MESSAGES + "SELECT id, tool_name FROM m WHERE contains(lower(tool_name), 'up')")
def filter_tool_name(spark, d):
    return MessageFilters(tool_name_contains="UP").apply(T.event_messages(spark, d)).select("id", "tool_name")


@query("filter_by_sessions", SESSIONS + "SELECT event_id AS id FROM events WHERE 'user:' || user_id IN (SELECT id FROM s WHERE parent_session_id IS NULL AND starts_with(cwd, '/home/u1/'))")
def filter_by_sessions(spark, d):
    f = MessageFilters(sessions=SessionFilters(session_kinds=("user",), paths=PathScope(workspace="/home/u1")))
    return f.apply(T.event_messages(spark, d), T.event_sessions(spark, d)).select("id")


@query("attributable_human", SAID + "SELECT id, content FROM n WHERE authorship = 'human'")
def attributable(spark, d):
    return attributable_human(said_messages(spark, d)).select("id", "content")


@query("child_sessions", SESSIONS + "SELECT p.id AS parent, c.id AS child FROM s c JOIN s p ON c.parent_session_id = p.id")
def child_sessions(spark, d):
    return analysis.child_sessions(T.event_sessions(spark, d))


# --- aggregation ------------------------------------------------------------


@query("role_counts", MESSAGES + "SELECT role, count(*) AS messages FROM m WHERE kind <> 'harness_notice' GROUP BY role")
def role_counts(spark, d):
    return analytics.role_counts(T.conversation_messages(spark, d))


_COMMANDS = ", c AS (SELECT session_id, regexp_extract(content, '^\\s*(/[\\p{L}\\p{N}_][\\p{L}\\p{N}_:.-]*)(\\s|$)', 1) AS command FROM n)"


@query("command_usage", SAID + _COMMANDS + """
SELECT command, count(*) AS uses, count(DISTINCT c.session_id) AS unique_sessions, count(DISTINCT s.repo_root) AS unique_projects
FROM c LEFT JOIN s ON s.id = c.session_id WHERE command <> '' GROUP BY command ORDER BY uses DESC, command LIMIT 50""")
def command_usage(spark, d):
    return analytics.command_usage(said_messages(spark, d), said_sessions(spark, d))


@query("command_usage_filtered", SAID + _COMMANDS + """
SELECT command, count(*) AS uses, count(DISTINCT session_id) AS unique_sessions, 0::BIGINT AS unique_projects FROM c WHERE regexp_matches(command, '(?i)TH.*ing') GROUP BY command""")
def command_usage_filtered(spark, d):
    return analytics.command_usage(said_messages(spark, d), patterns=("TH.*ing",), limit=None)


_TOKENS = "list_filter(string_split_regex(translate(lower({}), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '')"


@query("vocabulary", MESSAGES + f", t AS (SELECT id, unnest({_TOKENS.format('content')}) AS term FROM m) SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM t GROUP BY term")
def vocabulary(spark, d):
    return analytics.vocabulary(T.conversation_messages(spark, d))


@query("vocabulary_prefix", MESSAGES + f", t AS (SELECT id, unnest({_TOKENS.format('content')}) AS term FROM m) SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM t WHERE starts_with(term, 'th') GROUP BY term ORDER BY occurrences DESC, documents DESC, term LIMIT 50")
def vocabulary_prefix(spark, d):
    return analytics.vocabulary(T.conversation_messages(spark, d), prefix="TH", limit=50)


_TRIGRAMS = "SELECT DISTINCT id, substr(f, i, 3) AS term FROM (SELECT id, translate(lower(content), 'ς', 'σ') AS f FROM m), unnest(generate_series(1, length(f) - 2)) AS u(i)"


@query("vocabulary_trigrams", MESSAGES + f", t AS ({_TRIGRAMS}) SELECT term, count(*) AS documents, count(*) AS occurrences FROM t GROUP BY term")
def vocabulary_trigrams(spark, d):
    return analytics.vocabulary(T.conversation_messages(spark, d), by_trigram=True)


@query("trigram_candidates", MESSAGES + f", t AS ({_TRIGRAMS}) SELECT id FROM t WHERE term IN ('hea', 'eas') GROUP BY id HAVING count(*) = 2 UNION SELECT id FROM t WHERE term IN ('qui') GROUP BY id")
def trigram_candidates(spark, d):
    return analytics.trigram_candidates(analytics.trigram_postings(T.conversation_messages(spark, d)), [["hea", "eas"], ["qui"]])


_STOP = ", ".join(f"'{w}'" for w in text.REPEAT_STOPWORDS)
_NGRAMS = """
, w AS (SELECT id, session_id, seq, {tokens} AS w FROM {source}),
g AS (SELECT DISTINCT id, session_id, seq, list_slice(w, i, i + n - 1) AS p FROM w, unnest(generate_series({least}, {most})) AS a(n), unnest(generate_series(1, len(w) - n + 1)) AS b(i) WHERE len(w) >= n)
"""


_REPEATED = SAID + _NGRAMS.format(tokens=_TOKENS.format("content"), source="n", least=2, most=4) + f"""
, f AS (SELECT id, session_id, seq, array_to_string(p, ' ') AS phrase, len(p) AS words FROM g
        WHERE NOT regexp_matches(array_to_string(p, ' '), '[0-9]') AND p[1] NOT IN ({_STOP}) AND p[-1] NOT IN ({_STOP})
          AND len(list_filter(p, lambda x: strlen(x) >= 4 AND x NOT IN ({_STOP}))) > 0),
s2 AS (SELECT phrase, words, count(*) AS matches, count(DISTINCT session_id) AS sessions, list(id ORDER BY id) AS ids FROM f GROUP BY phrase, words HAVING count(*) >= 2),
top AS (SELECT phrase, words::BIGINT AS words, matches, sessions FROM s2
        WHERE NOT EXISTS (SELECT 1 FROM s2 l WHERE l.words > s2.words AND l.ids = s2.ids AND contains(' ' || l.phrase || ' ', ' ' || s2.phrase || ' '))
        ORDER BY matches DESC, words DESC, phrase LIMIT 50)
"""


@query("repeated_phrases", _REPEATED + "SELECT * FROM top")
def repeated_phrases(spark, d):
    return analytics.repeated_phrases(said_messages(spark, d), least=2, most=4, max_examples=0).select("phrase", "words", "matches", "sessions")


@query("repeated_phrase_examples", _REPEATED + """
, e AS (SELECT phrase, session_id, seq, row_number() OVER (PARTITION BY phrase ORDER BY session_id, seq) AS place FROM f SEMI JOIN top USING (phrase))
SELECT phrase, matches, (SELECT string_agg(session_id || '/' || seq, ' ' ORDER BY session_id, seq) FROM e WHERE e.phrase = top.phrase AND place <= 3) AS places FROM top""")
def repeated_phrase_examples(spark, d):
    found = analytics.repeated_phrases(said_messages(spark, d), least=2, most=4)
    return found.select("phrase", "matches", F.array_join(F.transform("examples", lambda e: F.concat_ws("/", e["session_id"], e["seq"].cast("string"))), " ").alias("places"))


@query("time_profile", EVENT_MESSAGES + """
, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts))) / 1e6 AS gap FROM m)
SELECT session_id, count(*) AS messages, count(ts) AS dated, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span_seconds, max(gap) AS max_gap_seconds, count(*) AS tool_calls FROM g GROUP BY session_id""")
def time_profile(spark, d):
    return analytics.time_profile(T.event_messages(spark, d)).select("session_id", "messages", "dated", "span_seconds", "max_gap_seconds", "tool_calls")


@query("parser_health", SESSIONS + "SELECT 'codex' AS provider, count(*) AS total, 0::BIGINT AS current, count(*) AS stale, count(parse_warning) AS warnings FROM s")
def parser_health(spark, d):
    return analytics.parser_health(T.event_sessions(spark, d), {"codex": "2"})


_FILES = """
WITH dd AS (SELECT coalesce(source, '') || '/' || doc_id AS p, n_chars AS n FROM documents),
ii AS (SELECT coalesce(source, '') || '/' || d.doc_id AS p, d.n_chars + coalesce(l.toxic, 0) AS n FROM labels l JOIN documents d USING (doc_id) UNION ALL SELECT 'page/' || page_id, strlen(html) FROM pages)
"""


def discovered_and_indexed(spark, d):
    """Files found: the documents; files indexed: those with a label, of another size where it is toxic, and the pages, which have vanished."""
    docs, size = T.table(spark, d, "documents"), F.col("n_chars").cast("bigint")
    p = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("source_path")
    found = docs.select(p, F.lit(1).alias("mtime_ns"), size.alias("size_bytes"))
    labelled = docs.join(T.table(spark, d, "labels"), "doc_id").select(p, F.lit(1).alias("mtime_ns"), (size + F.coalesce("toxic", F.lit(0))).alias("size_bytes"))
    gone = T.table(spark, d, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("source_path"), F.lit(1).alias("mtime_ns"), F.octet_length("html").cast("bigint").alias("size_bytes"))
    return found, labelled.unionByName(gone)


@query("index_status", _FILES + """
SELECT count(dd.p) AS discovered, count(ii.p) AS indexed, count(*) FILTER (ii.p IS NULL) AS unindexed, count(*) FILTER (ii.p IS NOT NULL AND dd.p IS NOT NULL AND ii.n <> dd.n) AS changed,
       count(*) FILTER (dd.p IS NULL) AS retained_missing FROM dd FULL JOIN ii ON dd.p = ii.p""")
def index_status(spark, d):
    return analytics.index_status(*discovered_and_indexed(spark, d))


@query("unindexed_files", _FILES + "SELECT p AS source_path FROM dd WHERE p NOT IN (SELECT p FROM ii)")
def unindexed_files(spark, d):
    found, have = discovered_and_indexed(spark, d)
    return analytics.unindexed(found.select("source_path"), have.select("source_path"))


@query("bm25", MESSAGES + f"""
, t AS (SELECT id, {_TOKENS.format('content')} AS w FROM m), st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
x AS (SELECT id, len(w) AS n, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM t) WHERE term IN ('the', 'tion') GROUP BY id, w, term),
df AS (SELECT term, count(*) AS df FROM x GROUP BY term)
SELECT id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM x JOIN df USING (term), st GROUP BY id""")
def bm25(spark, d):
    return analytics.bm25(T.conversation_messages(spark, d), "the tion").withColumn("score", F.round("score", 6))


@query("merged_candidates", MESSAGES + f"""
, t AS ({_TRIGRAMS}), g AS (SELECT id, 2 AS score FROM t WHERE term IN ('tio', 'ion') GROUP BY id HAVING count(*) = 2),
w AS (SELECT DISTINCT id, 5 AS score FROM (SELECT id, unnest({_TOKENS.format('content')}) AS term FROM m) WHERE term = 'the')
SELECT id, max(score) AS score FROM (SELECT * FROM g UNION ALL SELECT * FROM w) GROUP BY id""")
def merged_candidates(spark, d):
    m = T.conversation_messages(spark, d)
    grams = analytics.trigram_candidates(analytics.trigram_postings(m), [["tio", "ion"]]).withColumn("score", F.lit(2))
    words = m.filter(F.array_contains(text.tokens(F.col("content")), "the")).select("id", F.lit(5).alias("score"))
    return analytics.merged_candidates(words, grams)


# --- classification and analysis --------------------------------------------


#: A policy whose patterns the tables' texts have.
_WORDS = (("ending", ("[a-z]ing the ", "the [a-z]+ing ")), ("pair", (" and the ", " in is ")), ("question", (r"\? ", "^/th")))
_POLICY = classify.Policy("words", _WORDS)
_CASES = [(name, "(?i)" + "|".join(f"(?:{p})" for p in found)) for name, found in _WORDS]
_HITS = f"""
, h AS (SELECT session_id, seq, ts, parent_session_id, CASE {' '.join(f"WHEN regexp_matches(content, '{p}') THEN '{name}'" for name, p in _CASES)} END AS category,
               CASE category {' '.join(f"WHEN '{name}' THEN regexp_extract(content, '{p}')" for name, p in _CASES)} END AS matched
        FROM n JOIN s ON s.id = n.session_id WHERE authorship = 'human')
"""


@query("classify_corrections", SAID + _HITS + "SELECT session_id, seq, category, matched FROM h WHERE category IS NOT NULL AND parent_session_id IS NULL ORDER BY ts DESC, session_id, seq LIMIT 50")
def classify_corrections(spark, d):
    return classify.classify(said_messages(spark, d), said_sessions(spark, d), (_POLICY, classify.DEFAULT_POLICY)).select("session_id", "seq", "category", "matched")


@query("classification_counts", SAID + _HITS + "SELECT 'words' AS policy, category, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM h WHERE category IS NOT NULL GROUP BY category")
def classification_counts(spark, d):
    return classify.category_counts(classify.classify(said_messages(spark, d), policies=(_POLICY, classify.DEFAULT_POLICY), limit=None))


_RULES = [analysis.Rule("technique", "endings", "ing the ", "user_text", 7), analysis.Rule("role", "planner", "(?i)/th[a-z]+", "any", 11), analysis.Rule("place", "home", "^talk 1", "title", 3)]
_USER_TEXT = ", u AS (SELECT session_id, string_agg(content, ' ' ORDER BY seq) AS t FROM n WHERE authorship = 'human' GROUP BY session_id)"


@query("analysis_scores", SAID + _USER_TEXT + """
SELECT s.id AS session_id, (CASE WHEN contains(t, 'ing the ') THEN 7 ELSE 0 END + CASE WHEN regexp_matches(t, '(?i)/th[a-z]+') THEN 11 ELSE 0 END + CASE WHEN starts_with(title, 'talk 1') THEN 3 ELSE 0 END)::BIGINT AS score
FROM s LEFT JOIN u ON u.session_id = s.id""")
def analysis_scores(spark, d):
    return analysis.run(said_sessions(spark, d), said_messages(spark, d), _RULES).sessions.select("session_id", "score")


@query("analysis_vocabulary", SAID + _USER_TEXT + f"""
, w AS (SELECT session_id, {_TOKENS.format('t')} AS w FROM u),
g AS (SELECT session_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase, n AS words FROM w, unnest(generate_series(2, 3)) AS a(n), unnest(generate_series(1, len(w) - n + 1)) AS b(i)
      WHERE NOT regexp_matches(array_to_string(list_slice(w, i, i + n - 1), ' '), '\\p{{N}}') AND w[i] <> 'the')
SELECT phrase, words::BIGINT AS words, count(DISTINCT session_id) AS documents, count(*) AS occurrences FROM g GROUP BY phrase, words""")
def analysis_vocabulary(spark, d):
    spec = analysis.PhraseSpec(2, 3, excluded=("the",), max_unique=10**9)
    return analysis.run(said_sessions(spark, d), said_messages(spark, d), phrases=spec).vocabulary


def branched_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose titles name others: every fifth is a branch, every seventh shares a title."""
    s = T.event_sessions(spark, d)
    n = F.col("provider_session_id").cast("bigint")
    title = F.when(n % 5 == 0, F.concat(F.lit("Branch of task "), (n / 2).cast("bigint").cast("string"))).when(n % 7 == 0, F.lit("task 10")).otherwise(F.concat(F.lit("task "), n.cast("string")))
    return s.withColumn("title", title)


_BRANCHED = SESSIONS + """
, b AS (SELECT id, user_id, cwd, repo_root, CASE WHEN user_id % 5 = 0 THEN 'Branch of task ' || user_id // 2 WHEN user_id % 7 = 0 THEN 'task 10' ELSE 'task ' || user_id END AS title FROM s),
h AS (SELECT id AS session_id, regexp_extract(title, '^Branch of (.+)$', 1) AS parent_title FROM b WHERE starts_with(title, 'Branch of ')),
r AS (SELECT h.session_id, parent_title, count(DISTINCT b.id) AS n, min(b.id) AS parent FROM h LEFT JOIN b ON b.title = parent_title AND b.id <> h.session_id GROUP BY ALL)
"""
_BRANCH = [analysis.Relationship("branch", "branch", r"^Branch of (?P<parent>.+)$")]


@query("relationship_hints", _BRANCHED + "SELECT session_id, parent_title, CASE WHEN n = 0 THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM r")
def relationship_hints(spark, d):
    return analysis.relationship_hints(branched_sessions(spark, d), _BRANCH).select("session_id", "parent_title", "resolution")


@query("graph_edges", _BRANCHED + "SELECT parent AS source, session_id AS target, 'branch' AS kind, 'branch' AS rule_id FROM r WHERE n = 1")
def graph_edges(spark, d):
    return analysis.graph_edges(analysis.relationship_hints(branched_sessions(spark, d), _BRANCH))


@query("session_graph", _BRANCHED + """
SELECT 'node' AS part, id AS a, coalesce(title, '') AS b FROM b UNION ALL SELECT 'branch', parent, session_id FROM r WHERE n = 1
UNION ALL SELECT 'spawn', p.id, c.id FROM s c JOIN s p ON c.parent_session_id = p.id UNION ALL SELECT dimension, key, CAST(n AS VARCHAR) FROM
(SELECT 'working_directory' AS dimension, cwd AS key, count(*) AS n FROM s GROUP BY cwd HAVING count(*) > 1 UNION ALL SELECT 'repository', repo_root, count(*) FROM s GROUP BY repo_root HAVING count(*) > 1)""")
def session_graph(spark, d):
    g = analysis.session_graph(branched_sessions(spark, d), _BRANCH)
    nodes = g.nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.coalesce("title", F.lit("")).alias("b"))
    edges = g.edges.select(F.col("kind").alias("part"), F.col("source").alias("a"), F.col("target").alias("b"))
    return nodes.unionByName(edges).unionByName(g.groups.select(F.col("dimension").alias("part"), F.col("key").alias("a"), F.col("sessions").cast("string").alias("b")))


@query("graph_groups", SESSIONS + "SELECT 'working_directory' AS dimension, cwd AS key, count(*) AS sessions FROM s GROUP BY cwd HAVING count(*) > 1 UNION ALL SELECT 'repository', repo_root, count(*) FROM s GROUP BY repo_root HAVING count(*) > 1")
def graph_groups(spark, d):
    return analysis.graph_groups(T.event_sessions(spark, d))


@query("graph_memberships", SESSIONS + ", g AS (SELECT 'working_directory' AS dimension, cwd AS key, id FROM s UNION ALL SELECT 'repository', repo_root, id FROM s) SELECT dimension, key, id FROM g QUALIFY count(*) OVER (PARTITION BY dimension, key) > 1")
def graph_memberships(spark, d):
    return analysis.graph_memberships(T.event_sessions(spark, d))


# --- files ------------------------------------------------------------------


@query("file_summary", EDITS + "SELECT file_path, file_name, count(*) AS edits, count(DISTINCT session_id) AS sessions, max(ts) AS last_edited FROM e GROUP BY file_path, file_name ORDER BY edits DESC, file_path LIMIT 50")
def file_summary(spark, d):
    return files.file_summary(T.lineitem_edits(spark, d)).select("file_path", "file_name", "edits", "sessions", plain_time("last_edited"))


@query("file_summary_glob", EDITS + "SELECT file_path, count(*) AS edits FROM e WHERE regexp_matches(file_name, '^part1.*\\.rs$') GROUP BY file_path HAVING count(*) BETWEEN 2 AND 40")
def file_summary_glob(spark, d):
    return files.file_summary(T.lineitem_edits(spark, d), FileQuery(glob="part1*.rs", min_edits=2, max_edits=40), limit=None).select("file_path", "edits")


@query("file_cross_ref", EDITS + "SELECT file_path, session_id, 'claude' AS provider, count(*) AS edits FROM e WHERE regexp_matches(file_path, '^/repo/src/part12.*$') GROUP BY file_path, session_id")
def file_cross_ref(spark, d):
    return files.file_cross_ref(T.lineitem_edits(spark, d), FileQuery(glob="/repo/src/part12*"))


@query("file_versions", EDITS + "SELECT session_id, file_path, seq, row_number() OVER (PARTITION BY session_id, file_path ORDER BY seq)::BIGINT AS version FROM e")
def file_versions(spark, d):
    return files.versions(T.lineitem_edits(spark, d)).select("session_id", "file_path", F.col("seq").cast("int").alias("seq"), F.col("version").cast("bigint").alias("version"))


@query("file_contents", EDITS + """, o AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq, file_path) AS n FROM e)
SELECT session_id, 'f' AS file_path, n AS version, 'start' || string_agg(' v' || n, '') OVER (PARTITION BY session_id ORDER BY n) AS content FROM o""")
def file_contents(spark, d):
    """Every order as a file: a snapshot, then edits that each append a word."""
    e = T.lineitem_edits(spark, d)
    numbered = e.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("seq", "file_path")).cast("bigint"))
    n = F.col("seq")
    word = F.concat(F.lit(" v"), n.cast("string"))
    old = F.concat(F.lit("v"), (n - 1).cast("string"))
    edit = F.array(F.struct(old.alias("old"), F.concat(old, word).alias("new"), F.lit(False).alias("replace_all")))
    own = numbered.withColumns({"file_path": F.lit("f"), "new_content": F.when(n == 1, F.concat(F.lit("start"), word)), "edits": F.when(n > 1, edit)})
    return files.all_versions(own).select("session_id", "file_path", F.col("version").cast("bigint").alias("version"), "content")


# --- text, references, digests ----------------------------------------------


@query("text_functions", f"""
WITH c AS (SELECT doc_id, text, trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')) AS c, {_LINES.format('text')} AS l FROM documents)
SELECT doc_id, c AS compact, CASE WHEN length(c) <= 40 THEN c ELSE substr(c, 1, 37) || '...' END AS short, CASE WHEN text IS NOT NULL THEN len(l) END::BIGINT AS lines,
       CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(list_slice(l, 1, 2), chr(10)), '') END AS head FROM c""")
def text_functions(spark, d):
    t = F.col("text")
    return T.table(spark, d, "documents").select("doc_id", text.compact_whitespace(t).alias("compact"), text.truncate_for_display(t, 40).alias("short"), text.count_lines(t).alias("lines"), text.select_lines(t, 2).alias("head"))


@query("text_snippets", f"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')) AS c FROM documents), p AS (SELECT *, strpos({FOLD.format('c')}, 'the') AS pos FROM c)
SELECT doc_id, CASE WHEN coalesce(c, '') = '' THEN '(no snippet available)'
       WHEN pos > 0 THEN (CASE WHEN pos > 11 THEN '...' ELSE '' END) || substr(c, greatest(pos - 10, 1), least(pos + 12, length(c)) - greatest(pos - 10, 1) + 1) || (CASE WHEN pos + 12 < length(c) THEN '...' ELSE '' END)
       WHEN length(c) <= 20 THEN c ELSE substr(c, 1, 17) || '...' END AS snippet FROM p""")
def text_snippets(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), "The", 20).alias("snippet"))


@query("text_highlight", "SELECT doc_id, regexp_replace(text, '(?i)(the thing|thing)', '[[\\1]]', 'g') AS marked FROM documents")
def text_highlight(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.highlight(F.col("text"), "the thing").alias("marked"))


@query("text_csv", """
WITH g AS (SELECT doc_id, CASE WHEN regexp_matches(text, '^[-=+@\\t\\r]') THEN chr(39) || text ELSE text END AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '[",\\n\\r]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell FROM g""")
def text_csv(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.csv_escape(F.col("text")).alias("cell"))


@query("text_prose", f"""
WITH l AS (SELECT doc_id, x, i, ltrim(x) AS bare FROM (SELECT doc_id, unnest({_LINES.format("coalesce(text, '')")}) AS x, generate_subscripts({_LINES.format("coalesce(text, '')")}, 1) AS i FROM documents)),
f AS (SELECT *, starts_with(bare, '```') AS fence, coalesce(sum(starts_with(bare, '```')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
k AS (SELECT doc_id, i, x FROM f WHERE NOT fence AND NOT inside AND NOT starts_with(x, '    ') AND NOT starts_with(x, chr(9))
      AND lower(regexp_extract(bare, '^[\\pL\\pN_]*', 0)) NOT IN ({", ".join(repr(w) for w in text.CODE_WORDS)})
      AND NOT regexp_matches(bare, '^(\\{{|\\[|</|#)') AND NOT regexp_matches(bare, '^[\\pL_][\\pL\\pN_]*\\s*=') AND NOT regexp_matches(bare, '^[\\pL\\pN_]+\\s*\\('))
SELECT d.doc_id, coalesce(p.prose, '') AS prose FROM documents d LEFT JOIN (SELECT doc_id, string_agg(x || chr(10), '' ORDER BY i) AS prose FROM k GROUP BY doc_id) p USING (doc_id)""")
def text_prose(spark, d):
    return T.table(spark, d, "documents").select("doc_id", text.prose_only(F.coalesce("text", F.lit(""))).alias("prose"))


@query("json_pointer", "SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k FROM events")
def json_pointer(spark, d):
    return T.table(spark, d, "events").select("event_id", jsonptr.value_at(F.concat(F.lit('{"args":'), "props", F.lit("}")), "/k").alias("k"))


@query("page_refs", "SELECT page_id, url AS value, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages")
def page_refs(spark, d):
    found = T.table(spark, d, "pages").select("page_id", F.explode(refs.extract(F.concat(F.lit("see "), "url", F.lit(" ")))).alias("r"))
    return found.select("page_id", F.col("r.value").alias("value"), F.col("r.host").alias("host"))


@query("ref_summary", """
WITH r AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN url ELSE url || ' and ' || url || '/more' END AS t, page_id % 3 AS n FROM pages)
SELECT page_id, CASE n WHEN 0 THEN '' WHEN 1 THEN 'url' ELSE '2 urls' END AS summary FROM r""")
def ref_summary(spark, d):
    n = F.col("page_id") % 3
    t = F.when(n == 0, F.lit("no address, but main.rs:12 and src/lib.py")).when(n == 1, F.concat(F.lit("see "), "url", F.lit(" "))).otherwise(F.concat(F.lit("see "), "url", F.lit(" and "), "url", F.lit("/more.")))
    return T.table(spark, d, "pages").select("page_id", refs.summary(refs.extract(t)).alias("summary"))


@query("page_html_refs")
def page_html_refs(spark, d):
    """Addresses in whole pages; held against a plain version in the tests."""
    found = T.table(spark, d, "pages").select("page_id", F.explode(refs.extract(F.coalesce("html", F.lit("")))).alias("r"))
    return found.select("page_id", F.col("r.value").alias("value"), F.col("r.normalized_value").alias("normalized_value"))


@query("framed_digest", "SELECT event_id, sha256(strlen(event_type) || ':' || event_type || CASE WHEN props IS NULL THEN '-' ELSE strlen(props) || ':' || props END) AS digest FROM events")
def framed(spark, d):
    return T.table(spark, d, "events").select("event_id", framed_digest(F.col("event_type"), F.col("props")).alias("digest"))


@query("result_digest", MESSAGES + """
, r AS (SELECT session_id, seq, sha256(strlen(session_id) || ':' || session_id || strlen(seq::VARCHAR) || ':' || seq || strlen(role) || ':' || role || strlen(kind) || ':' || kind || CASE WHEN content IS NULL THEN '-' ELSE strlen(content) || ':' || content END) AS d FROM m),
k AS (SELECT d, row_number() OVER (ORDER BY session_id, seq, d) - 1 AS rank FROM r),
c AS (SELECT rank // 10000 AS node, sha256(string_agg(d, '' ORDER BY rank)) AS d FROM k GROUP BY node)
SELECT sha256(coalesce(string_agg(d, '' ORDER BY node), '')) AS digest, (SELECT count(*) FROM m) AS n FROM c""")
def result_digest(spark, d):
    return search.result_digest(T.conversation_messages(spark, d))


@query("transcripts", MESSAGES + "SELECT session_id, string_agg(role || chr(10) || content, chr(10) || chr(10) ORDER BY seq) AS transcript_text FROM m GROUP BY session_id")
def transcripts(spark, d):
    return sinks.transcripts(T.conversation_messages(spark, d))


@query("export_markdown", MESSAGES + "SELECT session_id, '# ' || session_id || chr(10) || chr(10) || string_agg('### ' || role || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```', chr(10) || chr(10) ORDER BY seq) AS body FROM m GROUP BY session_id")
def export_markdown(spark, d):
    return sinks.export_sessions(spark.createDataFrame([], T.SESSIONS), T.conversation_messages(spark, d), "markdown").select("session_id", "body")


@query("render_csv", MESSAGES + "SELECT session_id || ',' || seq || ',' || role AS value FROM m")
def render_csv(spark, d):
    return sinks.rendered(T.conversation_messages(spark, d).select("session_id", "seq", "role"), "csv")


@query("upsert_sessions", """SELECT c_custkey AS user_id, 'new' AS state FROM customer UNION ALL
SELECT DISTINCT user_id, 'old' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) AND user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def upsert(spark, d):
    """Users as stored sessions, customers as fresh ones, suppliers as those that are gone."""
    users = T.table(spark, d, "events").select("user_id").distinct().withColumn("state", F.lit("old"))
    fresh = T.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("new").alias("state"))
    return sinks.upsert_sessions(users, fresh, "user_id", T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id")))


# --- event time -------------------------------------------------------------


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    out = windows.tumbling(T.table(spark, d, "events"), "1 day")
    return out.select(plain_time("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


@query("window_sliding", "SELECT w AS window_start, event_type, count(*) AS events FROM events, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS u(w) GROUP BY ALL")
def window_sliding(spark, d):
    return windows.sliding(T.table(spark, d, "events"), "1 day", "12 hours").select(plain_time("window_start"), "event_type", "events")


@query("window_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 DAY THEN 0 ELSE 1 END AS fresh FROM events),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 DAY AS session_end, count(*) AS events FROM k GROUP BY user_id, run""")
def window_sessions(spark, d):
    return windows.sessions(T.table(spark, d, "events"), "2 days").select("user_id", plain_time("session_start"), plain_time("session_end"), "events")


# --- relational surface -----------------------------------------------------


def relational(name: str, sql: str, spark_sql: str | None = None):
    """One statement that both engines run over views of the tables; here it goes through the guard."""

    @query(name, sql)
    def run(spark, d):
        used = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if t in (spark_sql or sql)]
        sqlapi.register(spark, {t: T.table(spark, d, t) for t in used})
        return sqlapi.checked(spark, spark_sql or sql)


relational("sql_pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
relational("sql_shipping_priority", """SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
relational("sql_local_supplier", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
relational("sql_forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.06 AND l_quantity < 24")
relational("sql_exists", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
relational("sql_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
relational("sql_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
relational("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
relational("sql_grouping_sets", "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY GROUPING SETS ((n_regionkey), (n_name), ())")
relational("sql_ranking", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders) WHERE place <= 3")
relational("sql_window_frames", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events")
relational("sql_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
relational("sql_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
relational("sql_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier")
relational("sql_full_join", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
relational("sql_scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
relational("sql_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
relational("sql_filter_aggregate", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus HAVING count(*) > 3")
relational("sql_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 500000) SELECT c_name, round(t, 2) AS t FROM top JOIN customer ON c_custkey = o_custkey")
relational("sql_string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
relational("sql_theta_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
relational("sql_right_join", "SELECT s_suppkey, c_custkey FROM supplier RIGHT JOIN customer ON s_suppkey = c_custkey")
relational("sql_natural_join", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
relational("sql_using_join", "SELECT k, n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
relational("sql_range_frame", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 50000 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM orders")
relational("sql_window_values", """SELECT event_id, CAST(ntile(4) OVER w AS BIGINT) AS quarter, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
       nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, lead(event_id, 2) OVER w AS later, CAST(dense_rank() OVER w AS BIGINT) AS place
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
relational("sql_nulls_order", "SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey ORDER BY s_suppkey DESC NULLS LAST, c_custkey LIMIT 30 OFFSET 90")
relational("sql_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events")
relational("sql_json_unnest", "SELECT n_regionkey, json_array_length(to_json(list(n_name)))::BIGINT AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(json_array_length(to_json(collect_list(n_name))) AS BIGINT) AS n FROM nation GROUP BY n_regionkey")
relational("sql_strings", "SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 3) AS s, replace(p_name, 'a', '_') AS r, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded, length(p_name) AS n, instr(p_name, 'e') AS at FROM part WHERE p_name LIKE '%a%' AND p_name NOT LIKE 'z_'", "SELECT p_partkey, upper(p_name) AS u, substr(p_name, 2, 3) AS s, replace(p_name, 'a', '_') AS r, lpad(CAST(p_partkey AS STRING), 8, '0') AS padded, CAST(length(p_name) AS BIGINT) AS n, CAST(instr(p_name, 'e') AS BIGINT) AS at FROM part WHERE p_name LIKE '%a%' AND p_name NOT LIKE 'z_'")
relational("sql_scalars", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS st, abs(o_custkey - 700) AS a, greatest(o_custkey, 100) AS g, least(o_custkey, 100) AS l, CASE WHEN o_totalprice > 1e5 THEN 'high' ELSE 'low' END AS c FROM orders")
relational("sql_dates", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, date_trunc('month', o_orderdate) = o_orderdate AS first_day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
relational("sql_try_cast", "SELECT event_id, TRY_CAST(event_type AS BIGINT) AS none, TRY_CAST(CAST(user_id AS VARCHAR) AS BIGINT) AS u FROM events", "SELECT event_id, TRY_CAST(event_type AS BIGINT) AS none, TRY_CAST(CAST(user_id AS STRING) AS BIGINT) AS u FROM events")


def guarded(name: str, sql: str, spark_sql: str):
    """A statement that goes through the guard, over registered views of messages."""

    @query(name, sql)
    def run(spark, d):
        sqlapi.register(spark, {"conversation_messages": T.conversation_messages(spark, d), "event_calls": T.event_messages(spark, d)})
        return sqlapi.checked(spark, spark_sql)


guarded("sql_contains_caseless", MESSAGES + f"SELECT id FROM m WHERE contains({FOLD.format('content')}, 'tion')", "SELECT id FROM conversation_messages WHERE contains_caseless(content, 'TION')")
guarded("sql_text_regexp", MESSAGES + "SELECT id FROM m WHERE regexp_matches(content, '^[A-Z][a-z]+ th')", "SELECT id FROM conversation_messages WHERE text_regexp('^[A-Z][a-z]+ th', content)")
guarded("sql_json_pointer", EVENT_MESSAGES + "SELECT id, json_extract(content, '$.args.k')::VARCHAR AS k FROM m", "SELECT id, json_pointer('/k', content) AS k FROM event_calls")
guarded("sql_fuzzy_score", MESSAGES + f"SELECT id FROM m WHERE regexp_matches(content, '(?s)^{_FUZZY_SQL}')", "SELECT id FROM conversation_messages WHERE fuzzy_score('thing', content) IS NOT NULL")
