"""Digests on any partitioning, the SQL guard and functions, prefilters, evidence, sessions, references."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from test_goldens import edits, messages

from threadloom.functions import dates, digests, patterns, refs, text
from threadloom.operators import analysis, analytics, files, fuzzy, normalize, search
from threadloom.operators.filters import FileQuery, FilterError
from threadloom.plans import sqlapi
from threadloom.plans.queries import QUERIES
from threadloom.sources import logs, sinks
from threadloom.sources import tables as T
from threadloom.streaming import windows


def test_digest_is_of_the_rows_alone(spark):
    rows = spark.range(300).select((F.col("id") % 40).alias("k"), F.sha2((F.col("id") % 90).cast("string"), 256).alias("v"))
    found = set()
    for parts, adaptive in ((1, "true"), (2, "true"), (8, "false"), (31, "true")):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            found.add(tuple(digests.rows_digest(rows.repartition(parts), ["k"], ["k", "v"], chunk=7).first()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(found) == 1 and next(iter(found))[1] == 300
    other = digests.rows_digest(rows.filter("k <> 3"), ["k"], ["k", "v"], chunk=7).first()
    assert other["digest"] != next(iter(found))[0]
    assert digests.rows_digest(rows.limit(0), ["k"], ["k", "v"]).first()["n"] == 0


@pytest.fixture(scope="module")
def guarded(spark):
    call = '{"args":{"cmd":"echo hi","n":null,"list":[1,{"a":"b"}]},"kind":"tool_call"}'
    sqlapi.register(spark, {"own_view": messages(spark, [{"content": call}, {"content": "Hello b"}, {"content": None}])})
    spark.range(1).createOrReplaceTempView("strange_view")


REFUSED = [
    "SELECT * FROM `text`.`/etc/hosts`", "SELECT * FROM text.`/etc/hosts`", "SELECT * FROM own_view WHERE seq = (SELECT max(value) FROM text.`/etc/hosts`)", "SELECT * FROM strange_view",
    "SELECT 1 WHERE EXISTS (SELECT 1 FROM strange_view)", "WITH a AS (SELECT * FROM strange_view) SELECT * FROM a", "SELECT java_method('java.lang.System', 'lineSeparator')",
    "SELECT reflect('java.lang.System', 'lineSeparator')", "SELECT transform(array(1), x -> try_reflect('java.lang.System', 'lineSeparator'))", "SELECT TRANSFORM(seq) USING 'cat' FROM own_view",
    "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')", "SELECT IDENTIFIER('reflect')('java.lang.System', 'lineSeparator') FROM own_view",
    "WITH strange_view AS (SELECT * FROM strange_view) SELECT * FROM strange_view", "SELECT seq FROM own_view UNION ALL SELECT * FROM (WITH strange_view AS (SELECT 1 AS seq) SELECT * FROM strange_view) UNION ALL SELECT id FROM strange_view",
    "SELECT id FROM strange_view UNION ALL SELECT * FROM (WITH strange_view AS (SELECT 1 AS id) SELECT * FROM strange_view)", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
    "WITH a AS (WITH strange_view AS (SELECT 1 AS id) SELECT * FROM strange_view) SELECT * FROM a, strange_view", "SELECT (SELECT max(id) FROM strange_view) FROM own_view", "SELECT * FROM own_view, LATERAL (SELECT id FROM strange_view)",
    "SELECT * FROM own_view WHERE seq IN (WITH x AS (SELECT id FROM strange_view) SELECT id FROM x)", "SELECT seq, max(seq) OVER (PARTITION BY (SELECT max(id) FROM strange_view)) FROM own_view", "SELECT * FROM IDENTIFIER('strange' || '_view')",
    "SELECT IDENTIFIER('seq') FROM own_view", "SELECT * FROM own_view WHERE content RLIKE '(a|b)*c'", "SELECT regexp_replace(content, '(?:a.)+', '') FROM own_view", "SELECT content RLIKE content FROM own_view", "SELECT :x", "SELECT ?",
    "SELECT * FROM own_view LATERAL VIEW java_method('java.lang.System', 'lineSeparator') AS x", "SELECT count(*) FILTER (WHERE reflect('java.lang.System', 'lineSeparator') = '') FROM own_view", "SELECT builtin.version()", "SELECT role FROM own_view WHERE 'humn' = role",
    "SELECT kind FROM own_view WHERE kind IN ('conversation', 'tool-call')", "SELECT * FROM identifier('strange_view')", "EXECUTE IMMEDIATE 'SELECT 1'", "SHOW TABLES", "EXPLAIN SELECT 1", "SET x = 1", "SELECT input_file_name() FROM own_view", "SELECT 1; SELECT 2", "SELECT no_such_function(1)", "no sql",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_guard_refuses(spark, guarded, sql):
    with pytest.raises(sqlapi.SqlRefused):
        sqlapi.query(spark, sql)


ALLOWED = [
    "WITH a AS (SELECT * FROM own_view), b AS (SELECT seq FROM a) SELECT *, row_number() OVER (ORDER BY seq) FROM b WHERE seq IN (SELECT seq FROM own_view) ORDER BY 1 LIMIT 3 OFFSET 0",
    "SELECT role, count(*) FILTER (WHERE seq > 0) FROM own_view GROUP BY ROLLUP (role) HAVING count(*) > 0", "SELECT * FROM own_view m JOIN own_view k USING (seq)", "VALUES (1), (2)", "SELECT * FROM range(3)",
    "SELECT seq, x FROM own_view LATERAL VIEW explode(array(1, 2)) AS x", "SELECT seq FROM own_view UNION ALL SELECT seq FROM own_view EXCEPT SELECT 5L", "TABLE own_view", "SELECT kind FROM own_view WHERE kind = 'conversation'",
    "SELECT 'kind = ''foo'' and role in (''x'')'", "WITH a AS (SELECT 1 AS x), b AS (SELECT x + 1 AS x FROM a) SELECT * FROM b, a", "WITH own_view AS (SELECT 7 AS x) SELECT x FROM own_view", "WITH RECURSIVE n AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM n WHERE x < 4) SELECT * FROM n",
    "SELECT m.seq, k.n FROM own_view m, LATERAL (SELECT count(*) AS n FROM own_view k WHERE k.seq < m.seq) k", "SELECT seq FROM own_view WHERE content RLIKE 'a+' OR NOT content LIKE 'x%' OR content ILIKE 'h_%' OR seq NOT BETWEEN 1 AND 2", "SELECT text_regexp('(a|b)*c', content) FROM own_view",
    "SELECT * FROM (SELECT role, seq FROM own_view) PIVOT (max(seq) FOR role IN ('user', 'assistant'))", "SELECT max(seq) OVER w, sum(seq) OVER (ORDER BY seq ROWS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING) FROM own_view WINDOW w AS (PARTITION BY role)",
    "SELECT CASE WHEN seq > 1 THEN 'a' ELSE 'b' END, coalesce(role, 'x') || 'y', cast(seq AS string), try_cast('a' AS int), array(1, 2)[0], named_struct('a', 1).a, date '2020-01-01' + interval '1' day, extract(year FROM ts), -seq, +seq, seq % 2, seq div 2, current_date FROM own_view",
    "SELECT filter(array(1, 2), x -> x > 1), trim(both 'x' FROM 'xax'), substring('abc' FROM 2 FOR 1), position('b' IN 'abc'), seq IS DISTINCT FROM 1, content IS NOT NULL, seq & 1, ~seq, percentile_cont(0.5) WITHIN GROUP (ORDER BY seq) OVER () FROM own_view",
    "SELECT role, kind, count(DISTINCT seq), grouping(role) FROM own_view GROUP BY GROUPING SETS ((role), (kind), ()) ORDER BY ALL", "SELECT DISTINCT role FROM own_view ORDER BY 1 DESC NULLS LAST", "SELECT * EXCEPT (content) FROM own_view", "SELECT seq FROM own_view INTERSECT ALL SELECT 1L",
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_guard_allows(spark, guarded, sql):
    assert sqlapi.query(spark, sql, timeout_seconds=120).rows


def test_sql_functions(spark, guarded):
    sql = "SELECT contains_caseless(content, 'HELLO') a, text_regexp('^h.llo|^H', content) b, json_pointer('/cmd', content) c, json_pointer('/n', content) d, json_pointer('/list/1', content) e, fuzzy_score('hlo', content) f FROM own_view ORDER BY seq"
    rows = sqlapi.query(spark, sql).rows
    assert [r[:5] for r in rows] == [[False, False, "echo hi", "null", '{"a":"b"}'], [True, True, None, None, None], [False, False, None, None, None]]
    contents = [r[0] for r in sqlapi.query(spark, "SELECT content FROM own_view ORDER BY seq").rows]
    assert [r[5] for r in rows] == [c and fuzzy.match("hlo", c)[0] for c in contents]
    with pytest.raises(patterns.PatternError):
        sqlapi.query(spark, "SELECT text_regexp('(?=x)', content) FROM own_view")


def test_pages_and_batches(spark, guarded):
    with pytest.raises(sqlapi.SqlRefused):
        sqlapi.query(spark, "SELECT * FROM own_view", limit=0)
    assert [len(b) for b in sqlapi.query_batches(spark, "SELECT seq FROM own_view", 2)] == [2, 1]
    with pytest.raises(FilterError):
        search.search(messages(spark, [{"content": "a"}]), search.SearchRequest(query="a", limit=0))


def test_a_query_that_takes_too_long_is_cancelled(spark, guarded):
    sqlapi.register(spark, {"many": spark.range(10**12)})
    with pytest.raises(TimeoutError):
        sqlapi.query(spark, "SELECT sum(sqrt(id)) FROM many", timeout_seconds=2)
    assert sqlapi.query(spark, "SELECT 1").rows == [[1]]


def random_pattern(rnd):
    atoms = ["a", "b", "ab", "abc", " ", "é", "3", "12", "\\.", ".", "\\d", "\\w", "[ab]", "(?:ab|c)", "\\x61", "\\{"]
    counts = ["", "", "", "*", "+", "?", "{2}", "{0,1}", "{1,3}", "{0,200}"]
    return "|".join("".join(rnd.choice(atoms) + rnd.choice(counts) for _ in range(rnd.randint(1, 5))) for _ in range(rnd.choice([1, 1, 2])))


def test_prefilter_is_a_superset(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(["a", "b", "c", "ab", "abc", " ", "é", "3", "12", ".", "{", "}", "x", "200", "300", "\n"]) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    tried = 0
    for _ in range(6):
        made = [random_pattern(rnd) for _ in range(25)]
        made = [p for p in made if patterns.required_literals(p)] + ["ab.{0,200}cd", "x{2,300}", "abc{1,3}", "ab|12+3"]
        tried += len(made)
        off = [F.sum((patterns.regex_match(p, F.col("t")) != patterns.prefiltered_regex(p, F.col("t"))).cast("int")).alias(f"p{i}") for i, p in enumerate(made)]
        wrong = df.agg(*off).first()
        assert [p for i, p in enumerate(made) if wrong[i]] == []
    assert tried > 30


def test_literal_places_where_folding_changes_lengths(spark):
    rows = ["İİ needle", "abc needle", "İneedleİ", "needle"]
    m = messages(spark, [{"content": c} for c in rows])
    r = search.SearchRequest(query="NEEDLE")
    got = {x["content"]: (x["match_start"], x["match_end"]) for x in search.evidence(search.matching(m, r), r).collect()}
    assert got == {c: (c.index("needle"), c.index("needle") + 6) for c in rows}


def test_fuzzy_evidence_shows_the_densest_window(spark):
    rnd = random.Random(3)
    cases = [sorted(rnd.sample(range(60), rnd.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(c,) for c in cases], "p array<int>")
    for row in df.select("p", fuzzy.densest(F.col("p"), 7).alias("d"), fuzzy.match_ranges(F.col("p")).alias("r")).collect():
        first = fuzzy.densest_start(row["p"], 7)
        assert row["d"]["first"] == first and row["d"]["last"] == max(x for x in row["p"] if x < first + 7)
        assert [tuple(x) for x in row["r"]] == fuzzy.ranges(row["p"])
    m = messages(spark, [{"content": "c" + " filler" * 20 + " cargo test now"}])
    r = search.SearchRequest(query="cargo tst", mode="fuzzy", limit=5, match_chars=12)
    row = search.evidence(search.matching(m, r), r).first()
    assert "cargo t" in row["match_view"] and row["match_ranges"]


def test_sessions_are_read_in_order(spark):
    m = messages(spark, [{"content": f"row {i}", "ts": f"2026-01-01T00:00:0{9 - i}Z"} for i in range(4)] + [{"session_id": "t", "content": "row x see https://a.example/b", "authorship": "human"}])
    assert [r["seq"] for r in search.read_session(m, "s", newest_first=True).collect()] == [3, 2, 1, 0]
    assert [r["seq"] for r in search.timeline(m, search.SearchRequest(query="row", limit=3)).collect()] == [3, 2, 1]
    sessions = m.select(F.col("session_id").alias("id")).distinct().unionByName(spark.createDataFrame([("empty",)], "id string"))
    for c in ("title", "cwd", "repo_root", "parent_session_id", "parse_warning"):
        sessions = sessions.withColumn(c, F.lit(None).cast("string"))
    got = {r["id"]: (r["messages"], r["first_request"], r["references"]) for r in search.inspect(sessions, m).collect()}
    assert got == {"s": (4, "row 0", 0), "t": (1, "row x see https://a.example/b", 1), "empty": (0, None, 0)}


def test_references_of_whole_pages(spark):
    """Against a plain reading of the same rules."""
    def plain(page):
        out = []
        for m in re.finditer(refs.ADDRESS.replace("(?i)", ""), page, re.I | re.A):
            v = re.sub(r"[.,;:)\\]}]+\\Z", "", m.group())
            if not v or v in out:
                continue
            bare = re.sub(r":\\d+(-\\d+)?\\Z", "", v.lower())
            ending = (re.search(r"[^/]\\.([a-z0-9]+)/*\\Z", bare) or [None, ""])[1]
            first = (re.match(r"/*([^/]+)", v.lower()) or ["", ""])[1]
            host_first = "." in first and (re.search(r".\\.([a-z0-9]+)\\Z", first) or [None, ""])[1] not in refs.FILE_ENDINGS
            local = "://" not in v.lower() and not v.lower().startswith("www.") and ending in refs.FILE_ENDINGS and not ("/" in v and host_first) and bare != "docs.rs"
            if not local:
                out.append(v)
        return out

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {}
    for r in QUERIES["page_html_refs"][0](spark, sf).collect():
        got.setdefault(r["page_id"], []).append(r["value"])
    assert got and got == {k: v for k, page in pages.items() if (v := plain(page))}


def test_large_logs_are_split(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(f'{{"role":"user","message":{{"content":[{{"type":"text","text":"line {i}"}}]}}}}' for i in range(400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert logs.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 3
        rows = logs.cursor(spark, str(tmp_path)).messages.orderBy("seq").collect()
        assert [r["content"] for r in rows] == [f"line {i}" for i in range(400)] and [r["seq"] for r in rows] == list(range(400))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_relative_age_and_prefix(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00",), (None,)], "t string").select(F.to_timestamp("t").alias("t"))
    now = F.lit("2026-01-03 05:00:00").cast("timestamp")
    assert [r[0] for r in df.select(text.relative_age(F.col("t"), now)).collect()] == ["2d ago", "-"]


def test_effective_request():
    told = search.SearchRequest(query="a b", limit=7).effective()
    assert told["query"] == ("a b", "given") and told["limit"] == (7, "given") and told["mode"] == ("literal", "default")


def test_versions_are_published_restored_and_streamed(spark, tmp_path):
    e = edits(spark)
    q = FileQuery(glob="app.py")
    receipt = files.publish_versions(e, q, str(tmp_path / "bundle"))
    assert receipt["versions"]["rows"] == 4
    with pytest.raises(FileExistsError):
        files.publish_versions(e, q, str(tmp_path / "bundle"))
    target = tmp_path / "app.py"
    assert files.restore(e, "s1", "/a/app.py", str(target), 2) == len("line1\nLINE2\nline3") and target.read_text() == "line1\nLINE2\nline3"
    with pytest.raises(FileExistsError):
        files.restore(e, "s1", "/a/app.py", str(target), 1)
    with pytest.raises(LookupError):
        files.restore(e, "s1", "/a/none", str(tmp_path / "n"))
    lines = [json.loads(x) for x in files.version_stream(e, q)]
    assert [(x["session_id"], x["version"]) for x in lines] == [("s1", 1), ("s1", 2), ("s1", 3), ("s2", 1)]
    framed = "".join(files.version_stream(e, q, "framed"))
    for x in lines:
        head, _, framed = framed.partition("\n")
        n = json.loads(head)["bytes"]
        assert framed.encode()[:n].decode() == x["content"]
        framed = framed.encode()[n + 1 :].decode()
    assert framed == ""


def test_analysis_is_published(spark, tmp_path):
    m = messages(spark, [{"content": "forgot the tests"}, {"session_id": "t", "content": "fine"}])
    s = T.shaped(spark.createDataFrame([("s", "task", None), ("t", "Branch of task", "s")], "id string, title string, parent_session_id string"), T.SESSIONS)
    rules = [analysis.Rule("technique", "tests", r"forgot the tests", "user_text", 7)]
    branch = [analysis.Relationship("branch", "branch", r"^Branch of (?P<parent>.+)$")]
    receipt = analysis.publish_analysis(analysis.run(s, m, rules, analysis.PhraseSpec(2, 2)), analysis.session_graph(s, branch), str(tmp_path / "a"))
    assert {k: v["rows"] for k, v in receipt.items()} == {"sessions": 2, "nodes": 2, "edges": 2, "groups": 0, "memberships": 0, "taxonomy": 2}


def test_titles_that_many_share_are_ambiguous(spark):
    rows = [(f"s{i}", "same") for i in range(5)] + [("b", "Branch of same"), ("c", "Branch of Branch of c"), ("d", "Branch of none")]
    s = T.shaped(spark.createDataFrame(rows, "id string, title string"), T.SESSIONS)
    got = {r["session_id"]: (r["candidates"], r["parent"], r["resolution"]) for r in analysis.relationship_hints(s, [analysis.Relationship("x", "branch", r"^Branch of (?P<parent>.+)$")]).collect()}
    assert got == {"b": (5, None, "ambiguous"), "c": (0, None, "unresolved"), "d": (0, None, "unresolved")}


def test_parts_of_mixed_content(spark):
    part = lambda i, a, b, who: (i, a, b, who)
    cases = [
        ("abcdef", [part(0, 0, 2, "human"), part(1, 2, 6, "agent")], True), ("abcdef", [part(0, 0, 6, "human")], False), ("abcdef", [part(0, 0, 2, "human"), part(1, 3, 6, "agent")], False),
        ("abcdef", [part(0, 0, 2, "human"), part(1, 2, 5, "agent")], False), ("abcdef", [part(0, 0, 2, "human"), part(1, 2, 6, "human")], False), ("abcdef", [part(1, 0, 2, "human"), part(0, 2, 6, "agent")], False),
    ]
    df = spark.createDataFrame([(c, p) for c, p, _ in cases], "c string, p array<struct<ordinal:int,start_char:long,end_char:long,authorship:string>>")
    assert [r[0] for r in df.select(normalize.parts_valid(F.col("c"), F.col("p"))).collect()] == [ok for *_, ok in cases]


def test_rendered_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "=a,b"), (2, None)], "n long, t string").coalesce(1)
    assert sinks.render(df, "csv") == "n,t\n1,\"'=a,b\"\n2,\n" and sinks.render(df, "plain") == "1\t=a,b\n2\t\n"
    assert json.loads(sinks.render(df, "json")) == [{"n": 1, "t": "=a,b"}, {"n": 2}] and "=a,b" in sinks.render(df, "table")
    sinks.write_lines(df, "jsonl", str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    sinks.write_bucketed(df, str(tmp_path / "buckets"), "n", 4)
    sinks.write_bucketed(df.filter("n = 1").withColumn("t", F.lit("new")), str(tmp_path / "buckets"), "n", 4)
    assert {r["n"]: r["t"] for r in spark.read.parquet(str(tmp_path / "buckets")).collect()}[1] == "new"


def test_date_forms_are_those_that_are_read():
    for forms, _ in dates.reference():
        for form in re.split(r"[ ,]+(?=\d|today|yesterday|last)", forms) if "ago" not in forms else ["today", "yesterday", "3 days ago", "last friday"]:
            assert dates.parse_span(form).start <= dates.parse_span(form).end


def test_first_of_each_key_in_a_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long"
    rows = [(1, "2024-01-01 10:00:00", 7), (2, "2024-01-01 10:00:05", 7), (3, "2024-01-01 10:00:06", 8)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long").coalesce(1).write.json(str(tmp_path / "in"))
    stream = windows.first_seen(spark.readStream.schema(schema).json(str(tmp_path / "in")), ["user_id"], "1 hour")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert sorted(r["user_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [7, 8]


def test_schema_names_registered_views_only(spark, guarded):
    assert {r["table"] for r in sqlapi.schema(spark)} >= {"own_view"} and all(r["table"] != "strange_view" for r in sqlapi.schema(spark))
    with pytest.raises(sqlapi.SqlRefused):
        sqlapi.schema(spark, ["strange_view"])


def test_versions_of_a_long_history(spark):
    """Three thousand edits without a snapshot between them, replayed row by row."""
    rnd = random.Random(6)
    text, rows, want = "start " + "x" * 200, [], []
    rows.append(("s", 0, text, []))
    want.append(text)
    for i in range(1, 3000):
        old, new = rnd.choice(["x", "start", "é", f"<{i - 1}>", "nowhere"]), f"<{i}>" + rnd.choice(["x", "é", ""])
        every = rnd.random() < 0.1
        if i % 700 == 0:
            text = f"again {i} xx"
            rows.append(("s", i, text, []))
        else:
            rows.append(("s", i, None, [(old, new, every)]))
            text = None if text is None or old not in text else text.replace(old, new) if every else text.replace(old, new, 1)
        want.append(text)
    df = spark.createDataFrame(rows, "session_id string, seq long, new_content string, edits array<struct<old:string,new:string,replace_all:boolean>>").selectExpr("*", "'/f' AS file_path", "'Edit' AS tool", "CAST(NULL AS TIMESTAMP) AS ts")
    got = [r["content"] for r in files.all_versions(df, batch_bytes=1000).orderBy("version").collect()]
    assert got == want and any(x is None for x in want)
