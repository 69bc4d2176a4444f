"""Patterns as trees: literals never rule out a match, and no text or pattern ends the JVM."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.functions import linear, patterns, refs, regextree
from threadloom.operators.search import SearchRequest, matching, search
from threadloom.sources.tables import MESSAGES


def made(rnd, depth=3):
    """A pattern and a text that it matches."""
    kind = rnd.choice(["lit", "lit", "set", "cat", "cat", "alt", "rep", "group"]) if depth else rnd.choice(["lit", "set"])
    if kind == "lit":
        word = "".join(rnd.choice("abcKsİé. ") for _ in range(rnd.randint(1, 4)))
        return re.escape(word).replace("\\ ", " "), word
    if kind == "set":
        chars = rnd.sample("abcdxyz", rnd.randint(1, 4))
        return rnd.choice([("[" + "".join(chars) + "]", rnd.choice(chars)), ("[a-d]", rnd.choice("abcd")), (r"\w", "q"), (r"\d", "7"), (".", "-")])
    if kind == "cat":
        parts = [made(rnd, depth - 1) for _ in range(rnd.randint(2, 3))]
        return "".join(p if "|" not in p else f"(?:{p})" for p, _ in parts), "".join(t for _, t in parts)
    if kind == "alt":
        parts = [made(rnd, depth - 1) for _ in range(rnd.randint(2, 3))]
        return "(?:" + "|".join(p for p, _ in parts) + ")", rnd.choice(parts)[1]
    p, t = made(rnd, depth - 1)
    if kind == "group":
        return rnd.choice([f"({p})", f"(?:{p})", f"(?P<n{rnd.randint(0, 10**9)}>{p})", f"(?i:{p})"]), t
    least, most = rnd.choice([(0, None), (1, None), (0, 1), (2, 3), (2, None)])
    times = rnd.randint(least, most if most is not None else least + 2)
    count = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or f"{{{least},{most or ''}}}"
    return f"(?:{p}){count}", t * times


@pytest.mark.parametrize("seed", range(300))
def test_literals_are_in_every_match(seed):
    rnd = random.Random(seed)
    pattern, text = made(rnd)
    text = rnd.choice(["", "xx "]) + text + rnd.choice(["", " yy"])
    literals = regextree.required(pattern)
    assert literals is None or any(x in text for x in literals), (pattern, text, literals)
    folded = text.lower().replace("ς", "σ")
    literals = regextree.required("(?i)" + pattern if seed % 2 else pattern, folded=True)
    assert literals is None or any(x in folded for x in literals), (pattern, text, literals)


def test_literals_of_groups_and_classes():
    assert regextree.required("(?:foo|bar)baz[0-9]") == [f"{w}baz" for w in ("bar", "foo")]
    assert regextree.required("(ab|c)+def?g") == ["abdefg", "abdeg", "cdefg", "cdeg"]
    assert regextree.required("x[ab]yz") == ["xayz", "xbyz"]
    assert regextree.required("(?i)Error") is None and regextree.required("(?i)Eror", folded=True) == ["eror"]
    assert regextree.required("(?i)miss", folded=True) is None  # a long s folds to itself
    assert regextree.required("foo|ba") is None and regextree.required("(abc)*") is None
    assert patterns.regex_trigrams("(?:foo|bar)baz[0-9]") == [["bar", "arb", "rba", "baz"], ["foo", "oob", "oba", "baz"]]


def test_recursion_is_seen():
    for p in ["(a|b)*c", "(?:ab)+", "((a)|b){2,}", "(a){1,60}", "x(?:(?:ab?)*)y"]:
        assert patterns.recursive(p), p
    for p in ["a*b+", "[ab]*c", "(ab)?", "(?:ab){1,3}", r"\(a\)*", "(foo|bar)baz", ".*x.*?y"]:
        assert not patterns.recursive(p), p


TEXTS = ["", None, "abc", "ac\n", "é1 b", "aXbc", "ab ab ab", "x(abc)", "ABC", "tab\there", "日本c", "\u2028c", "a-b_c", "aa\r\n", "ſtop"]


@pytest.mark.parametrize(
    "pattern",
    ["(a|b)*c", "(?:ab ?)+$", r"(\w|-)+_", r"(?:[^\W\d]\d?)+ ", "(?i)(?:AB|x)+c", r"(?:\s|.)*c", r"^(?:a|\S)+\z", r"(?:[a-c-])+_", r"(?:\bab\b ?){2,}", r"(?s)(?:a.|\n)+", r"(?:\p{Lu}|x)+c"],
)
def test_equals_the_plain_matcher(spark, pattern):
    assert patterns.recursive(pattern)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    java = F.lit(patterns.to_java(pattern))
    start = F.greatest(F.regexp_instr("t", java) - 1, F.lit(0))
    size = F.coalesce(F.length(F.regexp_substr(F.col("t"), java)), F.lit(0))
    first, last = patterns.regex_span(pattern, F.col("t"))
    rows = df.select("t", patterns.regex_match(pattern, F.col("t")), F.coalesce(F.col("t").rlike(patterns.to_java(pattern)), F.lit(False)), first, start, last, start + size).collect()
    for t, got, want, *places in rows:
        assert got == want, (pattern, t)
        assert not want or places[0] == places[1] and places[2] == places[3], (pattern, t, places)


MEGABYTE = ["a." * 500_000, "ab" * 500_000, "1" * 1_000_000, " " * 1_000_000, "(" * 1_000_000, "a+" * 500_000, "http://" + "." * 1_000_000 + "x", ":1" * 500_000]


def test_no_text_ends_the_jvm(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(MEGABYTE)], "id int, content string").repartition(4)
    for pattern in ["(a|b)*c", r"(?:\w\.)+x", r"(?:\s|x)*y$", r"(?:\bab)+z"]:
        assert df.filter(patterns.regex_match(pattern, F.col("content"))).count() == 0
    assert df.filter(patterns.regex_match("(a|b)+", F.col("content"))).count() == 3
    found = {r.id: r.n for r in df.select("id", F.size(refs.extract(F.col("content"))).alias("n")).collect()}
    assert found[0] <= 1 and found[1] == found[2] == found[3] == 0


def test_search_by_a_repeated_group(spark):
    rows = [(i, "s", i, "user", "conversation", c) for i, c in enumerate(["ab" * 40_000 + "c", "ab" * 40_000, "xx abc"])]
    df = spark.createDataFrame(rows, "id long, session_id string, seq long, role string, kind string, content string")
    from threadloom.sources.tables import shaped

    messages = shaped(df, MESSAGES)
    request = SearchRequest(query="(a|b)*c", mode="regex")
    assert sorted(r.id for r in matching(messages, request).collect()) == [0, 2]
    assert [(r.match_start, r.match_end) for r in search(messages, request).rows] == [(0, 80_001), (3, 6)]


def test_spans_are_code_points():
    assert linear.spans("(b|c)+", pa.array(["ééb", None, "x", "日bcb"])) == [(2, 3), None, None, (1, 4)]
    assert linear.translated("(b|c)+") and linear.translated(r"\b(b|c)+") is None


def test_address_of_long_and_short_hosts(spark):
    texts = ["see www.example.com. Next", "a.b.c.d.example.org/x?y=1,", "ftp+x://h/p)", "no.thing9", "www.a-b.co:8080/z."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[x.value for x in r[0]] for r in df.select(refs.extract(F.col("t"))).collect()]
    assert got == [["www.example.com"], ["a.b.c.d.example.org/x?y=1"], ["ftp+x://h/p"], ["no.thing"], ["www.a-b.co:8080/z"]]
