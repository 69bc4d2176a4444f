"""The literal prefilter never drops a row that the pattern matches."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import patterns as P

TEXTS = ["a", "aaa", "Abcd", "Ling", "xyz 12", "abc|def", "abc.def", "colour", "color", "error: 404", "{1,100}", ""]


@pytest.mark.parametrize(
    "pattern", ["a{1,100}", r"\x41bcd", r"\x{41}bcd", r"\pLing", r"\p{L}ing", r"abc\|def", r"abc\.def", "colou?r", "colou{0,1}r", r"error: \d+", r"\x41{1,100}", r"xyz\s\d{2,100}"]
)
def test_prefilter_keeps_every_match(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    plain, quick = (sorted(r[0] for r in df.filter(f(pattern, F.col("t"))).collect()) for f in (P.regex_match, P.prefiltered_regex))
    assert quick == plain != []


def test_literals_remain():
    assert P.required_literals(r"error: \d+") and P.required_literals("permission denied") == ["permission denied"]
    assert P.required_literals("a{1,100}") is None and P.required_literals(r"\x41bcd") == ["bcd"]
