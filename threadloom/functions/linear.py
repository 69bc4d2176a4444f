"""Matching in linear time, for patterns whose repeated groups Java would match by recursion.

Java's matcher takes a stack frame for each round of a repeated group, so a long
text ends the executor. Such patterns are matched by Arrow's own engine, batch by
batch; where that lacks something (word bounds, a ``$`` before the last line
end), by one that keeps its state on the heap and gives up after SECONDS a text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import regextree

#: The heap engine may take so long for one text; then the query fails instead of running on.
SECONDS = 60


@lru_cache(maxsize=256)
def translated(pattern: str) -> str | None:
    """The pattern for Arrow's engine, if that has all it needs."""
    try:
        made = regextree.linear(regextree.parse(pattern))
        pc.match_substring_regex(pa.array([""]), made)
        return made
    except (regextree.Unparsed, regextree.Untranslated, pa.ArrowInvalid):
        return None


@lru_cache(maxsize=256)
def on_heap(pattern: str) -> regex.Pattern:
    ends = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
    tokens = regex.findall(r"\\.|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]|.", pattern, flags=regex.S)
    return regex.compile("".join({"$": ends, r"\z": r"\Z", ".": r"[^\n\r\x85\u2028\u2029]"}.get(t, t) for t in tokens) if "(?s" not in pattern and "(?m" not in pattern else pattern.replace(r"\z", r"\Z"), regex.V0)


def spans(pattern: str, texts: pa.Array) -> list[tuple[int, int] | None]:
    """The first match of each text, in code points."""
    plain, engine = pc.fill_null(texts.cast(pa.string()), ""), translated(pattern)
    if engine is None:
        found = [on_heap(pattern).search(t, timeout=SECONDS) for t in plain.to_pylist()]
        return [m.span() if m and ok else None for m, ok in zip(found, texts.is_valid().to_pylist())]
    # the shortest head before a match: where the first one starts
    held = pc.extract_regex(plain, rf"(?s:\A(?P<head>.*?))(?P<m>{engine})")
    heads, found = pc.struct_field(held, "head").to_pylist(), pc.struct_field(held, "m").to_pylist()
    return [(len(h), len(h) + len(m)) if ok and m is not None else None for h, m, ok in zip(heads, found, texts.is_valid().to_pylist())]


def occurs(pattern: str, texts: pa.Array) -> pa.Array:
    """Whether the pattern occurs in each text; null text: false."""
    texts = texts.cast(pa.string())
    engine = translated(pattern)
    if engine is not None:
        return pc.fill_null(pc.match_substring_regex(texts, engine), False)
    heap = on_heap(pattern)
    return pa.array([t is not None and heap.search(t, timeout=SECONDS) is not None for t in texts.to_pylist()], pa.bool_())


def matches(patterns: pa.Array, texts: pa.Array) -> pa.Array:
    """``occurs`` row by row, each pattern once over all of its rows; null pattern: false."""
    coded = patterns.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), dtype=bool)
    for code, pattern in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == code)
        out[rows] = occurs(pattern, texts.take(pa.array(rows))).to_numpy(zero_copy_only=False)
    return pa.array(out)


def match(pattern: str, text: Column) -> Column:
    """Whether the pattern occurs in the text; null text: false."""

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        return occurs(pattern, texts)

    return found(text)


def span(pattern: str, text: Column) -> Column:
    """struct(start, end) of the first match in code points, null without one."""

    @F.arrow_udf("struct<start:bigint,end:bigint>")
    def found(texts: pa.Array) -> pa.Array:
        made = [None if s is None else {"start": s[0], "end": s[1]} for s in spans(pattern, texts)]
        return pa.array(made, pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    return found(text)
