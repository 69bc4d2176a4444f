"""Patterns: a linear-time regex dialect on Java's engine, globs, and literal prefilters.

The dialect has Unicode classes by default and neither look-around nor
back-references; those are rejected before a query runs, so a pattern means the
same on every engine that shares the dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import linear, regextree
from .text import fold, fold_literal

#: POSIX class names and what Java calls them.
POSIX = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}


class PatternError(ValueError):
    """The pattern is not in the dialect."""


def to_java(pattern: str) -> str:
    """The pattern for Java's engine; raises PatternError for what the dialect lacks."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise PatternError("a backslash ends the pattern")
            n = pattern[i + 1]
            if n.isdigit() or n in "kGZ":
                raise PatternError(f"no back-references or \\{n}")
            out.append("\\" + n)
            i += 2
            continue
        if not in_class and pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), i):
            raise PatternError("no look-around or atomic groups")
        if not in_class and pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if in_class and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
            if m[2] not in POSIX:
                raise PatternError(f"unknown class {m[2]}")
            out.append(("\\P" if m[1] else "\\p") + "{" + POSIX[m[2]] + "}")
            i += m.end()
            continue
        if c == "[":
            in_class = True
        elif c == "]" and in_class and pattern[i - 1] not in "[^":
            in_class = False
        elif not in_class and c == "+" and i and pattern[i - 1] in "*+?}" and (i < 2 or pattern[i - 2] != "\\"):
            raise PatternError("no possessive repetition")
        out.append(c)
        i += 1
    if in_class:
        raise PatternError("unclosed character class")
    java = "".join(out)
    try:
        re.compile(re.sub(r"\\[pP]\{\w+\}|\\[pP]\w|\\z|\\x\{\w+\}", "x", java.replace("(?<", "(?P<")))
    except re.error as e:
        raise PatternError(str(e)) from None
    return "(?U)" + java


def recursive(pattern: str) -> bool:
    """Whether Java would match the pattern by recursion, which a long text doesn't survive."""
    try:
        return regextree.recurses(regextree.parse(pattern))
    except regextree.Unparsed:
        return bool(re.search(r"\)(?:[*+]|\{\d*(?:,\d*|\d{2,})\})", pattern))


def regex_match(pattern: str, text: Column) -> Column:
    """Whether the pattern occurs in the text; null text: false. Patterns with repeated groups leave the JVM."""
    java = to_java(pattern)
    if recursive(pattern):
        return linear.match(pattern, text)
    return F.coalesce(text.rlike(java), F.lit(False))


def regex_span(pattern: str, text: Column) -> tuple[Column, Column]:
    """Start and end of the first match in code points; 0 and 0 without one."""
    if recursive(pattern):
        found = linear.span(pattern, text)
        return F.coalesce(found["start"], F.lit(0)), F.coalesce(found["end"], F.lit(0))
    java = F.lit(to_java(pattern))
    start = F.greatest(F.regexp_instr(text, java) - 1, F.lit(0))
    return start, start + F.coalesce(F.length(F.regexp_substr(text, java)), F.lit(0))


def required_literals(pattern: str) -> list[str] | None:
    """Literals of which a match must hold one, from the pattern's tree; None if no prefilter is safe."""
    return regextree.required(pattern)


def prefiltered_regex(pattern: str, text: Column) -> Column:
    """``regex_match`` behind a cheap literal test that each match passes."""
    literals = required_literals(pattern)
    match = regex_match(pattern, text)
    if not literals:
        return match
    some = F.contains(text, F.lit(literals[0]))
    for x in literals[1:]:
        some = some | F.contains(text, F.lit(x))
    return F.coalesce(some, F.lit(False)) & match


def glob_to_regex(glob: str) -> str:
    """``*`` any run, ``?`` one character, the rest literal; the whole name must match."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + r"\z"


def path_glob(glob: str, path: Column, name: Column) -> Column:
    """A glob with a slash is held against the path, else against the name."""
    return F.coalesce((path if "/" in glob else name).rlike(glob_to_regex(glob)), F.lit(False))


def under_path(path: Column, prefix: str) -> Column:
    """Whether the path is the prefix or below it, by whole components."""
    clean = prefix.rstrip("/") or "/"
    below = F.startswith(path, F.lit(clean if clean == "/" else clean + "/"))
    return F.coalesce((path == clean) | below, F.lit(False))


def trigrams(text: Column) -> Column:
    """Distinct folded runs of three characters."""
    # shifted copies are zipped: each is made once, while substr walks the text from its start each time
    chars = F.filter(F.split(fold(text), ""), lambda c: c != "")
    tail = lambda k: F.slice(chars, k, F.greatest(F.size(chars), F.lit(1)))
    join = lambda a, b: F.concat(a, b)
    runs = F.zip_with(F.zip_with(chars, tail(2), join), tail(3), join)
    return F.coalesce(F.array_distinct(F.array_compact(runs)), F.array().cast("array<string>"))


def literal_trigrams(literal: str) -> list[str]:
    folded = fold_literal(literal)
    return list(dict.fromkeys(folded[i : i + 3] for i in range(len(folded) - 2)))


def regex_trigrams(pattern: str) -> list[list[str]] | None:
    """Groups of folded trigrams: a match has all of some group. None if the pattern demands none."""
    groups = [literal_trigrams(x) for x in regextree.required(pattern, folded=True) or []]
    return groups if groups and all(groups) else None
