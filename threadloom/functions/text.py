"""Text functions, Column to Column, all of them built-in expressions.

Lengths and positions count Unicode code points. White space means Unicode
white space, which Java's ``\\s`` covers only with ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never begin or end a repeated phrase.
REPEAT_STOPWORDS = (
    "a an additional and are as at be but by can does do for from has have i if in is it local metadata not of on or "
    "rather request s so that than the there this time to user was with you your"
).split()

#: Words that a highlighted query doesn't mark by themselves.
HIGHLIGHT_STOPWORDS = (
    "a an and are as at based be but by can check do double for from has have how i in into is it made not of on or "
    "please some that the this to update what with you your"
).split()

WORD_GAP = r"(?U)[^\p{IsAlphabetic}\p{N}]+"


def fold(text: Column) -> Column:
    """Lower case with one small sigma, so caseless comparison treats all sigmas alike."""
    # replace looks for bytes; translate would look up every letter
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def fold_literal(text: str) -> str:
    """``fold`` of a query at planning time (Python's lower knows the final-sigma rule too)."""
    return "".join(c.lower() for c in text).replace("ς", "σ")


def unfolded_place(text: Column, place: Column) -> Column:
    """The 0-based place in the text of a 0-based place in ``fold(text)``; a letter that folds to several has them all.

    Only where folding changes the length are the letters walked.
    """
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        upto = acc["upto"] + F.length(fold(c))
        return F.when(upto <= place, F.struct(upto.alias("upto"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(2**30).alias("upto"), acc["n"].alias("n")))

    walked = F.aggregate(letters, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")), step)["n"]
    return F.when(F.length(fold(text)) == F.length(text), place.cast("int")).otherwise(walked)


def contains_caseless(text: Column, query: str) -> Column:
    """Whether the text has the query, caseless; null text: false; empty query: true if not null."""
    return F.coalesce(F.contains(fold(text), F.lit(fold_literal(query))), F.lit(False))


def compact_whitespace(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate_for_display(text: Column, limit: int) -> Column:
    """Compacted text of at most ``limit`` characters, marked by ``...`` if the limit has room for it."""
    compact = compact_whitespace(text)
    mark = "..." if limit >= 3 else ""
    return F.when(F.length(compact) <= limit, compact).otherwise(F.concat(F.substring(compact, 1, limit - len(mark)), F.lit(mark)))


def char_prefix(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


def lines_of(text: Column) -> Column:
    """Lines as an array: a last newline ends the last line, carriage returns before newlines go."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", "")))


def count_lines(text: Column) -> Column:
    return F.size(lines_of(text)).cast("bigint")


def select_lines(text: Column, n: int) -> Column:
    """The first n lines, the last -n, or for 0 the text itself."""
    if n == 0:
        return text
    lines = lines_of(text)
    size = F.size(lines)
    start = F.lit(1) if n > 0 else F.greatest(size + n + 1, F.lit(1))
    return F.array_join(F.slice(lines, start, F.least(F.lit(abs(n)), size)), "\n")


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.filter(F.split(fold(text), WORD_GAP), lambda t: t != "")


def ngrams(words: Column, least: int, most: int) -> Column:
    """All windows of ``least`` to ``most`` words, joined by blanks, shorter windows first, in order."""

    def windows(w: Column) -> Column:
        of_width = lambda n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        wide = F.sequence(F.lit(least), F.least(F.lit(max(least, most)), F.size(w)))
        return F.when(F.size(w) >= least, F.flatten(F.transform(wide, of_width))).otherwise(F.array().cast("array<string>"))

    # the words are an element of an array, so they are made once and not once a window
    return F.coalesce(F.transform(F.array(words), windows)[0], F.array().cast("array<string>"))


def phrase_words(phrase: Column) -> Column:
    return F.size(F.split(phrase, " ")).cast("bigint")


def informative(phrase: Column) -> Column:
    """No digit, no stopword at either end, and a word of at least four bytes that is none."""
    words = F.split(phrase, " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    return (
        ~phrase.rlike("[0-9]")
        & ~first.isin(REPEAT_STOPWORDS)
        & ~last.isin(REPEAT_STOPWORDS)
        & F.exists(words, lambda w: (F.octet_length(w) >= 4) & ~w.isin(REPEAT_STOPWORDS))
    )


def word_mark(word: Column) -> Column:
    """What ``informative`` asks of a word: 3 a digit in it, 2 a stopword, 1 none and four bytes or more, 0 another."""
    stop = word.isin(REPEAT_STOPWORDS)
    return F.when(word.rlike("[0-9]"), 3).when(stop, 2).when(F.octet_length(word) >= 4, 1).otherwise(0)


def informative_ngrams(words: Column, marks: Column, least: int, most: int) -> Column:
    """Those of ``ngrams`` that are ``informative``; only these are put together. ``marks``: each word's ``word_mark``."""

    def of_width(n: int) -> Column:
        def good(i: Column) -> Column:
            own = F.slice(marks, i + 1, n)
            ends = (F.get(marks, i) < 2) & (F.get(marks, i + n - 1) < 2)
            return ends & F.array_contains(own, 1) & ~F.array_contains(own, 3)

        places = F.filter(F.sequence(F.lit(0), F.size(words) - n), good)
        return F.when(F.size(words) >= n, F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of_width(n) for n in range(least, most + 1)]))


def user_request_body(text: Column) -> Column:
    """What stands between the first USER_REQUEST tags, trimmed; without them the text."""
    body = F.regexp_extract(text, r"(?s)<USER_REQUEST>(.*?)</USER_REQUEST>", 1)
    has = text.rlike(r"(?s)<USER_REQUEST>.*?</USER_REQUEST>")
    return F.when(has, F.regexp_replace(body, r"(?U)^\s+|\s+$", "")).otherwise(text)


def slash_command(text: Column) -> Column:
    """``/name`` that the text begins with, up to white space or its end; null without one."""
    found = F.regexp_extract(text, r"(?U)^\s*(/[\p{IsAlphabetic}\p{N}_][\p{IsAlphabetic}\p{N}_:.\-]*)(?=\s|\z)", 1)
    return F.when(found != "", found)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def csv_escape(value: Column) -> Column:
    """A CSV cell; cells that a spreadsheet would run as a formula get a quote in front."""
    safe = F.when(value.rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(safe.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def markdown_fence(text: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def window_around(compact: Column, start: Column, length: Column, limit: int) -> Column:
    """Half of ``limit`` on each side of a match (1-based start), cut ends marked by ``...``."""
    half = limit // 2
    first = F.greatest(start - half, F.lit(1))
    end = F.least(start + length - 1 + half, F.length(compact))
    return F.concat(
        F.when(first > 1, F.lit("...")).otherwise(F.lit("")), F.substr(compact, first, end - first + 1), F.when(end < F.length(compact), F.lit("...")).otherwise(F.lit(""))
    )


def snippet(text: Column, query: str, limit: int) -> Column:
    """Text around the query, else around its first word found, else the head."""
    compact = compact_whitespace(text)
    folded = fold_literal(query)
    out = F.when(F.coalesce(compact, F.lit("")) == "", F.lit("(no snippet available)"))
    for needle in [folded, *folded.split()]:
        at = F.locate(needle, fold(compact))
        out = out.when(at > 0, window_around(compact, at, F.lit(len(needle)), limit))
    return out.otherwise(truncate_for_display(compact, limit))


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in word)


def highlight(text: Column, query: str) -> Column:
    """The query and its longer words marked as ``[[...]]``, caseless, longest first."""
    query = query.strip()
    terms = [query] if query else []
    for word in query.split():
        if len(word.encode()) >= 3 and word.lower() not in HIGHLIGHT_STOPWORDS and word.lower() not in [t.lower() for t in terms]:
            terms.append(word)
    if not terms:
        return text
    pattern = "|".join(_quoted(t) for t in sorted(terms, key=lambda t: -len(t.encode())))
    return F.regexp_replace(text, f"(?iu)({pattern})", "[[$1]]")


def relative_age(ts: Column, now: Column) -> Column:
    """Age in the largest whole unit: days, hours or minutes; null: ``-``."""
    s = F.unix_timestamp(now) - F.unix_timestamp(ts)
    d, h, m = (F.floor(s / n).cast("string") for n in (86400, 3600, 60))
    return (
        F.when(ts.isNull(), F.lit("-")).when(s >= 86400, F.concat(d, F.lit("d ago"))).when(s >= 3600, F.concat(h, F.lit("h ago"))).when(s >= 60, F.concat(m, F.lit("m ago"))).otherwise(F.lit("just now"))
    )


def transcript_line(ts: Column, role: Column, text: Column) -> Column:
    """``[time UTC] role`` and the text on the next line."""
    head = F.when(ts.isNull(), role).otherwise(F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC] "), role))
    return F.concat(head, F.lit("\n"), text)


#: Words that a line of code begins with.
CODE_WORDS = "import from def class return if elif else for while try except with async await".split()


def prose_only(text: Column) -> Column:
    """Lines that read as prose: no fenced or indented code, no code words, assignments or calls in front.

    The fence state runs over the lines in a fold; kept lines end in newlines.
    """

    def step(acc: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, r"(?U)^\s+", "")
        fence = bare.startswith("```")
        word = F.lower(F.regexp_extract(bare, r"^[\p{IsAlphabetic}\p{N}_]*", 0))
        code = (
            word.isin(CODE_WORDS)
            | bare.rlike(r"^(\{|\[|</|#)")
            | bare.rlike(r"(?U)^[\p{IsAlphabetic}_][\p{IsAlphabetic}\p{N}_]*\s*=")
            | bare.rlike(r"(?U)^[\p{IsAlphabetic}\p{N}_]+\s*\(")
        )
        keep = ~fence & ~acc["fence"] & ~line.startswith("    ") & ~line.startswith("\t") & ~code
        return F.struct(
            F.when(keep, F.concat(acc["out"], line, F.lit("\n"))).otherwise(acc["out"]).alias("out"), F.when(fence, ~acc["fence"]).otherwise(acc["fence"]).alias("fence")
        )

    return F.aggregate(lines_of(text), F.struct(F.lit("").alias("out"), F.lit(False).alias("fence")), step)["out"]
