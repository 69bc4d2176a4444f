"""Fuzzy match: the letters of every word of the query in order, scored.

Membership is exact: each blank-separated word of the query must be an ordered
subsequence of the text, caseless, and letters also match their accented forms.
The score follows the published affine-gap scheme for subsequence matches: 16 a
character, bonuses at word starts, after separators and at case changes, less 3
for the first and 1 for each further skipped character between matches. A
character is a grapheme cluster, told by its first code point: a letter and its
combining marks are one, and a match covers all code points of its clusters.

Membership is a built-in predicate, so it runs before any Python: only rows
that match reach the scorer, once, in Arrow batches. The texts of a slice are
scored at once; besides its batch a worker holds one slice.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, GAP_START, GAP_MORE = 16, 3, 1
BOUNDARY, AFTER_SPACE, CAMEL, CONSECUTIVE, FIRST = 8, 10, 7, 4, 2
KIND = pa.struct([("score", pa.int64()), ("places", pa.list_(pa.int32()))])
#: Code points scored at once; a longer text is scored alone.
SLICE = 1 << 17


@lru_cache(maxsize=65_536)
def plain_letter(c: str) -> str:
    """Lower case, without marks: only a letter followed by nothing but marks loses them."""
    parts = unicodedata.normalize("NFD", c)
    base = parts[0] if all(unicodedata.combining(m) for m in parts[1:]) else c
    low = base.lower()
    return low if len(low) == 1 else base


def plain(text: str) -> str:
    """One character for each of the text's: lower case without accents."""
    return "".join(map(plain_letter, text))


@lru_cache(maxsize=1)
def _forms() -> dict[str, str]:
    """All characters that fold to a letter, by letter; those that only fold to themselves are left out."""
    out: dict[str, str] = {}
    for i in (*range(0x41, 0xAC00), *range(0xE000, 0x1F000), *range(0x2F800, 0x2FA20)):
        low = plain_letter(chr(i))
        if low != chr(i):
            out[low] = out.get(low, "") + chr(i)
    return out


def words_of(query: str) -> list[str]:
    return query.split()


def letter_class(letter: str) -> str:
    """The inside of a pattern class: the letter and all characters that fold to it."""
    return "".join("\\" + c if c in r"\^-[]&" else c for c in letter + _forms().get(letter, ""))


def membership(query: str, text: Column) -> Column:
    """Whether each word of the query is a subsequence of the text; null text: false."""
    out = F.lit(True)
    for word in words_of(query):
        steps = [letter_class(c) for c in plain(word)]
        out = out & text.rlike("(?s)^" + "".join(f"[^{k}]*+[{k}]" for k in steps))
    return F.coalesce(out, F.lit(False))


def bonus_at(text: str, i: int) -> int:
    c, before = text[i], text[i - 1] if i else " "
    if not c.isalnum():
        return 0
    if before.isspace():
        return AFTER_SPACE
    if not before.isalnum():
        return BOUNDARY
    if before.islower() and c.isupper() or c.isdigit() and not before.isdigit():
        return CAMEL
    return 0


def match_word(word: str, text: str, folded: str) -> tuple[int, list[int]] | None:
    """Best score and the matched places; the places tried are those of the word's letters."""
    best: dict[int, tuple[int, list[int]]] = {}
    for k, c in enumerate(word):
        spots = [m.start() for m in re.finditer(re.escape(c), folded)]
        now: dict[int, tuple[int, list[int]]] = {}
        run: tuple[int, int, list[int]] | None = None  # best score so far, less gaps up to its place
        ends = sorted(best)
        e = 0
        for i in spots:
            bonus = bonus_at(text, i)
            if k == 0:
                now[i] = (MATCH + bonus * FIRST, [i])
                continue
            while e < len(ends) and ends[e] < i - 1:
                score, places = best[ends[e]]
                here = score + GAP_MORE * ends[e]
                if run is None or here > run[0]:
                    run = (here, ends[e], places)
                e += 1
            options = []
            if run is not None:
                gap = i - run[1] - 1
                options.append((run[0] - GAP_MORE * run[1] - GAP_START - GAP_MORE * (gap - 1) + MATCH + bonus, run[2]))
            if i - 1 in best:
                score, places = best[i - 1]
                options.append((score + MATCH + max(bonus, CONSECUTIVE), places))
            if options:
                score, places = max(options, key=lambda o: o[0])
                now[i] = (score, [*places, i])
        best = now
        if not best:
            return None
    return max(best.values(), key=lambda x: (x[0], -x[1][0])) if best else None


def clusters(text: str) -> list[int]:
    """Where each grapheme cluster begins, in code points, and the text's length."""
    import regex

    return [m.start() for m in regex.finditer(r"\X", text)] + [len(text)]


#: Blocks without marks, joiners or conjoining letters, where each code point is a cluster.
SIMPLE = re.compile("[\\0-\xac\xae-\u02ff\u0370-\u0482\u048a-\u058f\u2010-\u2027\u2030-\u205e\u20a0-\u20cf\u2100-\u2bff\u3000-\u3029\u3030-\u3098\u309b-\ua48c\uac00-\ud7a3\uff01-\uff9d]*")


def single(text: str) -> bool:
    """Whether each code point is surely a cluster."""
    return (text.isascii() or SIMPLE.fullmatch(text) is not None) and "\r\n" not in text


def match(query: str, text: str | None) -> tuple[int, list[int]] | None:
    """Score and places (code points of all matched clusters) of all words of the query, or None."""
    if text is None:
        return None
    starts = list(range(len(text) + 1)) if single(text) else clusters(text)
    units = "".join(text[i] for i in starts[:-1])
    folded, total, places = plain(units), 0, set()
    for word in words_of(query):
        found = match_word(plain(word), units, folded)
        if found is None:
            return None
        total += found[0]
        places |= {p for u in found[1] for p in range(starts[u], starts[u + 1])}
    return total, sorted(places)


#: Code points below are looked up in a table, those above (hardly any are letters) one by one.
TABLE = 0x3000


def per_letter(units: np.ndarray, value: Callable[[str], int], kind: type = np.int32) -> np.ndarray:
    """``value`` of each unit, asked once for each code point."""
    low = units < TABLE
    out = table_of(value, kind)[np.where(low, units, 0)]
    if not low.all():
        known, which = np.unique(units[~low], return_inverse=True)
        out[~low] = np.fromiter((value(chr(c)) for c in known), kind, len(known))[which]
    return out


@lru_cache(maxsize=8)
def table_of(value: Callable[[str], int], kind: type) -> np.ndarray:
    return np.fromiter((value(chr(c)) for c in range(TABLE)), kind, TABLE)


def folded_code(c: str) -> int:
    return ord(plain_letter(c))


def kinds_of(c: str) -> int:
    return c.isalnum() | c.isspace() << 1 | c.islower() << 2 | c.isupper() << 3 | c.isdigit() << 4


def bonuses(units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``bonus_at`` for every unit; ``first`` marks those that begin a text."""
    own = per_letter(units, kinds_of, np.uint8)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first] = kinds_of(" ")
    turns = (before & 4 != 0) & (own & 8 != 0) | (own & 16 != 0) & (before & 16 == 0)
    found = np.where(turns, np.uint8(CAMEL), np.uint8(0))
    found[before & 1 == 0] = BOUNDARY
    found[before & 2 != 0] = AFTER_SPACE
    found[own & 1 == 0] = 0
    return found


def word_scores(word: str, folded: np.ndarray, bonus: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each row its place in what follows (-1: no match); then, for matched rows, ``match_word``'s score and, letter by letter, the unit.

    One step a letter over the places of that letter in all texts. The best place
    before a gap is a running maximum; each row lifts its values above those of
    the rows before it, so that none is taken over from another row.
    """
    spots = np.flatnonzero(folded == ord(word[0]))
    score, origin = MATCH + bonus[spots].astype(np.int64) * FIRST, spots
    trail: list[tuple[np.ndarray, np.ndarray]] = [(spots, np.empty(0, np.int64))]
    lift, none = np.int64(4 * len(folded) + 64 * len(word) + 1024), np.iinfo(np.int64).min // 4
    for c in word[1:]:
        here = np.flatnonzero(folded == ord(c))
        if not len(spots) or not len(here):
            return np.full(rows, -1, np.int64), []
        # the best score that ends at least two units before, its place added and later taken away
        value = score + GAP_MORE * spots + lift * row[spots]
        top = np.maximum.accumulate(value)
        fresh = np.concatenate([[True], value[1:] > top[:-1]])
        source = np.maximum.accumulate(np.where(fresh, np.arange(len(value)), 0))
        last = np.searchsorted(spots, here - 1) - 1
        far = source[np.maximum(last, 0)]
        apart = (last >= 0) & (row[spots[far]] == row[here])
        by_gap = np.where(apart, score[far] + GAP_MORE * spots[far] - GAP_MORE * here + 2 * GAP_MORE - GAP_START + MATCH + bonus[here].astype(np.int64), none)
        close = np.minimum(np.searchsorted(spots, here - 1), len(spots) - 1)
        beside = (spots[close] == here - 1) & (row[spots[close]] == row[here])
        by_run = np.where(beside, score[close] + MATCH + np.maximum(bonus[here], CONSECUTIVE), none)
        kept = np.flatnonzero(apart | beside)
        parent = np.where(by_run > by_gap, close, far)[kept]
        score, origin, spots = np.maximum(by_run, by_gap)[kept], origin[parent], here[kept]
        trail.append((spots, parent))
    found = np.full(rows, -1, np.int64)
    if not len(spots):
        return found, []
    order = np.lexsort((spots, origin, -score, row[spots]))
    best = order[np.concatenate([[True], np.diff(row[spots[order]]) > 0])]
    matched = row[spots[best]]
    found[matched] = np.arange(len(best))
    taken, at = [], best
    for places, parent in reversed(trail):
        taken.append(places[at])
        at = parent[at] if len(parent) else at
    return found, [score[best], *reversed(taken)]


def match_slice(words: list[str], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``match`` of all texts at once: which of them match, their scores, how many places each has, and the places one after another."""
    given = [t or "" for t in texts]
    starts = [None if single(t) else np.array(clusters(t)) for t in given]
    codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32)[slice(None) if s is None else s[:-1]] for t, s in zip(given, starts)]
    sizes = np.array([len(c) for c in codes])
    units, row, base = np.concatenate(codes), np.repeat(np.arange(len(given)), sizes), np.cumsum(sizes) - sizes
    first = np.zeros(len(units), bool)
    first[base[sizes > 0]] = True
    folded, bonus = per_letter(units, folded_code), bonuses(units, first)
    results = [word_scores(w, folded, bonus, row, len(given)) for w in words]
    matched = np.array([t is not None for t in texts])
    for found, _ in results:
        matched &= found >= 0
    rows = np.flatnonzero(matched)
    score = sum((parts[0][found[rows]] for found, parts in results if len(rows)), np.zeros(len(rows), np.int64))
    # the units of all words in order, one that several words took once
    taken = [p[found[rows]] for found, parts in results if len(rows) for p in parts[1:]]
    taken = np.sort(np.stack(taken, axis=1), axis=1) if taken else np.empty((len(rows), 0), np.int64)
    kept = np.ones(taken.shape, bool)
    kept[:, 1:] = taken[:, 1:] != taken[:, :-1]
    counts, taken = kept.sum(axis=1), taken[kept]
    if all(s is None for s in starts):
        return rows, score, counts, taken - np.repeat(base[rows], counts)
    # each unit's code points: where they begin in its text, and how many they are
    begins = np.concatenate([np.arange(n) if s is None else s[:-1] for s, n in zip(starts, sizes)])[taken]
    widths = np.concatenate([np.ones(n, np.int64) if s is None else np.diff(s) for s, n in zip(starts, sizes)])[taken]
    within = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
    counts = np.bincount(np.repeat(np.arange(len(rows)), counts), widths, len(rows)).astype(np.int64)
    return rows, score, counts, np.repeat(begins, widths) + within


def match_all(query: str, texts: list[str | None]) -> list[tuple[int, list[int]] | None]:
    """``match`` of every text, slice by slice."""
    out: list[tuple[int, list[int]] | None] = []
    for part in match_batch(query, pa.array(texts, pa.string())):
        out += [None if f["score"] is None else (f["score"], f["places"]) for f in part.to_pylist()]
    return out


def match_batch(query: str, texts: pa.Array) -> Iterator[pa.StructArray]:
    """struct(score, places) of every text, both null without a match, slice by slice; only a slice's texts are taken out of Arrow."""
    words = [plain(w) for w in words_of(query)]
    for start, end in sliced(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)):
        rows, score, counts, places = match_slice(words, texts.slice(start, end - start).to_pylist())
        none, scores, offsets = np.ones(end - start, bool), np.zeros(end - start, np.int64), np.zeros(end - start + 1, np.int32)
        none[rows], scores[rows], offsets[rows + 1] = False, score, counts
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(places.astype(np.int32)), mask=pa.array(none))
        yield pa.StructArray.from_arrays([pa.array(scores, mask=none), lists], ["score", "places"])


def sliced(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of the runs of texts of at most ``SLICE`` code points, or of one text."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = max(int(np.searchsorted(ends, ends[start] - sizes[start] + SLICE, "right")), start + 1)
        yield start, end
        start = end


def scored(df: DataFrame, query: str, column: str) -> DataFrame:
    """Rows whose ``column`` matches, with fuzzy_score and fuzzy_places (0-based code points)."""

    @F.arrow_udf("struct<score:bigint,places:array<int>>")
    def score(texts: pa.Array) -> pa.Array:
        parts = list(match_batch(query, texts))
        return pa.concat_arrays(parts) if parts else pa.nulls(0, KIND)

    # as a function of its arguments alone it would be run once for the filter and again for the columns, in workers of their own
    hit = df.filter(membership(query, F.col(column))).withColumn("__f", score.asNondeterministic()(F.col(column)))
    return hit.filter(F.col("__f.score").isNotNull()).withColumns({"fuzzy_score": F.col("__f.score"), "fuzzy_places": F.col("__f.places")}).drop("__f")


def ranges(places: list[int]) -> list[tuple[int, int]]:
    """Half-open ranges of neighbouring places."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][1] == p:
            out[-1] = (out[-1][0], p + 1)
        else:
            out.append((p, p + 1))
    return out


def densest_start(places: list[int], width: int) -> int:
    """Where a window of ``width`` holds most places, the first such."""
    best, at, low = 0, places[0] if places else 0, 0
    for high in range(len(places)):
        while places[high] - places[low] >= width:
            low += 1
        if high - low + 1 > best:
            best, at = high - low + 1, places[low]
    return at


def densest(places: Column, width: int) -> Column:
    """struct(first, last): the first and last place in the window of ``width`` that begins at a place and holds most of them, the first such."""
    held = lambda p: F.filter(places, lambda q: (q >= p) & (q < p + width))
    windows = F.transform(places, lambda p: F.struct(F.size(held(p)).alias("n"), (-p).alias("back"), F.array_max(held(p)).alias("last")))
    best = F.array_max(windows)
    return F.struct((-best["back"]).cast("bigint").alias("first"), best["last"].cast("bigint").alias("last"))


def match_ranges(places: Column) -> Column:
    """Array of struct(start, end): half-open ranges of neighbouring places."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.array(F.struct(p.cast("bigint").alias("start"), (p + 1).cast("bigint").alias("end")))
        grown = F.array(F.struct(last["start"].alias("start"), (p + 1).cast("bigint").alias("end")))
        joins = (F.size(acc) > 0) & (last["end"] == p)
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), grown)).otherwise(F.concat(acc, own))

    return F.aggregate(places, none, step)
