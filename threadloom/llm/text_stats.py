"""Statistics of whole texts, computed a slice of a batch at a time.

Words are runs of anything but space and the ASCII controls 9 to 13. Words and
lines are dictionary-encoded, so repeats are found on integer codes. Used by the
quality rules and the quality classifier.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import encode_words, list_parts, segment_sums

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _table(SYMBOLS), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_END, _PUNCT = _table(".?!"), _table(".,;:!?\"'()-|#*$%&<>[]{}/\\=+_@~^`")
_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


class TextSlice:
    """Bytes, words and lines of some texts (strings without nulls)."""

    def __init__(self, texts: pa.Array):
        raw = pa.concat_arrays([texts.cast(pa.large_binary())])
        ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[: len(raw) + 1]
        self.n = len(texts)
        self.data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]] if self.n else np.zeros(0, np.uint8)
        self.ends = ends - ends[0]
        space = _SPACE[self.data]
        # a word starts at a non-space after a space or a text's start
        start = ~space
        start[1:] &= space[:-1]
        heads = self.ends[:-1][np.diff(self.ends) > 0]
        start[heads] = ~space[heads]
        stop = ~space
        stop[:-1] &= space[1:]
        stop[heads[1:] - 1] = ~space[heads[1:] - 1]
        if len(self.data):
            stop[-1] = not space[-1]
        self.word_start, self.word_stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.words_at = np.searchsorted(self.word_start, self.ends)
        self.space = space

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text that the table holds."""
        return segment_sums(table[self.data], self.ends)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words_at)

    def word_chars(self) -> np.ndarray:
        return segment_sums(_LEAD[self.data] & ~self.space, self.ends)

    def word_codes(self) -> tuple[np.ndarray, int]:
        """A code for each word, equal for equal words of the slice; how many codes there are."""
        if not len(self.word_start):
            return np.zeros(0, dtype=np.int64), 0
        sizes = self.word_stop - self.word_start
        offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=offsets[1:])
        packed = np.ascontiguousarray(self.data[~self.space])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        codes, distinct = encode_words(words)
        return codes.astype(np.int64), len(distinct)

    def repeat_words(self, codes: np.ndarray, n_codes: int) -> np.ndarray:
        """Words of each text inside 3-word windows that occur there twice or more."""
        out = np.zeros(self.n, dtype=np.int64)
        if len(codes) < 4:
            return out
        text_of = np.repeat(np.arange(self.n), self.n_words)
        whole = text_of[:-2] == text_of[2:]
        at = np.flatnonzero(whole)
        if not len(at):
            return out
        if n_codes < 1 << 21:
            key = codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2]
        else:
            pair = np.unique(codes[at] * n_codes + codes[at + 1], return_inverse=True)[1]
            key = np.unique(pair * n_codes + codes[at + 2], return_inverse=True)[1]
        # equal windows of a text become neighbours: the order keeps positions within equal keys
        order = np.argsort(key, kind="stable")
        k, t = key[order], text_of[at[order]]
        twin = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(at), dtype=bool)
        twice[1:] |= twin
        twice[:-1] |= twin
        hit = at[order[twice]]
        covered = np.zeros(len(codes), dtype=bool)
        for k in range(3):
            covered[hit + k] = True
        return segment_sums(covered, self.words_at)

    def distinct_words(self, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of each text, and how often its commonest one occurs."""
        distinct, most = np.zeros(self.n, dtype=np.int64), np.zeros(self.n, dtype=np.int64)
        if len(codes):
            text_of = np.repeat(np.arange(self.n), self.n_words)
            key, times = np.unique(text_of * np.int64(n_codes) + codes, return_counts=True)
            owner = key // n_codes
            distinct = np.bincount(owner, minlength=self.n)
            np.maximum.at(most, owner, times)
        return distinct, most


def line_stats(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word, those among them equal to an earlier line, and all lines."""
    lists = pc.split_pattern(texts, "\n")
    lines, offsets = list_parts(lists)
    codes, distinct = encode_words(lines)
    worded = pc.match_substring_regex(distinct, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    has_word = worded[codes] if len(codes) else np.zeros(0, bool)
    key = text_of * np.int64(max(1, len(distinct))) + codes
    first = np.zeros(len(key), dtype=bool)
    first[np.unique(key, return_index=True)[1]] = True
    return segment_sums(has_word, offsets), segment_sums(has_word & ~first, offsets), np.diff(offsets)


#: What the classifier sees of a document.
FEATURES = (
    "log_words", "mean_word", "symbol_share", "upper_share", "digit_share", "punct_share", "other_share",
    "end_rate", "distinct_share", "top_share", "repeat_share", "dup_line_share", "words_per_line", "short_share", "bang_rate", "pipe_rate",
)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; texts without words give zeros where a rate is undefined."""
    s = TextSlice(texts)
    words = s.n_words
    per_word, chars = np.maximum(words, 1), np.maximum(s.word_chars(), 1)
    codes, n_codes = s.word_codes()
    distinct, most = s.distinct_words(codes, n_codes)
    lines, dup_lines, _ = line_stats(texts)
    sizes = s.word_stop - s.word_start
    out = np.empty((s.n, len(FEATURES)), dtype=np.float64)
    out[:, 0] = np.log1p(words)
    out[:, 1] = s.word_chars() / per_word
    out[:, 2] = s.count(_SYMBOL) / chars
    out[:, 3] = s.count(_UPPER) / chars
    out[:, 4] = s.count(_DIGIT) / chars
    out[:, 5] = s.count(_PUNCT) / chars
    out[:, 6] = segment_sums(s.data >= 128, s.ends) / chars
    out[:, 7] = s.count(_END) / per_word
    out[:, 8] = distinct / per_word
    out[:, 9] = most / per_word
    out[:, 10] = s.repeat_words(codes, n_codes) / per_word
    out[:, 11] = dup_lines / np.maximum(lines, 1)
    out[:, 12] = words / np.maximum(lines, 1)
    out[:, 13] = segment_sums(sizes <= 3, s.words_at) / per_word
    out[:, 14] = s.count(_table("!")) / per_word
    out[:, 15] = s.count(_table("|")) / per_word
    return out
