"""Token counts by rank-synchronous merging of ragged arrays.

The byte-level BPE file gives the byte alphabet, the merge ranks and the added
tokens. A text is cut at added tokens, then into blank-led chunks; the distinct
chunks of a slice are cut into pre-tokens by the pre-tokenizer's pattern, and
the distinct pre-tokens are merged together: all of them lie in one ragged
array of symbols, each round finds the lowest-ranked pair of every sequence and
applies it to all its places in that sequence at once, and sequences without a
mergeable pair leave the array with their number of surviving symbols. A merge
only makes symbols whose own pairs rank later, so a round per rank and sequence
gives what merging one pair at a time gives.

Results at the edges: a null text counts as empty; an empty text has 0 tokens
and 0 bytes; repeated rows stay repeated; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, encode_words, list_parts, plain_strings, segment_sums, text_slices

NO_RANK = np.int32(2**31 - 1)

#: Distinct chunks whose counts a Python worker remembers between slices.
REMEMBERED = 300_000

#: Fixed value: the pre-tokenizer's pattern, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stays, the rest follows from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankTable:
    """Ranks of symbol pairs as a sorted array of 64-bit keys."""

    def __init__(self, merges: list, vocab: dict[str, int]):
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)


def count_symbols(symbols: np.ndarray, lengths: np.ndarray, table: RankTable) -> np.ndarray:
    """Symbols that survive the merging of each ragged sequence (lengths >= 0)."""
    survivors = lengths.astype(np.int64).copy()
    alive = np.flatnonzero(lengths > 1)
    keep = np.repeat(lengths > 1, lengths)
    sym, size = symbols[keep].astype(np.int32), lengths[alive].astype(np.int64)
    if not len(alive):
        return survivors
    last = np.zeros(len(sym), dtype=bool)
    last[np.cumsum(size) - 1] = True
    rank = np.full(len(sym), NO_RANK, dtype=np.int32)
    inner = np.flatnonzero(~last)
    rank[inner] = table.of(sym[inner], sym[inner + 1])
    while len(alive):
        ends = np.cumsum(size)
        least = np.minimum.reduceat(rank, ends - size)
        done = least == NO_RANK
        if done.any():
            survivors[alive[done]] = size[done]
            stay = np.repeat(~done, size)
            sym, rank, last = sym[stay], rank[stay], last[stay]
            alive, size, least = alive[~done], size[~done], least[~done]
            if not len(alive):
                break
        hit = rank == np.repeat(least, size)
        at = np.flatnonzero(hit)
        # in a run of overlapping places, every other one counts, from the left
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = np.diff(at) > 1
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        sym[at] = table.made[rank[at]]
        last[at] = last[at + 1]
        gone = np.zeros(len(sym), dtype=bool)
        gone[at + 1] = True
        owner = np.repeat(np.arange(len(alive)), size)
        size = size - np.bincount(owner[at], minlength=len(alive))
        changed = np.zeros(len(sym), dtype=bool)
        changed[at] = True
        before = at[at > 0] - 1
        before = np.where(gone[before], before - 1, before)
        changed[before[before >= 0]] = True
        stay = ~gone
        sym, rank, last, changed = sym[stay], rank[stay], last[stay], changed[stay]
        look = np.flatnonzero(changed)
        rank[look] = NO_RANK
        look = look[~last[look]]
        rank[look] = table.of(sym[look], sym[look + 1])
    return survivors


class TokenCounter:
    """A byte-level BPE vocabulary file, loaded once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normaliser or added blank")
        vocab = model["vocab"]
        self.table = RankTable(model["merges"], vocab)
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for shown, byte in byte_alphabet().items():
            self.byte_ids[byte] = vocab[shown]
        self.added = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings")
        self.at_added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def chunk_counts(self, chunks: list[str]) -> np.ndarray:
        """Tokens of each chunk; new chunks are merged together, known ones looked up."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        if new:
            pieces = [self.pattern.findall(c) for c in new]
            per_chunk = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
            flat = pa.array([p for x in pieces for p in x], pa.string())
            codes, distinct = encode_words(flat)
            raw = distinct.cast(pa.binary())
            offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
            counts = count_symbols(self.byte_ids[data], np.diff(offsets), self.table)
            ends = np.concatenate([[0], np.cumsum(per_chunk)])
            known.update(zip(new, segment_sums(counts[codes], ends).tolist()))
        return np.fromiter((known[c] for c in chunks), dtype=np.int64, count=len(chunks))

    def count_odd(self, text: str) -> int:
        """A text with added tokens or runs of white space: cut by the pattern itself."""
        total, at = 0, 0
        for m in self.at_added.finditer(text):
            total += 1 + self.count_plain(text[at : m.start()])
            at = m.end()
        return total + self.count_plain(text[at:])

    def count_plain(self, text: str) -> int:
        pieces = self.pattern.findall(text)
        return int(self.chunk_counts(pieces).sum()) if pieces else 0

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), dtype=np.int64)
        # a blank before a non-blank always starts a pre-token; other blanks need the whole text
        odd = pc.match_substring_regex(texts, r" (\s|[^\x00-\x7f]|$)")
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False)
        text_of = texts.take(pa.array(np.flatnonzero(odd)))
        suspects = np.flatnonzero(odd)
        white = regex.compile(r" (?:\s|\Z)")
        for i, text in zip(suspects.tolist(), text_of.to_pylist()):
            if white.search(text) or self.at_added.search(text):
                out[i] = self.count_odd(text)
            else:
                odd[i] = False
        even = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        if not len(even):
            return out
        words, offsets = list_parts(pc.split_pattern(texts.take(pa.array(even)), " "))
        heads = offsets[:-1]
        head_words = words.take(pa.array(heads))
        codes, distinct = encode_words(words)
        keys = distinct.to_pylist()
        by_code = self.chunk_counts([" " + k for k in keys])
        counts = by_code[codes]
        counts[heads] = self.chunk_counts(head_words.to_pylist())
        out[even] = segment_sums(counts, offsets)
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(
    df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str | None = None, limit: int = 512
) -> DataFrame:
    """``keep``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each text."""
    path = model or default_model()
    made = ("n_bytes", "n_tokens", "over_limit")
    if set(keep) & set(made):
        raise ValueError(f"columns {sorted(set(keep) & set(made))} are both kept and made")
    source = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(source.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ["n_bytes bigint", "n_tokens bigint", "over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for part in text_slices(batch, "__text"):
                texts = plain_strings(part.column("__text"))
                tokens = c.count(texts)
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), size, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], names=[*keep, *made]
                )

    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: bytes and tokens of every document."""
    return count_tokens(documents(spark, sf_dir))
