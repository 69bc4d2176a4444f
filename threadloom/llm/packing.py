"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Documents become token ids and an end id; those longer than a sequence give full
pieces and a rest. Each task numbers its pieces per length while it makes them,
so a piece's rank among all of its length is that number plus the pieces of the
tasks before: a sum over (task, length) counts, no sort. The histogram has one
number for each length, so planning is a driver step of bounded size: lengths go
longest first, each onto the packs with the most room (``pack_histogram``), a
pattern of packs being one entry with a count. Where that leaves more padding
than ``slack``, the emptiest packs are taken apart and their pieces cut to fill
the others (``fill_gaps``). The plan says, for runs of ranks of each length,
which sequences and offsets they get; it is a bounded table that tasks search.

Results at the edges: a null or empty text is one piece, the end id; a text of
any length is encoded in parts of bounded size cut where the pre-tokenizer cuts
anyway, and gives as many pieces as it needs; equal lengths are alike, so their
order is that of the tasks; repeated rows and null ids are rows like any other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, encode_words, list_parts, plain_strings, small_side, text_slices
from .token_counts import PATTERN, byte_alphabet

SIZE = 2048
END_ID = 1

#: Share of the sequences whose worth of padding is left rather than cutting more documents.
SLACK = 0.005

#: Bytes of text that the tokenizer gets as one string, about; bytes that a worker remembers of chunks and their ids.
PART_BYTES = 1 << 20
REMEMBERED_BYTES = 64 << 20

#: Chunks over so many bytes go to the tokenizer, whose time is not square in their length.
LONG_CHUNK = 2048


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def starts_and_sizes(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


class Encoder:
    """A byte-level BPE file, loaded once per Python worker; distinct blank-led chunks are encoded once.

    New chunks are joined and encoded in one go: each starts with a blank before
    a non-blank, where a pre-token starts anyway, and since a token stands for
    known bytes, the ids of each chunk follow from its place. Where the file's
    merges are in the order of their ids, the same vocabulary in ranked form
    encodes them (several times as fast); it is compared with the tokenizer over
    the whole vocabulary when loaded, and not used if they differ anywhere.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE without normaliser or added blank")
        self.added = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings")
        vocab = spec["model"]["vocab"]
        size = max(*vocab.values(), *(t["id"] for t in spec["added_tokens"])) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.n_bytes = np.zeros(size, dtype=np.int64)
        self.n_bytes[list(vocab.values())] = [len(k) for k in vocab]  # a character of a token stands for a byte
        self.ranked = self.ranked_form(spec["model"], path)
        self.at_blank = regex.compile(r" (?=\S)")
        self.white = regex.compile(r" (?:\s|\Z)")
        self.forget()

    def ranked_form(self, model: dict, path: str):
        import tiktoken

        stand_in = byte_alphabet()
        vocab = {k: i for k, i in model["vocab"].items() if set(k) <= stand_in.keys()}
        made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
        if made != sorted(made):
            return None
        found = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks={bytes(stand_in[c] for c in k): i for k, i in vocab.items()}, special_tokens={})
        spelled = [bytes(stand_in[c] for c in k).decode("utf-8", "replace") for k in vocab]
        probe = [w for w in spelled if w not in self.added] + [a + b for a, b in zip(spelled, reversed(spelled)) if not any(t in a + b for t in self.added)]
        same = all(e.ids == i for e, i in zip(self.tokenizer.encode_batch_fast(probe, add_special_tokens=False), map(found.encode_ordinary, probe)))
        return found if same else None

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.flat, self.sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text without added tokens."""
        quick = self.ranked and len(text) <= LONG_CHUNK
        return np.array(self.ranked.encode_ordinary(text), self.dtype) if quick else self.encode(text)

    def led(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a blank before each, and the number of each one's."""
        if not len(words):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        flat = self.ranked.encode_to_numpy(text, disallowed_special=()).astype(self.dtype) if self.ranked else self.encode(text)
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        last = np.searchsorted(np.cumsum(self.n_bytes[flat]), ends) + 1
        return flat, np.diff(last, prepend=0)

    def places(self, words: pa.Array) -> np.ndarray:
        """The place of each distinct blank-led word among the known ones; new ones are encoded."""
        if self.flat.nbytes + self.known.nbytes > REMEMBERED_BYTES:
            self.forget()
        at = pc.index_in(words, value_set=self.known)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if new.any():
            fresh = words.filter(pa.array(new))
            long = pc.greater(pc.binary_length(fresh), LONG_CHUNK)
            short, rest = fresh.filter(pc.invert(long)), fresh.filter(long)
            flat, sizes = self.led(short)
            apart = [self.encode(" " + w) for w in rest.to_pylist()]
            where = np.empty(len(fresh), dtype=np.int64)
            is_long = long.to_numpy(zero_copy_only=False)
            where[~is_long] = len(self.known) + np.arange(len(short))
            where[is_long] = len(self.known) + len(short) + np.arange(len(rest))
            at[new] = where
            self.known = pa.concat_arrays([self.known, short, rest])
            self.flat = np.concatenate([self.flat, flat, *apart])
            self.sizes = np.concatenate([self.sizes, sizes, np.fromiter(map(len, apart), np.int64, len(apart))])
        return at

    def parts(self, text: str) -> Iterator[str]:
        """``text`` in parts of about PART_BYTES; a blank before a non-blank always starts a pre-token."""
        start = 0
        while len(text) - start > PART_BYTES:
            at = self.at_blank.search(text, start + PART_BYTES)
            if not at:
                break
            yield text[start : at.start()]
            start = at.start()
        yield text[start:]

    def whole(self, text: str) -> np.ndarray:
        return np.concatenate([self.encode(part) for part in self.parts(text)])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and n + 1 offsets, in order."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, r" (\s|[^\x00-\x7f]|$)")
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False).copy()
        apart: dict[int, np.ndarray] = {}
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            if self.white.search(text) or any(t in text for t in self.added):
                apart[i] = self.whole(text)
            else:
                odd[i] = False
        sizes = np.zeros(n, dtype=np.int64)
        even = np.flatnonzero(~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0))
        flat = np.zeros(0, dtype=self.dtype)
        if len(even):
            words, offsets = list_parts(pc.split_pattern(texts.take(pa.array(even)), " "))
            codes, distinct = encode_words(words)
            heads = [self.plain(w) for w in words.take(pa.array(offsets[:-1])).to_pylist()]
            # the first words, which have no blank, follow the known ones
            place = self.places(distinct)[codes]
            place[offsets[:-1]] = len(self.sizes) + np.arange(len(heads))
            lengths = np.concatenate([self.sizes, np.fromiter(map(len, heads), np.int64, len(heads))])
            per_word = lengths[place]
            flat = np.concatenate([self.flat, *heads])[starts_and_sizes((np.cumsum(lengths) - lengths)[place], per_word)]
            sizes[even] = np.add.reduceat(per_word, offsets[:-1])
        for i, ids in apart.items():
            sizes[i] = len(ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if apart:
            out = np.empty(ends[-1], dtype=self.dtype)
            out[starts_and_sizes(ends[even], sizes[even])] = flat
            for i, ids in apart.items():
                out[ends[i] : ends[i + 1]] = ids
            flat = out
        return flat, ends


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(flat: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids with ``end_id`` behind them."""
    after = ends + np.arange(len(ends))
    out = np.full(after[-1], end_id, dtype=flat.dtype)
    out[starts_and_sizes(after[:-1], np.diff(ends))] = flat
    return out, after


def pieces(df: DataFrame, id_col: str, text_col: str, model: str, size: int, end_id: int) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_key, start, length, doc_tokens, ids (packed little-endian), task, and place among the task's pieces of that length."""
    source = df.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("__text"))
    kind = dict(source.dtypes)["doc_key"]
    ddl = f"doc_key {kind}, start bigint, length int, doc_tokens bigint, ids binary, task int, place bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, enc = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64), encoder(model)
        for batch in batches:
            for part in text_slices(batch, "__text"):
                flat, ends = with_end(*enc.ids(plain_strings(part.column("__text"))), end_id)
                tokens = np.diff(ends)
                times = -(-tokens // size)
                owner = np.repeat(np.arange(part.num_rows), times)
                start = starts_and_sizes(np.zeros(len(times), np.int64), times) * size
                length = np.minimum(tokens[owner] - start, size)
                order = np.argsort(length, kind="stable")
                least = np.searchsorted(length[order], length)
                place = np.empty(len(length), dtype=np.int64)
                place[order] = np.arange(len(length))
                place += seen[length] - least
                seen += np.bincount(length, minlength=size + 1)
                # a piece's ids are contiguous, and so are the pieces
                at = (np.concatenate([[0], np.cumsum(length)]) * flat.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(flat)])
                columns = [
                    part.column("doc_key").take(pa.array(owner)), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                    pa.array(tokens[owner], pa.int64()), packed, pa.array(np.full(len(owner), task), pa.int32()), pa.array(place, pa.int64()),
                ]
                made = pa.RecordBatch.from_arrays(columns, names=["doc_key", "start", "length", "doc_tokens", "ids", "task", "place"])
                for first in range(0, made.num_rows, 1024):
                    yield made.slice(first, 1024)

    return source.mapInArrow(run, ddl)


@dataclass
class Pattern:
    """``count`` packs of the same make: (length, times) in order of their offsets."""

    count: int
    room: int
    parts: list[tuple[int, int]] = field(default_factory=list)


def pack_histogram(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Shortest-pack-first: lengths longest first, each onto the packs with the most room."""
    open_: list[tuple[int, int, Pattern]] = []  # a heap by room, the most first
    done: list[Pattern] = []
    serial = 0

    def put(p: Pattern) -> None:
        nonlocal serial
        if p.room:
            heapq.heappush(open_, (-p.room, serial, p))
            serial += 1
        else:
            done.append(p)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not open_ or -open_[0][0] < length:
                each = Pattern(left, size - length, [(length, 1)])
                put(each)
                break
            p = heapq.heappop(open_)[2]
            second = -open_[0][0] if open_ else 0
            # it stays the one with the most room for so many pieces
            times = min(max(1, -(-(p.room - second) // length)), p.room // length)
            if left < times * p.count:
                times = max(1, left // p.count)
            taken = min(left // times, p.count)
            if taken < p.count:
                put(Pattern(p.count - taken, p.room, list(p.parts)))
            put(Pattern(taken, p.room - times * length, [*p.parts, (length, times)]))
            left -= taken * times
    return done + [p for _, _, p in open_]


def padding(room: int, size: int) -> int:
    """Ids of padding in a sequence: none where what it holds is a power of two."""
    held = size - room
    return 0 if held & (held - 1) == 0 else room


@dataclass
class Unit:
    """``count`` pieces of one length, cut alike: parts are (pattern, first sequence of it, from, length, offset)."""

    length: int
    count: int
    cut: int = 0
    parts: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def fill_gaps(patterns: list[Pattern], size: int = SIZE, slack: float = SLACK) -> tuple[list[Pattern], list[Unit]]:
    """The patterns without the packs taken apart, and the cut pieces that fill the others.

    So many of the emptiest packs go that the rest has no more padding than
    ``slack`` of all sequences (if it has that now, none); their pieces go into
    the widest gaps first.
    """
    loose = [i for i, p in enumerate(patterns) if padding(p.room, size)]
    packs = sum(patterns[i].count for i in loose)
    ids = sum(patterns[i].count * (size - patterns[i].room) for i in loose)
    fewest = -(-ids // size)
    spare = packs - fewest - int(slack * fewest)
    kept = [Pattern(p.count, p.room, p.parts) for p in patterns]
    units: list[Unit] = []
    for i in sorted(loose, key=lambda i: -patterns[i].room):
        if spare <= 0:
            break
        gone = min(spare, kept[i].count)
        kept[i].count -= gone
        spare -= gone
        units += [Unit(length, times * gone) for length, times in kept[i].parts]
    gaps = [(-kept[i].room, i, 0, kept[i].count) for i in loose if kept[i].count] if units else []
    heapq.heapify(gaps)
    done: list[Unit] = []
    while units:
        u = units.pop()
        room, i, first, count = heapq.heappop(gaps)
        n, take = min(u.count, count), min(-room, u.length - u.cut)
        if count > n:
            heapq.heappush(gaps, (room, i, first + n, count - n))
        if u.count > n:
            units.append(Unit(u.length, u.count - n, u.cut, [(p, f + n, a, b, o) for p, f, a, b, o in u.parts]))
        u = Unit(u.length, n, u.cut + take, [*u.parts, (i, first, u.cut, take, size + room)])
        if -room > take:
            heapq.heappush(gaps, (room + take, i, first, n))
        (done if u.cut == u.length else units).append(u)
    return kept, done


#: Bits of a rank in a key of (length, rank).
RANK_BITS = 48


class Plan:
    """Where the pieces of each length go, by rank, as arrays: runs of ranks, each with one part or several."""

    def __init__(self, histogram: dict[int, int], size: int = SIZE, slack: float = SLACK):
        kept, cut_units = fill_gaps(pack_histogram(histogram, size), size, slack)
        base = np.concatenate([[0], np.cumsum([p.count for p in kept])]).tolist()
        self.sequences = base[-1]
        next_rank = dict.fromkeys(histogram, 0)
        runs: list[tuple[int, int, list[tuple[int, int, int, int]]]] = []  # key, times, parts: sequence, from, length, offset
        for i, p in enumerate(kept):
            if not p.count:
                continue
            offset = 0
            for length, times in p.parts:
                runs.append((length << RANK_BITS | next_rank[length], times, [(base[i], 0, length, offset)]))
                next_rank[length] += times * p.count
                offset += times * length
        for u in cut_units:
            runs.append((u.length << RANK_BITS | next_rank[u.length], 1, [(base[i] + first, a, n, o) for i, first, a, n, o in u.parts]))
            next_rank[u.length] += u.count
        if next_rank != histogram:
            raise AssertionError("the plan does not place each piece once")
        runs.sort(key=lambda r: r[0])
        self.keys = np.array([r[0] for r in runs], dtype=np.int64)
        self.times = np.array([r[1] for r in runs], dtype=np.int64)
        self.n_parts = np.array([len(r[2]) for r in runs], dtype=np.int64)
        self.first_part = np.cumsum(self.n_parts) - self.n_parts
        self.parts = np.array([x for r in runs for x in r[2]], dtype=np.int64).reshape(-1, 4)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, [sequence, from, length, offset]) of each part of each piece."""
        key = length.astype(np.int64) << RANK_BITS | rank
        run = np.searchsorted(self.keys, key, side="right") - 1
        row = np.repeat(np.arange(len(key)), self.n_parts[run])
        out = self.parts[starts_and_sizes(self.first_part[run], self.n_parts[run])].copy()
        inside, times = (key - self.keys[run])[row], self.times[run][row]
        out[:, 0] += inside // times
        out[:, 3] += inside % times * out[:, 2]
        return row, out


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, size: int = SIZE, end_id: int = END_ID, slack: float = SLACK
) -> DataFrame:
    """One row per piece: its document's id, start, length, ids (array), ids_crc32, doc_tokens, sequence_id and offset.

    A sequence's pieces lie without gaps from offset 0 and hold at most ``size`` ids.
    """
    path = model or default_model()
    made = cut(pieces(df, id_col, text_col, path, size, end_id))
    counts = cut(made.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, size, slack)
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    placed = made.join(small_side(before), ["task", "length"]).select("doc_key", "start", "length", "doc_tokens", "ids", (F.col("before") + F.col("place")).alias("rank"))
    kind = dict(made.dtypes)["doc_key"]
    ddl = f"doc_key {kind}, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    names = ["doc_key", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(path).dtype
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                row, at = plan.place(part.column("length").to_numpy(), part.column("rank").to_numpy())
                ids = [np.frombuffer(b.as_buffer(), dtype=kind).astype("<u4") for b in part.column("ids")]
                cuts = [ids[r][a : a + n] for r, (_, a, n, _) in zip(row.tolist(), at.tolist())]
                flat = np.concatenate(cuts).astype(np.int32) if cuts else np.zeros(0, np.int32)
                ends = np.concatenate([[0], np.cumsum(at[:, 2])]).astype(np.int32)
                owner = pa.array(row)
                start = part.column("start").to_numpy()[row] + at[:, 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_key").take(owner), pa.array(start, pa.int64()), pa.array(at[:, 2], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
                        pa.array([zlib.crc32(c) for c in cuts], pa.int64()), part.column("doc_tokens").take(owner),
                        pa.array(at[:, 0], pa.int64()), pa.array(at[:, 3], pa.int64()),
                    ],
                    names=names,
                )

    return placed.mapInArrow(run, ddl).withColumnRenamed("doc_key", id_col) if id_col != "doc_key" else placed.mapInArrow(run, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents in sequences of at most 2048 ids."""
    out = pack(documents(spark, sf_dir))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
