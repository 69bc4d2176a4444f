"""Resampling documents towards a target distribution by importance weights.

Texts are bags of hashed runs of 1 to 3 words. Two counts per bucket, one over
all documents and one over all target texts, give each bucket a gain: the log
ratio of its smoothed shares, in whole thousandths. A document's weight is the
sum of its features' gains, read from an array; its score adds Gumbel noise that
depends on the id alone, so the highest scores are a draw without replacement
in proportion to the weights. The k-th highest key is found exactly by radix
selection: each round counts one digit of (score, id, row) over the rows that
share the digits so far and keeps at most 65,536 counts on the driver. Only rows
up to that key are sorted, by range, and ranked.

Features are hashed without making their texts: a run's crc32 follows from the
crc32 of its words, because appending n bytes is a linear map of the register.

Results at the edges: a null or empty text has no feature, weight 0 and is never
drawn; a null id counts as the empty text in the noise and comes first among
equal scores; rows alike in score and id are told apart by their number, so the
draw has exactly its size; very long texts are one slice of their own and never
cut; empty documents give an empty result, empty targets only smoothing; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, encode_words, list_parts, numbered, plain_strings, read_table, segment_sums, small_side, text_slices

BUCKETS = 10_000

#: Bits of a radix digit: a round brings at most 2**DIGIT counts to the driver.
DIGIT = 16


def _byte_map() -> np.ndarray:
    """Each byte's stand-in: a-z for A-Z, itself for digits, letters and bytes of other scripts, else a blank."""
    b = np.arange(256, dtype=np.uint8)
    word = (b >= 0x80) | ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A))
    upper = (b >= 0x41) & (b <= 0x5A)
    return np.where(upper, b + 32, np.where(word, b, 0x20)).astype(np.uint8)


BYTE_MAP = _byte_map()


def _crc_bytes() -> np.ndarray:
    """What one zero byte does to a register of a single byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map, given by its values on the four bytes of a register."""
    return table[0, c & 255] ^ table[1, (c >> 8) & 255] ^ table[2, (c >> 16) & 255] ^ table[3, c >> 24]


@lru_cache(maxsize=4096)
def shift_table(n: int) -> np.ndarray:
    """The map of appending ``n`` zero bytes, as a 4 x 256 table."""
    if n == 0:
        return (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    if n == 1:
        c = shift_table(0)
        return _crc_bytes()[c & 255] ^ (c >> 8)
    half = shift_table(n // 2)
    twice = _apply(half, half)
    return _apply(shift_table(1), twice) if n % 2 else twice


class Runs:
    """Hashes of all runs of 1 to 3 words of some texts, by position of their first word."""

    def __init__(self, texts: pa.Array):
        raw = texts.cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int32)
        data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        plain = pa.Array.from_buffers(pa.string(), len(raw), [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(BYTE_MAP[data])])
        words, ends = list_parts(pc.split_pattern(plain, " "))
        codes, distinct = encode_words(words)
        blank = pc.equal(distinct, "").to_numpy(zero_copy_only=False)
        real = ~blank[codes] if len(distinct) else np.zeros(len(codes), dtype=bool)
        self.offsets = np.concatenate([[0], np.cumsum(real)])[ends].astype(np.int64)
        self.codes = codes[real].astype(np.int64)
        spelled = distinct.cast(pa.binary()).to_pylist()
        led = zlib.crc32(b" ")
        self.alone = np.fromiter((zlib.crc32(w) for w in spelled), np.uint32, len(spelled))
        self.after = np.fromiter((zlib.crc32(w, led) for w in spelled), np.uint32, len(spelled))
        lengths, self.place = np.unique(np.fromiter((len(w) + 1 for w in spelled), np.int64, len(spelled)), return_inverse=True)
        self.tables = np.stack([shift_table(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), np.uint32)

    def appended(self, c: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Registers after a blank and the words ``codes``."""
        at, t = self.place[codes], self.tables
        moved = t[at, 0, c & 255] ^ t[at, 1, (c >> 8) & 255] ^ t[at, 2, (c >> 16) & 255] ^ t[at, 3, c >> 24]
        return moved ^ self.after[codes]

    def hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of the first word, crc32) of the runs of each length."""
        n = len(self.codes)
        left = np.repeat(self.offsets[1:], np.diff(self.offsets)) - np.arange(n)  # words from here to the text's end
        at, c = np.arange(n), self.alone[self.codes]
        yield at, c
        for more in (1, 2):
            fits = left[at] > more
            at = at[fits]
            c = self.appended(c[fits], self.codes[at + more])
            yield at, c


def bucket_counts(df: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; ``buckets`` sums are all that reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch, "__text"):
                for _, c in Runs(plain_strings(part.column("__text"))).hashes():
                    total += np.bincount(c % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], names=["bucket", "n"])

    sums = df.select(F.col(text_col).alias("__text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in sums.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, floored."""
    m = float(len(all_counts))
    big, aim = float(all_counts.sum()) + m, float(target_counts.sum()) + m
    pairs = zip(all_counts.tolist(), target_counts.tolist())
    return np.array([math.floor(1000.0 * math.log((t + 1.0) * big / ((s + 1.0) * aim))) for s, t in pairs], dtype=np.int64)


def weighed(df: DataFrame, id_col: str, text_col: str, gains: np.ndarray) -> DataFrame:
    """(doc_key, n_words, n_features, weight) of each row."""
    source = df.select(F.col(id_col).alias("doc_key"), F.col(text_col).alias("__text"))
    kind = dict(source.dtypes)["doc_key"]
    size = np.uint32(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                runs = Runs(plain_strings(part.column("__text")))
                at_word = np.zeros(len(runs.codes), dtype=np.int64)
                of_word = np.zeros(len(runs.codes), dtype=np.int64)
                for at, c in runs.hashes():
                    at_word[at] += gains[c % size]
                    of_word[at] += 1
                numbers = [np.diff(runs.offsets), segment_sums(of_word, runs.offsets), segment_sums(at_word, runs.offsets)]
                yield pa.RecordBatch.from_arrays([part.column("doc_key"), *(pa.array(x, pa.int64()) for x in numbers)], names=["doc_key", "n_words", "n_features", "weight"])

    return source.mapInArrow(run, f"doc_key {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, salt: int) -> Column:
    """Noise in whole thousandths, floored, from the first 32 bits of sha256(salt:id)."""
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0))))


def key_parts(score: Column, doc_id: Column, row: Column) -> list[Column]:
    """The order of the draw as four numbers >= 0, most important first: score down, id up (null first), row up."""
    wide = doc_id.cast("bigint")
    return [
        F.lit(2**62) - score,
        F.coalesce(F.shiftright(wide, 32) + F.lit(2**31 + 1), F.lit(0).cast("bigint")),
        F.coalesce(wide.bitwiseAND(F.lit(2**32 - 1)), F.lit(0).cast("bigint")),
        row,
    ]


def kth_key(keys: DataFrame, k: int, digit: int = DIGIT) -> list[int] | None:
    """The k-th least of the rows (k0, k1, ...), compared from the left, or a bound between it and the next one.

    ``None`` if there are no more than k rows. Digits that all remaining rows
    share are skipped; a round's counts are bounded by 2**digit.
    """
    names, pool, need = keys.columns, keys, k
    top = [2**63 - 1] * len(names)
    if keys.count() <= k:
        return None
    for place, name in enumerate(names):
        least, most = pool.agg(F.min(name), F.max(name)).first()
        bits = (least ^ most).bit_length()
        prefix = least >> bits << bits
        while bits:
            width = min(digit, bits)
            bits -= width
            part = F.shiftright(name, bits).bitwiseAND(F.lit(2**width - 1))
            counts = sorted(pool.groupBy(part.alias("d")).count().collect())
            for d, n in counts:
                if need <= n:
                    break
                need -= n
            prefix |= d << bits
            if need == n:
                top[place] = prefix + (1 << bits) - 1
                return top
            pool = pool.filter(part == d)
        top[place] = prefix
        pool = pool.filter(F.col(name) == prefix)
    return top


def up_to(names: list[str], bound: list[int]) -> Column:
    """Rows whose key is at most ``bound``."""
    test = F.lit(True)
    for name, value in reversed(list(zip(names, bound))):
        test = (F.col(name) < value) | ((F.col(name) == value) & test)
    return test


def ranked(rows: DataFrame, names: list[str], number: str) -> DataFrame:
    """(number, rank): places from 1 in the order of ``names``, by a range sort and counts of its partitions."""
    from .common import cut

    placed = cut(rows.orderBy(*names).select(F.col(number)))
    at = placed.select(number, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("at"))
    # a row for each partition of the sort
    before = at.groupBy("p").count().select("p", (F.sum("count").over(Window.orderBy("p")) - F.col("count")).alias("before"))
    return at.join(F.broadcast(before), "p").select(number, (F.col("before") + F.col("at") + 1).alias("rank"))


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    share: tuple[int, int] = (5, 100),
    min_words: int = 20,
    buckets: int = BUCKETS,
    salt: int = 42,
) -> DataFrame:
    """Each row's id, n_words, n_features, weight, score, and rank if drawn.

    Drawn are floor(share * N) of the N rows with ``min_words`` words or more;
    ids are integers (or null).
    """
    gains = bucket_gains(bucket_counts(df, text_col, buckets), bucket_counts(target, target_text, buckets))
    scored, number = numbered(weighed(df, id_col, text_col, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_key"), salt)))
    pool = scored.filter(F.col("n_words") >= min_words)
    names = ["k0", "k1", "k2", "k3"]
    keys = pool.select(*(c.alias(n) for c, n in zip(key_parts(F.col("score"), F.col("doc_key"), F.col(number)), names)), number)
    k = share[0] * pool.count() // share[1]
    bound = kth_key(keys.drop(number), k) if k else [-1] * len(names)
    drawn = ranked(keys.filter(up_to(names, bound)) if bound else keys, names, number)
    joined = scored.join(small_side(drawn), number, "left")
    return joined.select(F.col("doc_key").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: 5 % of the documents, drawn towards the benchmark's texts."""
    out = resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
