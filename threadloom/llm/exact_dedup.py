"""Exact dedup with static binary-fuse filters.

Texts are equal when identical after lower-casing A-Z. A snapshot is immutable;
its distinct digests are dealt into buckets by their first bits and each bucket
gets a binary-fuse filter (about 9 bits a digest), built once. The digests of an
incoming batch are grouped among themselves, then screened bucket by bucket:

* a negative is certainly new, its group is one of the batch alone;
* a positive joins the exact bucket of the snapshot on the whole digest.

Digests alone don't decide: every row of a digest that occurs twice is checked
by its bytes (rows are grouped by digest and text), so texts whose digests
collide stay apart. Only digests and ids are shuffled for all rows; texts are
shuffled for the rows with a repeated digest, which a second filter over the
repeated digests finds at the scan. That filter is broadcast only while it has
at most ``SCREEN_DIGESTS`` digests; beyond that, all texts take the join.

``save_snapshot`` writes a snapshot's texts by bucket and its filters once, and
``screen_batch`` holds any later batch against them; positives are compared
with the stored texts byte by byte.

The query deals the table into a snapshot and a batch by the hash of the id and
merges the groups of both; which rows come first doesn't change the result.

Results at the edges: a null text counts as empty, and empty texts are equal;
very long texts are hashed and compared whole; of equal texts with equal ids (a
repeated row) one row is kept; a null id is the smallest; no other column is
read, whatever its name, and stages return them as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CROWDED_ROWS, columns_of, cut, documents, numbered, row_numbers, small_side, split_join, without_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Digests that one filter bucket is meant to hold.
BUCKET_DIGESTS = 50_000

#: Repeated digests up to which their filter (9 bits each) is broadcast.
SCREEN_DIGESTS = 4_000_000


def normalised(text: Column) -> Column:
    """A-Z in lower case, null as empty; all-ASCII texts take the faster function."""
    filled = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(filled) == F.length(filled), F.lower(filled)).otherwise(F.translate(filled, UPPER, LOWER))


def sha256_digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


# --- binary-fuse filter -----------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of keys and seed."""
    h = keys + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class FuseFilter:
    """A static filter over 64-bit keys: three slots in neighbouring segments.

    A key is (perhaps) in the set if the bytes in its three slots xor to its
    fingerprint; that holds for every key of the set and for 1 in 256 others.
    """

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def shape(n: int) -> tuple[int, int]:
        """Length and number of segments for n keys (the published sizing rule)."""
        segment = 4 if n < 2 else min(1 << 18, 1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)))
        factor = 0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
        return segment, max(1, -(-int(round(n * factor)) // segment) - 2)

    def slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The three slots of each key (3 x n) and its fingerprint."""
        h = _mix(keys, self.seed)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        inside = np.uint64(self.segment - 1)
        base = first * np.uint64(self.segment)
        places = [base + np.uint64(k * self.segment) + ((h >> np.uint64(18 * k)) & inside) for k in range(3)]
        return np.array(places, dtype=np.int64), ((h ^ (h >> np.uint64(29))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Peel slots that a single key is left in, round by round, then fill backwards."""
        keys = np.unique(keys.astype(np.uint64))
        segment, segments = cls.shape(len(keys))
        for seed in range(1, 200):
            made = cls(seed * 0x9E3779B97F4A7C15 % 2**64, segment, segments, np.zeros((segments + 2) * segment, dtype=np.uint8))
            if made._fill(keys):
                return made
        raise RuntimeError("no seed builds the filter")

    def _fill(self, keys: np.ndarray) -> bool:
        slots, prints = self.slots(keys)
        n, m = len(keys), len(self.table)
        count = np.bincount(slots.ravel(), minlength=m)
        owner = np.zeros(m, dtype=np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left = [], n
        single = np.flatnonzero(count == 1)
        while left and len(single):
            key, first = np.unique(owner[single], return_index=True)
            rounds.append((key, single[first]))
            left -= len(key)
            touched = slots[:, key].ravel()
            np.subtract.at(count, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(key, 3))
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if left:
            return False
        # the keys of a round don't read one another's free slots
        for key, free in reversed(rounds):
            others = self.table[slots[0, key]] ^ self.table[slots[1, key]] ^ self.table[slots[2, key]] ^ self.table[free]
            self.table[free] = prints[key] ^ others
        return True

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], dtype=np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self.slots(keys.astype(np.uint64))
        return (self.table[slots[0]] ^ self.table[slots[1]] ^ self.table[slots[2]]) == prints

    def dump(self) -> bytes:
        head = np.array([self.seed, self.segment, self.segments], dtype=np.uint64)
        return head.tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> FuseFilter:
        seed, segment, segments = (int(x) for x in np.frombuffer(raw[:24], dtype=np.uint64))
        return cls(seed, segment, segments, np.frombuffer(raw, dtype=np.uint8, offset=24))


def filter_key(digest: Column) -> Column:
    """The 64 bits of a digest that filters work on."""
    return F.xxhash64(digest)


def as_keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64, copy=False).view(np.uint64)


def bucket_of(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(13), digest), F.lit(buckets)).cast("int")


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """(bucket, filter): one static filter for each bucket of the snapshot's digests."""

    def run(table: pa.Table) -> pa.Table:
        made = FuseFilter.build(as_keys(table["key"]))
        return pa.table({"bucket": table["bucket"][:1], "filter": pa.array([made.dump()], pa.binary())})

    keyed = snapshot.select(filter_key(F.col("digest")).alias("key"), bucket_of(F.col("digest"), buckets).alias("bucket"))
    return keyed.groupBy("bucket").applyInArrow(run, "bucket int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``incoming`` (distinct digests) with ``seen``: false means certainly not in the snapshot."""
    names = incoming.columns

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows and left.num_rows:
            seen = FuseFilter.load(right["filter"][0].as_py()).contains(as_keys(left["key"]))
        else:
            seen = np.zeros(left.num_rows, dtype=bool)
        return left.select(names).append_column("seen", pa.array(seen))

    keyed = incoming.withColumns({"key": filter_key(F.col("digest")), "bucket": bucket_of(F.col("digest"), buckets)})
    schema = ", ".join(f"{c} {k}" for c, k in incoming.dtypes) + ", seen boolean"
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, schema)


def texts_by_digest(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """(digest, norm, last, n): a row for each distinct text, so digests that collide have several."""
    norm = normalised(F.col(text_col))
    rank = F.struct(F.col(id_col).alias("doc_key"), F.lit(0).cast("bigint").alias("row")).alias("rank")
    marked = df.select(norm.alias("norm"), rank).withColumn("digest", digest(F.col("norm")))
    return marked.groupBy("digest", "norm").agg(F.max("rank").alias("last"), F.count("*").alias("n"))


def save_snapshot(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bucket_digests: int = BUCKET_DIGESTS, digest=sha256_digest) -> int:
    """Write the snapshot ``df`` to the new folder ``path``; returns the number of buckets.

    ``texts`` has (bucket, digest, text, keep_id, n), a row for each distinct text,
    in the order of buckets, so a reader of few buckets skips the other row groups;
    ``filters`` has one filter a bucket.
    """
    texts = cut(texts_by_digest(df, id_col, text_col, digest))
    digests = texts.select("digest").distinct()
    buckets = max(1, math.ceil(digests.count() / bucket_digests))
    placed = texts.select(bucket_of(F.col("digest"), buckets).alias("bucket"), "digest", F.col("norm").alias("text"), F.col("last.doc_key").alias("keep_id"), "n")
    placed.repartitionByRange("bucket", "digest").sortWithinPartitions("bucket", "digest").write.parquet(f"{path}/texts")
    build_filters(digests, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")
    return buckets


def screen_batch(spark: SparkSession, path: str, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest) -> DataFrame:
    """Per distinct text of the batch: text_sha256, batch_id (largest), n, and stored_id, the snapshot's id of an equal text or null.

    A text that the filters call new needs no look at the snapshot. Positives join
    the stored texts of their digest, and their bytes decide.
    """
    filters = spark.read.parquet(f"{path}/filters")
    first = filters.select("buckets").first()
    buckets = first[0] if first else 1
    own = cut(texts_by_digest(batch, id_col, text_col, digest))
    screened = cut(screen(own.select("digest").distinct(), filters.select("bucket", "filter"), buckets))
    positive = small_side(screened.filter("seen").select("digest"))
    held = spark.read.parquet(f"{path}/texts").select("digest", F.col("text").alias("norm"), F.col("keep_id").alias("stored_id"))
    exact = own.join(positive, "digest", "left_semi").join(held, ["digest", "norm"], "left")
    new = own.join(positive, "digest", "left_anti").withColumn("stored_id", F.lit(None).cast(dict(held.dtypes)["stored_id"]))
    columns = [F.sha2("norm", 256).alias("text_sha256"), F.col("last.doc_key").alias("batch_id"), "n", "stored_id"]
    return exact.select(*columns).unionByName(new.select(*columns))


# --- groups -----------------------------------------------------------------


def digest_groups(rows: DataFrame) -> DataFrame:
    """(digest, last, n) of rows (digest, rank); partial sums collapse copies before the shuffle."""
    return rows.groupBy("digest").agg(F.max("rank").alias("last"), F.count("*").alias("n"))


def screened_groups(snapshot: DataFrame, incoming: DataFrame, bucket_digests: int = BUCKET_DIGESTS) -> DataFrame:
    """Groups of snapshot and batch together, the batch screened by the snapshot's filters."""
    old, new = cut(digest_groups(snapshot)), cut(digest_groups(incoming))
    buckets = max(1, math.ceil(old.count() / bucket_digests))
    filters = cut(build_filters(old, buckets))
    flat = new.select("digest", F.col("last.doc_key").alias("last_key"), F.col("last.row").alias("last_row"), "n")
    last = F.struct(F.col("last_key").alias("doc_key"), F.col("last_row").alias("row")).alias("last")
    screened = cut(screen(flat, filters, buckets).select("digest", last, "n", "seen"))
    positive = screened.filter("seen").drop("seen")
    joined = old.alias("o").join(positive.alias("p"), "digest", "full_outer")
    exact = joined.select(
        "digest", F.greatest(F.col("o.last"), F.col("p.last")).alias("last"), (F.coalesce(F.col("o.n"), F.lit(0)) + F.coalesce(F.col("p.n"), F.lit(0))).alias("n")
    )
    return exact.unionByName(screened.filter("NOT seen").drop("seen"))


def screen_rows(rows: DataFrame, repeated: DataFrame, limit: int) -> DataFrame:
    """Rows (with digest) that may have a repeated digest; all rows beyond ``limit`` digests."""
    if repeated.count() > limit:
        return rows
    keys = as_keys(repeated.select(filter_key(F.col("digest")).alias("key")).toArrow()["key"])
    raw = rows.sparkSession.sparkContext.broadcast(FuseFilter.build(keys).dump() if len(keys) else b"")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not raw.value:
            return
        held = FuseFilter.load(raw.value)
        for batch in batches:
            yield batch.filter(pa.array(held.contains(as_keys(batch.column("__key"))), pa.bool_())).select(names)

    return rows.withColumn("__key", filter_key(F.col("digest"))).mapInArrow(run, rows.schema)


def classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest, screen_digests: int = SCREEN_DIGESTS, row_col: str | None = None
) -> DataFrame:
    """One row per row of ``df``: row, doc_key, digest, last (rank that stays), n.

    ``row`` is the column ``row_col`` of a numbered table; without it the rows are
    numbered here, and the number holds only within the result: it is not compared
    between scans. ``rank`` orders equal texts by (id, row).
    """
    marked = df.select(row_numbers(row_col).alias("row"), F.col(id_col).alias("doc_key"), normalised(F.col(text_col)).alias("norm"))
    digested = marked.withColumn("digest", digest(F.col("norm")))
    rank = F.struct("doc_key", "row").alias("rank")
    rows = cut(digested.select("row", "doc_key", "digest"))
    old = F.pmod(F.xxhash64(F.lit(3), F.col("row")), F.lit(2)) == 0
    ranked = rows.select("digest", rank, old.alias("old"))
    groups = cut(screened_groups(ranked.filter("old"), ranked.filter("NOT old")))
    repeated = groups.filter("n > 1").select("digest")
    # bytes decide: rows of repeated digests, grouped by digest and text
    suspects = screen_rows(digested, repeated, screen_digests)
    by_bytes = suspects.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    collided = cut(by_bytes.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"))
    crowded = groups.filter(F.col("n") > CROWDED_ROWS).select("digest")
    out = split_join(rows, groups, "digest", "row", crowded).select("row", "doc_key", "digest", "last", "n")
    if collided.isEmpty():
        return out
    mixed = cut(digested.join(collided, "digest", "left_semi"))
    apart = mixed.groupBy("digest", "norm").agg(F.max(rank).alias("last"), F.count("*").alias("n"))
    exact = mixed.select("row", "doc_key", "digest", "norm").join(apart, ["digest", "norm"]).select("row", "doc_key", "digest", "last", "n")
    return out.join(collided, "digest", "left_anti").unionByName(exact)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: its id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    found = classes(df, id_col, text_col, **options)
    return found.select(
        F.col("doc_key").alias(id_col),
        F.col("last.doc_key").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("last.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the class of every document."""
    return dedup(documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without the earlier copies of equal texts."""
    rows, number = numbered(docs)
    dropped = classes(rows, row_col=number).filter(F.col("row") != F.col("last.row")).select(F.col("row").alias(number))
    return without_rows(rows, dropped, number).select(*columns_of(docs))
