"""Stored posting lists of folded trigrams, so that a search reads only what its terms ask for.

Documents are numbered as they are written: a file's rows in order, the files
apart by the high bits. Of each term and block of BLOCK numbers the index has one
row with the numbers in order, as differences in a byte code of seven bits a
byte. Rows are sorted by term, so a reader of a few terms skips all other row
groups by their least and greatest term. A search decodes the lists of its terms
block by block, crosses those of a group, least first, and unites the groups;
what is left is tested against the text itself.

Lists of one block are bounded by BLOCK, whatever the term; a frequent term has
many rows, never a long one. Texts without three characters have no posting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import trigrams

POSTINGS = "term string, block bigint, n int, docs binary"

#: Numbers of documents in a block: a power of two.
BLOCK = 1 << 16

#: Postings that a worker codes or decodes at once.
HELD = 1 << 19

#: Bytes of a row group of the index: small, so few terms share one.
ROW_GROUP_BYTES = 1 << 20


def encode(lists: pa.ListArray) -> pa.Array:
    """Sorted lists of numbers >= 0 as differences, low seven bits first; the last byte of a number is below 128."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.uint64)
    offsets = offsets - offsets[0]
    gaps = values.copy()
    gaps[1:] -= values[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    gaps[heads] = values[heads]
    sizes = np.ones(len(gaps), dtype=np.int64)
    for bits in range(7, 64, 7):
        sizes += gaps >= np.uint64(1) << np.uint64(bits)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        more = np.where(sizes[has] > k + 1, 128, 0).astype(np.uint8)
        out[(ends - sizes)[has] + k] = ((gaps[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    cuts = np.concatenate([[0], ends])[offsets].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(cuts), pa.py_buffer(out)])


def differences(data: np.ndarray) -> np.ndarray:
    """The numbers of the byte code."""
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def decode(raw: bytes) -> np.ndarray:
    """The numbers of one list."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    return np.cumsum(differences(data))


def decode_all(raw: pa.Array, n: np.ndarray) -> np.ndarray:
    """The numbers of many lists, none of them empty, one after another; ``n``: how many each has."""
    gaps = differences(np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8))
    # sums may pass 64 bits: what is taken away again is off by the same
    total = np.cumsum(gaps)
    heads = np.cumsum(n) - n
    return total - np.repeat(total[heads] - gaps[heads], n)


def cross(lists: list[np.ndarray]) -> np.ndarray:
    """What all sorted lists have, the shortest first; a longer one is searched, not read through."""
    first, *rest = sorted(lists, key=len)
    for other in rest:
        at = np.searchsorted(other, first)
        first = first[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] == first)] if len(other) else first[:0]
    return first


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``doc``, their number; it is fixed by writing them."""
    return rows.withColumn("doc", F.monotonically_increasing_id())


def posting_rows(rows: DataFrame, text_col: str = "content") -> DataFrame:
    """The index of written rows (doc, text): POSTINGS.

    Each task codes its postings HELD at a time; only these pieces of lists are
    shuffled and joined, in order, so no list or batch of lists is ever wide.
    """
    block = F.shiftright("doc", BLOCK.bit_length() - 1)
    each = rows.select(F.explode(trigrams(F.col(text_col))).alias("term"), block.alias("block"), "doc")
    made = each.mapInArrow(pieces, "term string, block bigint, first bigint, n int, docs binary")
    return made.repartition("term", "block").sortWithinPartitions("term", "block", "first").drop("first").mapInArrow(joined, POSTINGS)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (term, block, doc) the lists of each HELD postings by term and block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield piece(held)
            held = []
    if any(b.num_rows for b in held):
        yield piece(held)


def piece(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    terms = pa.concat_arrays([b.column("term") for b in held]).dictionary_encode()
    code, block, docs = (np.concatenate(x) for x in ([terms.indices.to_numpy()], [b.column("block").to_numpy() for b in held], [b.column("doc").to_numpy() for b in held]))
    order = np.lexsort((docs, code))
    code, block, docs = code[order], block[order], docs[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(block) != 0)]))
    offsets = np.append(starts, len(docs)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(docs))
    named = terms.dictionary.take(pa.array(code[starts]))
    return pa.RecordBatch.from_arrays([named, pa.array(block[starts]), pa.array(docs[starts]), pa.array(np.diff(offsets)), encode(lists)], names=["term", "block", "first", "n", "docs"])


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (term, block, n, docs) in order of term and block one list for each; HELD postings are decoded at once, or those of one list."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        part = np.cumsum(batch.column("n").to_numpy().astype(np.int64)) // HELD
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            if start == end:
                continue
            whole = pa.concat_batches([*rest, batch.slice(start, end - start)])
            last = int(list_starts(whole)[-1])
            if last:
                yield one_list_each(whole.slice(0, last))
            # the last list may go on
            rest = [whole.slice(last)]
    if rest:
        yield one_list_each(rest[0])


def list_starts(part: pa.RecordBatch) -> np.ndarray:
    """Where another term or block begins."""
    term, block = part.column("term"), part.column("block").to_numpy()
    other = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], other.astype(bool) | (np.diff(block) != 0)]))


def one_list_each(part: pa.RecordBatch) -> pa.RecordBatch:
    starts, n = list_starts(part), part.column("n").to_numpy().astype(np.int64)
    docs = decode_all(part.column("docs"), n)
    offsets = np.append(np.cumsum(n)[starts] - n[starts], len(docs))
    own = np.repeat(np.arange(len(starts)), np.diff(offsets))
    if np.any((np.diff(docs) < 0) & (np.diff(own) == 0)):
        docs = docs[np.lexsort((docs, own))]
    at = pa.array(starts)
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(docs))
    return pa.RecordBatch.from_arrays([part.column("term").take(at), part.column("block").take(at), pa.array(np.diff(offsets).astype(np.int32)), encode(lists)], names=["term", "block", "n", "docs"])


def write(postings: DataFrame, folder: str) -> None:
    """The index, by range of term."""
    ranged = postings.repartitionByRange("term", "block").sortWithinPartitions("term", "block")
    ranged.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)


def candidates(postings: DataFrame, groups: list[list[str]], also: tuple[str, ...] = ()) -> DataFrame:
    """(``also``, doc) of the documents that have all terms of some group; ``also`` are columns that tell indexes apart."""
    groups = [list(dict.fromkeys(g)) for g in groups]
    wanted = sorted({t for g in groups for t in g})
    if not all(groups) or not groups:
        raise ValueError("no group of trigrams")
    asked = postings.filter(F.col("term").isin(wanted)).select(*also, "block", "term", "docs")
    kinds = dict(asked.dtypes)
    names = [*also, "doc"]

    def run(table: pa.Table) -> pa.Table:
        lists = dict(zip(table["term"].to_pylist(), (decode(x) for x in table["docs"].to_pylist())))
        found = [cross([lists[t] for t in g]) for g in groups if all(t in lists for t in g)]
        docs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        return pa.table([*(pa.array([table[c][0].as_py()] * len(docs), table[c].type) for c in also), pa.array(docs, pa.int64())], names=names)

    # a group of rows is one block: a list for each term asked for
    return asked.groupBy(*also, "block").applyInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in also), "doc bigint"]))


def build(rows: DataFrame, folder: str, text_col: str = "content") -> None:
    """Write rows, numbered, and their index to the new folder ``folder``."""
    numbered(rows).write.parquet(f"{folder}/rows")
    write(posting_rows(rows.sparkSession.read.parquet(f"{folder}/rows"), text_col), f"{folder}/postings")


def opened(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows with doc, postings) of what ``build`` wrote."""
    return spark.read.parquet(f"{folder}/rows"), spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
