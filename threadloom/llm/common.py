"""Helpers shared by the corpus operators: tables, batches, lineage cuts, splits.

Every operator that needs Python works on Arrow record batches inside
``mapInArrow``; a batch is cut into slices of bounded text size first, so the
memory of a task does not depend on how long the documents of a batch are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import cut

#: Bytes of text that one vectorised step handles at once.
SLICE_BYTES = 6 << 20

#: Rows of numbers up to which one side of a join is broadcast (some 50 MB).
BROADCAST_ROWS = 500_000

#: Rows of one key from which a join spreads them over several tasks.
CROWDED_ROWS = 50_000

#: The characters that end a word: space and the ASCII controls 9 to 13.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE_CLASS}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def row_numbers(row_col: str | None) -> Column:
    """The number of each row: the column ``row_col``, else one that holds within a single scan."""
    return F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with its rows numbered once and cut, so each later read has the same numbers; and the number's column.

    The numbers of a scan follow its file splits, which change with the cores at
    hand. The column's name is one that no column of ``df`` begins with.
    """
    name = "__row"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return cut(df.withColumn(name, F.monotonically_increasing_id())), name


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by name, whatever characters those have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_side(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, cut, and marked for broadcast if it has at most ``bound`` rows (a few numbers each)."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= bound else held


def without_rows(rows: DataFrame, dropped: DataFrame, number: str) -> DataFrame:
    """``rows`` but for those whose ``number`` is in ``dropped``; texts are shuffled only when those are many."""
    return rows.join(small_side(dropped), number, "left_anti")


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner", parts: int = 16) -> DataFrame:
    """Join by ``key``, of which one value may have very many rows in ``big``: they are spread over ``parts`` tasks by ``spread``."""
    left = big.withColumn("__salt", F.pmod(F.xxhash64(F.lit(17), spread), F.lit(parts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def split_join(big: DataFrame, small: DataFrame, key: str, spread: str, crowded: DataFrame, how: str = "inner") -> DataFrame:
    """Join by ``key``; the keys in ``crowded`` (key), which have very many rows in ``big``, are joined spread, the others plainly.

    Without crowded keys it is the plain join.
    """
    if crowded.isEmpty():
        return big.join(small, key, how)
    hot = small_side(crowded)
    cold = big.join(hot, key, "left_anti").join(small, key, how)
    return cold.unionByName(salted_join(big.join(hot, key, "left_semi"), small.join(hot, key, "left_semi"), key, spread, how))


def refuse_clash(keep: tuple[str, ...], *made: str) -> None:
    """Kept columns must not have the names, in any case, of those that an operator makes or works with."""
    wrong = [k for k in keep if k.lower() in {m.lower() for m in (*made, "__text", "__text_key")}]
    if wrong or len({k.lower() for k in keep}) < len(keep):
        raise ValueError(f"columns {wrong or list(keep)} cannot be kept beside those that are made: {', '.join(made)}")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def bounded_sample(df: DataFrame, id_col: str, bound: int, salt: int = 11) -> DataFrame:
    """At most ``bound`` rows, the same ones in each run: least hash first.

    Used only to fit models; the bound is a documented parameter of each one.
    """
    return df.orderBy(F.xxhash64(F.lit(salt), F.col(id_col)), F.col(id_col)).limit(bound)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``limit`` bytes of ``column``.

    A single longer text makes a part of its own; texts are never cut.
    """
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def plain_strings(values: pa.Array) -> pa.Array:
    """Strings without nulls (null counts as empty), offset 0."""
    return pc.fill_null(values.cast(pa.string()), "")


def list_parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat values and n + 1 offsets into them of a list array without nulls."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty segments give 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def encode_words(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes by position and the distinct values they stand for."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
