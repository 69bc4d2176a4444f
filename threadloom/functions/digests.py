"""Digests: SHA-256 of fields framed by their lengths, and of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def framed(*fields: Column) -> Column:
    """Fields with their byte lengths in front, so no two lists of fields look alike; null is ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.concat(*parts)


def framed_digest(*fields: Column) -> Column:
    return F.sha2(framed(*fields), 256)


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``rank`` from 0 in ``order``: places within ranges of the order, after the rows of the ranges before.

    The ranges are cut before they are counted, so both readings see the same ones.
    No task holds more than a range.
    """
    from ..sources.session import cut

    held = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = held.groupBy("__part").count()
    # a row a range
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return held.withColumn("__place", place).join(starts, "__part").withColumn("rank", F.col("__place") + F.col("__start")).drop("__part", "__place", "__start")


def _joined(place: str, chunk: int) -> tuple[Column, Column]:
    """The chunk of a place, and the digest of a chunk's digests in order."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct(place, "d"))), lambda x: x["d"])
    return F.floor(F.col(place) / chunk).alias("above"), F.sha2(F.array_join(inside, ""), 256).alias("d")


def rows_digest(df: DataFrame, order: list[str], fields: list[str], chunk: int = 10_000) -> DataFrame:
    """One row (digest, n): a tree of SHA-256 over the row digests in ``order``, ``chunk`` of them a node.

    Nodes are cut by the rows' ranks in the whole result and ties of the order are
    settled by the row digests, so the digest is the same on any partitioning; no
    task holds more than a node. There are two levels at least.
    """
    keyed = df.select(*order, framed_digest(*[F.col(c) for c in fields]).alias("d"))
    level = ranked(keyed, [*order, "d"]).select("rank", "d")
    n = level.count()
    above, d = _joined("rank", chunk)
    level = level.groupBy(above).agg(d).withColumnRenamed("above", "rank")
    nodes = -(-n // chunk)
    while nodes > chunk:
        level = level.groupBy(above).agg(d).withColumnRenamed("above", "rank")
        nodes = -(-nodes // chunk)
    return level.agg(d, F.lit(n).cast("bigint").alias("n")).select(F.col("d").alias("digest"), "n")
