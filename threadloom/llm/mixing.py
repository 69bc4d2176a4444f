"""Mixing sources to target weights by entropy balancing.

Each document i of source s gets a rate r_i, the copies of it that the mix is
to hold. Among all rates within [0, cap] whose words add up to the source's
target, entropy balancing takes those nearest to one copy each (least relative
entropy). Its dual has one multiplier per source and the solution is
exponentially tilted: r_i = min(cap, exp(lambda_s * x_i)), x_i being the
document's size over its source's mean size. The multipliers are found by
Newton steps, kept within a bracket that each step narrows; a step is one
distributed aggregate over the histogram of (source, size), which is made once.
The rates are then rounded to whole copies by error diffusion within groups of
bounded size, so that the words taken stay next to the words asked for.

Results at the edges: a null or empty text has size 0 and is taken 0 times; a
source without words has target 0; a null source is a source of its own, the
last; a document longer than its source's target is taken at most as often as
the words owed allow; equal rows are rounded alike but for ties, which the row's
hash and place in its group settle; a null id is an id of its own; rows of an id
that thousands share are rounded in groups dealt out by row; no other column is read, whatever its name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, columns_of, cut, documents, numbered, small_side

#: No document is taken more often than this.
CAP = 3.0

#: Newton steps; a source stops at a relative error of TOLERANCE.
STEPS = 40
TOLERANCE = 1e-9

#: Documents that are rounded together, about.
GROUP_ROWS = 2000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def source_weight(place: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... by the source's place, from 0."""
    return (place % 3 + 1).cast("double")


def capped_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """Targets of sources: shares by weight, none above ``cap`` times its size.

    ``sizes`` has (source, source_size). A source is capped at level t when
    weight * t >= cap * size, so the capped ones are a head of the sources
    ordered by size / weight; the level that spends the whole total on head and
    rest is found from running sums over that order. There is a row a source.
    """
    placed = sizes.withColumn("weight", source_weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1))
    bound = placed.withColumn("most", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    run = bound.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("head"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    )
    level = (F.col("total") - F.coalesce("head", F.lit(0.0))) / F.col("rest")
    found = run.withColumn("level", level).withColumn("free", F.col("weight") * F.col("level") <= F.col("most"))
    first = found.withColumn("at", F.max(F.when(F.col("free"), F.struct(-F.col("most") / F.col("weight"), F.col("level")))).over(Window.partitionBy())["level"])
    return first.select("source", "source_size", F.least(F.col("weight") * F.col("at"), F.col("most")).alias("target"))


def newton(histogram: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, mean, tilt): the multiplier of each source.

    ``histogram`` has (source, size, n) with size > 0. The tilt of a source at
    its cap is the least that caps all its documents; it needs no steps.
    """
    span = histogram.groupBy(F.col("source").alias("__span")).agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    high = F.coalesce(F.log(F.lit(cap)) * F.col("mean") / F.col("least"), F.lit(0.0))
    capped = F.col("target") >= F.lit(cap) * F.col("source_size")
    state = cut(
        targets.join(span, F.col("source").eqNullSafe(F.col("__span")), "left").select(
            "source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"),
            F.when(capped, high).otherwise(0.0).alias("tilt"), F.lit(-1e4).alias("low"), high.alias("high"), capped.alias("done"),
        )
    )
    for _ in range(STEPS):
        s, h = state.alias("s"), histogram.alias("h")
        x = F.col("h.size") / F.col("s.mean")
        raw = F.exp(F.least(F.col("s.tilt") * x, F.lit(50.0)))
        words = F.col("h.n") * F.col("h.size")
        sums = (
            h.join(s.filter(~F.col("done")), F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy(F.col("s.source").alias("__sums"))
            .agg(F.sum(words * F.least(raw, F.lit(cap))).alias("value"), F.sum(F.when(raw < cap, words * raw * x).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("value") - F.col("target")
        near = F.abs(gap) <= F.lit(TOLERANCE) * F.greatest(F.col("target"), F.lit(1.0))
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.when(F.col("slope") > 0, gap / F.col("slope"))
        # a step out of the bracket is replaced by its middle
        moved = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("__sums")), "left")
        bracketed = joined.select(
            "source", "source_size", "target", "mean", "tilt", "value", "slope",
            F.when(F.col("value").isNull(), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("value").isNull(), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | F.col("value").isNull() | near | (F.abs(F.col("high") - F.col("low")) < 1e-15)).alias("done"),
        )
        state = cut(bracketed.select("source", "source_size", "target", "mean", F.when(F.col("done"), F.col("tilt")).otherwise(moved).alias("tilt"), "low", "high", "done"))
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", "tilt")


def round_group(table: pa.Table) -> pa.Table:
    """Whole copies of the documents of one group, largest first, by error diffusion."""
    size = table["size"].to_numpy().astype(np.float64)
    rate = table["rate"].to_numpy()
    order = np.lexsort((table["hash"].to_numpy(), -size))
    whole = np.floor(rate + 1e-9)
    part = np.clip(rate - whole, 0.0, 1.0)
    copies = whole.astype(np.int64)
    owed = 0.0
    for i in order.tolist():
        owed += part[i] * size[i]
        if part[i] > 0 and owed * 2 >= size[i] > 0:
            copies[i] += 1
            owed -= size[i]
    return table.select(["doc_key"]).append_column("copies", pa.array(copies, pa.int64()))


def rounding_groups(rated: DataFrame, group_rows: int) -> DataFrame:
    """``rated`` with ``spread``, by which crowded groups (source, part) are dealt out; ``number`` is used up.

    Rows without id, or with an id that very many share, are one group by their
    hash; only those are dealt out by row number, others stay by id alone.
    """
    crowded = rated.groupBy("source", "part").agg(F.count("*").alias("rows")).filter(F.col("rows") > 4 * group_rows)
    held = small_side(crowded.select(F.col("source").alias("__s"), F.col("part").alias("__p"), F.ceil(F.col("rows") / F.lit(group_rows)).alias("share")))
    spread = F.when(F.col("share").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.lit(29), "number"), F.col("share")))
    joined = rated.join(held, F.col("source").eqNullSafe(F.col("__s")) & (F.col("part") == F.col("__p")), "left")
    return joined.withColumn("spread", spread).drop("__s", "__p", "share", "number")


def copies_of(rows: DataFrame, cap: float = CAP, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Copies of each row; ``rows`` has (doc_key, source, size).

    Returns (doc_key, source, size, source_size, target, copies).
    """
    rows, number = numbered(rows)
    histogram = cut(rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    counts = cut(sizes)
    tilts = newton(histogram, cut(capped_targets(counts.select("source", "source_size"), cap)), cap)
    plan = cut(tilts.join(counts.select(F.col("source").alias("__s"), "n_docs"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"))
    r, p = rows.alias("r"), plan.alias("p")
    rate = F.least(F.exp(F.least(F.col("p.tilt") * F.col("r.size") / F.col("p.mean"), F.lit(50.0))), F.lit(cap))
    salt = F.xxhash64(F.lit(7), F.col("r.doc_key"))
    rated = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).select(
        F.col("r.doc_key"), F.col("r.source"), F.col("r.size"), F.col("p.source_size"), F.col("p.target"),
        F.when(F.col("r.size") > 0, rate).otherwise(0.0).alias("rate"), salt.alias("hash"),
        F.pmod(salt, F.ceil(F.col("p.n_docs") / F.lit(group_rows))).alias("part"), F.col(f"r.{number}").alias("number"),
    )
    rated = rounding_groups(rated, group_rows)

    names = ["doc_key", "source", "size", "source_size", "target", "copies"]

    def run(table: pa.Table) -> pa.Table:
        return table.append_column("copies", round_group(table)["copies"]).select(names)

    kinds = dict(rated.dtypes)
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names)
    return rated.groupBy("source", "part", "spread").applyInArrow(run, schema)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its id, size, source_size, target, taken (words) and copies."""
    rows = df.select(F.col(id_col).alias("doc_key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    out = copies_of(rows)
    return out.select(F.col("doc_key").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: what the mix takes of every document."""
    return mix(documents(spark, sf_dir))


def repeat_rows(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as its ``copies`` says, without that column."""

    names = [c for c in df.columns if c != copies]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                times = part.column(copies).to_numpy(zero_copy_only=False)
                yield part.select(names).take(pa.array(np.repeat(np.arange(part.num_rows), times)))

    return df.mapInArrow(run, df.drop(copies).schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, each as often as it is taken."""
    keyed, number = numbered(docs)
    rows = keyed.select(F.col(number).alias("doc_key"), "source", word_count(F.col("text")).alias("size"))
    copies = f"{number}copies"
    taken = copies_of(rows).filter("copies > 0").select(F.col("doc_key").alias(number), F.col("copies").alias(copies))
    return repeat_rows(keyed.join(small_side(taken), number).select(*columns_of(docs), copies), copies)
