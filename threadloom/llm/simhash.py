"""SimHash near-dedup by a self-join of binary tries.

Fingerprints: A-Z are lower-cased, a text's 4-word shingles (fewer words: the
whole sequence) are hashed with XXH64, seed 42, and a bit of the fingerprint is
1 if more than half of the hashes, repeats included, have it. Texts without
words have fingerprint zero, linked like any other.

Links: two fingerprints link at ``budget`` (4) or fewer differing bits. Equal
fingerprints become one node first. If two nodes differ in at most 4 bits, then
one of five blocks of the 64 bits is the same in both; so there are five tries,
each with another block rotated to the top, and a trie is dealt out by its top
block. Inside a task the trie is a sorted array, a trie node a range of it. The
self-join starts with each subtree paired with itself, walks pairs of trie
nodes down together one bit at a time, adds up the bits in which their paths
differ and drops a pair once that exceeds the budget. Pairs of small ranges are
finished by comparing what they hold.

A subtree that more than ``HOT_NODES`` nodes share is dealt out again the same
way: its nodes differ in the bits below alone, so one of five blocks of those is
the same in both of a pair, and five tries more, each with one of these blocks
next, have subtrees a thousand times smaller. Only rows of hot subtrees are
repeated, five times a level. What ``LEVELS`` such steps leave hot holds values
that are all alike; its tries are cut into pages of neighbouring values, and two
pages meet if the bits that all values of each share, taken together, are within
the budget. So a task's memory is bounded at any skew, and pruning by the
budget goes on across tasks.

A task returns no pairs but a spanning forest of the links it found (one row per
node at most); components of the forests' union are found by hooking each node
to its least neighbour and jumping, until nothing changes. No link is lost: a
forest connects whatever its task's links connect.

Results at the edges: null and empty texts have fingerprint zero; of a very long
text the votes are added up part by part, so only a part's hashes are in memory;
repeated rows are equal fingerprints and stay repeated; null ids never name a
component while another id is in it; no other column is read, whatever its name;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CROWDED_ROWS, columns_of, cut, documents, numbered, plain_strings, refuse_clash, row_numbers, salted_join, split_join, text_slices, without_rows

SEED = 42
SHINGLE_WORDS = 4
BUDGET = 4
BITS = 64

#: Nodes of one subtree that one task takes; more are dealt out again.
HOT_NODES = 8192

#: Rows of whole subtrees that a task compares at once; a task holds these and one subtree more.
TOGETHER = 200_000

#: How often hot subtrees are dealt out by blocks of their free bits before they are cut into pages.
LEVELS = 3

#: Bytes of a text whose shingles are hashed and voted on at once.
PART_BYTES = 1 << 20

#: Ranges with fewer nodes than this are compared at once.
LEAF = 12

#: Pairs that are compared in one step.
STEP_PAIRS = 1 << 21


def blocks(budget: int = BUDGET) -> list[tuple[int, int]]:
    """(start, width) of budget + 1 blocks that make up the 64 bits, from the top."""
    n = budget + 1
    ends = [BITS * (i + 1) // n for i in range(n)]
    return [(a, b - a) for a, b in zip([0, *ends], ends)]


# --- fingerprints -----------------------------------------------------------

SPACE = re.compile(rb"[\x20\x09-\x0D]")


def window_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each window of SHINGLE_WORDS words, in order, repeats included."""
    n = len(words) - SHINGLE_WORDS + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :].tolist())], dtype=np.uint64)


def shingle_hashes(text: str, part_bytes: int = PART_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, an array for each part of about ``part_bytes``; none without words.

    A part ends at white space; its last words go before the next part's, so no window is lost.
    """
    raw = text.encode("utf-8", "surrogatepass")
    held: list[bytes] = []
    windows = start = 0
    while start < len(raw):
        found = SPACE.search(raw, start + part_bytes)
        end = found.start() if found else len(raw)
        held += raw[start:end].lower().split()
        made = window_hashes(held)
        if len(made):
            windows += len(made)
            held = held[1 - SHINGLE_WORDS :]
            yield made
        start = end
    if held and not windows:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], dtype=np.uint64)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash, a row each."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def majority(votes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 votes: the bits that over half of ``sizes`` hashes have."""
    return np.packbits(votes * 2 > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprint_texts(texts: list[str], step: int = 1 << 16, part_bytes: int = PART_BYTES) -> np.ndarray:
    """Fingerprints of texts; short texts of up to ``step`` shingles are voted on together."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    pending = 0

    def vote() -> None:
        sizes = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        votes = np.add.reduceat(bits_of(np.concatenate(held)), np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
        out[owners] = majority(votes, sizes)

    for i, text in enumerate(texts):
        parts = shingle_hashes(text, part_bytes)
        first = next(parts, None)
        if first is None:
            continue
        second = next(parts, None)
        if second is None:
            held.append(first)
            owners.append(i)
            pending += len(first)
            if pending >= step:
                vote()
                held, owners, pending = [], [], 0
            continue
        votes, n = np.zeros(BITS, dtype=np.int64), 0
        for part in (first, second):
            votes, n = votes + bits_of(part).sum(axis=0, dtype=np.int64), n + len(part)
        for part in parts:
            votes, n = votes + bits_of(part).sum(axis=0, dtype=np.int64), n + len(part)
        out[i : i + 1] = majority(votes[None, :], np.array([n]))
    if held:
        vote()
    return out


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and fp, the fingerprint as a signed long."""
    refuse_clash(keep, "fp")
    source = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text", 2 << 20):
                fp = fingerprint_texts(plain_strings(part.column("__text")).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return source.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "fp bigint"]))


# --- trie self-join ---------------------------------------------------------


class Forest:
    """Union-find over 0 .. n - 1 that takes links in bulk."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            open_ = ra != rb
            if not open_.any():
                break
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(self.parent, high, low)
        self.parent = self.roots(self.parent)


def rotate(values: np.ndarray, start: int) -> np.ndarray:
    """Bits from ``start`` on moved to the top."""
    if start == 0:
        return values
    return (values << np.uint64(start)) | (values >> np.uint64(BITS - start))


def compare_ranges(sorted_fp: np.ndarray, forest: Forest, lo1, hi1, lo2, hi2, budget: int) -> None:
    """Link what the pairs of ranges hold; a range paired with itself has each pair once."""
    n1, n2 = hi1 - lo1, hi2 - lo2
    work = n1 * n2
    order = np.cumsum(work)
    start = 0
    while start < len(work):
        base = order[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(order, base + STEP_PAIRS, side="right")))
        w, cols = work[start:stop], n2[start:stop]
        inside = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        width = np.repeat(cols, w)
        a = np.repeat(lo1[start:stop], w) + inside // width
        b = np.repeat(lo2[start:stop], w) + inside % width
        near = (a != b) & (np.bitwise_count(sorted_fp[a] ^ sorted_fp[b]) <= budget)
        forest.link(a[near], b[near])
        start = stop


def trie_links(fps: np.ndarray, heads: np.ndarray, shared: int, budget: int = BUDGET) -> Forest:
    """Forest over values that are distinct and sorted within subtrees, which begin at ``heads``.

    Values of a subtree have ``shared`` first bits or more in common, so the walk
    starts below those. Pairs of trie nodes are five arrays: two ranges and the
    bits that differ so far.
    """
    forest = Forest(len(fps))
    if len(fps) < 2:
        return forest
    bounds = np.append(heads, len(fps))
    lo1, hi1 = bounds[:-1], bounds[1:]
    lo2, hi2, diff = lo1.copy(), hi1.copy(), np.zeros(len(lo1), dtype=np.int64)
    for level in range(shared, BITS + 1):
        small = ((hi1 - lo1) * (hi2 - lo2) <= LEAF * LEAF) | (level == BITS)
        if small.any():
            compare_ranges(fps, forest, lo1[small], hi1[small], lo2[small], hi2[small], budget)
            large = ~small
            lo1, hi1, lo2, hi2, diff = lo1[large], hi1[large], lo2[large], hi2[large], diff[large]
        if not len(lo1):
            break
        # below this level all bits may differ: the whole pair of subtrees links
        if BITS - level <= budget:
            sure = diff + (BITS - level) <= budget
            for l1, h1, l2, h2 in zip(lo1[sure], hi1[sure], lo2[sure], hi2[sure]):
                forest.link(np.arange(l1, h1), np.full(h1 - l1, l2))
                forest.link(np.arange(l2, h2), np.full(h2 - l2, l1))
            lo1, hi1, lo2, hi2, diff = lo1[~sure], hi1[~sure], lo2[~sure], hi2[~sure], diff[~sure]
        bit = (fps >> np.uint64(BITS - 1 - level)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        # inside a trie node the values with a 0 at this level come first
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        same = lo1 == lo2
        pairs = [
            (lo1, mid1, lo2, mid2, diff, None),
            (mid1, hi1, mid2, hi2, diff, None),
            (lo1, mid1, mid2, hi2, diff + 1, None),
            (mid1, hi1, lo2, mid2, diff + 1, ~same),
        ]
        kept = []
        for a, b, c, d, e, also in pairs:
            ok = (a < b) & (c < d) & (e <= budget)
            kept.append([x[ok if also is None else ok & also] for x in (a, b, c, d, e)])
        lo1, hi1, lo2, hi2, diff = (np.concatenate(x) for x in zip(*kept))
    return forest


def task_forest(fps: np.ndarray, task: np.ndarray, value: np.ndarray, shared: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root's fingerprint) within subtrees: rows of one ``task`` whose ``value`` leads with equal bits.

    ``value`` is the fingerprint with its bits in the trie's order. A row that came twice to a task counts once.
    """
    order = np.lexsort((value, task))
    fps, task, value = fps[order], task[order], value[order]
    fresh = np.ones(len(fps), dtype=bool)
    fresh[1:] = (task[1:] != task[:-1]) | (value[1:] != value[:-1])
    fps, task, value = fps[fresh], task[fresh], value[fresh]
    heads = np.append(0, np.flatnonzero(task[1:] != task[:-1]) + 1) if len(fps) else np.zeros(0, dtype=np.int64)
    forest = trie_links(value, heads, shared, budget)
    root = forest.roots(np.arange(len(fps)))
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def dealt(rows: DataFrame, budget: int) -> DataFrame:
    """Rows (fp, v, fixed, path) once for each of budget + 1 blocks of their free bits.

    The first ``fixed`` bits of ``v`` are shared in the row's subtree; the others are
    rotated so that the block comes next, and it is shared in the new subtree
    ``top``. ``path`` names the order of bits.
    """
    n = budget + 1
    block = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")
    cuts = rows.select("fp", "v", "fixed", "path", block).selectExpr(
        "fp", "v", "fixed", f"path * {n} + j + 1 AS path", f"CAST((64 - fixed) * j DIV {n} AS INT) AS a", f"CAST((64 - fixed) * (j + 1) DIV {n} AS INT) AS b", "64 - fixed AS free"
    )
    # all 64 bits are free at first; a shift by 64 would be one by 0
    mask = "CASE WHEN free = 64 THEN -1L ELSE shiftleft(1L, free) - 1L END"
    turned = cuts.withColumn("mask", F.expr(mask)).withColumn(
        "v", F.expr("(v & ~mask) | CASE WHEN a = 0 THEN v & mask ELSE (shiftleft(v & mask, a) | shiftrightunsigned(v & mask, free - a)) & mask END")
    )
    placed = turned.selectExpr("fp", "v", "fixed + b - a AS fixed", "path")
    return placed.withColumn("top", F.expr("CASE WHEN fixed >= 64 THEN v ELSE shiftrightunsigned(v, 64 - fixed) END"))


def paged(hot: DataFrame, page_rows: int) -> DataFrame:
    """Hot rows with ``page``: runs of ``page_rows`` neighbours of a subtree in the order of its trie."""
    # the order of unsigned values
    ranged = hot.withColumn("rank", F.col("v").bitwiseXOR(F.lit(-(2**63)))).repartitionByRange("path", "top", "rank").sortWithinPartitions("path", "top", "rank")
    placed = ranged.withColumn("part", F.spark_partition_id())
    own = hot.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # subtree, rows of its last page so far, number of that page
        last, n, page = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            pages = np.zeros(batch.num_rows, dtype=np.int64)
            path, top = batch.column("path").to_numpy(), batch.column("top").to_numpy()
            starts = np.append(0, np.flatnonzero((path[1:] != path[:-1]) | (top[1:] != top[:-1])) + 1)
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                if (path[a], top[a]) != last:
                    last, n, page = (path[a], top[a]), 0, page + 1
                pages[a:b] = page + (n + np.arange(b - a)) // page_rows
                page, n = page + (n + b - a) // page_rows, (n + b - a) % page_rows
            made = pa.array(pages + (np.int64(part) << np.int64(40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), made], names=[*own, "page"])

    kinds = dict(hot.dtypes)
    return placed.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in hot.columns), "page bigint"]))


def page_tasks(hot: DataFrame, budget: int, page_rows: int) -> DataFrame:
    """Hot rows once for each pair of pages that may hold a link, with ``task``.

    The bits at which all values of a page agree are those that its least and
    greatest lead with; two pages of which these differ in too many bits don't meet.
    """
    rows = cut(paged(hot, page_rows))
    rank = F.col("v").bitwiseXOR(F.lit(-(2**63)))
    pages = rows.groupBy("path", "top", "page").agg(F.min(rank).alias("low"), F.max(rank).alias("high"))
    spread = F.col("low").bitwiseXOR(F.col("high"))
    lead = F.when(spread == 0, 64).when(spread < 0, 0).otherwise(64 - F.length(F.bin(spread)))
    pages = cut(pages.select("path", "top", "page", "low", lead.alias("lead")))
    a, b = pages.alias("a"), pages.alias("b")
    both = F.least("a.lead", "b.lead")
    far = F.when(both == 0, 0).otherwise(F.bit_count(F.call_function("shiftrightunsigned", F.col("a.low").bitwiseXOR(F.col("b.low")), 64 - both)))
    met = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.top") == F.col("b.top")) & (F.col("a.page") <= F.col("b.page"))).filter(far <= budget)
    task = F.xxhash64(F.lit(1), "a.page", "b.page").alias("task")
    ends = F.array_distinct(F.array("a.page", "b.page"))
    return rows.join(met.select(task, F.explode(ends).alias("page")), "page").select("fp", "v", "fixed", "task")


def links(nodes: DataFrame, budget: int = BUDGET, hot_nodes: int = HOT_NODES, levels: int = LEVELS) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``nodes`` (fp)."""
    task = F.xxhash64(F.lit(0), "path", "top").alias("task")
    rows = dealt(nodes.select("fp", F.col("fp").alias("v"), F.lit(0).alias("fixed"), F.lit(0).cast("bigint").alias("path")), budget)
    tasks = None
    for level in range(levels):
        crowded = rows.groupBy("path", "top").agg(F.count("*").alias("n")).filter(F.col("n") > hot_nodes)
        hot = cut(crowded.select("path", "top"))
        if hot.isEmpty():
            whole = rows.select("fp", "v", "fixed", task)
            tasks = whole if tasks is None else tasks.unionByName(whole)
            break
        cold = rows.join(hot, ["path", "top"], "left_anti").select("fp", "v", "fixed", task)
        tasks = cold if tasks is None else tasks.unionByName(cold)
        again = cut(rows.join(hot, ["path", "top"], "left_semi"))
        if level == levels - 1:
            tasks = tasks.unionByName(page_tasks(again, budget, hot_nodes))
        else:
            rows = dealt(again, budget)

    names = ["fp", "v", "fixed", "task"]

    def linked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        fp, value = (table[c].to_numpy().view(np.uint64) for c in ("fp", "v"))
        fixed, of = table["fixed"].to_numpy(), table["task"].to_numpy()
        for shared in np.unique(fixed):
            own = fixed == shared
            a, b = task_forest(fp[own], of[own], value[own], int(shared), budget)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # subtrees come one after the other: held are TOGETHER rows of whole ones and the last, unfinished one
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows + batch.num_rows > TOGETHER and held:
                first = batch.column("task")[0].as_py()
                of = batch.column("task").to_numpy()
                ends = np.flatnonzero(of != first)
                # the subtree that goes on from the last batch ends here, if it does
                if held[-1].column("task")[-1].as_py() != first:
                    yield from linked(held)
                    held, rows = [], 0
                elif len(ends):
                    yield from linked([*held, batch.slice(0, int(ends[0]))])
                    held, rows, batch = [], 0, batch.slice(int(ends[0]))
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from linked(held)

    return tasks.select(names).repartition("task").sortWithinPartitions("task").mapInArrow(run, "a bigint, b bigint").distinct()


# --- components -------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge (a, b); the root is the component's least node.

    A round gives each node the least label around it, then the label of its
    label; it ends when no edge has two labels.
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"), F.count("*").alias("n")))
    labels = seen.select(F.col("a").alias("node"), "root")
    # each link is there both ways, so a node has as many rows at b as at a; the middle of a star has very many
    crowded = cut(seen.filter(F.col("n") > CROWDED_ROWS).select(F.col("a").alias("b")))
    for _ in range(rounds):
        near = split_join(both, labels.select(F.col("node").alias("b"), "root"), "b", "a", crowded).groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("root"))
        # what a label learns goes to all that carry it: roots hook to lower roots
        lower = labels.join(hooked.select("node", F.col("root").alias("new")), "node").groupBy(F.col("root").alias("old")).agg(F.min("new").alias("low"))
        # one root may stand for a third of all nodes: its rows are spread
        lower = lower.filter("low < old").select(F.col("old").alias("root"), "low")
        moved = salted_join(hooked, lower, "root", "node", "left").select("node", F.least("root", F.coalesce("low", "root")).alias("root"))
        after = cut(moved)
        changed = after.alias("x").join(labels.alias("y"), "node").filter("x.root <> y.root")
        done = changed.isEmpty()
        labels = after
        if done:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, row_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: row (``row_col``, if given), doc_key, fp, component (least id of its class), first_row."""
    rows = df.select(row_numbers(row_col).alias("row"), F.col(id_col).alias("doc_key"), F.col(text_col).alias("text"))
    marked = cut(fingerprints(rows, keep=("row", "doc_key")))
    # null ids come last
    rank = F.struct(F.col("doc_key").isNull().alias("none"), "doc_key", "row")
    nodes = cut(marked.groupBy("fp").agg(F.min(rank).alias("least"), F.count("*").alias("n")))
    labels = components(links(nodes.select("fp"), budget))
    rooted = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # single nodes name themselves; one root may stand for a third of the others, so its rows are spread
    shared = rooted.groupBy("root").agg(F.min("least").alias("best"), F.count("*").alias("nodes")).filter("nodes > 1").select("root", "best")
    named = cut(salted_join(rooted, shared, "root", "fp", "left").select("fp", F.coalesce("best", "least").alias("best")))
    crowded = nodes.filter(F.col("n") > CROWDED_ROWS).select("fp")
    return split_join(marked, named, "fp", "row", crowded).select("row", "doc_key", "fp", F.col("best.doc_key").alias("component"), F.col("best.row").alias("first_row"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per row: its id, fingerprint (16 hex digits) and component_id."""
    found = near_groups(df, id_col, text_col, budget)
    return found.select(F.col("doc_key").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprint and component of every document."""
    return dedup(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one with the least id."""
    rows, number = numbered(docs)
    dropped = near_groups(rows, row_col=number).filter(F.col("row") != F.col("first_row")).select(F.col("row").alias(number))
    return without_rows(rows, dropped, number).select(*columns_of(docs))
