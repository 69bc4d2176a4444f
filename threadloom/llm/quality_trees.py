"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features (``text_stats.FEATURES``) of at most ``FIT_ROWS`` labelled documents,
the least by a hash of the id, are computed on the executors; the small matrix
is binned by quantiles and boosted in numpy. Trees grow level by level: one
histogram of gradients and hessians over (node, feature, bin) gives every split
of a level. All trees are flattened into arrays (feature, threshold, child,
value), which tasks walk for all documents of a slice at once.

Results at the edges: a null text counts as empty and is scored like any other;
very long texts are read whole, in a slice of their own; without labelled rows
every score is the prior 0.5; null ids and labels other than 0 and 1 are not
learned from; repeated rows get equal scores; no column but id and text is read,
whatever its name, and the stage returns them as they are; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, documents, id_remainder, plain_strings, read_table, refuse_clash, text_slices
from .text_stats import FEATURES, features

#: Labelled documents that the trees are fitted on, at most.
FIT_ROWS = 20_000

CUT_SCORE = 0.7


@dataclass
class Forest:
    """Trees as flat arrays; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' leaves for each row of ``x``, all trees walked together."""
        out = np.full(len(x), self.base)
        for start in range(0, len(x), 4096):
            part = x[start : start + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots))).copy()
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                go_left = part[row, self.feature[node]] <= self.threshold[node]
                node = np.where(go_left, self.left[node], self.right[node])
            out[start : start + 4096] += self.value[node].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -40, 40)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Split points of each feature: its distinct quantiles."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least_leaf: float = 2.0) -> Forest:
    """Boost ``trees`` trees on the logistic loss of labels ``y`` (0 or 1)."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(v: float) -> int:
        i = len(value)
        feature.append(0), threshold.append(0.0), left.append(i), right.append(i), value.append(v)
        return i

    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(prior / (1 - prior)))
    done = lambda: Forest(*(np.array(a) for a in (feature, threshold, left, right, value, roots)), depth, base)
    if len(np.unique(y)) < 2:
        roots.append(add(0.0))
        return done()
    edges = bin_edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    n, m = binned.shape
    score = np.full(n, base)
    columns = np.arange(m) * bins
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        # nodes of the level: ids in the flat arrays; place: each row's node, -1 once in a leaf
        nodes, place = [add(0.0)], np.zeros(n, dtype=np.int64)
        roots.append(nodes[0])
        for level in range(depth + 1):
            k = len(nodes)
            live = np.flatnonzero(place >= 0)
            cells = (place[live, None] * (m * bins) + columns[None, :] + binned[live]).ravel()
            hg = np.bincount(cells, np.repeat(g[live], m), k * m * bins).reshape(k, m, bins)
            hh = np.bincount(cells, np.repeat(h[live], m), k * m * bins).reshape(k, m, bins)
            sum_g, sum_h = hg[:, 0].sum(axis=1), hh[:, 0].sum(axis=1)
            for i, node in enumerate(nodes):
                value[node] = float(-rate * sum_g[i] / (sum_h[i] + l2))
            if level == depth:
                break
            lg, lh = np.cumsum(hg, axis=2)[:, :, :-1], np.cumsum(hh, axis=2)[:, :, :-1]
            rg, rh = sum_g[:, None, None] - lg, sum_h[:, None, None] - lh
            gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - (sum_g**2 / (sum_h + l2))[:, None, None]
            gain[(lh < least_leaf) | (rh < least_leaf)] = -np.inf
            best = gain.reshape(k, -1).argmax(axis=1)
            top = gain.reshape(k, -1)[np.arange(k), best]
            next_nodes, move = [], np.full((k, 2), -1)
            which, at = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
            for i, node in enumerate(nodes):
                f, b = divmod(int(best[i]), bins - 1)
                if top[i] <= 1e-6 or b >= len(edges[f]):
                    continue
                feature[node], threshold[node] = f, float(edges[f][b])
                left[node], right[node] = add(0.0), add(0.0)
                which[i], at[i] = f, b
                move[i] = len(next_nodes), len(next_nodes) + 1
                next_nodes += [left[node], right[node]]
            side = (binned[live, which[place[live]]] > at[place[live]]).astype(np.int64)
            stay = move[place[live], 0] < 0
            score[live[stay]] += np.array(value)[np.array(nodes)[place[live[stay]]]]
            place[live] = move[place[live], side]
            nodes = next_nodes
            if not nodes:
                break
        live = np.flatnonzero(place >= 0)
        if len(live):
            score[live] += np.array(value)[np.array(nodes)[place[live]]]
    return done()


def feature_rows(df: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` and ``features`` (array<double>) of each row."""
    refuse_clash(keep, "features")
    source = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                x = features(plain_strings(part.column("__text")))
                made = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), made], names=[*keep, "features"])

    return source.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "features array<double>"]))


def fit_on(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Forest:
    """Trees fitted on the labelled documents for whose ``doc_id`` ``learn`` holds.

    At most ``fit_rows`` labels are drawn, and of the rows that have their ids (an
    id may be repeated) at most ``fit_rows`` bring their features to the driver.
    """
    known = labels.filter(learn & F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("y"))
    chosen = bounded_sample(known, "doc_id", fit_rows)
    # at most fit_rows pairs of numbers, so they can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    table = feature_rows(rows, ("doc_id", "y")).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "y", "features").limit(fit_rows).toArrow()
    x = np.array(table["features"].combine_chunks().values if table.num_rows else []).reshape(-1, len(FEATURES))
    y = table["y"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[::-1], y, table["doc_id"].to_numpy()))
    return fit(x[order], y[order])


def score(df: DataFrame, model: Forest, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", cut_score: float = CUT_SCORE) -> DataFrame:
    """``keep``, score and predicted (1 from ``cut_score`` on) of each row."""
    refuse_clash(keep, "score", "predicted")
    source = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(source.dtypes)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                s = held.value.scores(features(plain_strings(part.column("__text"))))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(s), pa.array((s >= cut_score).astype(np.int32))], names=[*keep, "score", "predicted"]
                )

    return source.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "score double", "predicted int"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: quality of every document, learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = fit_on(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier predicts to be good."""
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = fit_on(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                good = held.value.scores(features(plain_strings(part.column("text")))) >= CUT_SCORE
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
