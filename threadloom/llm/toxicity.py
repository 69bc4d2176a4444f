"""Toxicity by non-negative positive-unlabelled learning.

Learned from confirmed toxic documents (P) and unlabelled text (U); negatives
are never needed. Features are whole words and word beginnings (3 to 6 letters),
hashed to 64 bits. All executors count in how many P and U documents each
feature occurs; the ``FEATURES`` that stand out most in P are kept. A document
is its distinct words with each kept feature, log-scaled, next to its log
length. A linear numpy classifier minimises the class-prior-corrected risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss; whenever the second term falls below zero, its gradient
is turned round, so the risk cannot be lowered by overfitting U. The prior is
the share of toxic ones among labelled rows of the learning folds.

P and U are bounded samples (``FIT_TOXIC``, ``FIT_OTHER`` rows, least by a hash
of the id); scoring looks up each distinct word of a slice once.

Results at the edges: null and empty texts are scored by the bias alone; very
long texts are read whole, in a slice of their own; with no toxic row to learn
from every score is 0; labels other than 0 and 1 are not learned from; repeated
rows get equal scores; no column but id and text is read, whatever its name; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, cut, documents, encode_words, id_remainder, list_parts, plain_strings, read_table, refuse_clash, text_slices

FIT_TOXIC = 6_000
FIT_OTHER = 12_000
FEATURES = 20_000
LEAST_TOXIC_DOCS = 3
LEAST_RATIO = 2.0
BEGINNINGS = (3, 4, 5, 6)


def letter_words(texts: pa.Array) -> pa.ListArray:
    """Runs of letters and digits of each text in lower case."""
    return pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}\p{N}]+", " "), " ")


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of each word (itself and its beginnings), and the word each is of."""
    c = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(sizes) - sizes
    h = np.full(len(words), 0xCBF29CE484222325, dtype=np.uint64)
    out, owner = [], []
    live = np.flatnonzero(sizes > 0)
    k = 0
    while len(live):
        h[live] = (h[live] ^ c[start[live] + k]) * np.uint64(0x100000001B3)
        k += 1
        if k in BEGINNINGS:
            out.append(h[live] ^ np.uint64(0x9E3779B97F4A7C15))
            owner.append(live)
        ended = live[sizes[live] == k]
        out.append(h[ended])
        owner.append(ended)
        live = live[sizes[live] > k]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.concatenate(out)
    return x ^ (x >> np.uint64(31)), np.concatenate(owner)


def document_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Distinct (text, word code) pairs as two arrays, the words by code, words in each text."""
    words, offsets = list_parts(letter_words(texts))
    codes, distinct = encode_words(words)
    names = distinct.to_pylist()
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = np.unique(text_of * np.int64(max(1, len(names))) + codes)
    text, code = pairs // max(1, len(names)), pairs % max(1, len(names))
    real = np.array([bool(w) for w in names], dtype=bool)
    ok = real[code] if len(code) else np.zeros(0, bool)
    return text[ok], code[ok], names, np.bincount(text[ok], minlength=len(texts))


def text_features(texts: pa.Array, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, distinct words that have it) triples, and distinct words of each text.

    With ``known`` (sorted hashes) only those features, as their places in it.
    """
    text, code, names, n_words = document_words(texts)
    hashes, owner = word_features(names)
    if known is not None:
        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        feature, owner = at[hit], owner[hit]
        table = known
    else:
        table, feature = np.unique(hashes, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    per_word = np.bincount(owner, minlength=len(names))
    first = np.cumsum(per_word) - per_word
    times = per_word[code]
    ends = np.cumsum(times)
    where = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times) + np.repeat(first[code], times)
    key = np.repeat(text, times) * np.int64(max(1, len(table))) + feature[where]
    key, n = np.unique(key, return_counts=True)
    place = key % max(1, len(table))
    return key // max(1, len(table)), place if known is not None else table[place], n, n_words


@dataclass
class ToxicModel:
    known: np.ndarray
    weight: np.ndarray
    length_weight: float
    bias: float
    fitted: bool

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        text, place, n, n_words = text_features(texts, self.known)
        raw = np.bincount(text, self.weight[place] * np.log1p(n), len(texts)) + self.bias + self.length_weight * np.log1p(n_words)
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -40, 40)))


def fit_nnpu(
    row: np.ndarray, place: np.ndarray, value: np.ndarray, length: np.ndarray, positive: np.ndarray, n_features: int, prior: float,
    steps: int = 250, rate: float = 0.05, l2: float = 2e-5,
) -> tuple[np.ndarray, float, float]:
    """Weights, length weight and bias; rows are documents, positive marks P, the rest is U."""
    n = len(positive)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    theta = np.zeros(n_features + 2)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(row, theta[place] * value, n) + theta[-2] * length + theta[-1]
        s = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        soft = np.logaddexp(0.0, z)
        negative_risk = soft[~positive].mean() - prior * soft[positive].mean()
        # d softplus(z) = s, d softplus(-z) = s - 1
        down = np.where(positive, -prior * s / n_p, s / n_u)
        up = np.where(positive, prior * (s - 1) / n_p, 0.0)
        dz = up + down if negative_risk >= 0 else -down
        grad = np.concatenate([np.bincount(place, dz[row] * value, n_features), [dz @ length, dz.sum()]])
        grad[:-1] += l2 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta[:-2], float(theta[-2]), float(theta[-1])


def feature_documents(rows: DataFrame) -> DataFrame:
    """(feature, positive documents, other documents) of rows (text, positive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                text, feature, _, _ = text_features(plain_strings(part.column("text")), None)
                of = part.column("positive").to_numpy(zero_copy_only=False)[text].astype(np.float64)
                seen, inverse = np.unique(feature, return_inverse=True)
                p = np.bincount(inverse, of, len(seen)).astype(np.int64)
                u = np.bincount(inverse, 1 - of, len(seen)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(p), pa.array(u)], names=["feature", "p", "u"])

    return rows.mapInArrow(run, "feature bigint, p bigint, u bigint").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def known_features(rows: DataFrame, known: np.ndarray) -> DataFrame:
    """rows (doc_id, text, positive) as (doc_id, positive, places, counts, n_words)."""
    held = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                text, place, n, n_words = text_features(plain_strings(part.column("text")), held.value)
                ends = np.searchsorted(text, np.arange(part.num_rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32))) for x in (place, n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("positive"), *lists, pa.array(n_words.astype(np.int64))], names=["doc_id", "positive", "places", "counts", "n_words"]
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, positive boolean, places array<int>, counts array<int>, n_words bigint")


def fit_on(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_other: int = FIT_OTHER) -> ToxicModel:
    """A model learned from the rows for whose ``doc_id`` ``learn`` holds."""
    known = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).alias("y"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    empty = ToxicModel(np.zeros(0, np.uint64), np.zeros(0), 0.0, 0.0, False)
    if not n_toxic:
        return empty
    prior = min(0.9, max(1e-4, n_toxic / n))
    toxic = bounded_sample(known.filter("y = 1").select("doc_id").distinct(), "doc_id", fit_toxic)
    other = bounded_sample(docs.filter(learn & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id", fit_other, salt=12)
    both = toxic.select("doc_id", F.lit(True).alias("positive")).unionByName(other.select("doc_id", F.lit(False).alias("positive")))
    # at most fit_toxic + fit_other ids, so they can be broadcast
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(both), "doc_id").select("doc_id", "text", "positive"))
    # an id may be of several rows: all are counted, but only bounded numbers of rows come to the driver
    size = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    n_p, n_u = max(1, size.get(True, 0)), max(1, size.get(False, 0))
    rate_p, rate_u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    counted = feature_documents(rows).filter((F.col("p") >= LEAST_TOXIC_DOCS) & (rate_p >= LEAST_RATIO * rate_u))
    best = counted.orderBy(F.desc(F.col("p") * F.log(rate_p / rate_u)), "feature").limit(FEATURES).select("feature").toArrow()
    names = np.sort(best["feature"].to_numpy().view(np.uint64))
    found = cut(known_features(rows, names))
    drawn = lambda which, n: found.filter(which).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "places", "counts").limit(n)
    table = drawn("positive", fit_toxic).unionByName(drawn("NOT positive", fit_other)).toArrow()
    if not table.num_rows or not len(names):
        return empty
    table = table.sort_by([("doc_id", "ascending"), ("positive", "ascending")]).combine_chunks()
    places, counts = table["places"].combine_chunks(), table["counts"].combine_chunks()
    flat, ends = list_parts(places)
    n_of, _ = list_parts(counts)
    weight, by_length, bias = fit_nnpu(
        np.repeat(np.arange(table.num_rows), np.diff(ends)), flat.to_numpy(), np.log1p(n_of.to_numpy()), np.log1p(table["n_words"].to_numpy()),
        table["positive"].to_numpy(), len(names), prior,
    )
    return ToxicModel(names, weight, by_length, bias, True)


def score(df: DataFrame, model: ToxicModel, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, score and predicted (1 from 0.5 on) of each row."""
    refuse_clash(keep, "score", "predicted")
    source = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(source.dtypes)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text", 3 << 20):
                s = held.value.scores(plain_strings(part.column("__text")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "score double", "predicted int"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: toxicity of every document, learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = fit_on(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
