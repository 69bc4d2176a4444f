"""Quality rules with risk-controlled thresholds.

Every rule is a statistic and a fixed list of cutoffs, laxest first. Labelled
documents that pass the base rules are the holdout, one for each distinct text
(letter case aside), because copies are no separate trials; a good one that a
cutoff rejects is a false rejection. Per stratum (band of lengths) and rule, cutoffs
are tested in order: with k of n good holdout documents rejected, a cutoff is
certified while P(Binomial(n, limit) <= k) <= level, which is to say while the
exact (Clopper-Pearson) upper bound of its false-rejection rate is within the
limit. The limit of a stratum is split evenly over the rules (their union
rejects at most the sum) and the error level evenly over all pairs of stratum
and rule (Bonferroni); within a pair the fixed order needs no more correction.
With probability 1 - ``ERROR`` no stratum loses more than ``LIMIT`` of its good
documents. Among certified cutoffs, the laxest one that catches most of the bad
holdout documents at least cost is used; without a certified cutoff a rule is
off, so strata with few labels reject nothing beyond the base rules.

Results at the edges: a null text has no words, so the base rules reject it; an
empty one likewise; texts are read whole, a very long one in a slice of its own;
rows without label, or with a null one, are judged but not learned from; repeated
rows are judged alike and are one trial; a text with labels that contradict one
another counts as good, so the bound errs to the side of keeping; no column but
id and text is read, whatever its name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, plain_strings, read_table, refuse_clash, text_slices
from .text_stats import _SYMBOL, _UPPER, TextSlice, line_stats

#: Share of good documents that a stratum may lose, and the chance that one loses more.
LIMIT, ERROR = 0.05, 0.05

#: Lengths (words) at which the bands begin.
BANDS = (0, 200, 1000)

#: What a point of good documents lost weighs against a point of bad ones caught.
COST = 20.0

#: Rule: statistic, and whether too much (1) or too little (-1) of it is bad; cutoffs, laxest first.
RULES: dict[str, tuple[str, int, list[float]]] = {
    "symbols": ("symbol_share", 1, [round(0.5 * 0.86**i, 6) for i in range(30)]),
    "capitals": ("upper_share", 1, [round(0.98 - 0.03 * i, 6) for i in range(30)]),
    "repeats": ("repeat_share", 1, [round(0.5 * 0.88**i, 6) for i in range(30)]),
    "same_lines": ("dup_line_share", 1, [round(0.9 * 0.88**i, 6) for i in range(30)]),
    "long_words": ("mean_word", 1, [round(40 * 0.93**i, 6) for i in range(30)]),
    "short_words": ("mean_word", -1, [round(0.5 + 0.125 * i, 6) for i in range(30)]),
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")


#: A hash of the text in lower case: what rows of one trial have in common.
TEXT_KEY = "__text_key"


def counts(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, TEXT_KEY and COUNTS of each row."""
    refuse_clash(keep, *COUNTS)
    source = df.select(*keep, F.xxhash64(F.lower(F.col(text_col))).alias(TEXT_KEY), F.col(text_col).alias("__text"))
    keep = (*keep, TEXT_KEY)
    kinds = dict(source.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                texts = plain_strings(part.column("__text"))
                s = TextSlice(texts)
                lines, dup, _ = line_stats(texts)
                made = (s.n_words, s.word_chars(), s.count(_SYMBOL), dup, s.repeat_words(*s.word_codes()), s.count(_UPPER), lines)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(x.astype(np.int64)) for x in made)], names=[*keep, *COUNTS])

    return source.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), *(f"{c} bigint" for c in COUNTS)]))


def base_failed() -> Column:
    """The fixed base rules: too few words, or over half of them repeated."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def statistic(name: str) -> Column:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "upper_share": F.col("n_upper") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "mean_word": F.col("word_chars") / words,
    }[name]


def band(n_words: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(n_words >= least, i).otherwise(out)
    return out


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k): the regularised incomplete beta function of 1 - p, by its continued fraction.

    Some tens of terms are enough for any n, where the sum has k + 1.
    """
    if k >= n:
        return 1.0
    return beta_share(float(n - k), float(k + 1), 1.0 - p)


def beta_share(a: float, b: float, x: float, tiny: float = 1e-300) -> float:
    """I_x(a, b), the share of a beta distribution's mass up to x."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        # there the fraction of the other tail converges fast
        return 1.0 - beta_share(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    # the terms needed grow with the root of the larger parameter
    for m in range(1, 200 + int(10 * math.sqrt(max(a, b)))):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            c, d = 1.0 + term / c, 1.0 + term * d
            c, d = c if abs(c) > tiny else tiny, 1.0 / (d if abs(d) > tiny else tiny)
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def choose(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int, limit: float, level: float) -> int | None:
    """Place of the cutoff to use: of the certified ones, the best and then laxest.

    good, bad: documents that each cutoff rejects; they grow along the list.
    """
    best, found = 0.0, None
    for i, k in enumerate(good.tolist()):
        if binomial_cdf(k, n_good, limit) > level:
            break
        worth = (bad[i] / n_bad if n_bad else 0.0) - COST * k / max(n_good, 1)
        if worth > best + 1e-12:
            best, found = worth, i
    return found


def rejecting(name: str, sign: int, cutoffs: list[float]) -> Column:
    """How many of the cutoffs spare the document: the first that rejects it has this place."""
    stat = statistic(name)
    spared = [F.when(stat <= c if sign > 0 else stat >= c, 1).otherwise(0) for c in cutoffs]
    total = spared[0]
    for s in spared[1:]:
        total = total + s
    return total


def holdout(stats: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """COUNTS and label of the labelled rows that pass the base rules, one row for each distinct text."""
    marks = labels.filter(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).alias("label"))
    rows = stats.filter(~base_failed()).join(marks, "doc_id")
    first = F.min(F.struct("doc_id", *COUNTS)).alias("s")
    return rows.groupBy(TEXT_KEY).agg(first, F.max("label").alias("label")).select("s.*", "label")


def certify(stats: DataFrame, labels: DataFrame, label_col: str = "quality", limit: float = LIMIT, error: float = ERROR) -> dict[tuple[int, str], float]:
    """Cutoffs in use by (band, rule). Only the table of counts comes to the driver."""
    held = holdout(stats, labels, label_col)
    places = F.array(*[F.struct(F.lit(r).alias("rule"), rejecting(*spec).alias("place")) for r, spec in RULES.items()])
    table = held.select(band(F.col("n_words")).alias("band"), "label", F.explode(places).alias("r")).groupBy("band", "label", "r.rule", "r.place").count().collect()
    level = error / (len(BANDS) * len(RULES))
    out = {}
    for b in range(len(BANDS)):
        for rule, (_, _, cutoffs) in RULES.items():
            first = {0: np.zeros(len(cutoffs) + 1, dtype=np.int64), 1: np.zeros(len(cutoffs) + 1, dtype=np.int64)}
            for row in table:
                if row["band"] == b and row["rule"] == rule:
                    first[row["label"]][row["place"]] += row["count"]
            rejected = {label: np.cumsum(f)[:-1] for label, f in first.items()}
            at = choose(rejected[1], rejected[0], int(first[1].sum()), int(first[0].sum()), limit / len(RULES), level)
            if at is not None:
                out[b, rule] = cutoffs[at]
    return out


def judge(stats: DataFrame, cutoffs: dict[tuple[int, str], float]) -> DataFrame:
    """``stats`` with base_failed, band, failed_rules and kept."""
    failed = [F.lit(None).cast("string")]
    for (b, rule), c in sorted(cutoffs.items()):
        name, sign, _ = RULES[rule]
        over = statistic(name) > c if sign > 0 else statistic(name) < c
        failed.append(F.when((band(F.col("n_words")) == b) & over, F.lit(rule)))
    out = stats.withColumns({"base_failed": base_failed(), "band": band(F.col("n_words")), "failed_rules": F.array_compact(F.array(*failed))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: statistics and verdict of every document."""
    stats = cut(counts(documents(spark, sf_dir)))
    judged = judge(stats, certify(stats, read_table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
