"""Quality rules, mixing and the three classifiers: brute force, guarantees, held-out accuracy, edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import language_id as L
from threadloom.llm import mixing as M
from threadloom.llm import quality_rules as R
from threadloom.llm import quality_trees as Q
from threadloom.llm import toxicity as X
from threadloom.llm.text_stats import FEATURES, TextSlice, features, line_stats

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "\t\x0b\x0c\r", "one", "a b c", "a b c a b c", "é é é é", "# $ % & | < > *", "x\nx\ny\nx\n \n \n", "w " * 30000, "nb sp　wide"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_counts(text):
    w = words_of(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def random_texts(seed, n):
    rnd = random.Random(seed)
    vocab = ["a", "b", "ccc", "ÄÖ", "#", "<x>", "\n", "\n\n", "\t", "the"]
    return ["".join(rnd.choice(vocab) + rnd.choice([" ", " ", "\n", ""]) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


# --- quality rules ----------------------------------------------------------


def test_counts_equal_brute_force(spark):
    texts = ODD + random_texts(3, 300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in R.counts(df).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_binomial_bound_is_exact():
    for n, k, p in [(10, 3, 0.2), (700, 2, 0.01), (50, 50, 0.3), (1, 0, 0.5)]:
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert R.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)


def test_choose_keeps_the_limit():
    bad = np.arange(1, 31) * 10
    assert R.choose(np.zeros(30, int), bad, 100, 400, 0.01, 0.003) is None  # too few labels to certify anything
    at = R.choose(np.zeros(30, int), bad, 2000, 400, 0.01, 0.003)
    assert at == 29
    good = np.array([0] * 10 + [500] * 20)
    assert R.choose(good, bad, 2000, 400, 0.01, 0.003) == 9


def test_false_rejections_stay_within_the_limit():
    """Over many holdouts a useless statistic must not cost more than the limit, but for the error level."""
    rnd = np.random.default_rng(0)
    cutoffs = np.linspace(0.999, 0.9, 30)
    broken = 0
    for _ in range(200):
        good, bad = rnd.random(2000), rnd.random(400) * 1.5
        at = R.choose((good[:, None] > cutoffs).sum(0), (bad[:, None] > cutoffs).sum(0), 2000, 400, 0.03, 0.05)
        broken += at is not None and 1 - cutoffs[at] > 0.03
    assert broken <= 20


def test_verdicts_without_labels(spark):
    df = spark.createDataFrame([(1, None), (2, " ".join(f"w{i}" for i in range(80))), (3, "a b c " * 40)], "doc_id long, text string")
    stats = R.counts(df)
    cutoffs = R.certify(stats, spark.createDataFrame([], "doc_id long, quality int"))
    assert cutoffs == {}
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in R.judge(stats, cutoffs).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (True, False)}


def at_most(k, n, p):
    """P(Binomial(n, p) <= k), term by term."""
    term = total = (1 - p) ** n
    for j in range(k):
        term *= (n - j) / (j + 1) * p / (1 - p)
        total += term
    return total


def brute_verdicts(texts, labels):
    """base_failed and kept of each text by plain counting: {id: text}, [(id, label)]."""
    stats = {}
    for i, t in texts.items():
        n, chars, symbols, dup, repeats = brute_counts(t)
        upper = sum(c.isupper() for c in t or "")
        lines = sum(1 for line in (t or "").split("\n") if words_of(line))
        w, c = max(n, 1), max(chars, 1)
        share = {"symbol_share": symbols / c, "upper_share": upper / c, "repeat_share": repeats / w, "dup_line_share": dup / max(lines, 1), "mean_word": chars / w}
        stats[i] = (n, n < 50 or 100 * repeats > 50 * n, share)
    band = lambda n: sum(n >= b for b in R.BANDS) - 1
    trials = {}
    for i, y in sorted(labels):
        if i in stats and not stats[i][1]:
            key = (texts[i] or "").lower()
            first, label = trials.get(key, (i, 0))
            trials[key] = (first, max(label, y))
    over = lambda rule, cutoff, share: share[R.RULES[rule][0]] > cutoff if R.RULES[rule][1] > 0 else share[R.RULES[rule][0]] < cutoff
    level, limit = R.ERROR / (len(R.BANDS) * len(R.RULES)), R.LIMIT / len(R.RULES)
    chosen = {}
    for b in range(len(R.BANDS)):
        held = [(stats[i][2], y) for i, y in trials.values() if band(stats[i][0]) == b]
        n_good, n_bad = sum(y for _, y in held), sum(1 - y for _, y in held)
        for rule, (_, _, cutoffs) in R.RULES.items():
            best = 0.0
            for cutoff in cutoffs:
                k = sum(y and over(rule, cutoff, x) for x, y in held)
                if k >= n_good or at_most(k, n_good, limit) > level:
                    break
                caught = sum((not y) and over(rule, cutoff, x) for x, y in held)
                worth = (caught / n_bad if n_bad else 0.0) - R.COST * k / max(n_good, 1)
                if worth > best + 1e-12:
                    best, chosen[b, rule] = worth, cutoff
    return {i: (failed, not failed and not any(b == band(n) and over(rule, c, x) for (b, rule), c in chosen.items())) for i, (n, failed, x) in stats.items()}, chosen


def test_verdicts_equal_brute_force(spark):
    rnd = random.Random(12)
    vocab = [f"word{i}" for i in range(300)]
    texts, labels = {}, []
    for i in range(2600):
        bad = rnd.random() < 0.15
        words = [rnd.choice(vocab) + ("###$$" if bad and rnd.random() < 0.6 else "") for _ in range(rnd.randint(55, 120))]
        texts[i] = " ".join(words)
        labels.append((i, 0 if bad else 1))
    for i in range(200):  # copies are no trials of their own
        texts[3000 + i] = texts[i].upper() if i % 2 else texts[i]
        labels.append((3000 + i, 0))
    texts |= {4000: None, 4001: "", 4002: "few words"}
    want, chosen = brute_verdicts(texts, labels)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    stats = R.counts(df).cache()
    cutoffs = R.certify(stats, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert cutoffs == pytest.approx(chosen) and len(chosen) > 0
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in R.judge(stats, cutoffs).collect()} == want
    assert R.holdout(stats, spark.createDataFrame(labels, "doc_id long, quality int")).count() == len({t.lower() for i, t in texts.items() if t and i < 4000})


# --- mixing -----------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free = {}, set(order)
    left = float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def mixed_rows():
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        source = rnd.choice([None, "a", "b", "B", "é", "hot", "hot", "hot", "tiny"]) if i % 40 else "tiny"
        rows.append((i, " ".join(["w"] * rnd.choice([0, 1, 5, 50, 51, 400 if source == "hot" else 3])), source))
    return rows + [(1000, None, "empty"), (1001, "", "empty"), (1002, "x " * 20000, "hot"), (2007, "dup row", "a"), (2007, "dup row", "a"), (None, "no id", "b")]


def test_mixing_meets_its_targets(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = M.mix(df).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    want = brute_targets(dict(sizes))
    per = Counter()
    of = {i: s for i, _, s in rows}
    for r in out:
        assert r["source_size"] == sizes[of[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[of[r["doc_id"]]], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        per[of[r["doc_id"]]] += r["taken"]
    for s, t in want.items():
        assert abs(per[s] - t) <= max(0.01 * t, 60), (s, per[s], t)
    again = M.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)


def test_rates_are_the_exponential_tilt(spark):
    """The dual's solution: one multiplier a source reproduces its target exactly before rounding."""
    hist = spark.createDataFrame([("a", s, 10) for s in (1, 2, 5, 9, 30)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 470, 800.0)], "source string, source_size long, target double")
    r = M.newton(hist, targets).first()
    words = sum(10 * s * min(3.0, math.exp(r["tilt"] * s / r["mean"])) for s in (1, 2, 5, 9, 30))
    assert words == pytest.approx(800.0, rel=1e-6)


def test_mixing_empty_table(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# --- text statistics --------------------------------------------------------


def test_text_statistics():
    texts = [t or "" for t in ODD] + random_texts(8, 200)
    s = TextSlice(pa.array(texts))
    assert s.n_words.tolist() == [len(words_of(t)) for t in texts]
    distinct, most = s.distinct_words(*s.word_codes())
    assert distinct.tolist() == [len(set(words_of(t))) for t in texts]
    assert most.tolist() == [max(Counter(words_of(t)).values(), default=0) for t in texts]
    assert line_stats(pa.array(texts))[1].tolist() == [brute_counts(t)[3] for t in texts]
    x = features(pa.array(texts))
    assert x.shape == (len(texts), len(FEATURES)) and np.isfinite(x).all()


# --- classifiers ------------------------------------------------------------


def auc(y, score):
    pos, neg = [s for s, k in zip(score, y) if k], [s for s, k in zip(score, y) if not k]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def held_rows(spark, out, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(F.col(label).isNotNull()).select("doc_id", label)
    return out.join(labels, "doc_id").filter("held_out").collect()


def test_quality_on_held_out_rows(spark):
    out = Q.query(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = held_rows(spark, out, "quality")
    assert auc([r["quality"] for r in rows], [r["score"] for r in rows]) > 0.95
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.93 * len(rows)


def test_toxicity_on_held_out_rows(spark):
    rows = held_rows(spark, X.query(spark, SF), "toxic")
    assert auc([r["toxic"] for r in rows], [r["score"] for r in rows]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_language_on_held_out_rows(spark):
    out = L.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows)


def test_flat_trees_equal_walking(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, len(FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = Q.fit(x, y)

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return total

    assert forest.raw(x[:50]) == pytest.approx([walk(r) for r in x[:50]])
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.97


def test_unlabelled_fit_recovers_the_positives():
    """Positives hidden in U are found although no negative is labelled."""
    rnd = np.random.default_rng(2)
    n, toxic = 3000, rnd.random(3000) < 0.2
    has = rnd.random((n, 40)) < np.where(toxic[:, None], 0.3, 0.05)
    positive = toxic & (rnd.random(n) < 0.5)
    row, place = np.nonzero(has)
    w, length_w, b = X.fit_nnpu(row, place, np.ones(len(row)), np.zeros(n), positive, 40, 0.2)
    z = np.bincount(row, w[place], n) + b
    hidden = ~positive
    assert auc(toxic[hidden].tolist()[:800], z[hidden].tolist()[:800]) > 0.95


def test_language_bits_equal_one_filter_a_language():
    """Bits, rates and verdicts against a set of slots for each language."""
    rnd = np.random.default_rng(3)
    profiles = {f"l{i:02d}": rnd.integers(0, 2**63, 300).astype(np.uint64) for i in range(70)}  # more than one word of bits
    f = L.LanguageFilter.build(profiles, "l00")
    slots = {name: {int(x) for s in L.slots_of(g) for x in s} for name, g in profiles.items()}
    probe = np.concatenate([rnd.integers(0, 2**63, 400).astype(np.uint64), *[g[:20] for g in profiles.values()]])
    places = L.slots_of(probe)
    for i, name in enumerate(f.langs):
        found = ~np.zeros(len(probe), dtype=np.uint64)
        for s in places:
            found &= f.masks[i // 64][s]
        own = ((found >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
        assert own.tolist() == [all(int(s[k]) in slots[name] for s in places) for k in range(len(probe))]
        assert f.false_rate[i] == pytest.approx((len(slots[name]) / L.SLOTS) ** L.PROBES)


def test_language_predictions_equal_counting(spark):
    """Hits by language, less what false positives give, from plain loops over n-grams."""
    words = {"aa": ["bakat", "tokan", "banok"], "bb": ["shurz", "zhurk", "krush"], "cc": ["éloï", "çaé", "oué"]}
    profiles = {k: np.unique(L.word_grams(v)[0]) for k, v in words.items()}
    f = L.LanguageFilter.build(profiles, "bb")
    f.false_rate[:] = [0.2, 0.1, 0.3]
    slots = {k: {int(x) for s in L.slots_of(g) for x in s} for k, g in profiles.items()}
    texts = ["bakat tokan", "Shurz bakat bakat", "éloï, oué! krush", "xyz", "12 34", "", "bakat " * 3000]
    names, scores = f.predict(pa.array(texts))
    for text, name, score in zip(texts, names, scores.tolist()):
        hits, n = Counter(), 0
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for g in L.word_grams([w])[0]:
                n += 1
                at = [int(s[0]) for s in L.slots_of(np.array([g]))]
                hits.update(k for k in words if all(x in slots[k] for x in at))
        if not n:
            assert (name, score) == ("und", 0.0)
            continue
        kept = {k: max(0.0, (hits[k] - n * r) / (1 - r)) for k, r in zip(f.langs, [0.2, 0.1, 0.3])}
        best = max(f.langs, key=lambda k: kept[k])
        total = sum(kept.values())
        assert name == (best if total else "bb") and score == pytest.approx(kept[best] / total if total else 0.0)


def test_each_language_has_its_own_sample(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "rare").when(F.col("id") % 3 == 0, "mid").otherwise("hot").alias("lang"))
    chosen, langs = L.language_sample(ids.unionByName(ids), 200)
    sizes = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    assert langs == ["hot", "mid", "rare"] and sizes["rare"] == 3
    assert all(60 <= sizes[k] <= 200 for k in ("hot", "mid")) and chosen.distinct().count() == sum(sizes.values())


def test_toxic_features_equal_a_plain_version():
    texts = ["Bad bad words", "", None, "Worse-badly é9", "badge " * 500]
    text, place, n, n_words = X.text_features(pa.array([t or "" for t in texts]), None)
    own = lambda w: set(X.word_features([w])[0].tolist())
    for i, t in enumerate(texts):
        words = set(re.findall(r"[^\W_]+", (t or "").lower()))
        want = Counter(f for w in words for f in own(w))
        assert dict(zip(place[text == i].tolist(), n[text == i].tolist())) == want and n_words[i] == len(words)
    # a word has itself and its beginnings of 3 to 6 letters, and a beginning differs from the same whole word
    assert len(own("badger")) == 5 and len(own("bad") & own("badger")) == 1 and len(own("ab")) == 1


def plain_nnpu(x, length, positive, prior, steps):
    """The same optimiser over a dense matrix, its gradient taken by finite differences of the risk."""
    theta = np.zeros(x.shape[1] + 2)
    theta[-1] = np.log(prior / (1 - prior))
    m, v, turned = np.zeros_like(theta), np.zeros_like(theta), 0
    soft = lambda z: np.logaddexp(0.0, z)

    def parts(t):
        z = x @ t[:-2] + t[-2] * length + t[-1]
        return prior * soft(-z[positive]).mean(), soft(z[~positive]).mean() - prior * soft(z[positive]).mean()

    for t in range(1, steps + 1):
        low = parts(theta)[1] < 0
        turned += low
        goal = (lambda th: -parts(th)[1]) if low else (lambda th: sum(parts(th)))
        grad = np.array([(goal(theta + e) - goal(theta - e)) / 2e-6 for e in np.eye(len(theta)) * 1e-6])
        grad[:-1] += 2e-5 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= 0.05 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return theta, turned


def test_risk_and_turned_gradient_equal_a_plain_version():
    rnd = np.random.default_rng(5)
    n, k = 60, 6
    x = np.where(rnd.random((n, k)) < 0.4, 1.0, 0.0)
    positive = np.arange(n) < 30
    x[positive, 0] = 1.0
    x[~positive, 0] = 0.0  # U can be told from P: the risk of negatives falls below zero
    length = rnd.random(n)
    row, place = np.nonzero(x)
    want, turned = plain_nnpu(x, length, positive, 0.5, 120)
    w, by_length, bias = X.fit_nnpu(row, place, x[row, place], length, positive, k, 0.5, steps=120)
    assert turned > 5
    assert np.append(w, [by_length, bias]) == pytest.approx(want, abs=2e-3)


def plain_split(binned, g, h, bins, l2=1.0, least=2.0):
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + l2)
    for f in range(binned.shape[1]):
        for b in range(bins - 1):
            left = binned[:, f] <= b
            lh, rh = h[left].sum(), h[~left].sum()
            if lh < least or rh < least:
                continue
            gain = g[left].sum() ** 2 / (lh + l2) + g[~left].sum() ** 2 / (rh + l2) - whole
            if gain > best[0] + 1e-12:
                best = (gain, f, b)
    return best


def test_splits_and_leaves_equal_a_plain_search():
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(300, 4)).round(1)
    y = ((x[:, 1] > 0.2) ^ (rnd.random(300) < 0.1)).astype(float)
    forest = Q.fit(x, y, trees=3, depth=2, bins=8)
    edges = Q.bin_edges(x, 8)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    score = np.full(300, forest.base)
    for root in forest.roots:
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)

        def check(node, rows, depth):
            gain, f, b = plain_split(binned[rows], g[rows], h[rows], 8) if depth < 2 else (0, None, None)
            if f is None:
                assert forest.left[node] == node
                assert forest.value[node] == pytest.approx(-0.15 * g[rows].sum() / (h[rows].sum() + 1.0))
                score[rows] += forest.value[node]
                return
            assert (forest.feature[node], forest.threshold[node]) == (f, pytest.approx(edges[f][b]))
            left = binned[rows, f] <= b
            check(forest.left[node], rows[left], depth + 1)
            check(forest.right[node], rows[~left], depth + 1)

        check(root, np.arange(300), 0)
    assert forest.raw(x) == pytest.approx(score)


def test_repeated_ids_stay_within_the_bounds(spark):
    """An id of many rows must not bring more rows to the driver than the bound."""
    df = spark.range(600).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("some toxic words "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 7, 7)], "doc_id long, quality int, toxic int")
    seen = []
    real = Q.fit
    Q.fit = lambda x, y: seen.append(len(y)) or real(x, y)
    try:
        Q.fit_on(df, labels, F.lit(True), fit_rows=50)
    finally:
        Q.fit = real
    assert seen == [50]
    real_fit = X.fit_nnpu
    X.fit_nnpu = lambda *a, **k: seen.append(len(a[4])) or real_fit(*a, **k)
    try:
        X.fit_on(df, labels, F.lit(True), fit_toxic=20, fit_other=30)
    finally:
        X.fit_nnpu = real_fit
    assert len(seen) < 3 or seen[1] <= 50


EDGE = [(1, None, "en", "s"), (2, "", None, None), (3, "1234 !!", "en", "s"), (4, "plain words here", "en", "s"), (4, "plain words here", "en", "s"), (None, "no id", "de", "s"), (5, "mot " * 20000, "fr", "s")]


def edge_frame(spark, rows=EDGE):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"score": F.lit("x"), "predicted": F.lit("y"), "held_out": F.lit("z")})


def test_classifier_edges(spark):
    df, always = edge_frame(spark), F.lit(True)
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (4, 0, 1), (4, 0, 1), (5, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    forest = Q.fit_on(df, labels, always)
    assert Q.score(df, forest).count() == len(EDGE)
    toxic = X.fit_on(df, labels, always)
    assert X.score(df, toxic).count() == len(EDGE)
    got = {(r["doc_id"], r["lang_pred"], r["score"] >= 0) for r in L.predict(df, L.fit(df, always)).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", True), (5, "fr", True)} <= got


def test_nothing_to_learn_from(spark):
    df, none = edge_frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.score(df, Q.fit_on(df, none, F.lit(True))).collect()} == {0.5}
    assert {r["score"] for r in X.score(df, X.fit_on(df, none, F.lit(True))).collect()} == {0.0}
    assert {r["lang_pred"] for r in L.predict(df, L.fit(df, F.lit(False))).collect()} == {"und"}
    empty = edge_frame(spark, [])
    for out in (Q.score(empty, Q.fit_on(empty, none, F.lit(True))), X.score(empty, X.fit_on(empty, none, F.lit(True))), L.predict(empty, L.fit(empty, F.lit(True)))):
        assert out.count() == 0


def test_rows_that_share_an_id_are_rounded_in_groups(spark):
    """Half without id, half with one id: no group is much larger than asked for, and the words still come near the target."""
    rows = [(None if i % 2 else 7, f"s{i % 3}" if i % 5 else "s0", 20 + i % 50) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_key long, source string, size long")
    rated = df.select("source", F.lit(0).cast("bigint").alias("part"), F.monotonically_increasing_id().alias("number"))
    sizes = [r["count"] for r in M.rounding_groups(rated, 100).groupBy("source", "part", "spread").count().collect()]
    assert max(sizes) < 200 and sum(sizes) == 6000
    out = M.copies_of(df, group_rows=100).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert len(out) == 3
    for r in out:
        assert abs(r["taken"] - r["target"]) < 0.01 * r["target"] and r["most"] <= 3


def test_bound_of_very_many_trials():
    """The fraction is as exact for millions of trials as the sum is for few, and quick."""
    import time

    began = time.perf_counter()
    assert R.binomial_cdf(5_000_000, 10_000_000, 0.5) == pytest.approx(0.5, abs=2e-4)
    assert R.binomial_cdf(9_800, 1_000_000, 0.01) == pytest.approx(0.0222, abs=5e-4)
    assert R.binomial_cdf(0, 50, 0.1) == pytest.approx(0.9**50, rel=1e-10) and R.binomial_cdf(49, 50, 0.1) == pytest.approx(1 - 0.1**50, rel=1e-12)
    assert time.perf_counter() - began < 2


@pytest.mark.parametrize("make", [lambda df, k: R.counts(df, k), lambda df, k: L.predict(df, None, k), lambda df, k: X.score(df, None, k), lambda df, k: Q.score(df, None, k)])
def test_kept_columns_that_clash_are_refused(spark, make):
    df = spark.createDataFrame([(1, "a", 2, 3, 4, 5)], "doc_id long, text string, SCORE int, N_words int, Lang_pred int, __text int")
    for names in (("doc_id", "SCORE", "N_words"), ("doc_id", "__text"), ("doc_id", "doc_id")):
        with pytest.raises(ValueError):
            make(df, names)


def test_languages_of_one_id(spark):
    """An id with rows of two languages teaches each row's own language."""
    rows = [(i % 50, ("the cat sat on the mat " if lang == "en" else "el gato se sienta en la alfombra ") * 5, lang) for i in range(100) for lang in ("en", "es")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, F.lit(True))
    got = L.predict(df, model, ("doc_id", "lang")).filter("lang <> lang_pred").count()
    assert got == 0
