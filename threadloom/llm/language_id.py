"""Language ID with language-bitmask n-gram filters.

At most ``FIT_ROWS`` labelled documents of each language, chosen by a hash of the
id (so a rare language is learned at any size of the corpus), give the character
n-grams (2 to 4, within words and their blanks) of each language. A
language's profile holds the ``PROFILE`` commonest n-grams whose rate in it is
at least ``SHARE`` of the highest rate in any language. All profiles go into one
bit-sliced Bloom filter: a slot is a bitmask of languages, an n-gram's ``PROBES``
slots and-ed give every language that has it (and few others) at once.

A document's n-grams, repeats included, are counted per language. A language
whose bits fill a share f of the slots answers a foreign n-gram with probability
f ** PROBES, so from ``hits`` of ``n`` n-grams (hits - n * fp) / (1 - fp) are
kept. The most wins, ties go to the first by name; the score is its share of all
languages' counts. Distinct words of a slice are looked up once.

Results at the edges: a null text, and one without a letter, is ``und`` with
score 0; if nothing could be learned all are ``und``; a text with letters but
no known n-gram takes the language with most learned documents, score 0. Texts
are read whole; repeated rows get equal results; a repeated id brings all its
rows to the counts; no column but id, text and (to learn) lang is read, whatever
its name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, encode_words, id_remainder, list_parts, plain_strings, refuse_clash, segment_sums, small_side, text_slices

FIT_ROWS = 8_000
PROFILE = 40_000
SHARE = 0.25
SLOTS = 1 << 20
PROBES = 3
SIZES = (2, 3, 4)
UND = "und"

#: Distinct words that are looked up in one step.
STEP_WORDS = 30_000


def letter_words(texts: pa.Array) -> pa.ListArray:
    """Runs of letters of each text in lower case; empty strings stand between separators."""
    lower = pc.utf8_lower(texts)
    return pc.split_pattern(pc.replace_substring_regex(lower, r"[^\p{L}\p{M}]+", " "), " ")


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of words, and the place of the word each is from."""
    joined = " " + " ".join(words) + " "
    c = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    blank = c == 32
    owner = np.cumsum(blank) - 1
    hashes, owners = [], []
    h = c.copy()
    inner = np.zeros(len(c), dtype=bool)  # a blank strictly inside the n-gram
    for n in range(2, max(SIZES) + 1):
        size = len(c) - n + 1
        if size <= 0:
            break
        h = h[:size] * np.uint64(0x100000001B3) ^ c[n - 1 :]
        if n > 2:
            inner = inner[:size] | blank[n - 2 : n - 2 + size]
        else:
            inner = inner[:size] | (blank[:size] & blank[1:])
        if n in SIZES:
            ok = ~inner & (owner[:size] < len(words))
            hashes.append(h[:size][ok] + np.uint64(n))
            owners.append(owner[:size][ok])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.concatenate(hashes)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29)), np.concatenate(owners)


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    step = (grams >> np.uint64(32)) | np.uint64(1)
    return [((grams + np.uint64(i) * step) % np.uint64(SLOTS)).astype(np.int64) for i in range(PROBES)]


@dataclass
class LanguageFilter:
    """Bit-sliced Bloom filter: per slot, words of 64 languages' bits each."""

    langs: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    fallback: str

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray], fallback: str) -> LanguageFilter:
        langs = sorted(profiles)
        masks = np.zeros((max(1, -(-len(langs) // 64)), SLOTS), dtype=np.uint64)
        rates = np.zeros(len(langs))
        for i, lang in enumerate(langs):
            for s in slots_of(profiles[lang]):
                masks[i // 64, s] |= np.uint64(1 << (i % 64))
            rates[i] = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** PROBES
        return cls(langs, masks, rates, fallback)

    def word_hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hits of each word's n-grams by language (words x languages), and its n-grams."""
        hits, total = np.zeros((len(words), len(self.langs)), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for start in range(0, len(words), STEP_WORDS):
            part = words[start : start + STEP_WORDS]
            grams, owner = word_grams(part)
            places = slots_of(grams)
            total[start : start + len(part)] = np.bincount(owner, minlength=len(part))
            for i in range(len(self.langs)):
                if i % 64 == 0:
                    found = self.masks[i // 64][places[0]]
                    for p in places[1:]:
                        found &= self.masks[i // 64][p]
                has = (found >> np.uint64(i % 64)) & np.uint64(1) == 1
                hits[start : start + len(part), i] = np.bincount(owner[has], minlength=len(part))
        return hits, total

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        lists = letter_words(texts)
        words, offsets = list_parts(lists)
        codes, distinct = encode_words(words)
        has_letter = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        if not self.langs or not len(texts):
            return [UND] * len(texts), np.zeros(len(texts))
        hits, total = self.word_hits(distinct.to_pylist())
        n = segment_sums(total[codes], offsets)
        per = np.stack([segment_sums(hits[codes, i], offsets) for i in range(len(self.langs))], axis=1)
        kept = np.maximum(0.0, (per - n[:, None] * self.false_rate) / (1 - self.false_rate))
        best, sums = kept.argmax(axis=1), kept.sum(axis=1)
        score = np.where(has_letter & (sums > 0), kept[np.arange(len(best)), best] / np.maximum(sums, 1e-12), 0.0)
        names = [self.langs[b] if s > 0 else self.fallback for b, s in zip(best.tolist(), sums.tolist())]
        return [x if ok else UND for x, ok in zip(names, has_letter.tolist())], score


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of rows (lang, text): how often each language has each n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                lang = part.column("lang").dictionary_encode()
                words, offsets = list_parts(letter_words(plain_strings(part.column("text"))))
                of = np.repeat(lang.indices.to_numpy(), np.diff(offsets))
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    own = words.take(pa.array(np.flatnonzero(of == i)))
                    codes, distinct = encode_words(own)
                    grams, owner = word_grams(distinct.to_pylist())
                    times = np.bincount(codes, minlength=len(distinct))[owner]
                    seen, inverse = np.unique(grams, return_inverse=True)
                    n = np.bincount(inverse, times, len(seen)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def language_sample(ids: DataFrame, fit_rows: int) -> tuple[DataFrame, list[str]]:
    """At most ``fit_rows`` of the distinct (doc_id, lang) of each language, and the languages, commonest first.

    Those whose hash has the most leading zeros are taken, as many zeros as it
    needs; each zero more halves the rows, so a language with more rows than the
    bound gives half of it or more. Counts by (language, zeros) decide, so no
    language is sorted or held in one task, and a rare one is taken whole.
    """
    h = F.xxhash64(F.lit(11), F.col("doc_id"))
    zeros = F.when(h < 0, 0).when(h == 0, 64).otherwise(64 - F.length(F.bin(h)))
    marked = ids.distinct().withColumn("zeros", zeros.cast("int"))
    table = marked.groupBy("lang", "zeros").count().collect()  # at most 65 rows a language
    total: dict[str, int] = {}
    for r in table:
        total[r["lang"]] = total.get(r["lang"], 0) + r["count"]
    least = {lang: 0 for lang in total}
    left = dict(total)
    for r in sorted(table, key=lambda r: r["zeros"]):
        if left[r["lang"]] > fit_rows:
            left[r["lang"]] -= r["count"]
            least[r["lang"]] = r["zeros"] + 1
    langs = sorted(total, key=lambda lang: (-total[lang], lang))
    cut_at = ids.sparkSession.createDataFrame([(k, v) for k, v in least.items()], "lang string, least int")
    return marked.join(cut_at, "lang").filter(F.col("zeros") >= F.col("least")).select("doc_id", "lang"), langs


def fit(docs: DataFrame, learn: Column, fit_rows: int = FIT_ROWS, profile: int = PROFILE) -> LanguageFilter:
    """Filters learned from the rows (doc_id, text, lang) for which ``learn`` holds."""
    ids = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang")
    chosen, langs = language_sample(ids, fit_rows)
    # an id may have rows of several languages: each row has its own
    rows = docs.select("doc_id", "lang", "text").join(small_side(chosen), ["doc_id", "lang"])
    counted = gram_counts(rows.select("lang", "text"))
    rate = counted.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    near = rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= F.lit(SHARE) * F.col("top"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    held = near.withColumn("place", place).filter(F.col("place") <= profile).select("lang", "gram").toArrow()
    grams, names = held["gram"].to_numpy().view(np.uint64), np.array(held["lang"].to_pylist(), dtype=object)
    profiles = {lang: grams[names == lang] if len(grams) else grams for lang in langs}
    return LanguageFilter.build(profiles, langs[0] if langs else UND)


def predict(df: DataFrame, model: LanguageFilter, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, lang_pred and score of each row."""
    refuse_clash(keep, "lang_pred", "score")
    source = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(source.dtypes)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text", 3 << 20):
                names, score = held.value.predict(plain_strings(part.column("__text")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(names, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string, score double"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: language of every document, learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out)
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
