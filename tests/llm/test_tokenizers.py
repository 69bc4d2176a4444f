"""SentencePiece codec and token counts against the libraries themselves."""

import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from threadloom.llm import sentencepiece_codec as S
from threadloom.llm import token_counts as T

PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "▁", "\x00", "　", "\xa0", "<s>", "</s>", "<|endoftext|>", "'s", "'ll", "12", "$$", "🎉", "\x1c", "\x85", "\r\n", "A" * 30, "=-" * 20]


def texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 30))) for _ in range(n)]
    return ["", " ", "  ", "a", " a", "a ", "▁", "▁▁a", *made, "abcdefg" * 3000, "a" * 5001, "\n" * 100, " " * 999]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=S.default_model())


def test_codec_equals_library(sp):
    given = texts(5, 1500)
    ids, ends, decoded = S.encode_slice(S.default_model(), pa.array(given), True)
    for i, t in enumerate(given):
        want = sp.encode(t, add_bos=True, add_eos=True)
        assert ids[ends[i] : ends[i + 1]].tolist() == want
        assert decoded[i] == sp.decode(want)


def test_codec_without_the_marker_rule(sp, monkeypatch):
    c = S.ChunkCodec(S.default_model())
    c.chunked = False
    monkeypatch.setattr(S, "codec", lambda path: c)
    given = texts(6, 50)
    ids, ends, decoded = S.encode_slice("", pa.array(given), True)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [sp.encode(t, add_bos=True, add_eos=True) for t in given]
    assert decoded == [sp.decode(sp.encode(t)) for t in given]


def test_counts_equal_library():
    given = texts(7, 1500)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = T.counter(T.default_model()).count(pa.array(given))
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(given, add_special_tokens=False)]


def test_merging_one_at_a_time():
    """Bulk rounds give what merging the leftmost lowest pair alone gives."""
    vocab = {c: i for i, c in enumerate("abc")} | {"aa": 3, "ab": 4, "aab": 5, "abc": 6, "aaaa": 7}
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("ab", "c"), ("aa", "aa")]
    table = T.RankTable(merges, vocab)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("aabc") for _ in range(rnd.randint(0, 12))) for _ in range(300)]

    def slow(w: str) -> int:
        parts = list(w)
        while True:
            ranked = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
            if not ranked:
                return len(parts)
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    flat = np.array([vocab[c] for w in words for c in w], dtype=np.int32)
    got = T.count_symbols(flat, np.array([len(w) for w in words]), table)
    assert got.tolist() == [slow(w) for w in words]


def test_rows_on_spark(spark, sp):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the cat  sat", "x"), (3, "the cat  sat", "x"), (None, "naïve ▁ text" * 400, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = S.encode(df, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(out) == 5
    by = {r["doc_id"]: r for r in out}
    assert by[1]["ids"] == [1, 2] and by[1]["decoded"] == "" and by[1] [1:] == by[2][1:]
    want = sp.encode(rows[4][1], add_bos=True, add_eos=True)
    assert by[None]["ids"] == want and by[None]["n_tokens"] == len(want)
    assert by[None]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    counted = {r["doc_id"]: r for r in T.count_tokens(df).collect()}
    assert (counted[1]["n_bytes"], counted[1]["n_tokens"], counted[1]["over_limit"]) == (0, 0, False)
    assert counted[None]["over_limit"]
    assert S.encode(df.limit(0)).count() == 0 and T.count_tokens(df.limit(0)).count() == 0


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        S.encode(df.withColumnRenamed("doc_id", "ids"), keep=("ids",))
    with pytest.raises(ValueError):
        T.count_tokens(df.withColumnRenamed("doc_id", "n_bytes"), keep=("n_bytes",))
