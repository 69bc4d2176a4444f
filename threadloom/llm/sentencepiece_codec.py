"""SentencePiece encoding and decoding by a table of distinct chunks.

A text becomes one marker, then itself with every blank turned into a marker.
No piece of the model has a marker after another character, so no merge can
join what stands on both sides of the start of a run of markers: each chunk
``marker+ non-marker*`` is segmented alone. Per slice of a batch, the chunks
are dictionary-encoded, each distinct chunk is segmented once by the library,
and ids are joined back by position with array gathers. Decoding uses the same
table: the text of a document is its chunks' decoded texts, joined by blanks.

``check_marker_rule`` verifies the premise over the vocabulary; a model that
breaks it is handled text by text by the library itself.

Results at the edges: a null text counts as empty; an empty text has the begin
and end ids alone and decodes to the empty text; repeated rows stay repeated;
columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, encode_words, list_parts, plain_strings, text_slices

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkCodec:
    """One model, loaded once per Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.mark_ids = [self.sp.piece_to_id(MARK)]
        self.chunked = self.check_marker_rule()

    def check_marker_rule(self) -> bool:
        """True if chunks are independent: markers only lead pieces, text is kept as it is."""
        sp = self.sp
        for i in range(sp.vocab_size()):
            if MARK in sp.id_to_piece(i).lstrip(MARK):
                return False
        probe = "Ａﬁ é　x  y\n z "
        return sp.is_unknown(self.mark_ids[0]) is False and sp.decode(sp.encode(probe)) == probe

    def encode_chunks(self, keys: list[str]) -> list[list[int]]:
        """Ids of chunks, each given without its first marker (the library adds it)."""
        out = self.sp.encode(keys, num_threads=1)
        for i, key in enumerate(keys):
            if not key:
                out[i] = self.mark_ids
        return out

    def decode_chunks(self, ids: list[list[int]]) -> list[str]:
        """Texts of chunks, each without the blank of its first marker."""
        return self.sp.decode(ids, num_threads=1)

    def frame(self) -> tuple[int, int]:
        return self.sp.bos_id(), self.sp.eos_id()


@lru_cache(maxsize=2)
def codec(path: str) -> ChunkCodec:
    return ChunkCodec(path)


def chunk_lists(texts: pa.Array) -> pa.ListArray:
    """Chunks of each text without their first marker."""
    texts = pc.replace_substring(texts, MARK, " ")
    lists = pc.split_pattern(texts, " ")
    runs = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.equal(texts, "")))
    odd = np.flatnonzero(runs.to_numpy(zero_copy_only=False))
    if not len(odd):
        return lists
    fixed = []
    for i in odd.tolist():
        marked = texts[i].as_py().replace(" ", MARK)
        fixed.append([c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + marked)] if marked else [])
    values, offsets = list_parts(lists)
    order = np.arange(len(texts))
    order[odd] = len(texts) + np.arange(len(odd))
    both = pa.concat_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(fixed, pa.list_(pa.string()))])
    return both.take(pa.array(order))


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate values[starts[i] : starts[i] + lengths[i]]; also the n + 1 offsets."""
    ends = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=ends[1:])
    index = np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - ends[:-1], lengths)
    return values[index], ends


def encode_slice(path: str, texts: pa.Array, with_text: bool) -> tuple[np.ndarray, np.ndarray, list[str] | None]:
    """Flat ids with begin and end ids, n + 1 offsets into them, decoded texts."""
    c = codec(path)
    bos, eos = c.frame()
    if not c.chunked:
        ids = c.sp.encode(texts.to_pylist(), add_bos=True, add_eos=True, num_threads=1)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return np.array([i for x in ids for i in x], dtype=np.uint32), ends, c.sp.decode(ids, num_threads=1) if with_text else None
    words, offsets = list_parts(chunk_lists(texts))
    codes, distinct = encode_words(words)
    table = c.encode_chunks(distinct.to_pylist())
    sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table))
    flat = np.fromiter((i for x in table for i in x), dtype=np.uint32, count=int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    ids, at = ragged_take(flat, starts[codes], sizes[codes])
    ends = at[offsets]
    n = len(texts)
    framed = np.empty(len(ids) + 2 * n, dtype=np.uint32)
    bounds = ends + 2 * np.arange(n + 1)
    is_id = np.ones(len(framed), dtype=bool)
    is_id[bounds[:-1]] = False
    is_id[bounds[1:] - 1] = False
    framed[is_id] = ids
    framed[bounds[:-1]] = bos
    framed[bounds[1:] - 1] = eos
    decoded = None
    if with_text:
        by_position = pa.array(c.decode_chunks(table), pa.string()).take(pa.array(codes))
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), by_position), " ").to_pylist()
    return framed, bounds, decoded


def encode(
    df: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    model: str | None = None,
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"),
) -> DataFrame:
    """Encode every text of ``df``; returns ``keep`` and the chosen outputs.

    outputs: ``n_tokens`` (long, begin and end included), ``ids`` (array of
    int), ``decoded`` (text), ``ids_sha256`` and ``decoded_sha256`` (hex
    digests of the little-endian 32-bit ids and of the decoded UTF-8 text).
    """
    path = model or default_model()
    types = {"n_tokens": "bigint", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    clash = set(keep) & set(outputs)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are both kept and made")
    source = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(source.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"`{o}` {types[o]}" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "__text"):
                wants_text = "decoded" in outputs or "decoded_sha256" in outputs
                ids, ends, decoded = encode_slice(path, plain_strings(part.column("__text")), wants_text)
                columns = [part.column(k) for k in keep]
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B") if len(ids) else b""
                for o in outputs:
                    if o == "n_tokens":
                        columns.append(pa.array(np.diff(ends), pa.int64()))
                    elif o == "ids":
                        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                    elif o == "ids_sha256":
                        at = (ends * 4).tolist()
                        columns.append(pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])], pa.string()))
                    elif o == "decoded":
                        columns.append(pa.array(decoded, pa.string()))
                    else:
                        columns.append(pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *outputs])

    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: ids and round trip of every document, as digests."""
    return encode(documents(spark, sf_dir), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the ids of each document and its decoded text's digest."""
    return encode(docs, outputs=("n_tokens", "ids", "decoded_sha256"))
