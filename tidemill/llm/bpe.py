"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts are split before white space that follows other characters. The split
pattern always starts a match there, so long texts are encoded in pieces of
bounded size with the very ids of the whole text. Decoding joins raw bytes and
never passes through text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_limits, document_rows, pieces

#: Texts longer than this many characters are encoded piecewise.
PIECE_CHARS = 200_000
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n])")


@functools.lru_cache(4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Parts of ``text`` of about ``size`` characters that can be encoded on their own."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start : cut.start()])
        start = cut.start()
    parts.append(text[start:])
    return parts


def encode(text: str | None, rank_file: str, pattern: str) -> np.ndarray:
    """The ids of a text (null: none) as little-endian unsigned 32-bit integers."""
    enc = encoding(rank_file, pattern)
    parts = [enc.encode_ordinary(part) for part in safe_pieces(text or "")]
    return np.concatenate([np.asarray(p, "<u4") for p in parts])


def decode(ids, rank_file: str, pattern: str) -> bytes:
    """The raw bytes of a list of ids."""
    return encoding(rank_file, pattern).decode_bytes([int(i) for i in ids])


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<long>) of every whole text; null texts have no ids.

    Needs no shuffle: each row is encoded where it is read. ``rank_file`` must be
    at the same path on every executor.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in pieces(batches, text_col, 4 << 20):
            ids = [encode(t, rank_file, pattern) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "ids"])

    return document_rows(docs, id_col, text_col).mapInArrow(run, "id long, ids array<bigint>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` (binary) of each list of ids; a null list decodes to no bytes."""

    def run(batches):
        for batch in batches:
            found = [decode(ids or [], rank_file, pattern) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "decoded"])

    return document_rows(encoded, id_col, ids_col).mapInArrow(run, "id long, decoded binary").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of the ids of each text, and the digest of what they decode to.

    The ids live only inside the task, so nothing but digests is written.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in pieces(batches, text_col, 4 << 20):
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text, rank_file, pattern)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(encoding(rank_file, pattern).decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return document_rows(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
