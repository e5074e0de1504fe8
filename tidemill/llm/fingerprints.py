"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over seven bytes of the text. It triggers where its ``k`` leading
bits are zero, which cuts the text into blocks of about 2^k bytes. A chunk ends
at the first trigger that leaves it half a block at least, and at four blocks at
most, so text that says the same again and again is cut as finely as any other.
A document takes the smallest block size that gives at most 64 chunks, whatever
its length: no part of a text is left out or lumped together. Chunks are hashed
to symbols: one string of them for this block size, and one for the next.

Two fingerprints are compared where they have a block size in common, by the
edit distance of their symbols. Distances of a whole batch are worked out at once,
each pair's column of the matrix in the bits of one integer.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, document_rows, pieces, stored

WINDOW = 7
#: Chunks of a signature at most, as bits of the integer that the edit distance works in.
CHUNKS = 64
#: Bytes that the hash rolls over at once.
PIECE = 1 << 20
_FACTOR, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_SYMBOLS = np.array([a + b for a in _LETTERS for b in _LETTERS], object)


@dataclass(frozen=True)
class Fingerprint:
    """Symbols of the chunks at block sizes 2^level and 2^(level + 1)."""

    level: int
    fine: np.ndarray
    coarse: np.ndarray

    def __str__(self) -> str:
        return f"{1 << self.level}:{''.join(_SYMBOLS[self.fine])}:{''.join(_SYMBOLS[self.coarse])}"


def _rolled(data: bytes, start: int) -> np.ndarray:
    """The hash of the window that ends at each byte of a piece; windows begin with zeros at the start of the text."""
    before = data[max(0, start - WINDOW + 1) : start]
    part = np.frombuffer(bytes(WINDOW - 1 - len(before)) + before + data[start : start + PIECE], np.uint8).astype(np.uint32)
    n = len(part) - WINDOW + 1
    h = part[:n].copy()
    for k in range(1, WINDOW):
        h *= _FACTOR
        h += part[k : k + n]
    h *= _MIX
    h ^= h >> np.uint32(15)
    h *= _MIX
    return h


def _cuts(triggers: list[int], n: int, level: int) -> list[int] | None:
    """Where chunks begin, and the end of the text; None for more than ``CHUNKS``."""
    least, most = max(1, (1 << level) // 2), 4 << level
    at = [0]
    while at[-1] < n:
        k = bisect_left(triggers, at[-1] + least)
        cut = at[-1] + most
        at.append(min(cut, n, triggers[k] if k < len(triggers) else n))
        if len(at) > CHUNKS + 1:
            return None
    return at


def fingerprint(text: str | None) -> Fingerprint:
    """The fingerprint of a text; null counts as empty."""
    data = (text or "").encode()
    n = len(data)
    level = max(0, (n // CHUNKS).bit_length() - 2)  # cut evenly, a smaller block size gives too many chunks
    rolled, ends = [], []
    for s in range(0, n, PIECE):
        h = _rolled(data, s)
        found = np.flatnonzero(h <= np.uint32(0xFFFFFFFF >> level))
        rolled.append(h[found])
        ends.append(found + s + 1)
    h, end = (np.concatenate(x) if x else np.array([], np.int64) for x in (rolled, ends))
    cuts: dict[int, list[int] | None] = {}
    while True:
        for k in (level, level + 1):
            if k not in cuts:
                cuts[k] = _cuts(end[h <= 0xFFFFFFFF >> k].tolist(), n, k)
        if cuts[level] and cuts[level + 1]:
            fine, coarse = (np.array([xxhash.xxh3_64_intdigest(data[a:b]) & 4095 for a, b in zip(x[:-1], x[1:])], np.uint16) for x in (cuts[level], cuts[level + 1]))
            return Fingerprint(level, fine, coarse)
        level += 1


def parse(said: str) -> Fingerprint:
    """The fingerprint that a string tells."""
    size, *symbols = said.split(":")
    digit = {c: i for i, c in enumerate(_LETTERS)}
    return Fingerprint(int(size).bit_length() - 1, *(np.array([64 * digit[a] + digit[b] for a, b in zip(s[::2], s[1::2])], np.uint16) for s in symbols))


def edit_distances(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Levenshtein distances of pairs of symbol strings (at most ``CHUNKS`` long), by bit-parallel columns."""
    n = len(xs)
    x, y = np.full((n, CHUNKS), 0xFFFF, np.uint16), np.full((n, CHUNKS), 0xFFFE, np.uint16)
    for rows, strings in ((x, xs), (y, ys)):
        for row, s in zip(rows, strings):
            row[: len(s)] = s
    m, l = (np.fromiter(map(len, s), np.int64, n) for s in (xs, ys))
    one = np.uint64(1)
    top = np.maximum(m - 1, 0).astype(np.uint64)
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = m.copy()
    for j in range(int(l.max(initial=0))):
        eq = np.packbits(x == y[:, j, None], axis=1, bitorder="little").view("<u8")[:, 0]
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(across | up), up & across
        score += np.where(j < l, (plus >> top & one).astype(np.int64) - (minus >> top & one).astype(np.int64), 0)
        plus, minus = plus << one | one, minus << one
        both = eq | down
        up, down = minus | ~(both | plus), plus & both
    return np.where(m == 0, l, score)


def likeness(xs: list[Fingerprint], ys: list[Fingerprint]) -> np.ndarray:
    """1 for equal symbols, 0 for none in common or no common block size; of two common sizes the better counts."""
    at, a, b = [], [], []
    for i, (x, y) in enumerate(zip(xs, ys)):
        for k, s in ((x.level, x.fine), (x.level + 1, x.coarse)):
            for j, t in ((y.level, y.fine), (y.level + 1, y.coarse)):
                if k == j:
                    at.append(i)
                    a.append(s)
                    b.append(t)
    out = np.zeros(len(xs))
    longest = np.array([max(len(s), len(t)) for s, t in zip(a, b)], np.int64)
    np.maximum.at(out, at, 1 - edit_distances(a, b) / np.maximum(longest, 1))
    return out


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the ``fingerprint`` of every whole text, where it is read; null counts as empty."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in pieces(batches, text_col, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(fingerprint(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "fingerprint"])

    return document_rows(docs, id_col, text_col).mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def with_likeness(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """``pairs`` with how alike the fingerprints of columns ``a`` and ``b`` are; a null fingerprint is like none."""

    @F.pandas_udf("double")
    def alike(x, y):
        import pandas as pd

        both = (x.notna() & y.notna()).to_numpy()
        out = np.zeros(len(x))
        out[both] = likeness([parse(s) for s in x[both]], [parse(s) for s in y[both]])
        return pd.Series(out)

    return pairs.withColumn(name, alike(a, b))


_FIGURES = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much (or all) of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _figures(texts: list[str], prints: list[Fingerprint], following: list[str], following_prints: list[Fingerprint]) -> list[pa.Array]:
    edited = [_edited(t, f) for t, f in zip(texts, following)]
    edited_prints = [fingerprint(t) for t in edited]
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        *(pa.array(map(str, x), pa.string()) for x in (prints, edited_prints)),
        *(pa.array(likeness(prints, x), pa.float64()) for x in (edited_prints, following_prints)),
    ]


def edit_test(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How alike each document's fingerprint is to that of an edited copy, and to the next document's.

    The copy's last quarter of code points is the beginning of the next document by ascending id; the first document
    follows the last. Null ids come first, and rows of one id go by a hash of their text; each row is a document. Null
    texts are empty, and two empty texts are alike. An empty table gives an empty result.

    Texts are sorted into ranges once, and each task walks through its range. Only the first and last document of a
    range are written with their texts: a range's last document meets the next range's first one afterwards.
    """
    arrow_limits(docs.sparkSession)
    order = [F.col("id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = document_rows(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("place", F.struct(*order))
    ranged = rows.repartitionByRange("place").sortWithinPartitions("place").select("id", "text")
    names = ["part", "kind", "id", *(x.split()[0] for x in _FIGURES.split(", ")), "text"]

    def edge(part, kind, i, text):
        values = [part, kind, i, *[None] * 6, text]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    def walk(batches):
        part, ids, texts, prints = TaskContext.get().partitionId(), [], [], []
        for batch in pieces(batches, "text", 4 << 20):
            if not texts:
                yield edge(part, "first", batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            prints += [fingerprint(t) for t in texts[len(prints) :]]
            n = len(ids) - 1
            found = _figures(texts[:-1], prints[:-1], texts[1:], prints[1:])
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(["row"] * n, pa.string()), pa.array(ids[:-1], pa.int64()), *found, pa.nulls(n, pa.string())], names=names)
            ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]
        if texts:
            yield edge(part, "last", ids[0], texts[0])

    def meet(batches):
        for batch in pieces(batches, "text", 4 << 20):
            texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), *_figures(texts, [*map(fingerprint, texts)], following, [*map(fingerprint, following)])], names=["id", *names[3:9]])

    walked = stored(ranged.mapInArrow(walk, f"part int, kind string, id long, {_FIGURES}, text string"), "edit-test")
    first, last = (walked.where(F.col("kind") == k) for k in ("first", "last"))
    along = Window.orderBy("part")  # one row a range
    after = first.select("part", F.coalesce(F.lead("part").over(along), F.min("part").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    met = last.select("part", "id", "text").join(after, "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
    ended = met.select("id", "text", "following").mapInArrow(meet, f"id long, {_FIGURES}")
    return walked.where(F.col("kind") == "row").select("id", *names[3:9]).unionByName(ended).withColumnRenamed("id", id_col)
