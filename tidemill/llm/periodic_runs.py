"""Periodic runs of words, by a suffix automaton of each stretch of text that repeats itself.

A run is a maximal stretch of words that equal the word one period before. Its
states' end positions are merged up the automaton's suffix links, smaller sets
into larger ones. Where two end positions become neighbours in the set of a state
of length l, the string of length l ends at both: at a distance d of at most l
it overlaps or touches itself, and seeds a square of period d. The state where
two positions meet first has the longest string that ends at both, so the seed
of the last position of a run spans the whole of it, and seeds that the next
word on either side would extend are left to it.

The automaton is built only where a run can be. A run of at least four periods
(six words) is made of triples of words that stand three times in the text, so
stretches of such triples, found for a whole batch at once, hold every run.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_limits, document_rows, pieces

#: A run has at least this many words, and this many times its period. Triples find no shorter ones.
MIN_LENGTH, MIN_PERIODS = 6, 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of text looked at together.
AT_ONCE = 2 << 20
#: End positions in one block of a set.
BLOCK = 512

Run = tuple[int, int, int]
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class Ends:
    """An ordered set of end positions, in sorted blocks, so an insertion moves few of them."""

    __slots__ = ("blocks", "lasts", "size")

    def __init__(self, x: int):
        self.blocks, self.lasts, self.size = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Put ``x`` in; its neighbours below and above (-1: none)."""
        blocks, lasts = self.blocks, self.lasts
        self.size += 1
        k = bisect_left(lasts, x) if len(lasts) > 1 else 0
        if k == len(lasts):
            k -= 1
        block = blocks[k]
        i = bisect_left(block, x)
        below = block[i - 1] if i else blocks[k - 1][-1] if k else -1
        above = block[i] if i < len(block) else -1  # a position beyond its block is beyond all
        block.insert(i, x)
        if above < 0:
            lasts[k] = x
        if len(block) > BLOCK:
            half = BLOCK // 2
            blocks[k : k + 1] = [block[:half], block[half:]]
            lasts[k : k + 1] = [block[half - 1], block[-1]]
        return below, above


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of each state of the suffix automaton of ``word``, and the state of each prefix."""
    length, link, step = [0], [-1], [{}]
    at, prefixes = 0, []
    for c in word:
        new = len(length)
        length.append(length[at] + 1)
        link.append(0)
        step.append({})
        p = at
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        at = new
        prefixes.append(at)
    return length, link, prefixes


def runs_in(word: list[int], min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> list[Run]:
    """All runs (start, length, smallest period) of ``word``, by start, then period. ``min_periods`` is 2 at least."""
    length, link, prefixes = automaton(word)
    ends: list[Ends | None] = [None] * len(length)
    for i, state in enumerate(prefixes):
        ends[state] = Ends(i)
    found: dict[tuple[int, int], int] = {}
    n = len(word)

    def seed(a: int, b: int, shared: int) -> None:
        """The ``shared`` words that end at ``a`` are those that end at ``b``."""
        period = b - a
        start = a - shared + 1
        if shared < (min_periods - 1) * period or shared + period < min_length:
            return
        if (b + 1 < n and word[b + 1] == word[a + 1]) or (start and word[start - 1] == word[start - 1 + period]):
            return
        found[start, b] = min(period, found.get((start, b), period))

    # longest first: a state's set is whole before it goes to its link
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up = link[state]
        small, large = ends[state], ends[up]
        ends[state] = None
        if up <= 0:
            continue
        if large is None:
            ends[up] = small
            continue
        if small.size > large.size:
            small, large = large, small
        ends[up], shared = large, length[up]
        for x in small:
            below, above = large.add(x)
            if below >= 0 and x - below <= shared:
                seed(below, x, shared)
            if above >= 0 and above - x <= shared:
                seed(x, above, shared)
    return sorted((start, end - start + 1, period) for (start, end), period in found.items())


def stretches(words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, first word, end) of all stretches of triples that stand three times in their document.

    ``words``: numbered words of all documents, which begin at ``at``. Triples are told apart by a 64-bit
    hash; two that share one only make a stretch longer.
    """
    n = len(words)
    if n < 3:
        return []
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key, w = doc.astype(np.uint64), words.astype(np.uint64)
    for k in range(3):
        key = (key[: n - 2] ^ w[k : n - 2 + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[2:] == ranked[:-2]
    often = np.zeros(n, bool)
    for k in range(3):
        often[order[k : n - 4 + k][same]] = True
    often[: n - 2] &= doc[2:] == doc[: n - 2]
    # a document's last triple begins two words before its end, so stretches of two documents never touch
    edge = np.flatnonzero(np.diff(np.r_[0, often.astype(np.int8), 0]))
    return [(int(doc[s]), int(s - at[doc[s]]), int(e - at[doc[s]]) + 2) for s, e in zip(edge[::2], edge[1::2])]


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words: at least six words and four periods long."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    at = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
    words = np.fromiter((numbers[w] for text in texts for w in text), np.int64, int(at[-1]))
    found: list[list[Run]] = [[] for _ in texts]
    for doc, s, e in stretches(words, at):
        if e - s >= MIN_LENGTH:
            found[doc] += [(s + a, n, q) for a, n, q in runs_in(words[at[doc] + s : at[doc] + e].tolist())]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def kept(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without what runs say again: all that a run has after its first period."""
    if not runs:
        return words
    stays = np.ones(len(words), bool)
    for start, n, period in runs:
        stays[start + period : start + n] = False
    return [words[i] for i in np.flatnonzero(stays)]


def foremost(runs: list[Run]) -> Run | None:
    """The run with the most periods; of equal ones that which starts first, then the shortest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _batches(batches, text_col: str, rewrite: Rewrite | None):
    for batch in pieces(batches, text_col, AT_ONCE):
        ids = batch.column(0).to_pylist()
        words = [_WORD.findall(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
        if rewrite:
            words = [rewrite(i, w) for i, w in zip(ids, words)]
        yield batch.column(0), words, runs_of(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """For each document: id, ``runs`` (``start``, ``length``, ``period`` in words) and ``collapsed``, its words without the repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``. ``rewrite`` may change a document's words first, given its id. Null and empty
    texts have no runs; every row is a document of its own. Needs no shuffle, and an empty table gives an empty result.
    A text's stretches take some 600 bytes a word while they are looked at; texts that don't repeat take none.
    """
    arrow_limits(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for ids, words, runs in _batches(batches, text_col, rewrite):
            found = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
            texts = [b" ".join(kept(w, r)).decode() for w, r in zip(words, runs)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind), pa.array(texts, pa.string())], names=["id", "runs", "collapsed"])

    made = document_rows(docs, id_col, text_col).mapInArrow(run, "id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return made.withColumnRenamed("id", id_col)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """What ``periodic_runs`` finds, as figures: ``n_runs``, the foremost run and its exponent, digests of all runs and of the collapsed text.

    Without runs the foremost one's four columns are null. Texts and runs stay inside the task.
    """
    arrow_limits(docs.sparkSession)
    long = pa.int64()

    def run(batches):
        for ids, words, runs in _batches(batches, text_col, rewrite):
            best = [foremost(x) for x in runs]
            first = [pa.array([r and r[k] for r in best], long) for k in range(3)]
            milli = pa.array([r and 1000 * r[1] // r[2] for r in best], long)
            said = pa.array([hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in x).encode()).hexdigest() for x in runs])
            text = pa.array([hashlib.sha256(b" ".join(kept(w, x))).hexdigest() for w, x in zip(words, runs)])
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in runs], long), *first, milli, said, text], names=["id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    made = document_rows(docs, id_col, text_col).mapInArrow(run, "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    return made.withColumnRenamed("id", id_col)
