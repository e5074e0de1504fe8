"""Repeated-substring removal over a sparse, distributed suffix array.

A byte goes if it is covered by a window (a string of ``WINDOW`` bytes) that also
starts earlier in the corpus. Sorting every suffix would move ``WINDOW`` times the
corpus, so windows are first gathered into runs: consecutive windows that share the
same minimiser, the least of their ``GRAM``-byte hashes. Equal windows have equal minimisers.

1. Each text is cut into runs where it is read. Runs met before in the same task are compared byte by byte and marked, and of
   the different runs of one minimiser one alone goes on by it, so a hot passage leaves one row per task.
2. Runs meet by minimiser. One that stands in a single place needs nothing more; the bytes of all others are asked for.
3. The bytes, a window and the few that its run adds, meet by minimiser; those of hot ones window by window, by what they hold. There they are sorted
   deep-shallow: multikey quicksort on eight-byte words to a shallow depth, then blind tries for the groups that still
   share their prefix. Runs that are equal to their full length come first: the earliest stays, all
   windows of the others go. Then the windows of the different runs are sorted likewise, and of equal ones all but the earliest go.
   Equal windows of a minimiser with very many runs meet in shares, and then the earliest ones of the shares meet: no
   task ever holds all places of a passage that stands in every document.

Hashes only bring candidates together. What goes is decided by the sorted order of bytes.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import row_numbers
from .common import arrow_limits, pieces, stored, unused

WINDOW = 100
GRAM = 50
#: Bytes of text that are hashed together, and the depth of the multikey quicksort.
SEGMENT = 1 << 20
SHALLOW = 24
#: Runs that a task gathers before it marks those it has met.
HELD = 1 << 18
#: Runs whose bytes are sorted together, and windows of them.
RUNS, ASKED = 1 << 14, 1 << 17
#: A minimiser with more runs than this is hot, and at most so many minimisers are: beyond that the limit grows.
HOT_RUNS, HOT_MINIMISERS = 2048, 500_000
#: Runs of one minimiser whose equal windows may meet in one task; where it has more, they meet in shares of about so many first.
SHARE = 8192
_NO_ID = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POS = np.uint64((1 << 22) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes of any stretch of a segment, modulo 2^64, over random values of bytes."""

    def __init__(self, size: int):
        self.up, self.down = _powers(_BASE, size + 1), _powers(_INVERSE, size + 1)
        rng = np.random.default_rng(5)
        self.value = rng.integers(0, 2**64, 256, np.uint64)
        self.odd = rng.integers(0, 2**64, 256, np.uint64) | np.uint64(1)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, start, end) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, m = 1, x
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return m if span == width else np.minimum(m[: len(x) - width + 1], m[width - span :][: len(x) - width + 1])


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher, window: int = WINDOW, gram: int = GRAM):
    """Runs of the texts at ``starts``..``ends`` of ``data``: text number, first window (within ``data``), number of windows, place of the minimiser
after the first window, its hash, the run's hash."""
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = hasher.prefix(data)
    n = len(data) - gram + 1
    h = _mix((prefix[gram:] - prefix[:n]) * hasher.down[:n])
    least = _sliding_min((h & ~_POS) | np.arange(n, dtype=np.uint64), window - gram + 1)
    sizes = np.maximum(0, ends - starts - window + 1)
    text = np.repeat(np.arange(len(starts)), sizes)
    p = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[text]
    a = (least[p] & _POS).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])]) if len(p) else none
    count = np.diff(np.r_[new, len(p)])
    first, at, text = p[new], a[new], text[new]
    whole = _mix(hasher.stretch(prefix, first, first + count + window - 1) ^ _mix((at - first).astype(np.uint64) * np.uint64(1009) + count.astype(np.uint64)))
    return text, first, count, at - first, h[at], whole


def _segments(texts: list[bytes], window: int):
    """(numbers, offsets within the texts, bytes, starts, ends): short texts together, long ones in overlapping parts."""
    numbers, offsets, parts, size = [], [], [], 0

    def out():
        ends = np.cumsum([len(x) for x in parts])
        return np.array(numbers), np.array(offsets), np.frombuffer(b"".join(parts), np.uint8), ends - [len(x) for x in parts], ends

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), SEGMENT):
            part = text[at : at + SEGMENT + window - 1]
            if len(part) < window:
                continue
            numbers.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= SEGMENT:
                yield out()
                numbers, offsets, parts, size = [], [], [], 0
    if parts:
        yield out()


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


#: ``place`` in one number: first window, place of the minimiser after it, number of windows, and what is known: the run goes,
#: its bytes are asked for, it doesn't have to meet others (dealt out evenly), it meets those of its share only and then the earliest of the others.
RUN_SCHEMA = "h long, doc long, place long"
_GOES, _ASKED, _PASSES, _SHARED = 1, 2, 4, 8


def _place(p, off, n, flags=0):
    return p << 20 | off << 12 | n << 4 | flags


def _parts(place: np.ndarray):
    """First window, place of the minimiser after it, number of windows."""
    return place >> 20, place >> 12 & 255, place >> 4 & 255


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which stretches of the same length, from ``a`` and from ``b``, hold the same bytes."""
    out = np.ones(len(a), bool)
    for s in range(0, len(a), 1 << 14):
        n = length[s : s + (1 << 14)]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        same = data[np.repeat(a[s : s + (1 << 14)], n) + step] == data[np.repeat(b[s : s + (1 << 14)], n) + step]
        out[s : s + (1 << 14)] = np.logical_and.reduceat(same, first)
    return out


def _marked(data, at, h, s, doc, p, off, n, window: int) -> pa.RecordBatch:
    """Rows of runs: those that repeat an earlier one of these go, and of several with one minimiser the first alone has to meet others."""
    by = np.lexsort((p, doc, s, h))
    at, h, s, doc, p, off, n = (x[by] for x in (at, h, s, doc, p, off, n))
    new = _changes(h, s)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    goes = np.flatnonzero(~new & ((doc != doc[first]) | (p != p[first])))
    goes = goes[_equal_bytes(data, at[goes], at[first[goes]], n[goes] + window - 1)] if len(goes) else goes
    flags = np.zeros(len(h), np.int64)
    flags[goes] = _GOES | _PASSES
    left = np.flatnonzero(flags == 0)
    group = _changes(h[left])
    several = np.flatnonzero(~group | np.r_[~group[1:], False]) if len(left) else left
    flags[left[several]] |= _ASKED
    flags[left[~group]] |= _PASSES
    return pa.RecordBatch.from_arrays([pa.array(np.where(flags & _GOES, 0, h.view(np.int64))), pa.array(doc), pa.array(_place(p, off, n, flags))], names=["h", "doc", "place"])


def text_runs(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    def run(batches):
        hasher = Hasher(2 * SEGMENT + 2 * window)
        held, size, base = [], 0, 0

        def out():
            data, *columns = zip(*held)
            return _marked(np.concatenate(data), *map(np.concatenate, columns), window)

        for batch in pieces(batches, "text", 4 * SEGMENT):
            ids, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            for numbers, offsets, data, starts, ends in _segments(texts, window):
                text, p, n, off, h, s = runs_of(data, starts, ends, hasher, window, gram)
                held.append((data, p + base, h, s, ids[numbers[text]], p - starts[text] + offsets[text], off, n))
                size, base = size + len(h), base + len(data)
            if size >= HELD:
                yield out()
                held, size, base = [], 0, 0
        if held:
            yield out()

    return rows.mapInArrow(run, RUN_SCHEMA)


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows that pass are dealt out evenly, all others by ``key``, and sorted by it."""
    passes = F.col("place").bitwiseAND(F.lit(_PASSES)) != 0
    return rows.repartition(F.when(passes, F.xxhash64("doc", "place")).otherwise(F.col(key))).sortWithinPartitions(key)


def meet(runs: DataFrame) -> DataFrame:
    """The runs that go, and those whose bytes are asked for because their minimiser stands in several places."""

    def run(batches):
        last = lone = None  # the last minimiser, and its first row while it is the only one
        for batch in batches:
            h, doc, place = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            passes = (place & _PASSES) != 0
            yield _rows(h[passes], doc[passes], place[passes])
            h, doc, place = h[~passes], doc[~passes], place[~passes]
            if not len(h):
                continue
            group = _changes(h)
            if h[0] == last:
                group[0] = False
            asked = ~group | np.r_[~group[1:], False] | ((place & _ASKED) != 0)
            if lone is not None and not group[0]:
                yield _rows(*lone)
            yield _rows(h[asked], doc[asked], place[asked] | _ASKED)
            last = h[-1]
            lone = None if asked[-1] else (h[-1:], doc[-1:], place[-1:] | _ASKED)

    return _dealt(runs, "h").mapInArrow(run, RUN_SCHEMA)


def _rows(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(place)], names=["h", "doc", "place"])


def suffix_order(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows of one length, and which of them (in that order) differ from the one before.

    Multikey quicksort to a shallow depth: only groups that are still tied are split by their next eight bytes.
    Then a blind trie for each group that still shares its prefix.
    """
    n, length = rows.shape
    depth = min(length, -(-shallow // 8) * 8)
    words = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    words[:, :depth] = rows[:, :depth]
    words = words.view(">u8").astype(np.uint64)
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    for k in range(words.shape[1]):
        tied = np.flatnonzero(~new | np.r_[~new[1:], False]) if n else order
        if not len(tied):
            return order, new
        group, word = np.cumsum(new)[tied], words[order[tied], k]
        by = np.lexsort((word, group))
        order[tied], word = order[tied][by], word[by]
        new[tied[1:]] |= (word[1:] != word[:-1]) & (group[1:] == group[:-1])
    _blind_tries(rows, order, new, depth)
    return order, new


def _blind_tries(rows: np.ndarray, order: np.ndarray, new: np.ndarray, depth: int) -> None:
    """Order the groups that share their first ``depth`` bytes, all groups at once.

    A group's first row is a path from the root of its trie. One comparison gives the depth at which each other row leaves
    the path, and its branching byte; what lies in between isn't looked at again. Rows that leave at one
    node by one byte are the group of the trie below, rows that never leave are equal.
    Rows below the path come before it, the higher they leave the earlier; rows above it come after it, the deeper the earlier.
    """
    n, length = rows.shape
    if depth >= length or not n:
        return
    equal = np.zeros(n, bool)  # first places of groups of equal rows
    path_key = length << 8
    while True:
        starts = np.flatnonzero(new)
        size = np.diff(np.r_[starts, n])
        some = (size > 1) & ~equal[starts]
        if not some.any():
            return
        starts, size = starts[some], size[some]
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        path, row = np.repeat(order[starts], size), order[at]
        key = np.empty(len(at), np.int64)
        for a in range(0, len(at), 1 << 15):
            x, y = rows[row[a : a + (1 << 15)], depth:], rows[path[a : a + (1 << 15)], depth:]
            differ = x != y
            leaves = differ.argmax(1)
            k = np.arange(len(x))
            mine, its = x[k, leaves].astype(np.int64), y[k, leaves]
            down = leaves << 8 | mine
            up = path_key + 1 + ((length - leaves) << 8 | mine)
            key[a : a + (1 << 15)] = np.where(~differ[k, leaves], path_key, np.where(mine < its, down, up))
        group = np.repeat(np.arange(len(starts)), size)
        by = np.lexsort((key, group))
        order[at], key = row[by], key[by]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        new[at] = fresh
        equal[at[fresh]] = key[fresh] == path_key


def _digest(w: np.ndarray, hasher: Hasher) -> np.ndarray:
    """A 64-bit hash of each byte row, to deal rows out by what they hold."""
    return _mix((hasher.value[w] * hasher.up[: w.shape[1]]).sum(1, dtype=np.uint64)).view(np.int64)


def _shares(digest: np.ndarray, doc: np.ndarray, place: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What windows are dealt out by: their digest, where they meet in several shares also the share their place falls into; and where they do."""
    several = shares > 1
    share = _mix(_mix(doc.view(np.uint64)) + place.astype(np.uint64)) % shares.astype(np.uint64)
    return np.where(several, _mix(digest.view(np.uint64) + (share + np.uint64(1)) * np.uint64(_BASE)).view(np.int64), digest), several


def _stretches(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The bytes from each start as values of a binary column."""
    ends = np.r_[0, np.cumsum(length)]
    flat = data[np.repeat(start - ends[:-1], length) + np.arange(int(ends[-1]))]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins (one more than there are values)."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _repeats(order: np.ndarray, new: np.ndarray, doc: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: which aren't the earliest of those they are equal to, and which are."""
    group = np.cumsum(new)
    order = order[np.lexsort((p[order], doc[order], group))]
    head = order[np.flatnonzero(new)[group - 1]]
    goes, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    goes[order] = (doc[order] != doc[head]) | (p[order] != p[head])
    first[head] = True
    return goes, first


def hot_minimisers(asks: DataFrame) -> np.ndarray:
    """Sorted hashes of the minimisers with so many runs that one task shouldn't have them all (their number is bounded), and in how many shares their equal windows meet."""
    limit = max(HOT_RUNS, asks.count() // HOT_MINIMISERS)
    hot = asks.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > limit)
    rows = np.array([(r["h"], 1 + r["k"] // SHARE) for r in hot.collect()], np.int64).reshape(-1, 2)
    return rows[np.argsort(rows[:, 0])]


def asked_bytes(rows: DataFrame, asks: DataFrame, hot: np.ndarray, window: int = WINDOW) -> DataFrame:
    """The runs asked for with their ``bytes``; hot ones as single windows, dealt out by their bytes, of which those that repeat one of the same batch go."""
    lists = asks.groupBy("doc").agg(F.collect_list(F.struct("h", "place")).alias("runs"))
    joined_rows = rows.join(lists, rows.id == lists.doc).select("id", "text", "runs")
    held = rows.sparkSession.sparkContext.broadcast(hot)  # at most HOT_MINIMISERS pairs of numbers

    def run(batches):
        hot, shares, hasher = *held.value.T, Hasher(window)

        def out(h, doc, place, found):
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(place), found], names=["h", "doc", "place", "bytes"])

        for batch in pieces(batches, "text", SEGMENT):
            data, begins = _values(batch.column(1))
            runs = batch.column(2)
            of = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy(zero_copy_only=False))
            runs = runs.flatten()
            h, place = (pc.struct_field(runs, c).to_numpy(zero_copy_only=False) for c in ("h", "place"))
            doc, base, (p, off, n) = batch.column(0).to_numpy()[of], begins[:-1][of], _parts(place)
            at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
            burning = hot[at] == h if len(hot) else np.zeros(len(h), bool)
            k = np.flatnonzero(~burning)
            yield out(h[k], doc[k], _place(p[k], off[k], n[k]), _stretches(data, base[k] + p[k], n[k] + window - 1))
            k = np.flatnonzero(burning)
            k = np.repeat(k, n[k])
            step = np.arange(len(k)) - np.flatnonzero(np.r_[True, k[1:] != k[:-1]])[np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1] if len(k) else k
            for a in range(0, len(k), ASKED):
                r, j = k[a : a + ASKED], step[a : a + ASKED]
                w = data[(base[r] + p[r] + j)[:, None] + np.arange(window)]
                goes, _ = _repeats(*suffix_order(w), doc[r], p[r] + j)
                places = _place(p[r] + j, off[r] - j, 1)
                yield out(np.zeros(int(goes.sum()), np.int64), doc[r][goes], places[goes] | _GOES | _PASSES, pa.nulls(int(goes.sum()), pa.binary()))
                stay = np.flatnonzero(~goes)
                key, several = _shares(_digest(w[stay], hasher), doc[r][stay], places[stay], shares[at[r[stay]]])
                yield out(key, doc[r][stay], places[stay] | np.where(several, _SHARED, 0), _stretches(data, (base[r] + p[r] + j)[stay], np.full(len(stay), window)))

    return joined_rows.mapInArrow(run, f"{RUN_SCHEMA}, bytes binary")


def _decided(h: np.ndarray, doc: np.ndarray, place: np.ndarray, data: np.ndarray, begins: np.ndarray, window: int):
    """``doc``, ``p``, ``n`` of the windows that go among runs with their bytes, whole groups of equal ``h``; and the rows that are the earliest of their share."""
    p, off, n = _parts(place)
    length = np.diff(begins)
    sorted_rows = np.zeros((len(h), int(length.max()) + 2), np.uint8)
    row = np.repeat(np.arange(len(h)), length)
    sorted_rows[row, np.arange(len(row)) - np.repeat(begins[:-1] - begins[0], length)] = data[begins[0] : begins[-1]]
    sorted_rows[:, -2], sorted_rows[:, -1] = n, off
    goes, first = _repeats(*suffix_order(sorted_rows), doc, p)
    yield doc[goes], p[goes], n[goes], np.flatnonzero(first & ((place & _SHARED) != 0))
    # windows of different runs of one minimiser, a bounded number at a time
    k = np.flatnonzero(first)
    group = _changes(h[k])
    k = k[~group | np.r_[~group[1:], False]] if len(k) else k
    starts = np.flatnonzero(_changes(h[k]))
    total = np.r_[0, np.cumsum(n[k])]
    s = 0
    while s < len(starts):
        t = max(s + 1, int(np.searchsorted(total[np.r_[starts[s + 1 :], len(k)]], total[starts[s]] + ASKED, side="right")) + s)
        some = k[starts[s] : starts[t] if t < len(starts) else len(k)]
        r = np.repeat(np.arange(len(some)), n[some])
        j = np.arange(len(r)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
        w = sorted_rows[some[r][:, None], j[:, None] + np.arange(window)]
        goes, _ = _repeats(*suffix_order(w), doc[some[r]], p[some[r]] + j)
        # neighbouring windows of a run in one row
        begin = goes & np.r_[True, ~goes[:-1] | (r[1:] != r[:-1])]
        end = goes & np.r_[~goes[1:] | (r[1:] != r[:-1]), True]
        b = np.flatnonzero(begin)
        yield doc[some[r[b]]], p[some[r[b]]] + j[b], np.flatnonzero(end) - b + 1, b[:0]
        s = t


def decide(asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows that also start earlier: runs of one minimiser meet, sorted by their bytes. Rows with ``bytes`` are the earliest windows of shares, which are still to meet."""

    def run(batches):
        def out(doc, p, n):
            place = _place(p, 0, n, _GOES | _PASSES)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(doc), np.int64)), pa.array(doc), pa.array(place), pa.nulls(len(doc), pa.binary())], names=["h", "doc", "place", "bytes"])

        held, size, last = [], 0, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                place = batch.column(2).to_numpy()
                passes = (place & _PASSES) != 0
                if passes.any():
                    p, _, n = _parts(place[passes])
                    yield out(batch.column(1).to_numpy()[passes], p, n)
                    batch = batch.filter(pa.array(~passes))
                if not batch.num_rows:
                    continue
                held.append(batch)
                size += batch.num_rows
                h = batch.column(0).to_numpy()
                # what belongs to the last minimiser may go on in the next batch
                if size < RUNS or (h[0] == h[-1] and last in (None, h[0])):
                    last = h[-1] if last is None or last == h[0] else last
                    continue
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column(0).to_numpy()
            whole = len(h)
            if batch is not None:
                whole = int(np.searchsorted(h, h[-1]))
            if whole:
                part = table.slice(0, whole)
                doc, place = part.column(1).to_numpy(), part.column(2).to_numpy()
                values = part.column(3).combine_chunks() if part.column(3).num_chunks != 1 else part.column(3).chunk(0)
                for *found, again in _decided(h[:whole], doc, place, *_values(values), window):
                    yield out(*found)
                    if len(again):
                        yield pa.RecordBatch.from_arrays([pa.array(h[again]), pa.array(doc[again]), pa.array(place[again] & ~_SHARED), values.take(pa.array(again))], names=["h", "doc", "place", "bytes"])
            rest = table.slice(whole)
            held, size = (rest.to_batches() if rest.num_rows else []), rest.num_rows
            last = h[-1] if rest.num_rows else None

    return _dealt(asked, "h").mapInArrow(run, f"{RUN_SCHEMA}, bytes binary")


def _covered(length: int, p: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Starts and ends [k, 2] of the maximal stretches that the windows p .. p + n - 1 cover."""
    if not len(p):
        return np.zeros((0, 2), np.int64)
    by = np.argsort(p, kind="stable")
    start, end = p[by], np.minimum((p + n - 1 + window)[by], length)
    far = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, start[1:] > far[:-1]])
    return np.stack([start[new], far[np.r_[new[1:] - 1, len(far) - 1]]], 1)


def placed(docs: DataFrame, id_col: str, text_col: str, place: str) -> DataFrame:
    """``docs`` with ``place``, a long that orders and names documents: a document is an id with its text.

    Where every id has one text that is the id itself, null before all others. Else documents are numbered in the order of
    id (null first) and text digest, so that other texts of the same id or of null ids are places of their own.
    """
    own = F.col(f"`{id_col}`")
    number, key = F.coalesce(own, F.lit(_NO_ID)), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    has_col, id_, key_ = names = unused(docs, "__has", "__doc_id", "__key")
    plain = docs.select(own.isNotNull().alias(has_col), number.alias(id_), key.alias(key_))
    several = F.min(F.struct(has_col, key_)) != F.max(F.struct(has_col, key_))
    if plain.groupBy(id_).agg(several.alias("several")).where("several").isEmpty():
        return docs.withColumn(place, number)
    places = row_numbers(plain.distinct(), [F.col(c) for c in names], place)
    keyed = docs.withColumns({has_col: own.isNotNull(), id_: number, key_: key})
    return stored(keyed.join(places, names).drop(*names), "places")


def _with_repeats(docs: DataFrame, columns: list[str], id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """``columns`` of ``docs``, then the starts and the counts of windows that go."""
    arrow_limits(docs.sparkSession)
    if not 0 < gram < window or window - gram > 254:
        raise ValueError("a window must be longer than a gram, by at most 254 bytes")
    place, doc, starts, counts = unused(docs, "__place", "__doc", "__starts", "__counts")
    docs = placed(docs, id_col, text_col, place)
    rows = docs.select(F.col(place).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    met = stored(meet(text_runs(rows, window, gram)), "runs")
    goes = F.col("place").bitwiseAND(F.lit(_GOES)) != 0
    asks = met.where(~goes)
    found = stored(decide(asked_bytes(rows, asks, hot_minimisers(asks), window), window), "windows")
    again = found.where("bytes is not null").withColumn("h", F.xxhash64("bytes"))
    found = found.where("bytes is null").unionByName(decide(again, window))
    gone = met.where(goes).unionByName(found.drop("bytes")).select("doc", F.shiftright("place", 20).alias("p"), F.shiftright("place", 4).bitwiseAND(F.lit(255)).alias("n"))
    lists = gone.groupBy("doc").agg(F.collect_list("p").alias(starts), F.collect_list("n").alias(counts)).withColumnRenamed("doc", doc)
    own = docs.select(*[F.col(f"`{c}`") for c in columns], place)
    return own.join(lists, F.col(place) == F.col(doc), "left").drop(doc, place)


def _cut(text: bytes, starts, counts, window: int) -> tuple[bytes, np.ndarray]:
    spans = _covered(len(text), np.array(starts or [], np.int64), np.array(counts or [], np.int64), window)
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), spans


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The id, ``n_bytes``, ``spans`` (maximal removed [start, end) byte ranges) and ``kept_sha256`` of every document.

    A byte is removed if a window of ``window`` bytes that covers it also starts in a document with a smaller id, or earlier in the same
    one. Null texts are empty; texts shorter than a window lose nothing. A null id comes
    before all others. Rows that repeat an id and its text are one place: they don't make repeats of one another. Other texts
    of an id, or of null ids, are places of their own, in the order of their SHA-256.
    An empty table gives an empty result.
    """

    def run(batches):
        for batch in pieces(batches, "text", 8 << 20):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            cuts = [_cut(t, s, n, window) for t, s, n in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            spans = pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for _, s in cuts], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), spans, pa.array([hashlib.sha256(k).hexdigest() for k, _ in cuts], pa.string())], names=["id", "n_bytes", "spans", "kept_sha256"])

    made = _with_repeats(docs, [id_col, text_col], id_col, text_col, window, gram).toDF("id", "text", "starts", "counts")
    return made.mapInArrow(run, "id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string").withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes removed from the texts; what is left of a cut character goes too. Null texts stay null."""
    columns = docs.columns
    made = _with_repeats(docs, columns, id_col, text_col, window, gram)
    at = columns.index(text_col)

    def run(batches):
        for batch in pieces(batches, text_col, 8 << 20):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            k = len(columns)
            kept = [None if t is None else _cut(t, s, n, window)[0].decode("utf-8", "ignore") for t, s, n in zip(texts, batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())]
            arrays = list(batch.columns[:k])
            arrays[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return made.mapInArrow(run, docs.schema)
