"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint is a row of positional bytes, eight for each 64-bit lane. With one lane and
at most three differing bits, two fingerprints share at least five of eight bytes,
so three of them lie in one half of the positions: posting lists are kept for the
eight triples of positions inside a half, and no pair is lost. (A list of one byte would hold
1/256 of all fingerprints and its pairs would grow with their square.) For pairs that meet in a list
the shared positional bytes are tallied, pairs below the guaranteed minimum are dropped, and the rest are verified bit by bit.

``drop_near_duplicates`` asks for a similarity of shingles, which no list of bytes guarantees at 0.8. Its
lists are kept for the rarest shingles of each text (a prefix that any two similar texts share an element of). Of the pairs
that meet there, those with near wide fingerprints are looked at, and of the others all but those whose sizes and sketches
prove that they aren't similar: no similar pair is lost. The sets of shingles verify each link.

Equal fingerprints are one entry of the index. A list leaves a spanning forest of
its links, never all pairs, and lists with many entries are cut into chunks that
are compared two by two in separate tasks.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, connected_components, cut, document_rows, joined, named_by_first, pieces, stored, texts_of, unused

WORDS = 3
DISTANCE = 3
SEED = 42
#: Entries of a posting list that one task compares with one another.
CHUNK = 16384
#: Lanes of the fingerprints that go before the sets of shingles, and the share of bits beyond which sketches decide whether a pair is looked at.
#: Texts of similarity 0.8 differ in 0.15 of the bits, tiny ones in up to 0.19, few in more than 5/16.
WIDE_LANES = 4
WIDE_SHARE = 5 / 16
#: Lanes of the sketches of sets: the first with so many bits for a shingle, which tell most pairs below similarity 0.6 apart; larger sets have the last.
SKETCH_LANES = (4, 16, 64, 256)
SKETCH_BITS = 0.6
#: Common shingles come last in the order of prefixes: at most so many, found so often in one of so many texts. Any order loses nothing.
COMMON = 1 << 16
COMMON_COUNT = 8
COMMON_SAMPLE = 16
#: Members of a group whose sets of shingles one task compares with one another.
SETS = 512
#: Long lists (two numbers each) that may be broadcast.
BROADCAST_LISTS = 100_000
_SHORT = 48
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: bytes, words: int = WORDS, lanes: int = 1) -> list[int]:
    """SimHash of the text's word shingles, A-Z lower-cased: a 64-bit number for each lane, all 0 without words."""
    found = _WORD.findall(text.lower())
    if not found:
        return [0] * lanes
    total, n = np.zeros((lanes, 64), np.int64), max(1, len(found) - words + 1)
    for a in range(0, n, 1 << 14):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found[i : i + words]), SEED) for i in range(a, min(n, a + (1 << 14)))], "<u8")
        for lane in range(lanes):
            if lane:
                hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                hashes ^= hashes >> np.uint64(29)
            total[lane] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def _columns(lanes: int) -> list[str]:
    return [f"f{i}" for i in range(lanes)]


def fingerprints(docs: DataFrame, words: int = WORDS, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the fingerprint's lanes ``f0``.. as signed longs, of each whole text; null counts as empty."""
    arrow_limits(docs.sparkSession)
    names = _columns(lanes)

    def run(batches):
        for batch in pieces(batches, text_col, 4 << 20):
            known: dict[bytes, list[int]] = {}
            out = [known[t] if t in known else known.setdefault(t, fingerprint(t, words, lanes)) for t in texts_of(batch.column(1))]
            columns = np.array(out, np.uint64).reshape(-1, lanes).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]], names=["id", *names])

    return document_rows(docs, id_col, text_col).mapInArrow(run, ", ".join(["id long", *[f"{c} long" for c in names]]))


def _near(a: np.ndarray, b: np.ndarray, distance: int, shared: int) -> np.ndarray:
    """Tally the shared positional bytes of rows of lanes, keep the guaranteed minimum, verify."""
    x = a ^ b
    # a byte of x is zero where both hold the same: fold its bits into the lowest one and count
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    differ = np.bitwise_count(y & np.uint64(0x0101010101010101)).sum(-1, dtype=np.int64)
    out = differ <= 8 * x.shape[-1] - shared
    out[out] = np.bitwise_count(x[out]).sum(-1, dtype=np.int64) <= distance
    return out


def forest(prints: np.ndarray, distance: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links that connect what all links among the prints [row, lane] connect."""
    return _forest(prints, partial(_near, distance=distance, shared=shared))


def _forest(prints: np.ndarray, near: Callable) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` for links that ``near`` tells from rows: breadth first, so each row is reached once."""
    left, a, b = np.arange(len(prints)), [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for f in front:
                linked = near(prints[left], prints[f])
                if linked.any():
                    got = left[linked]
                    a.append(np.full(len(got), f))
                    b.append(got)
                    reached.append(got)
                    left = left[~linked]
                    if not len(left):
                        break
            front = np.concatenate(reached) if reached else left[:0]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(keys: list[np.ndarray], prints: np.ndarray, near: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) within runs of equal keys."""
    new = np.zeros(len(prints), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(prints)])
    a, b = [], []
    short = np.repeat(size <= _SHORT, size)
    run = np.cumsum(new)
    for d in range(1, int(size[size <= _SHORT].max(initial=1))):
        i = np.flatnonzero((run[d:] == run[:-d]) & short[d:])
        i = i[near(prints[i], prints[i + d])]
        a.append(i)
        b.append(i + d)
    for s, n in zip(start[size > _SHORT], size[size > _SHORT]):
        x, y = _forest(prints[s : s + n], near)
        a.append(x + s)
        b.append(y + s)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


_TRIPLES = [t for half in (range(4), range(4, 8)) for t in itertools.combinations(half, 3)]


def near_links(entries: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """``a``, ``b`` (values of ``entry``): links whose components are those of all pairs with at most ``distance`` differing bits.

    ``entries`` holds distinct fingerprints ``f0``, each named by the long ``entry``.
    """
    if not 0 <= distance <= 3:
        raise ValueError("byte triples guarantee pairs of at most 3 differing bits")
    byte = [F.shiftrightunsigned("f0", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    lists = F.array(*[F.lit(g << 24).cast("long") + byte[x] * 65536 + byte[y] * 256 + byte[z] for g, (x, y, z) in enumerate(_TRIPLES)])
    posted = entries.select("entry", "f0", F.explode(lists).alias("list"))
    long = posted.groupBy("list").count().where(F.col("count") > chunk).select("list", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    long = cut(long)
    n_long = long.count()
    if n_long:  # lists beyond the chunk are few; they are broadcast only below a checked number
        posted = posted.join(F.broadcast(long) if n_long <= BROADCAST_LISTS else long, "list", "left")
    else:
        posted = posted.withColumn("chunks", F.lit(None).cast("int"))
    posted = posted.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return listed_links(posted, ["f0"], partial(_near, distance=distance, shared=8 - distance))


def _rows(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and rows of lanes, from columns of longs and a last one that may hold lanes as bytes; rows of equally many lanes together."""
    longs = np.stack([np.ascontiguousarray(c).view(np.uint64) for c in columns if c.dtype != object], 1)
    if columns[-1].dtype != object:
        yield np.arange(len(longs)), longs
        return
    sizes = np.array([len(x) for x in columns[-1]])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.concatenate([longs[at], np.frombuffer(b"".join(columns[-1][at]), "<u8").reshape(len(at), -1)], 1)


def listed_links(posted: DataFrame, names: list[str], near: Callable) -> DataFrame:
    """``a``, ``b``: links whose components are those of all pairs that meet in a ``list`` and are ``near`` by rows of ``names``.

    ``posted`` has a row for each ``list`` of an ``entry``, and the number of ``chunks`` that the list is cut into.
    """
    mine = F.pmod(F.xxhash64("entry"), F.col("chunks")).cast("int")
    posted = posted.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    posted = posted.select("list", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "entry", *names)
    posted = posted.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "entry")

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                held = now if held is None else [np.r_[x, y] for x, y in zip(held, now)]
            if held is None or not len(held[0]):
                continue
            # what belongs to the last list may go on in the next batch
            whole = len(held[0])
            if batch is not None:
                same = np.ones(whole, bool)
                for k in held[:3]:
                    same &= k == k[-1]
                whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if whole:
                for at, prints in _rows([c[:whole] for c in held[4:]]):
                    a, b = _links([k[at] for k in held[:3]], prints, near)
                    a, b = contracted_pairs(held[3][at[a]], held[3][at[b]])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                held = [k[whole:] for k in held]

    return posted.mapInArrow(run, "a long, b long")


def contracted_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``contracted`` does, for the links of a few lists, before they leave their task."""
    if not len(a):
        return a, b
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    new = np.r_[True, b[1:] != b[:-1]]
    low = a[new][np.cumsum(new) - 1]
    pairs = np.unique(np.stack([np.r_[a[new], low[a > low]], np.r_[b[new], a[a > low]]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def contracted(links: DataFrame) -> DataFrame:
    """Links with the same components: ``b`` keeps its smallest ``a``, and its other ``a`` are linked to that one.

    The lists of one group differ in the entry that the others hang on, so each entry comes with several; those
    pairs are few and collapse. An entry is ``b`` once for each list (and pair of chunks) that it is in.
    """
    low = links.distinct().withColumn("m", F.min("a").over(Window.partitionBy("b")))
    # many rows name the same few hubs: each half is made distinct before it is shuffled, and none is written out twice
    hubs = low.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).distinct()
    return low.select(F.col("m").alias("a"), "b").distinct().unionByName(hubs).where("a <> b").distinct()


def simhash_components(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id reachable by links) of each row.

    Texts without words have fingerprint zero and link like any other; null texts
    are empty; rows that repeat an id keep their own fingerprints. Null ids belong to
    the component of their fingerprint, whose id is null only without any other id.
    An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, words, 1, id_col, text_col))
    # an id may come with several texts, and a fingerprint with many ids
    classes = cut(prints.groupBy("f0").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("k")))
    entries, firsts = named_by_first(classes, "f0")
    links = cut(contracted(cut(near_links(entries, distance))))
    parts = connected_components(links)
    found = entries.join(parts, entries.entry == parts.node, "left").select("f0", "k", F.coalesce("component", "entry").alias("component"))
    if firsts is not None:
        found = found.join(firsts, "component").withColumn("component", F.col("__first"))
    found = cut(found.select("f0", "k", F.col("component").alias("component_id")))
    digits = F.lower(F.lpad(F.hex("f0"), 16, "0"))
    return joined(prints, found, ["f0"], prints.count()).select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z lower-cased; a text of fewer words is one shingle."""
    found = _WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64)
    each = np.array([xxhash.xxh64_intdigest(w, SEED) for w in found], np.uint64)
    n = max(1, len(each) - words + 1)
    out = np.full(n, min(words, len(each)), np.uint64)
    for k in range(min(words, len(each))):
        out = (out ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _wide(found: np.ndarray, lanes: int) -> np.ndarray:
    """SimHash lanes of a set of hashes."""
    total, hashes = np.zeros((lanes, 64), np.int64), found
    for lane in range(lanes):
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        hashes = hashes ^ (hashes >> np.uint64(29))
        for a in range(0, len(hashes), 1 << 14):
            total[lane] += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(found), axis=1, bitorder="little").view("<u8").ravel()


def _kind(size: float) -> int:
    """The place in SKETCH_LANES of the sketch of a set of this size."""
    return next((k for k, lanes in enumerate(SKETCH_LANES) if 64 * lanes >= SKETCH_BITS * size), len(SKETCH_LANES) - 1)


def _kinds(size: int, similarity: float) -> range:
    """The kinds of sketches by which a set is compared: its own, and those of larger sets that may be similar."""
    return range(_kind(size), _kind((size + 1e-9) / similarity) + 1)


def sketch(found: np.ndarray, lanes: int) -> np.ndarray:
    """A bit for each value of a hash, set if an odd number of elements has it: two sets differ in at least as many elements as their sketches in bits."""
    count = np.bincount((found & np.uint64(64 * lanes - 1)).view(np.int64), minlength=64 * lanes)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view("<u8")


def _open(a: np.ndarray, b: np.ndarray, lanes: int, distance: int, similarity: float) -> np.ndarray:
    """Whether sets may be similar, from rows of fingerprint, size and sketch: near fingerprints, or sketches that leave it open.

    Similar sets differ in at most (1 - similarity) / (1 + similarity) of the sum of their sizes.
    """
    bits = np.bitwise_count(a ^ b)
    x, y = a[..., lanes].astype(np.float64), b[..., lanes].astype(np.float64)
    open_ = bits[..., lanes + 1 :].sum(-1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * (x + y) + 1e-9
    return (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9) & (open_ | (bits[..., :lanes].sum(-1, dtype=np.int64) <= distance))


def _prefix(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles, common ones last: two sets share ``similarity`` of each at least, so one of these."""
    size = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
    if len(common):
        often = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.r_[found[~often], found[often]]
    return found[:size]


def common_shingles(texts: DataFrame, words: int, sample: int = COMMON_SAMPLE, count: int = COMMON_COUNT) -> np.ndarray:
    """Sorted hashes of shingles that many texts (``text``) hold, counted in a sample; only the order of prefixes follows them."""

    def run(batches):
        for batch in pieces(batches, "text", 4 << 20):
            found = np.concatenate([np.zeros(0, np.uint64), *[shingles(t, words) for t in texts_of(batch.column(0))]])
            one, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n)], names=["list", "n"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text").mapInArrow(run, "list long, n long")
    often = some.groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") >= count).orderBy(F.desc("n"), "list").limit(COMMON)
    return np.sort(np.array([r["list"] for r in often.collect()], np.int64).view(np.uint64))


def shingle_entries(rows: DataFrame, words: int, similarity: float, lanes: int) -> DataFrame:
    """``id``, ``key`` of the rows (which have a ``text`` too), a 128-bit digest of their set of shingles (``set``), its fingerprint, ``size``, ``kind`` and ``sketches`` of that kind and the next ones, and its ``lists``."""
    held = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, words))
    names = _columns(lanes)

    def run(batches):
        common = held.value
        for batch in pieces(batches, "text", 4 << 20):
            sets = [shingles(t, words) for t in texts_of(batch.column(2))]
            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary())
            prints = np.array([_wide(s, lanes) for s in sets], np.uint64).reshape(-1, lanes).view(np.int64).T
            kinds = [_kinds(len(s), similarity) for s in sets]
            sketches = pa.array([[sketch(s, SKETCH_LANES[k]).tobytes() for k in ks] for s, ks in zip(sets, kinds)], pa.list_(pa.binary()))
            sizes, first = pa.array([len(s) for s in sets], pa.int64()), pa.array([ks[0] for ks in kinds], pa.int32())
            lists = [_prefix(s, common, similarity) for s in sets]
            ends = np.cumsum([0, *map(len, lists)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *lists]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digest, *[pa.array(np.ascontiguousarray(c)) for c in prints], sizes, first, sketches, lists], names=["id", "key", "set", *names, "size", "kind", "sketches", "lists"])

    return rows.mapInArrow(run, ", ".join(["id long, key binary, set binary", *[f"{c} long" for c in names], "size long, kind int, sketches array<binary>, lists array<long>"]))


def loose_links(entries: DataFrame, lanes: int, distance: int, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """``a``, ``b``: links that connect all similar sets, and others that fingerprints and sketches don't tell apart.

    Sets meet in the lists of the larger one's kind. Most lists have one entry, so only the others meet the sketches.
    """
    kinds = F.sequence("kind", F.col("kind") + F.size("sketches") - 1)
    posted = entries.select("entry", "lists", F.explode(kinds).alias("kind")).select("entry", "kind", F.explode("lists").alias("list"))
    posted = posted.select(F.xxhash64("list", "kind").alias("list"), "entry", "kind")
    shared = posted.groupBy("list").count().where(F.col("count") > 1)
    wide = F.array(*[F.lit(n / SKETCH_LANES[0] / chunk) for n in SKETCH_LANES])[F.col("kind")]  # chunks of one kind have as many bytes as those of another
    # stored, so the shuffle files of all the other lists are gone when sketches are shuffled
    met = stored(posted.join(shared, "list").select("list", "entry", "kind", F.ceil(F.col("count") * wide).cast("int").alias("chunks")), "met")
    names = [*_columns(lanes), "size"]
    rows = entries.select("entry", *names, "kind", F.posexplode("sketches").alias("more", "sketch")).withColumn("kind", F.col("kind") + F.col("more")).drop("more")
    return listed_links(met.join(rows, ["entry", "kind"]), [*names, "sketch"], partial(_open, lanes=lanes, distance=distance, similarity=similarity))


def similar_forest(sets: list[np.ndarray], prints: np.ndarray, similarity: float, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``forest`` does, for sets of that Jaccard similarity at least."""
    sizes, left, a, b = np.array([len(s) for s in sets]), np.arange(len(sets)), [], []
    width = SKETCH_LANES[_kind(sizes.max(initial=0))]
    rows = np.concatenate([prints, sizes[:, None].astype(np.uint64), np.array([sketch(s, width) for s in sets], np.uint64).reshape(-1, width)], 1)
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            f = front.pop()
            may = left[_open(rows[left], rows[f], prints.shape[1], distance, similarity)]
            may = may[sizes[may] > 0]
            if not len(may) or not sizes[f]:
                continue
            flat = np.concatenate([sets[k] for k in may])
            hit = sets[f][np.minimum(np.searchsorted(sets[f], flat), sizes[f] - 1)] == flat
            both = np.add.reduceat(hit, np.cumsum(sizes[may]) - sizes[may], dtype=np.int64)
            got = may[both >= similarity * (sizes[may] + sizes[f] - both) - 1e-9]
            a += [f] * len(got)
            b += got.tolist()
            front += got.tolist()
            left = np.setdiff1d(left, got, assume_unique=True)
    return np.array(a, np.int64), np.array(b, np.int64)


def similar_links(rows: DataFrame, entries: DataFrame, groups: DataFrame, words: int, similarity: float, lanes: int, distance: int, size: int = SETS) -> DataFrame:
    """``a``, ``b``: links by the sets of shingles within ``groups`` (``node``, ``component``), large ones by pairs of parts of about ``size`` members."""
    names = _columns(lanes)
    parts = groups.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks"))
    members = groups.join(parts, "component").join(entries, F.col("node") == F.col("entry")).select("key", "entry", *names, "component", "chunks")
    texts = rows.select("key", "text").join(members, "key").select("entry", *names, "component", "chunks", "text")

    def sets(batches):
        for batch in pieces(batches, "text", 4 << 20):
            found = pa.array([shingles(t, words).tobytes() for t in texts_of(batch.column(batch.num_columns - 1))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=[*batch.schema.names[:-1], "found"])

    made = texts.mapInArrow(sets, ", ".join(["entry long", *[f"{c} long" for c in names], "component long, chunks int, found binary"]))
    mine = F.pmod(F.xxhash64("entry"), F.col("chunks")).cast("int")
    made = made.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    made = made.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "entry", *names, "found")
    made = made.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "entry")

    def run(batches):
        last, entry, prints, found = None, [], [], []

        def links():
            a, b = similar_forest(found, np.array(prints, np.int64).view(np.uint64), similarity, distance)
            a, b = np.array(entry, np.int64)[a], np.array(entry, np.int64)[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for c, i, j, e, *rest in zip(*[x.to_pylist() for x in batch.columns]):
                if (c, i, j) != last:
                    if len(entry) > 1:
                        yield links()
                    last, entry, prints, found = (c, i, j), [], [], []
                if not entry or entry[-1] != e:  # the same text in several rows is one
                    entry.append(e)
                    prints.append(rest[:-1])
                    found.append(np.frombuffer(rest[-1], np.uint64))
        if len(entry) > 1:
            yield links()

    return made.mapInArrow(run, "a long, b long")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = WIDE_LANES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id, once; null ids come last.

    Links join texts whose sets of word shingles have a Jaccard similarity of at least ``similarity``. A document is an id
    with its text: other texts of the same id, or of null ids, are documents of their own.
    """
    arrow_limits(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.unhex(F.sha2(text, 256))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), text.alias("text"))
    distance, names = int(WIDE_SHARE * 64 * lanes), _columns(lanes)
    prints = stored(shingle_entries(rows, words, similarity, lanes), "shingles")
    # a set is named by the smallest id that has it, and told by that document's text
    known = [*names, "size", "kind", "sketches", "lists"]
    one = F.min_by(F.struct("id", "key", *known), F.struct(F.col("id").isNull(), "id", "key"))
    entries, _ = named_by_first(stored(prints.groupBy("set").agg(one.alias("x")).select("set", F.col("x.id").alias("first"), *[f"x.{c}" for c in ("key", *known)]), "entries"), "key")
    loose = connected_components(cut(contracted(cut(loose_links(entries, lanes, distance, similarity)))))
    links = cut(contracted(cut(similar_links(rows, entries.select("key", "entry", *names), loose, words, similarity, lanes, distance))))
    parts = connected_components(links)
    # a component's smallest entry is its document with the smallest id
    roots = entries.join(parts, F.col("entry") == F.col("node"), "left").where(F.coalesce("component", "entry") == F.col("entry"))
    own, keep, kept = unused(docs, "__key", "__keep", "__kept")
    roots = cut(roots.select(F.col("first").alias(keep), F.col("key").alias(kept)))
    found = docs.withColumn(own, key).join(roots, F.col(f"`{id_col}`").eqNullSafe(F.col(keep)) & (F.col(own) == F.col(kept)), "left_semi")
    return found.dropDuplicates([id_col, own]).drop(own)
