"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the largest permitted length, in tokens. Each shard,
a bounded share of the documents by hash, is packed longest piece first: a piece goes
to the open bin with the least room that still holds it. If none does, a new bin opens. Which length
it gets is decided over all permitted lengths at once: for each, the pieces that are left are tried in it, and the
length whose cost per token held is least wins. A shard is packed this way and with every single opening length, and the packing of
least total cost stays. At the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_limits, cut, document_rows, pieces, texts_of

#: Permitted sequence lengths, and what a sequence of length L costs: its tokens, a fixed share, and attention's square.
LENGTHS = (512, 1024, 2048, 4096, 8192)
FIXED_COST = 64.0
SQUARE_COST = 1 / 65536
#: Documents of a shard, on average.
SHARD_DOCS = 20_000


def cost_of(length: int) -> float:
    return length + FIXED_COST + SQUARE_COST * length * length


class _Sorted:
    """Numbers filed under keys; the least key that is enough and the largest that fits are found by bisection over the distinct keys."""

    def __init__(self):
        self.keys: list[int] = []
        self.held: dict[int, list[int]] = {}

    def put(self, key: int, number: int) -> None:
        if key not in self.held:
            self.held[key] = []
            bisect.insort(self.keys, key)
        self.held[key].append(number)

    def take(self, key: int) -> int:
        found = self.held[key].pop()
        if not self.held[key]:
            del self.held[key]
            self.keys.pop(bisect.bisect_left(self.keys, key))
        return found

    def at_least(self, key: int) -> int | None:
        i = bisect.bisect_left(self.keys, key)
        return self.keys[i] if i < len(self.keys) else None


def _filled(size: int, length: int, left: list[int], many: dict[int, int]) -> int:
    """Tokens that a bin of ``length`` opened by a piece of ``size`` would hold if the largest pieces left that fit went in, one after the other."""
    used, i = size, len(left)
    while used < length:
        i = bisect.bisect_right(left, length - used, 0, i) - 1
        if i < 0:
            break
        take = min(many[left[i]], (length - used) // left[i])
        used += take * left[i]
    return used


def _packed(sizes: list[int], lengths: list[int], opening: int | None) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and what each bin holds. ``opening``: the least length that a bin opens with, or None to choose it anew each time."""
    many: dict[int, int] = {}
    for size in sizes:
        many[size] = many.get(size, 0) + 1
    left = sorted(many)  # distinct sizes of the pieces that have no bin yet
    opened, where, at, used, room = _Sorted(), [], [], [], []
    for size in sizes:
        many[size] -= 1
        if not many[size]:
            del many[size]
            left.pop(bisect.bisect_left(left, size))
        key = opened.at_least(size)
        if key is not None:
            b = opened.take(key)
        else:
            fits = lengths[bisect.bisect_left(lengths, size) :]
            if opening is not None:
                length = max(fits[0], opening)
            else:
                held = [(_filled(size, n, left, many), n) for n in fits]
                length = min((cost_of(lengths[bisect.bisect_left(lengths, u)]) / u, n) for u, n in held)[1]
            b = len(used)
            used.append(0)
            room.append(length)
        where.append(b)
        at.append(used[b])
        used[b] += size
        if room[b] > used[b]:
            opened.put(room[b] - used[b], b)
    return where, at, used


def best_fit(sizes, lengths=LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece (in the order given, which should be descending), and each bin's final length.

    Pieces must be longer than 0 and no longer than the largest length.
    """
    lengths, sizes = sorted(lengths), [int(s) for s in sizes]
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    if any(not 0 < s <= lengths[-1] for s in sizes):
        raise ValueError("a piece is empty or longer than the largest length")
    best = None
    for opening in (None, *lengths):
        where, at, used = _packed(sizes, lengths, opening)
        final = [lengths[bisect.bisect_left(lengths, u)] for u in used]
        cost = sum(map(cost_of, final))
        if best is None or cost < best[0]:
            best = cost, where, at, final
    return tuple(np.array(x, np.int64) for x in best[1:])


def word_counts(texts: list[bytes]) -> list[int]:
    """White-space words of texts: a measure that needs no tokenizer."""
    return [len(t.split()) for t in texts]


def token_counts(rank_file: str, pattern: str):
    """A measure of texts in tokens of byte-level BPE, what ``sequences`` assembles."""
    return lambda texts: [len(bpe.encode(t.decode(), rank_file, pattern)) for t in texts]


def pack(docs: DataFrame, lengths=LENGTHS, id_col: str = "doc_id", text_col: str = "text", count=word_counts, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each piece: the id, ``text_hash``, ``copy``, ``piece`` (from 0), ``start`` and ``n_tokens`` within the document, ``shard``, ``bin_id``,
    ``bin_offset`` and ``bin_length``. (``shard``, ``bin_id``) names a bin.

    Lengths are those that ``count`` gives for whole texts. Null and empty texts are one
    piece of no tokens and need no bin (null). Rows that repeat an id are packed as documents of their own; rows without an id that hold the same
    text are told apart by ``copy``. An empty table gives no bins. Shards are dealt by a hash, so a group of copies spreads; a shard's bins depend on its rows alone and not on
    their order, so a lost executor changes nothing.
    """
    spark, longest = docs.sparkSession, max(lengths)
    arrow_limits(spark)

    def measure(batches):
        for batch in pieces(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(count(texts_of(batch.column(2))), pa.int64())], names=["id", "text_hash", "n"])

    rows = document_rows(docs, id_col, text_col).toDF("id", "text").select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    # three branches follow; texts are measured once for all
    rows = cut(rows.mapInArrow(measure, "id long, text_hash long, n long")).withColumn("copy", F.lit(0).cast("long"))
    # rows without an id are counted first, so that equal ones can be dealt to different shards
    nameless = rows.where("id is null").groupBy("id", "text_hash", "n").agg(F.count(F.lit(1)).alias("k"))
    nameless = nameless.select("id", "text_hash", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("copy"))
    rows = rows.where("id is not null").unionByName(nameless)
    shards = max(1, math.ceil(docs.count() / shard_docs))
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0))).cast("array<long>")
    split = rows.select("id", "text_hash", "copy", "n", F.explode(parts).alias("piece")).withColumn("start", F.col("piece") * longest)
    split = split.select("id", "text_hash", "copy", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(longest)).alias("n_tokens"))
    own = ["id", "text_hash", "copy", "piece", "start", "n_tokens"]
    held = split.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("id", "text_hash", "copy", "piece"), F.lit(shards)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "id", "text_hash", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        where, at, final = best_fit(group["n_tokens"].to_numpy(), lengths)
        return group.assign(bin_id=where, bin_offset=at, bin_length=final[where])

    kinds = ", ".join(f"{c} long" for c in (*own, "shard", "bin_id", "bin_offset", "bin_length"))
    made = held.groupBy("shard").applyInPandas(run, kinds)
    none = [F.lit(None).cast("long").alias(c) for c in ("shard", "bin_id", "bin_offset", "bin_length")]
    return made.unionByName(split.where("n_tokens = 0").select(*own, *none)).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, packed: DataFrame, rank_file: str, pattern: str, pad: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training sequences that ``packed`` (of ``token_counts`` with the same ranks) describes: ``shard``, ``bin_id``, ``ids`` (``bin_length`` token ids, the
    rest filled with ``pad``) and ``segments`` (where each piece of which document lies).

    Texts are encoded where they are read, and only the ids of pieces move, to their bin; a bin is bounded by the largest permitted length.
    """
    arrow_limits(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).dropDuplicates(["id", "text_hash"])
    placed = packed.where("bin_id is not null").withColumnRenamed(id_col, "id")
    lists = placed.groupBy("id", "text_hash").agg(F.collect_list(F.struct("copy", "piece", "start", "n_tokens", "shard", "bin_id", "bin_offset", "bin_length")).alias("places"))
    both = texts.alias("t").join(lists.alias("p"), F.col("t.id").eqNullSafe(F.col("p.id")) & (F.col("t.text_hash") == F.col("p.text_hash"))).select("t.id", "t.text", "p.places")
    fields = ["shard long", "bin_id long", "bin_offset long", "bin_length long", "id long", "piece long", "start long", "n_tokens long", "ids binary"]

    def encode(batches):
        for batch in pieces(batches, "text", 4 << 20):
            out = []
            for key, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                ids = bpe.encode(text, rank_file, pattern)
                out += [(p["shard"], p["bin_id"], p["bin_offset"], p["bin_length"], key, p["piece"], p["start"], p["n_tokens"], ids[p["start"] : p["start"] + p["n_tokens"]].tobytes()) for p in places]
            columns = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f == "ids binary" else pa.int64()) for c, f in zip(columns, fields)], names=[f.split()[0] for f in fields])

    moved = both.mapInArrow(encode, ", ".join(fields))
    segment = F.struct("bin_offset", "id", "piece", "start", "n_tokens")
    bins = moved.groupBy("shard", "bin_id", "bin_length").agg(F.array_sort(F.collect_list(segment)).alias("segments"), F.array_sort(F.collect_list(F.struct("bin_offset", "ids"))).alias("parts"))

    def join(batches):
        for batch in batches:
            whole = []
            for length, parts in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                row = np.full(length, pad, np.int64)
                for part in parts:
                    ids = np.frombuffer(part["ids"], "<u4")
                    row[part["bin_offset"] : part["bin_offset"] + len(ids)] = ids
                whole.append(row)
            flat = np.concatenate(whole) if whole else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, whole)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), batch.column(3)], names=["shard", "bin_id", "ids", "segments"])

    return bins.mapInArrow(join, "shard long, bin_id long, ids array<bigint>, segments array<struct<bin_offset: bigint, id: bigint, piece: bigint, start: bigint, n_tokens: bigint>>")
