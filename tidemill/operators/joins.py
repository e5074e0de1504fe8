"""Joins that Spark SQL has no syntax for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..functions import ranges
from ..functions.stats import col, need_columns


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], columns: list[str]) -> DataFrame:
    """Each left row with ``columns`` of the latest right row of its key at or before ``on``, null if there is none.

    Both sides are laid in one order of key and time, cut into ranges, and each range hands its last right row on to the next: a
    hot key spreads over many ranges, and there is no inequality join. Of right rows with equal keys and times the
    largest tuple of values wins. Rows with a null key or time find nothing.
    """
    need_columns(left, [on, *by])
    need_columns(right, [on, *by, *columns])
    keys = [col(c) for c in (*by, on)]
    whole = F.lit(True)
    for k in keys:
        whole = whole & k.isNotNull()
    value = F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(by)], *[col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    kind = right.select(value.alias("v")).schema["v"].dataType
    a = left.select(F.struct(*map(col, left.columns)).alias("row"), *[k.alias(f"o{i}") for i, k in enumerate(keys)], F.lit(1).alias("side"), F.lit(None).cast(kind).alias("v"))
    b = right.where(whole).select(F.lit(None).cast(a.schema["row"].dataType).alias("row"), *[k.alias(f"o{i}") for i, k in enumerate(keys)], F.lit(0).alias("side"), value.alias("v"))
    order = [F.col(f"o{i}") for i in range(len(keys))] + [F.col("side"), F.col("v")]
    met = ranges.neighbours(a.unionByName(b), {"v": F.col("v")}, order, ahead=False).where("side = 1")
    found = F.col("__prev_v.value")
    same = F.col(f"o{len(by)}").isNotNull()
    for i in range(len(by)):
        same = same & (found[f"k{i}"] == F.col(f"o{i}"))
    return met.select("row.*", *[F.when(same, found[f"v{i}"]).alias(c) for i, c in enumerate(columns)])


#: Points of one bin at least, and bins at most; points and intervals of one piece of a bin at most, unless they are a small share of all.
POINTS_PER_BIN, BINS, PIECE, SHARE = 1024, 4096, 200_000, 50_000
#: Places looked at for each cut between two bins.
LOOKED_AT = 32
#: Pairs written at once.
PAIRS = 1 << 16
_CLOSED = {"both": (True, True), "left": (True, False), "right": (False, True), "neither": (False, False)}


def _axis(df: DataFrame, name: str):
    """A column as a double that never reverses the order of two values."""
    kind = dict(df.dtypes)[name]
    x = F.unix_micros(col(name).cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(col(name)) if kind == "date" else col(name)
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def _pieces(rows: DataFrame, name: str) -> DataFrame:
    """Bins with so many rows that they are cut, and into how many pieces. The driver sees a count for each bin."""
    counts = {r["bin"]: r["n"] for r in rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = max(PIECE, sum(counts.values()) // SHARE)
    return rows.sparkSession.createDataFrame([(b, -(-n // limit)) for b, n in counts.items() if n > limit], f"bin int, `{name}` int")


def _cuts(left: DataFrame, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places, in order, that cut the points into about ``m`` bins of equal size, as range partitioning finds them.

    They come from some of the points; where they lie decides how even the bins are, not which pairs are found.
    """
    if m < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    some = left.select("h", "x").sample(min(1.0, LOOKED_AT * m / n), 7).toArrow()
    h, x = some.column(0).to_numpy(), some.column(1).to_numpy()
    order = np.lexsort((x, h))
    at = order[np.unique(np.arange(1, m) * len(order) // m)] if len(order) else order
    h, x = h[at], x[at]
    new = np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])][: len(h)]
    return h[new], x[new]


def _places(h: np.ndarray, x: np.ndarray, keys: np.ndarray, values: np.ndarray, side: str) -> np.ndarray:
    """Where (key, value) pairs belong among ordered pairs ``h``, ``x``: before their equals (left) or behind them (right)."""
    steps = np.unique(x)
    wide = len(steps) + 1
    known = np.unique(h)
    group = np.searchsorted(known, keys, "left")
    # a key that isn't there belongs before the next one's first pair
    there = known[np.minimum(group, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)
    code = group * wide + np.where(there, np.searchsorted(steps, values, side), 0)
    return np.searchsorted(np.searchsorted(known, h) * wide + np.searchsorted(steps, x), code, "left")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of points and the intervals that hold them. Of each piece of a bin the intervals come first, then the points in the order of keys and places."""
    key, held = None, []
    for batch in batches:
        keys = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]) if batch.num_rows else np.zeros((0, 4), np.int64)
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
        for s, e in zip(starts, [*starts[1:], len(keys)]):
            if key != (now := tuple(keys[s, :3])):
                key, held = now, []
            part = batch.slice(s, e - s)
            h = part.column(4).to_numpy()
            if not keys[s, 3]:
                held.append((h, part.column(5).to_numpy(), part.column(6).to_numpy(), part.column(8)))
                continue
            x, points = part.column(5).to_numpy(), part.column(7)
            for of, a, b, spans in held:
                near = np.flatnonzero((of >= h[0]) & (of <= h[-1]))  # both are in the order of keys
                first, last = (_places(h, x, of[near], v[near], side) for v, side in ((a, "left"), (b, "right")))
                n = np.maximum(last - first, 0)
                ends = np.cumsum(n)
                for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                    pair = np.arange(at, min(at + PAIRS, ends[-1]))
                    i = np.searchsorted(ends, pair, "right")
                    j = first[i] + pair - (ends[i] - n[i])
                    yield pa.RecordBatch.from_arrays([points.take(pa.array(j)), spans.take(pa.array(near[i]))], names=["l", "r"])


def range_join(points: DataFrame, intervals: DataFrame, on: str, low: str, high: str, by: list[str] | None = None, closed: str = "both") -> DataFrame:
    """Each row of ``points`` with each row of ``intervals`` (of equal ``by``) whose ``low`` to ``high`` holds its ``on``: all columns of both.

    Points, in the order of their keys and then of ``on``, are cut into bins of about equally many, and an interval goes to the
    bins that it meets of its own key: two, and one more for each bin that lies in it as a whole. The join is one on bins. Bins
    with many points or intervals are cut into pieces that meet one another. In a task sorted points are searched for the ends
    of intervals: work grows with the rows and the pairs found, not with all pairs. ``closed`` tells which
    ends belong to an interval. Null and not-a-number find nothing; other columns of the same name on both sides are an error.
    """
    by = list(by or [])
    need_columns(points, [on, *by])
    need_columns(intervals, [low, high, *by])
    if closed not in _CLOSED:
        raise InputError(f"closed is one of {', '.join(_CLOSED)}")
    both = [c for c in intervals.columns if c in points.columns and c not in by]
    if both:
        raise InputError(f"columns on both sides: {', '.join(both)}")
    h = F.xxhash64(*map(col, by)) if by else F.lit(0).cast("long")
    whole = lambda df: F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    known = F.lit(True)
    for c in by:
        known = known & col(c).isNotNull()
    left = points.where(known).select(h.alias("h"), _axis(points, on).alias("x"), whole(points).alias("l")).where("x is not null")
    right = intervals.where(known).select(h.alias("h"), _axis(intervals, low).alias("x"), _axis(intervals, high).alias("y"), whole(intervals).alias("r")).where("x <= y")
    n = left.count()
    m = max(1, min(BINS, n // POINTS_PER_BIN))
    cut_keys, cuts = _cuts(left, n, m)

    @F.pandas_udf("int")
    def bin_of(h: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(_places(cut_keys, cuts, h.to_numpy(), x.to_numpy(), "right").astype(np.int32))

    left = left.withColumn("bin", bin_of("h", "x"))
    right = right.withColumn("bin", F.explode(F.sequence(bin_of("h", "x"), bin_of("h", "y"))))
    of_points, of_intervals = _pieces(left, "points"), _pieces(right, "intervals")
    for side in (of_points, of_intervals):
        left, right = (df.join(F.broadcast(side), "bin", "left") for df in (left, right))
    own = lambda value, n: F.pmod(F.xxhash64(value), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    kinds = [df.schema[c].dataType for df, c in ((left, "l"), (right, "r"))]
    left = left.select("bin", own("l", F.col("points")).alias("p"), every(F.col("intervals")).alias("i"), F.lit(1).alias("side"), "h", "x", F.lit(None).cast("double").alias("y"), "l", F.lit(None).cast(kinds[1]).alias("r"))
    right = right.select("bin", every(F.col("points")).alias("p"), own("r", F.col("intervals")).alias("i"), F.lit(0).alias("side"), "h", "x", "y", F.lit(None).cast(kinds[0]).alias("l"), "r")
    rows = left.unionByName(right).repartition("bin", "p", "i").sortWithinPartitions("bin", "p", "i", "side", "h", "x")
    pairs = rows.mapInArrow(_merged, T.StructType([T.StructField("l", kinds[0]), T.StructField("r", kinds[1])]))
    at = {("l", c): F.col(f"l.c{i}") for i, c in enumerate(points.columns)} | {("r", c): F.col(f"r.c{i}") for i, c in enumerate(intervals.columns)}
    x, a, b = at["l", on], at["r", low], at["r", high]
    with_low, with_high = _CLOSED[closed]
    fits = ((a <= x) if with_low else (a < x)) & ((x <= b) if with_high else (x < b))
    for c in by:  # a hash brought them together
        fits = fits & (at["l", c] == at["r", c])
    return pairs.where(fits).select(*[at["l", c].alias(c) for c in points.columns], *[at["r", c].alias(c) for c in intervals.columns if c not in by])
