"""Counts, means and co-moments of all pairs of columns over their pairwise complete rows.

A batch of rows is a matrix of values and one of presence. Their products give,
for every pair at once, how many rows have both and the sums of either value, of
its square and of the product over these rows. Values are shifted by the batch's
means first, and turned into centred moments before batches are combined, so
large means lose no digits. A task combines its batches, and tasks are combined
in two steps, each of which holds one state for a pair of blocks of columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranges
from ..functions.stats import number
from ..session import fixed

#: Columns of a block, and pairs of blocks that one pass over the rows works out (12 MB each in a task).
BLOCK, BLOCKS_AT_ONCE = 512, 16
#: States that the first of the two steps combines the tasks' into.
FIRST_STEP = 64
_PARTS = 6  # count, mean of x, mean of y, centred squares of x and of y, centred products
_STATE = "i int, j int, part int, state binary"


def _products(x: np.ndarray, there: np.ndarray, y: np.ndarray, there_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have both, and sums of x and of its squares over them; columns of y that are always present cost no product."""
    n = np.repeat(there.sum(0)[:, None], y.shape[1], 1)
    s, q = (np.repeat(v.sum(0)[:, None], y.shape[1], 1) for v in (x, x * x))
    gaps = np.flatnonzero(~there_y.all(0))
    if len(gaps):
        m = there_y[:, gaps].astype(float)
        n[:, gaps], s[:, gaps], q[:, gaps] = there.T.astype(float) @ m, x.T @ m, (x * x).T @ m
    return n.astype(float), s, q


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The state of a batch: rows of two blocks of columns, NaN where a value is missing."""
    there, there_y = ~np.isnan(x), ~np.isnan(y)
    endless, endless_y = np.isinf(x), np.isinf(y)
    undefined = None
    if endless.any() or endless_y.any():
        undefined = (endless.T.astype(float) @ there_y + there.T.astype(float) @ endless_y) > 0
        x, y = np.where(endless, 0, x), np.where(endless_y, 0, y)
    shift, shift_y = (np.where(t.any(0), np.where(t, v, 0).sum(0) / np.maximum(t.sum(0), 1), 0) for v, t in ((x, there), (y, there_y)))
    a, b = np.where(there, x - shift, 0), np.where(there_y, y - shift_y, 0)
    n, s, q = _products(a, there, b, there_y)
    _, t, r = (v.T for v in _products(b, there_y, a, there))
    some = np.maximum(n, 1)
    xx, yy = q - s * s / some, r - t * t / some
    for v, square in ((xx, q), (yy, r)):  # a column that is constant over these rows leaves only rounding
        v[v <= 64 * np.finfo(float).eps * square] = 0
    out = np.stack([n, shift[:, None] + s / some, shift_y + t / some, xx, yy, a.T @ b - s * t / some])
    if undefined is not None:
        out[1:, undefined] = np.nan
    return out


def _combined(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    """The moments of two sets of rows from those of each."""
    if a is None:
        return b
    n = a[0] + b[0]
    some = np.maximum(n, 1)
    dx, dy = np.where((a[0] > 0) & (b[0] > 0), b[1:3] - a[1:3], 0)
    w, share = a[0] * b[0] / some, b[0] / some
    mean = [np.where(a[0] > 0, u + d * share, v) for u, v, d in ((a[1], b[1], dx), (a[2], b[2], dy))]
    return np.stack([n, *mean, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def _step(states: DataFrame, *keys: str) -> DataFrame:
    """States that agree in ``keys`` combined as they come in, one held for each pair of blocks."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for i, j, part, state in zip(*(c.to_pylist() for c in batch.columns)):
                key = (i, j, part % FIRST_STEP if "part" in keys else 0)
                shape = (_PARTS, *np.frombuffer(state, np.int32, 2))
                held[key] = _combined(held.get(key), np.frombuffer(state, offset=8).reshape(shape))
        yield from (_row(*key, state) for key, state in held.items())

    part = F.pmod("part", F.lit(FIRST_STEP)) if "part" in keys else F.lit(0)
    return states.repartition("i", "j", part).mapInArrow(run, _STATE)


def _row(i: int, j: int, part: int, state: np.ndarray) -> pa.RecordBatch:
    data = np.array(state.shape[1:], np.int32).tobytes() + state.tobytes()
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (i, j, part)] + [pa.array([data], pa.binary())], names=["i", "j", "part", "state"])


class Moments:
    """``n``, ``mean`` (of the row's column over rows that have the other's too), ``square`` and ``product``, each a matrix."""

    def __init__(self, width: int):
        self.n, self.mean, self.square, self.product = (np.zeros((width, width)) for _ in range(4))

    def put(self, i: int, j: int, state: np.ndarray) -> None:
        a, b = (slice(k, k + v) for k, v in zip((i, j), state.shape[1:]))
        for whole, x, y in ((self.n, 0, 0), (self.mean, 1, 2), (self.square, 3, 4), (self.product, 5, 5)):
            whole[a, b] = state[x]
            whole[b, a] = state[y].T

    def correlations(self) -> np.ndarray:
        """Pearson's coefficients; not a number where a column is constant over the common rows or has infinite values there."""
        own = np.maximum(np.diag(self.n), 1)
        size = np.abs(np.diag(self.mean)) + 3 * np.sqrt(np.diag(self.square) / own)
        # means of batches are known to the last digits of a column's usual size
        rounding = self.n * (64 * np.finfo(float).eps * size[:, None]) ** 2
        square = np.where(self.square <= rounding, 0, self.square)
        below = np.sqrt(square) * np.sqrt(square.T)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(below > 0, np.clip(self.product / below, -1, 1), np.nan)


def co_moments(rows: DataFrame) -> Moments:
    """The moments of all pairs of columns of ``rows`` (doubles; null and not-a-number are missing).

    The result has as many entries as there are pairs of columns and comes to the driver. Up to some 2,500 columns are one
    pass over the rows. Infinite values make the moments of their pairs not a number.
    """
    width = len(rows.columns)
    out = Moments(width)
    starts = range(0, width, BLOCK)
    todo = [(i, j) for i in starts for j in starts if i <= j]
    for k in range(0, len(todo), BLOCKS_AT_ONCE):
        pairs = todo[k : k + BLOCKS_AT_ONCE]
        needed = sorted({b for p in pairs for b in p})
        names = [c for b in needed for c in rows.columns[b : b + BLOCK]]
        at = {b: sum(len(rows.columns[x : x + BLOCK]) for x in needed if x < b) for b in needed}

        def run(batches):
            held: dict = {}
            for batch in batches:
                if batch.num_rows:
                    whole = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])
                    for i, j in pairs:
                        x, y = (whole[:, at[b] : at[b] + min(BLOCK, width - b)] for b in (i, j))
                        held[i, j] = _combined(held.get((i, j)), _moments(x, y))
            for (i, j), state in held.items():
                yield _row(i, j, TaskContext.get().partitionId(), state)

        states = rows.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).mapInArrow(run, _STATE)
        for r in _step(_step(states, "i", "j", "part"), "i", "j").collect():
            shape = (_PARTS, *np.frombuffer(r["state"], np.int32, 2))
            out.put(r["i"], r["j"], np.frombuffer(r["state"], offset=8).reshape(shape))
    return out


def _numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])


def pearson_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    return co_moments(_numbered(df, columns)).correlations()


def spearman_matrix(df: DataFrame, columns: list[str], of_pair) -> np.ndarray:
    """Pearson's coefficients of average ranks over pairwise complete rows.

    The values of all columns are counted together and laid in one order, so all columns are ranked by one sort. A column's
    own ranks are those of a pair whose columns miss the same rows; ``of_pair(a, b)`` ranks the rows of the others anew.
    """
    x = fixed(_numbered(df, columns).withColumn("row", F.monotonically_increasing_id()))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), (F.col(f"c{i}") + 0.0).alias("v")) for i in range(len(columns))])  # -0.0 is 0.0
    cells = x.select("row", F.explode(cells).alias("c")).select("row", "c.*").where("v is not null")
    counts = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    below = ranges.running_totals(counts, ["i", "v"], {"n": "below"})
    # totals run on over the columns: a column's own begin where its first value stands
    ranks = below.select("i", "v", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))
    ranked = cells.join(ranks, ["i", "v"]).groupBy("row").agg(*[F.max(F.when(F.col("i") == i, F.col("rank"))).alias(f"c{i}") for i in range(len(columns))]).drop("row")
    found = co_moments(ranked)
    out = found.correlations()
    alone = np.diag(found.n)
    for i in range(len(columns)):
        for j in range(i):
            if not found.n[i, j] == alone[i] == alone[j]:
                value = of_pair(columns[i], columns[j])
                out[i, j] = out[j, i] = np.nan if value is None else value
    return out
