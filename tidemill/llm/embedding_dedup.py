"""Embedding near-dedup by cover trees and dual traversal.

Vectors are scaled to length one, where cosine ``c`` is distance ``sqrt(2 - 2c)``.
Pivots taken farthest-first from a bounded sample are the upper, nested levels: every
vector goes to the cell of its nearest pivot, and meets another cell only if it lies within that cell's
covering radius (over all vectors) and the threshold of its pivot. Cells are cut into chunks; each pair of chunks is one
task, which builds a cover tree per side (nested levels, halving radii, covering
radii of what lies below) and walks both together level by level. Node pairs that pass the
bound on the last level are compared row by row in double precision.

Pruning follows the data: where vectors lie in no clusters (pairwise distances near
sqrt 2 in high dimension) cells overlap and the work grows with the square of the
distinct vectors, in matrix products of bounded size. No link is lost either way.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, connected_components, cut, joined, named_by_first

THRESHOLD = 0.9
#: Vectors of the sample that pivots come from (and so the most pivots), and distinct vectors of one side of a task.
SAMPLE = 1024
CHUNK = 8192
_BLOCK = 1024
#: Vectors in one batch on their way to the chunks that they meet.
_SENT = 1 << 15
#: Room for rounding in the bounds; links are decided by the cosine itself.
_SLACK = 1e-6


def _apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` rows, each the farthest from those before: any prefix is a net, so levels nest."""
    out, d = [0], _apart(x @ x[0])
    while len(out) < min(k, len(x)):
        far = int(d.argmax())
        if d[far] <= 0:
            break
        out.append(far)
        d = np.minimum(d, _apart(x @ x[far]))
    return np.array(out)


def _net(x: np.ndarray, radius: float, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (``seeds`` first) such that each row lies within ``radius`` of one, and which of them covers each row."""
    near = 1.0 - radius * radius / 2.0
    centres, owner = list(seeds), np.full(len(x), -1)
    owner[seeds] = np.arange(len(seeds))
    for s in range(0, len(seeds), _BLOCK):
        rest = np.flatnonzero(owner < 0)
        if not len(rest):
            break
        g = x[rest] @ x[seeds[s : s + _BLOCK]].T
        best = g.argmax(1)
        fits = g[np.arange(len(rest)), best] >= near
        owner[rest[fits]] = best[fits] + s
    for a in range(0, len(x), _BLOCK):
        rows = np.flatnonzero(owner[a : a + _BLOCK] < 0) + a
        if not len(rows):
            continue
        g = x[rows] @ x[rows].T >= near
        for i, row in enumerate(rows):
            if owner[row] < 0:
                owner[rows[g[i] & (owner[rows] < 0)]] = len(centres)
                owner[row] = len(centres)
                centres.append(row)
        # later rows within reach of a new centre
        fresh = np.array([c for c in centres[len(seeds) :] if a <= c < a + _BLOCK], np.int64)
        later = np.flatnonzero(owner[a + _BLOCK :] < 0) + a + _BLOCK
        if len(fresh) and len(later):
            g = x[later] @ x[fresh].T
            best = g.argmax(1)
            fits = g[np.arange(len(later)), best] >= near
            owner[later[fits]] = (len(centres) - len(fresh)) + best[fits]
    return np.array(centres), owner


def _first_scale(x: np.ndarray, finest: float) -> float:
    """The largest halving of 1 at which a few hundred rows already cover one another: levels above would hold every row."""
    few, scale = x[:: max(1, len(x) // 512)][:512], 1.0
    g = few @ few.T
    np.fill_diagonal(g, -1)
    while scale > finest and (g.max(1, initial=-1) >= 1 - scale * scale / 2).mean() < 0.25:
        scale /= 2
    return scale


def _screen(x: np.ndarray) -> np.ndarray:
    """The first half of the dimensions and the length of the rest, in single precision: their products are never below the cosine."""
    k = x.shape[1] // 2
    return np.concatenate([x[:, :k], np.linalg.norm(x[:, k:], axis=1, keepdims=True)], 1).astype(np.float32)


class CoverTree:
    """Levels from coarse to fine; each has its centres' rows, and of each node the parent, the covering radius over all rows below and their number."""

    def __init__(self, x: np.ndarray, finest: float):
        self.x, self._by, self.screen = x, {}, _screen(x)
        # nets may be rounded: only the radii, taken below in double precision, bound anything
        single, nets = x.astype(np.float32), []
        seeds, scale = np.zeros(min(1, len(x)), np.int64), _first_scale(single, finest)
        while True:
            centres, owner = _net(single, scale, seeds)
            nets.append((centres, owner))
            if scale <= finest or len(centres) == len(x):
                break
            seeds, scale = centres, scale / 2
        self.owner = nets[-1][1]
        below, levels = self.owner, []
        for i in range(len(nets) - 1, -1, -1):
            centres = nets[i][0]
            radius = np.zeros(len(centres))
            # rows in pieces, so no copy of all centres is made
            for a in range(0, len(x), 4 * _BLOCK):
                b = below[a : a + 4 * _BLOCK]
                np.maximum.at(radius, b, _apart(np.einsum("ij,ij->i", x[a : a + 4 * _BLOCK], x[centres[b]])))
            parent = nets[i - 1][1][centres] if i else np.zeros(len(centres), np.int64)
            levels.append((centres, parent, radius, np.bincount(below, minlength=len(centres))))
            below = parent[below]
        self.levels = levels[::-1]
        order = np.argsort(self.owner, kind="stable")
        self.rows, self.starts = order, np.searchsorted(self.owner[order], np.arange(len(nets[-1][0]) + 1))

    def level(self, i: int):
        return self.levels[min(i, len(self.levels) - 1)]

    def below(self, i: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes of level i under nodes of level i - 1 (themselves where the tree has no such level)."""
        if i >= len(self.levels):
            return nodes
        if i not in self._by:
            by = np.argsort(self.levels[i][1], kind="stable")
            self._by[i] = by, np.searchsorted(self.levels[i][1][by], np.arange(len(self.levels[i - 1][0]) + 1))
        by, starts = self._by[i]
        first, n = starts[nodes], starts[nodes + 1] - starts[nodes]
        return by[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def leaf(self, node: int) -> np.ndarray:
        return self.rows[self.starts[node] : self.starts[node + 1]]


def _passing(a: CoverTree, b: CoverTree, ca, ra, p, cb, rb, q, reach: float, ordered: bool = False):
    """Pairs of nodes that the bound leaves. ``ordered``: p and q are the same list, and a pair is wanted once.

    Upper bounds of the cosine in single precision and the largest radius of a block screen; what is left is judged by its own radii.
    """
    x, y = a.x, b.x
    by = np.argsort(ra[p], kind="stable")
    p = p[by]
    q = p if ordered else q
    left, right = a.screen[ca[p]], b.screen[cb[q]]
    for s in range(0, len(p), _BLOCK):
        first = s if ordered else 0
        far = np.minimum(2.0, ra[p[s : s + _BLOCK]].max() + rb[q[first:]] + reach + _SLACK)
        i, j = np.nonzero(left[s : s + _BLOCK] @ right[first:].T >= (1.0 - far * far / 2.0 - 1e-5).astype(np.float32))
        if ordered:
            i, j = i[i <= j], j[i <= j]
        i, j = p[s + i], q[first + j]
        for t in range(0, len(i), 1 << 16):
            m, n = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
            near = _apart(np.einsum("ij,ij->i", x[ca[m]], y[cb[n]])) <= ra[m] + rb[n] + reach + _SLACK
            yield m[near], n[near]


def dual_join(a: CoverTree, b: CoverTree, threshold: float):
    """(rows of a, rows of b, link matrix, same) of each pair of leaves that holds links; ``same``: a leaf with itself.

    With ``a is b`` a pair of different leaves comes once.
    """
    reach, one = math.sqrt(2.0 - 2.0 * threshold), a is b

    def kept(found, sizes):
        # a single row has no pair with itself; small lists are joined, so a node's partners come together
        out, held, size = [], [], 0
        for p, q in found:
            some = (p != q) | (sizes[p] > 1) if one else slice(None)
            held.append((p[some], q[some]))
            size += len(held[-1][0])
            if size >= 1 << 20:
                out.append(tuple(map(np.concatenate, zip(*held))))
                held, size = [], 0
        return out + ([tuple(map(np.concatenate, zip(*held)))] if size else [])

    (ca, _, ra, sizes), (cb, _, rb, others) = a.level(0), b.level(0)
    pairs = kept(_passing(a, b, ca, ra, np.arange(len(ca)), cb, rb, np.arange(len(cb)), reach, one), sizes)
    for i in range(1, max(len(a.levels), len(b.levels))):
        wide_a, wide_b, few_a, few_b = ra, rb, sizes == 1, others == 1
        (ca, parent, ra, sizes), (cb, _, rb, others) = a.level(i), b.level(i)
        found = []
        for ps, qs in pairs:
            # two single rows have met already; of the rest, all partners of the wider node are taken at once
            done = few_a[ps] & few_b[qs]
            if done.any():
                found.append((a.below(i, ps[done]), b.below(i, qs[done])))
                ps, qs = ps[~done], qs[~done]
            by_q = wide_b[qs] > wide_a[ps]
            for some, key in ((~by_q, ps), (by_q, qs)):
                order = np.flatnonzero(some)
                order = order[np.argsort(key[order], kind="stable")]
                for group in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
                    p = a.below(i, ps[group[:1]] if key is ps else ps[group])
                    q = b.below(i, qs[group] if key is ps else qs[group[:1]])
                    for m, n in _passing(a, b, ca, ra, p, cb, rb, q, reach):
                        if one:  # children of one node meet twice
                            once = (m <= n) | (parent[m] != parent[n])
                            m, n = m[once], n[once]
                        found.append((m, n))
        pairs = kept(found, sizes)
    for ps, qs in pairs:
        for p, q in zip(ps, qs):
            same = one and p == q
            rows, cols = a.leaf(int(p)), b.leaf(int(q))
            for s in range(0, len(rows), _BLOCK):
                hit = a.x[rows[s : s + _BLOCK]] @ b.x[cols].T >= threshold
                if same:
                    hit &= rows[s : s + _BLOCK, None] != cols
                if hit.any():
                    yield rows[s : s + _BLOCK], cols, hit, same


def _find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = up


def link_chunks(x: np.ndarray, many: np.ndarray, y: np.ndarray | None, many_y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Over the rows of x, then of y: rows linked to (weighted by ``many``), and a root row of the component within both."""
    finest = math.sqrt(2.0 - 2.0 * threshold) / 2
    a = CoverTree(x, finest)
    b, base = (a, 0) if y is None else (CoverTree(y, finest), len(x))
    weight = many if y is None else np.r_[many, many_y]
    n, parent = np.zeros(len(weight), np.int64), np.arange(len(weight))
    for rows, cols, hit, same in dual_join(a, b, threshold):
        cols = cols + base
        n[rows] += hit @ weight[cols]
        if not same:
            n[cols] += weight[rows] @ hit
        while True:
            r, c = _find(parent, rows), _find(parent, cols)
            low_r = np.where(hit, c[None, :], len(weight)).min(1)
            low_c = np.where(hit, r[:, None], len(weight)).min(0)
            u, v = np.r_[r, c], np.r_[low_r, low_c]
            u, v = u[v < len(weight)], v[v < len(weight)]
            if (u == v).all():
                break
            np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
    return n, _find(parent, np.arange(len(weight)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1. Powers of two take very small and very large components into the range of squares first, exactly."""
    power = np.frexp(np.abs(x).max(axis=1, keepdims=True))[1] if x.size else 0
    x = np.ldexp(x, -power)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(vectors: DataFrame, threshold: float, sample: int, chunk: int) -> DataFrame:
    """Of distinct vectors (``rep``, ``many``, ``v``) of one dimension: ``rep``, ``n`` links in one task, ``root`` there."""
    total = vectors.count()
    few = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, 2.0 * sample / max(total, 1))))) if total > sample else vectors
    picked = np.array([r["v"] for r in few.orderBy(F.xxhash64("rep")).select("v").limit(sample).collect()], np.float64)
    if not len(picked):  # by chance the hashes left none
        picked = np.array([vectors.select("v").first()["v"]], np.float64)
    picked = _unit(picked)
    pivots = picked[farthest_first(picked, max(1, math.ceil(total / chunk)))]
    kind = vectors.schema["v"].dataType.simpleString()

    def nearest(batches):
        for batch in batches:
            if batch.num_rows:
                g = _matrix(batch.column(2)) @ pivots.T
                best = g.argmax(1)
                far = _apart(g[np.arange(len(g)), best])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(far)], names=["rep", "many", "v", "cell", "far"])

    placed = cut(vectors.mapInArrow(nearest, f"rep long, many long, v {kind}, cell int, far double"))
    # one row for each pivot
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()
    limit, parts = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)
    for r in cells:
        limit[r["cell"]] = r["radius"] + math.sqrt(2.0 - 2.0 * threshold) + _SLACK
        parts[r["cell"]] = max(1, math.ceil(r["n"] / chunk))

    def sent(batches):
        """Each vector to the chunks of the cells that it may have links in, as one side of a pair of chunks."""
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, many = batch.column(0).to_numpy(), batch.column(1)
            cell = batch.column(3).to_numpy().astype(np.int64)
            own = cell << 32 | ((rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[cell]
            meets = _apart(_matrix(batch.column(2)) @ pivots.T) <= limit
            meets[np.arange(len(rep)), cell] = True
            i, j = np.nonzero(meets)
            n = parts[j]
            part = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i, other = np.repeat(i, n), np.repeat(j, n) << 32 | part
            for a in range(0, len(i), _SENT):
                k, o = i[a : a + _SENT], other[a : a + _SENT]
                mine = own[k]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, o)), pa.array(np.maximum(mine, o)), pa.array(mine <= o), pa.array(rep[k]), many.take(pa.array(k)), batch.column(2).take(pa.array(k))], names=["p", "q", "first", "rep", "many", "v"])

    work = placed.mapInArrow(sent, f"p long, q long, first boolean, rep long, many long, v {kind}")

    def join(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy()
        table = pa.concat_tables([table.filter(pa.array(first)), table.filter(pa.array(~first))])
        k, x = int(first.sum()), _matrix(table.column("v"))
        rep, many = table.column("rep").to_numpy(), table.column("many").to_numpy()
        alone = table.column("p")[0] == table.column("q")[0]
        if not alone and (k == 0 or k == len(x)):
            n, root = np.zeros(len(x), np.int64), np.arange(len(x))
        elif alone:
            n, root = link_chunks(x, many, None, None, threshold)
        else:
            n, root = link_chunks(x[:k], many[:k], x[k:], many[k:], threshold)
        linked = n > 0
        return pa.table({"rep": rep[linked], "n": n[linked], "root": rep[root][linked]})

    return work.groupBy("p", "q").applyInArrow(join, "rep long, n long, root long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """The id, ``n_links``, ``component_id`` and ``kept`` of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing. Only vectors of the same dimension are compared. Equal vectors are one entry of the
    join with a weight and always link with one another. Rows that repeat an id are vectors of
    their own: each has its own links, and a component is named by the smallest id of its rows; a row with a null id links, but names no component unless its
    own has no id. An empty table gives an empty result.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    arrow_limits(rows.sparkSession)
    vector = F.col(f"`{vector_col}`")
    every = rows.select(F.col(f"`{id_col}`").alias("id"), vector.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = (F.size("v") > 0) & finite & F.exists("v", lambda c: c != 0)
    every = every.withColumn("good", F.coalesce(F.col("v").isNotNull() & good, F.lit(False)))
    alone = every.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    # vectors meet their class again by 128 bits of hash, so they don't move a second time
    value = (F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = cut(every.where("good").groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("many")))
    classes, firsts = named_by_first(classes, "v")
    found, n_good = None, 0
    for width, n in classes.groupBy(F.size("v").alias("width")).agg(F.sum("many").alias("n")).orderBy("width").collect():
        part = _links(classes.where(F.size("v") == width).select(F.col("entry").alias("rep"), "many", "v"), threshold, sample, chunk)
        found, n_good = part if found is None else found.unionByName(part), n_good + n
    if found is None:
        out = alone
    else:
        found = cut(found)
        links = found.groupBy("rep").agg(F.sum("n").alias("n"))
        parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        named = classes.select("entry", "many", *value).join(links, F.col("entry") == F.col("rep"), "left").join(parts, F.col("entry") == F.col("node"), "left")
        named = named.select("h1", "h2", F.col("many").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "entry").alias("component"))
        if firsts is not None:
            named = named.join(firsts, "component").withColumn("component", F.col("__first"))
        named = cut(named.select("h1", "h2", "k", "n_links", F.col("component").alias("component_id")))
        linked = joined(every.where("good").select("id", *value), named, ["h1", "h2"], n_good)
        out = linked.select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
