"""Analysis kinds: ``kind(df, **params) -> DataFrame`` with a small result, and sampling."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions import dates, ranges, stats
from ..functions.stats import col, kinds, need_columns, number, numeric_columns, pearson
from ..session import fixed
from . import moments
from .clean import _absent, _numeric

#: Bits of a digit of ranks: each digit is one pass. Up to so many distinct pairs are counted on the driver instead.
DIGIT_BITS = 4
FEW_PAIRS = 100_000
#: Coefficients that one aggregation works out; more come from products of whole batches.
FEW_COEFFICIENTS = 45
AGGS = ("count", "sum", "mean", "min", "max", "median", "std", "nunique", "first", "last")


def aggregate(df: DataFrame, column: str, agg: str, order_by=None):
    """One aggregate expression; missing values don't count, a sum of nothing is 0."""
    if agg not in AGGS:
        raise InputError(f"unknown aggregate: {agg}")
    need_columns(df, [column])
    x = number(df, column) if dict(df.dtypes)[column] in ("float", "double") else col(column)
    if agg in ("first", "last"):
        if not order_by:
            raise InputError("order_by is needed: rows have no order of their own")
        rank = F.when(x.isNotNull(), F.struct(*map(col, order_by)))
        return (F.min_by if agg == "first" else F.max_by)(x, rank)
    if agg == "sum":
        return F.coalesce(F.sum(x), F.lit(0))
    return {"count": F.count, "mean": F.avg, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_samp, "nunique": F.count_distinct}[agg](x)


def groupby(df: DataFrame, by, metrics, top: int | None = None, order_by=None) -> DataFrame:
    """Missing is a group; sorted by key, missing last; ``top`` keeps the first groups in key order.

    Distinct values are counted by their digests and medians of large groups are selected by rank, so no row is expanded
    for a distinct count and no buffer holds a large group.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    if not by or not metrics:
        raise InputError("keys and metrics are needed")
    need_columns(df, by)
    made = [aggregate(df, m["column"], m["agg"], order_by).alias(f"m{i}") for i, m in enumerate(metrics)]
    keys = [col(c).alias(f"k{i}") for i, c in enumerate(by)]
    apart = {agg: list(dict.fromkeys(m["column"] for m in metrics if m["agg"] == agg)) for agg in ("nunique", "median")}
    large = _large_groups(df, keys, apart["median"]) if apart["median"] else None
    whole = [a for a, m in zip(made, metrics) if not (m["agg"] == "nunique" or m["agg"] == "median" and large is not None)]
    out = df.groupBy(*keys).agg(*whole or [F.lit(1).alias("any")])
    for agg, found in (("nunique", _distinct(df, apart["nunique"], keys) if apart["nunique"] else None), ("median", _medians(df, keys, apart["median"], large) if large is not None else None)):
        if found is not None:
            same = F.lit(True)
            for i in range(len(by)):
                same = same & F.col(f"a.k{i}").eqNullSafe(F.col(f"b.k{i}"))
            value = {i: F.col(f"b.v{apart[agg].index(m['column'])}") for i, m in enumerate(metrics) if m["agg"] == agg}
            out = out.alias("a").join(found.alias("b"), same, "left").select("a.*", *[(F.coalesce(v, F.lit(0)) if agg == "nunique" else v).alias(f"m{i}") for i, v in value.items()])
    out = out.orderBy(*[F.col(f"k{i}").asc_nulls_last() for i in range(len(by))])
    out = out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(by)], *[F.col(f"m{i}").alias(f"{m['column']} / {m['agg']}") for i, m in enumerate(metrics)])
    return out.limit(int(top)) if top else out


#: Large groups whose brackets the driver keeps; where there are more their values are sorted.
GROUPS = 2000
#: Steps of the grid that brackets a median.
GRID = 1000


def _large_groups(df: DataFrame, keys: list, columns: list[str]) -> DataFrame | None:
    """Keys of the groups that have more values of a column than one buffer may hold; None if there are none."""
    many = F.greatest(*[F.count(number(df, c)) for c in columns], F.lit(0)) > stats.EXACT_ROWS
    large = df.groupBy(*keys).agg(many.alias("many")).where("many").drop("many")
    return None if large.isEmpty() else fixed(large)


def _same_keys(n: int):
    same = F.lit(True)
    for i in range(n):
        same = same & F.col(f"k{i}").eqNullSafe(F.col(f"g{i}"))
    return same


def _medians(df: DataFrame, keys: list, columns: list[str], large: DataFrame) -> DataFrame:
    """By group (``k0``, ``k1``, ...): exact medians of columns, as ``v0``, ``v1``, ...; those of large groups without a buffer of their values."""
    names = [f"k{i}" for i in range(len(keys))]
    few = large.count() <= GROUPS
    groups = large.toDF(*[f"g{i}" for i in range(len(keys))]).withColumn("g", F.monotonically_increasing_id())
    if not few:
        groups = fixed(groups)
    groups = df.sparkSession.createDataFrame(groups.collect(), groups.schema) if few else groups
    rows = df.select(*keys, *[(number(df, c) + F.lit(0.0)).alias(f"x{j}") for j, c in enumerate(columns)])
    small = rows.join(F.broadcast(groups) if few else groups, _same_keys(len(keys)), "left_anti")
    out = small.groupBy(*names).agg(*[F.median(f"x{j}").alias(f"v{j}") for j in range(len(columns))])
    met = rows.join(F.broadcast(groups) if few else groups, _same_keys(len(keys)))
    found = groups
    for j in range(len(columns)):
        x = met.select("g", F.col(f"x{j}").alias("x")).where("x is not null")
        middle = df.sparkSession.createDataFrame(_bracketed(x), f"h long, v{j} double") if few else _selected(x).withColumnRenamed("v", f"v{j}")
        found = found.join(middle, F.col("g") == F.col("h"), "left").drop("h")
    return out.unionByName(found.select(*[F.col(f"g{i}").alias(n) for i, n in enumerate(names)], *[f"v{j}" for j in range(len(columns))]))


def _bracketed(rows: DataFrame) -> list[tuple[int, float]]:
    """Medians of ``x`` by ``g`` (at most ``GROUPS`` groups): brackets on a grid of approximate quantiles narrow until they hold few values or one."""
    spark = rows.sparkSession
    state = {r["g"]: [r["low"], r["high"], 0, r["n"], (r["n"] - 1) / 2] for r in rows.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).collect()}
    grid = [k / GRID for k in range(GRID + 1)]
    stuck: set[int] = set()

    def inside(todo) -> DataFrame:
        some = spark.createDataFrame([(g, state[g][0], state[g][1]) for g in todo], "h long, low double, high double")
        return rows.join(F.broadcast(some), (F.col("g") == F.col("h")) & (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).select("g", "x")

    while todo := [g for g, (low, high, _, n, _) in state.items() if n > stats.EXACT_ROWS and low < high and g not in stuck]:
        ends = {}
        for r in inside(todo).groupBy("g").agg(F.percentile_approx("x", grid, stats.BRACKETS).alias("q")).collect():
            low, high, below, n, rank = state[r["g"]]
            k = int((rank - below) / max(n - 1, 1) * GRID)
            ends[r["g"]] = (low if k < 2 else r["q"][k - 1], high if k > GRID - 3 else r["q"][k + 2])
        some = spark.createDataFrame([(g, *ends[g]) for g in todo], "h long, low double, high double")
        counted = inside(todo).join(F.broadcast(some), F.col("g") == F.col("h")).groupBy("g").agg(F.count_if(F.col("x") < F.col("low")).alias("b"), F.count_if((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).alias("m"))
        for r in counted.collect():
            g, (low, high, below, n, rank) = r["g"], state[r["g"]]
            if below + r["b"] <= rank <= below + r["b"] + r["m"] - 1 and (r["m"] < n or ends[g][0] == ends[g][1]):
                state[g] = [*ends[g], below + r["b"], r["m"], rank]
            else:
                stuck.add(g)
    out = [(g, low) for g, (low, high, *_) in state.items() if low == high]
    rest = [g for g in state if state[g][0] < state[g][1]]
    if rest:
        # the two middle values of what lies inside, of each group
        some = spark.createDataFrame([(g, math.floor(state[g][4]) - state[g][2], math.ceil(state[g][4]) - state[g][2]) for g in rest], "h long, first long, second long")
        counts = inside(rest).groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
        out += [(r["g"], r["v"]) for r in _at_ranks(counts, some).collect()]
    return out


def _at_ranks(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """``g``, ``v``: the mean of the values at two ranks (``first``, ``second``) of each group ``h``, from ``g``, ``x`` and how often ``n`` it stands; values are sorted in ranges."""
    ordered = ranges.running_totals(counts, ["g", "x"], {"n": "below"})
    starts = ordered.groupBy(F.col("g").alias("s")).agg(F.min("below").alias("start"))
    met = ordered.join(starts.join(ranks, F.col("s") == F.col("h")), F.col("g") == F.col("s")).withColumn("at", F.col("below") - F.col("start"))
    held = [F.max(F.when((F.col("at") <= F.col(r)) & (F.col(r) < F.col("at") + F.col("n")), F.col("x"))) for r in ("first", "second")]
    return met.groupBy("g").agg(((held[0] + held[1]) / 2).alias("v"))


def _selected(rows: DataFrame) -> DataFrame:
    """Medians of ``x`` by ``g``, as ``h`` and ``v``, of any number of groups."""
    counts = fixed(rows.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n")))
    size = F.sum("n") - 1
    ranks = counts.groupBy(F.col("g").alias("h")).agg(F.floor(size / 2).alias("first"), F.ceil(size / 2).alias("second"))
    return _at_ranks(counts, ranks).withColumnRenamed("g", "h")


def _digest(df: DataFrame, column: str) -> list:
    """128 bits that tell values of a column apart; 0.0 and -0.0 are one value, not-a-number is none."""
    v = number(df, column) + F.lit(0.0) if dict(df.dtypes)[column] in ("float", "double") else col(column)
    return [F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b")]


def _wide_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``i`` (number of the column), ``v`` (value as text), ``n``: the values of all columns by one unpivoted count. Values are told apart by their digests."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), *_digest(df, c), F.when(~_absent(df, c), col(c).cast("string")).alias("v")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("c")).select("c.*").where("v is not null").groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v")).drop("a", "b")


def _distinct(df: DataFrame, columns: list[str], keys: list) -> DataFrame:
    """By group (``keys``): distinct values of columns, as ``v0``, ``v1``, ...; digests move, map-side deduplicated, values don't."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), *_digest(df, c), (~_absent(df, c)).alias("there")) for i, c in enumerate(columns)])
    names = [f"k{i}" for i in range(len(keys))]
    once = df.select(*keys, F.explode(cells).alias("c")).select(*names, "c.*").where("there").groupBy(*names, "i", "a", "b").agg(F.lit(1))
    return once.groupBy(*names).agg(*[F.count_if(F.col("i") == i).alias(f"v{i}") for i in range(len(columns))])


def _top(counts: DataFrame) -> DataFrame:
    """By column number: present values, distinct ones, and the most frequent with its count (ties by value)."""
    best = F.min_by("v", F.struct(-F.col("n"), "v"))
    return counts.groupBy("i").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("top"), F.max("n").alias("freq"))


def describe(df: DataFrame, columns=None) -> DataFrame:
    """A row for each column: count, unique, top and freq of text, statistics of numbers; one scan for the numbers, one for the other columns together."""
    columns = list(columns or df.columns)
    need_columns(df, columns)
    kind = kinds(df)
    numeric, others = [c for c in columns if kind[c] == "numeric"], [c for c in columns if kind[c] != "numeric"]
    rows = {}
    x = {c: number(df, c) for c in numeric}
    aggs = [a.alias(f"{i}:{n}") for i, c in enumerate(numeric) for n, a in (("count", F.count(x[c])), ("mean", F.avg(x[c])), ("std", F.stddev_samp(x[c])), ("min", F.min(x[c])), ("max", F.max(x[c])))]
    with ThreadPoolExecutor(3) as pool:
        tops = pool.submit(lambda: {r["i"]: r for r in _top(_wide_counts(df, others)).collect()}) if others else None
        got = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
        q = stats.quantiles(df, x, [0.25, 0.5, 0.75], got["n"])
        found = tops.result() if others else {}
    for i, c in enumerate(numeric):
        rows[c] = (c, got[f"{i}:count"], None, None, None, got[f"{i}:mean"], got[f"{i}:std"], got[f"{i}:min"], *(q[c] or [None] * 3), got[f"{i}:max"])
    for i, c in enumerate(others):
        r = found.get(i)
        rows[c] = (c, *((r["count"], r["unique"], r["top"], r["freq"]) if r else (0, 0, None, None)), *[None] * 7)
    numbers_of = ", ".join(f"{n} double" for n in ("mean", "std", "min", "p25", "p50", "p75", "max"))
    return df.sparkSession.createDataFrame([rows[c] for c in columns], f"column string, count long, unique long, top string, freq long, {numbers_of}")


def value_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    need_columns(df, [column])
    v = df.where(~_absent(df, column)).select(col(column).cast("string").alias("value"))
    return v.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(int(top))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal bins from min to max, the last one closed, empty ones included; a constant column gets half a unit to each side."""
    _numeric(df, column)
    bins, x = max(2, min(200, int(bins))), number(df, column)
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        raise InputError("no values")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    slot = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(x.isNotNull()).groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(F.broadcast(counted), "bin", "left")  # at most 200 rows
    edges = [low + i * width for i in range(bins)] + [high]
    labels = F.array(*[F.lit(f"{a:.4g}~{b:.4g}") for a, b in zip(edges, edges[1:])])
    at = F.array(*map(F.lit, edges))
    here = F.col("bin") + 1
    return out.select("bin", F.element_at(labels, here).alias("label"), F.element_at(at, here).alias("low"), F.element_at(at, here + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("count")).orderBy("bin")


def boxplot(df: DataFrame, columns=None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    if not columns:
        raise InputError("no numeric column")
    for c in columns:
        _numeric(df, c)
    x = {c: number(df, c) for c in columns}
    ends = df.agg(*[a for i, c in enumerate(columns) for a in (F.min(x[c]).alias(f"a{i}"), F.max(x[c]).alias(f"b{i}"))]).first()
    rows = []
    for i, (c, q) in enumerate(stats.quantiles(df, x, [0.25, 0.5, 0.75]).items()):
        if q:
            gap = 1.5 * (q[2] - q[0])
            rows.append((c, *[round(v, 6) for v in (ends[f"a{i}"], *q, ends[f"b{i}"], q[0] - gap, q[2] + gap)]))
        else:
            rows.append((c, *[None] * 7))
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{n} double" for n in ("min", "q1", "median", "q3", "max", "low", "high")))


def outliers(df: DataFrame, columns=None, method: str = "iqr") -> DataFrame:
    """By column: bounds (of iqr only), number of outliers, percentage of all rows, smallest and largest value."""
    columns = list(columns or numeric_columns(df))
    bounds = stats.outlier_bounds(df, columns, method)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.sum(stats.is_outlier(df, c, bounds[c]).cast("long")).alias(f"o{i}"), F.min(number(df, c)).alias(f"a{i}"), F.max(number(df, c)).alias(f"b{i}")]
    one, shown = df.agg(*aggs), method == "iqr"
    rows = [F.struct(F.lit(c).alias("column"), F.lit(bounds[c][0] if shown else None).cast("double").alias("low"), F.lit(bounds[c][1] if shown else None).cast("double").alias("high"), F.coalesce(f"o{i}", F.lit(0)).alias("n_outliers"), F.round(F.coalesce(F.try_divide(F.col(f"o{i}") * 100.0, F.col("n")), F.lit(0.0)), 2).alias("percent"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max")) for i, c in enumerate(columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _average_rank(df: DataFrame, x: str, name: str) -> DataFrame:
    """Ranks with ties averaged: counts by value, running totals over the sorted values, joined back; no row is sorted in one task twice."""
    counts = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.count(F.lit(1)).alias("__n"))
    counts = ranges.running_total(counts, x, "__n", "__below")
    ranks = counts.select(F.col(x).alias("__v"), (F.col("__below") + (F.col("__n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(x) == F.col("__v"), "left").drop("__v")


def spearman(df: DataFrame, x: str, y: str) -> float | None:
    """Pearson's coefficient of average ranks over pairwise complete rows."""
    both = df.select(number(df, x).alias("a"), number(df, y).alias("b")).where("a is not null and b is not null")
    ranked = _average_rank(_average_rank(both, "a", "ra"), "b", "rb")
    return ranked.agg(pearson(F.col("ra"), F.col("rb"))).first()[0]


def kendall(df: DataFrame, x: str, y: str) -> float | None:
    """Tau-b. Values become dense ranks; pairs of ranks with their counts are compared by merge counting over the digits of x's rank.

    Two pairs first differ in exactly one digit of x, from the top. So for each digit the rows that agree above it form a group, and
    each row needs to know how many of its group have a larger digit and a smaller y. Rows sorted by (group, y) answer that with
    running totals, range by range: no task holds a group and no pairs are made.
    """
    pairs = df.select(number(df, x).alias("x"), number(df, y).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    pairs = fixed(pairs)

    def ties(*keys: str):
        row = pairs.groupBy(*keys).agg(F.sum("w").alias("w")).agg(F.sum("w"), F.sum(F.col("w").cast("decimal(38,0)") * (F.col("w") - 1) / 2), F.count(F.lit(1))).first()
        return int(row[0] or 0), int(row[1] or 0), row[2]

    (n, tied_x, distinct), (_, tied_y, _), (_, tied_both, _) = ties("x"), ties("y"), ties("x", "y")
    every = n * (n - 1) // 2
    if not every or every == tied_x or every == tied_y:
        return None
    found = _swapped_few(pairs) if pairs.count() <= FEW_PAIRS else _swapped(pairs, distinct)
    concordant = every - tied_x - tied_y + tied_both - found
    return (concordant - found) / math.sqrt((every - tied_x) * (every - tied_y))


def _swapped_few(pairs: DataFrame) -> int:
    """Pairs of rows whose order in y is against that in x, of a bounded number of distinct pairs, with the same digits as below, one bit each."""
    x, y, w = (np.array(c) for c in zip(*pairs.select("x", "y", "w").collect()))
    rank, w, total = np.unique(x, return_inverse=True)[1], w.astype(object), 0
    for bit in range(max(1, int(rank.max()).bit_length())):
        group, one = rank >> (bit + 1), (rank >> bit & 1).astype(bool)
        by = np.lexsort((y, group))
        before = np.r_[0, np.cumsum(np.where(one, w, 0)[by])][:-1]
        new_group = np.r_[True, group[by][1:] != group[by][:-1]]
        first = np.flatnonzero(new_group | np.r_[True, y[by][1:] != y[by][:-1]])
        run = np.searchsorted(first, np.arange(len(by)), side="right") - 1
        start = np.flatnonzero(new_group)[np.cumsum(new_group) - 1]
        total += int((np.where(one, 0, w)[by] * (before[first[run]] - before[start])).sum())
    return total


def _swapped(pairs: DataFrame, distinct: int) -> int:
    """Pairs of rows whose order in y is against that in x, by digits of x's rank."""
    ranks = ranges.row_numbers(pairs.select("x").distinct(), [F.col("x")], "rank").select(F.col("x").alias("at"), "rank")
    ranked = fixed(pairs.join(ranks, F.col("x") == F.col("at")).select("rank", "y", "w"))
    digits = max(1, -(-int(distinct - 1).bit_length() // DIGIT_BITS))
    swapped = 0  # pairs whose order in y is against that in x
    above = range(1, 1 << DIGIT_BITS)
    for k in range(digits):
        digit = F.shiftright("rank", DIGIT_BITS * k).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("long"))
        group = F.shiftright("rank", DIGIT_BITS * (k + 1)).alias("g")
        by_value = ranked.groupBy(group, "y").agg(*[F.sum(F.when(digit == d, F.col("w")).otherwise(0)).alias(f"c{d}") for d in range(1 << DIGIT_BITS)])
        counted = ranges.running_totals(by_value, ["g", "y"], {f"c{d}": f"b{d}" for d in above})
        starts = counted.groupBy("g").agg(*[F.min(f"b{d}").alias(f"s{d}") for d in above])
        larger, total = F.lit(0).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")
        for d in reversed(above):
            larger = larger + (F.col(f"b{d}") - F.col(f"s{d}"))
            total = total + F.col(f"c{d - 1}").cast("decimal(19,0)") * larger.cast("decimal(19,0)")
        swapped += int(counted.join(starts, "g").agg(F.sum(total.cast("decimal(38,0)"))).first()[0] or 0)
    return swapped


def corr(df: DataFrame, columns=None, method: str = "pearson") -> DataFrame:
    """Matrix rows: ``column`` and one coefficient for each column, rounded to 4 digits, over pairwise complete rows."""
    columns = list(columns or [c for c in numeric_columns(df)])
    if len(columns) < 2:
        raise InputError("two numeric columns are needed")
    for c in columns:
        _numeric(df, c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if method not in ("pearson", "spearman", "kendall"):
        raise InputError(f"unknown method: {method}")
    if method == "pearson" and len(pairs) <= FEW_COEFFICIENTS:
        row = df.agg(*[pearson(number(df, a), number(df, b)).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
        found = {p: row[i] for i, p in enumerate(pairs)}
    elif method == "kendall" or len(pairs) == 1:
        found = {(a, b): (kendall if method == "kendall" else spearman)(df, a, b) for a, b in pairs}
    else:
        made = moments.pearson_matrix(df, columns) if method == "pearson" else moments.spearman_matrix(df, columns, lambda a, b: spearman(df, a, b))
        found = {(a, b): float(made[i, j]) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j}
    found = {p: None if r is None or math.isnan(r) else r for p, r in found.items()}
    rounded = lambda v: None if v is None else round(v, 4)
    rows = [tuple([a] + [1.0 if a == b else rounded(found.get((a, b), found.get((b, a)))) for b in columns]) for a in columns]
    return df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"`{c}` double" for c in columns))


def trend(df: DataFrame, date_column: str, value_column: str, freq: str = "M", agg: str = "sum", order_by=None) -> DataFrame:
    """``period``, ``value`` (4 digits). Empty periods inside the span are 0 for sum, count and nunique and left out for the rest."""
    need_columns(df, [date_column, value_column])
    freq = freq if freq in dates.STEPS else "M"
    when = col(date_column) if kinds(df)[date_column] == "datetime" else dates.parse_date(col(date_column))
    dated = df.withColumn("period", dates.period(when.cast("timestamp_ntz"), freq)).where("period is not null")
    out = dated.groupBy("period").agg(aggregate(df, value_column, agg, order_by).cast("double").alias("value"))
    if agg in ("sum", "count", "nunique"):
        span = out.agg(F.min("period").alias("a"), F.max("period").alias("b"))
        spine = span.select(F.explode(F.sequence("a", "b", F.expr(dates.STEPS[freq]))).alias("period"))
        out = spine.join(out, "period", "left").select("period", F.coalesce("value", F.lit(0.0)).alias("value"))
    return out.where("value is not null").select("period", F.round("value", 4).alias("value")).orderBy("period")


def kpi(df: DataFrame, agg: str = "sum", value_column: str | None = None, date_column: str | None = None) -> DataFrame:
    """``value``, ``previous``, ``delta_percent``: with a date, of the latest half of the span and of the half before."""
    if agg not in ("sum", "mean", "count"):
        raise InputError("agg must be sum, mean or count")
    if agg != "count" and not value_column:
        raise InputError("value_column is needed")
    x = number(df, value_column) if value_column else F.lit(1)

    def value(inside):
        v = F.when(inside, x)
        return {"sum": F.coalesce(F.sum(v), F.lit(0)), "mean": F.avg(v), "count": F.count(v)}[agg].cast("double")

    if not date_column:
        return df.agg(value(F.lit(True)).alias("value"), F.lit(None).cast("double").alias("previous"), F.lit(None).cast("double").alias("delta_percent"))
    need_columns(df, [date_column])
    day = (col(date_column) if kinds(df)[date_column] == "datetime" else dates.parse_date(col(date_column))).cast("date")
    low, high = df.agg(F.min(day), F.max(day)).first()
    if low is None:
        raise InputError(f"{date_column} holds no dates")
    half = ((high - low).days + 1) // 2
    if half < 1:
        return df.agg(value(F.lit(True)).alias("value"), F.lit(None).cast("double").alias("previous"), F.lit(None).cast("double").alias("delta_percent"))
    now, before = day > F.date_sub(F.lit(high), half), (day <= F.date_sub(F.lit(high), half)) & (day > F.date_sub(F.lit(high), 2 * half))
    out = df.agg(value(now).alias("value"), value(before).alias("previous"))
    return out.withColumn("delta_percent", F.round(F.try_divide((F.col("value") - F.col("previous")) * 100, F.abs("previous")), 1))


def funnel(df: DataFrame, mode: str = "events", column: str | None = None, steps=None, user_column: str | None = None, columns=None) -> DataFrame:
    """``step``, ``n``, ``conversion`` (percent of the step before, 1 digit)."""
    if mode == "columns":
        columns = list(columns or [])
        if len(columns) < 2:
            raise InputError("two columns are needed")
        need_columns(df, columns)
        names = columns
        counted = df.agg(*[F.count(F.when(~_absent(df, c), 1)).alias(str(i)) for i, c in enumerate(columns)])
        rows = counted.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(str(i)).alias("n")) for i in range(len(columns))])).alias("r")).select("r.*")
    else:
        names = [str(s) for s in steps or []]
        if len(names) < 2:
            raise InputError("two steps are needed")
        need_columns(df, [column] + ([user_column] if user_column else []))
        n = F.count_distinct(col(user_column)) if user_column else F.count(F.lit(1))
        rows = df.where(col(column).cast("string").isin(*names)).groupBy(col(column).cast("string").alias("s")).agg(n.alias("n"))
        rows = rows.select((F.array_position(F.array(*map(F.lit, names)), F.col("s")) - 1).cast("int").alias("i"), "n")
    every = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, step string")
    out = every.join(rows, "i", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = F.lag("n").over(Window.orderBy("i"))  # as many rows as there are steps
    return out.withColumn("conversion", F.round(F.try_divide(F.col("n") * 100.0, before), 1)).orderBy("i").select("step", "n", "conversion")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    need_columns(df, [row, column])
    pairs = df.select(col(row).cast("string").alias("row"), col(column).cast("string").alias("c")).where("row is not null and c is not null")
    values = [r[0] for r in pairs.select("c").distinct().orderBy("c").limit(1001).collect()]
    if len(values) > 1000:
        raise InputError("more than 1000 columns")
    return pairs.groupBy("row").pivot("c", values).count().na.fill(0).orderBy("row")


def profile(df: DataFrame, columns=None) -> DataFrame:
    """By column: kind, count, missing, distinct values; numeric statistics, the first and last date, or the five most frequent values.

    One scan for counts and moments, one for the values of all columns together.
    """
    columns, kind = list(columns or df.columns), kinds(df)
    need_columns(df, columns)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs.append(F.count(F.when(~_absent(df, c), 1)).alias(f"{i}:count"))
        if kind[c] == "numeric":
            x = number(df, c)
            aggs += [F.min(x).alias(f"{i}:min"), F.max(x).alias(f"{i}:max"), F.avg(x).alias(f"{i}:mean"), F.stddev_samp(x).alias(f"{i}:std")]
        elif kind[c] == "datetime":
            aggs += [F.min(col(c)).cast("string").alias(f"{i}:first"), F.max(col(c)).cast("string").alias(f"{i}:last")]
    got = df.agg(*aggs).first().asDict()
    q = stats.quantiles(df, {c: number(df, c) for c in columns if kind[c] == "numeric"}, [0.25, 0.5, 0.75], got["n"])
    listed = [i for i, c in enumerate(columns) if kind[c] in ("text", "boolean")]
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))
    found = _distinct(df, columns, []).first() or {}
    distinct = {i: found[f"v{i}"] for i in range(len(columns))}
    tops: dict[int, list] = {}
    if listed:
        counts = _wide_counts(df, [columns[i] for i in listed]).withColumn("i", F.element_at(F.array(*map(F.lit, listed)), F.col("i") + 1))
        best = counts.withColumn("rank", rank).where("rank <= 5").orderBy("i", "rank").collect()
        for r in best:
            tops.setdefault(r["i"], []).append((r["v"], r["n"]))
    rows = []
    for i, c in enumerate(columns):
        missing = got["n"] - got[f"{i}:count"]
        quarters = q.get(c) or [None] * 3
        rows.append((c, kind[c], got[f"{i}:count"], missing, round(missing * 100 / got["n"], 2) if got["n"] else 0.0, distinct.get(i, 0), *[got.get(f"{i}:{n}") for n in ("min", "max", "mean", "std")], *quarters, got.get(f"{i}:first"), got.get(f"{i}:last"), tops.get(i, [])))
    return df.sparkSession.createDataFrame(rows, "column string, kind string, count long, missing long, missing_percent double, nunique long, min double, max double, mean double, std double, p25 double, median double, p75 double, first string, last string, top_values array<struct<value: string, count: long>>")


def missing_matrix(df: DataFrame, order_by, buckets: int = 40) -> DataFrame:
    """Missing percentage of each column in up to ``buckets`` stretches of rows in ``order_by``'s order."""
    need_columns(df, order_by)
    n = df.count()
    if not n:
        raise InputError("no rows")
    numbered = ranges.row_numbers(df, list(map(col, order_by)))
    seg = min(buckets, n)
    bucket = F.floor(F.col("__row") * seg / n).cast("int")
    return numbered.groupBy(bucket.alias("bucket")).agg(*[F.round(F.avg(_absent(df, c).cast("double")) * 100, 2).alias(c) for c in df.columns]).orderBy("bucket")


def duplicates(df: DataFrame) -> DataFrame:
    """Rows in groups of equal rows, rows beyond the first of each, and groups."""
    groups = df.groupBy(*map(col, df.columns)).count().where("count > 1")
    return groups.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra_rows"), F.count(F.lit(1)).alias("groups"))


def duplicate_rows(df: DataFrame, limit: int = 100) -> DataFrame:
    """The first rows of duplicate groups."""
    groups = df.groupBy(*map(col, df.columns)).count().where("count > 1")
    return groups.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).select(*map(col, df.columns)).orderBy(*map(col, df.columns)).limit(limit)


def text_stats(df: DataFrame, column: str) -> DataFrame:
    from ..functions.text import trim_edges

    c = col(column).cast("string")
    n = F.length(c)
    return df.agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length"), F.sum((trim_edges(c) == "").cast("long")).alias("blank"), F.sum((trim_edges(c) != c).cast("long")).alias("edge_space"))


def scatter(df: DataFrame, x: str, y: str, order_by, max_points: int = 1000) -> DataFrame:
    """Every k-th complete, finite row, k = rows // max_points."""
    _numeric(df, x), _numeric(df, y)
    a, b = number(df, x), number(df, y)
    good = df.where(a.isNotNull() & b.isNotNull() & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")))
    n = good.count()
    if not n:
        raise InputError("no points")
    step = max(1, n // max_points)
    return ranges.row_numbers(good, list(map(col, order_by))).where(F.col("__row") % step == 0).orderBy("__row").select(a.alias("x"), b.alias("y"))


def interactions(df: DataFrame, x: str, y: str, order_by, max_points: int = 1000) -> dict:
    """The points of ``scatter`` and their rank correlation."""
    points = scatter(df, x, y, order_by, max_points)
    held = [(round(r["x"], 6), round(r["y"], 6)) for r in points.collect()]  # fewer than 2 * max_points
    rho = spearman(points, "x", "y") if len(held) > 2 else None
    return {"x": x, "y": y, "points": held, "spearman": None if rho is None else round(rho, 4), "total_sampled": len(held)}


def sample(df: DataFrame, method: str = "random", n: int = 100, by: str | None = None, seed: int = 42, order_by=None) -> DataFrame:
    """Exactly ``n`` rows at random, up to ``n`` of each group, or the first ``n``; the seed decides, not the partitioning."""
    if int(n) < 1:
        raise InputError("n must be at least 1")
    # md5 of the row's text and the seed: any engine draws the same rows
    texts = [F.coalesce(col(c).cast("string"), F.lit("")) for c, k in df.dtypes if not k.startswith(("map", "variant"))]
    mark = F.md5(F.concat_ws("|", *texts, F.lit(str(seed))))
    if method == "random":
        # the smallest digests are wanted: a cut that keeps twice as many as needed, and some, leaves little to sort
        rows = df.count()
        share = (2.0 * int(n) + 1000) / max(rows, 1)
        few = df.where(mark < f"{int(share * 2**60):015x}") if share < 1 else df
        few = few if share >= 1 or few.limit(int(n)).count() == int(n) else df
        return few.orderBy(mark, *map(col, df.columns)).limit(int(n))
    if method == "stratified":
        if not by:
            raise InputError("by is needed")
        need_columns(df, [by])
        rank = F.row_number().over(Window.partitionBy(col(by)).orderBy(mark, *map(col, df.columns)))
        return df.withColumn("__rank", rank).where(F.col("__rank") <= int(n)).drop("__rank")
    if method == "top":
        if not order_by:
            raise InputError("order_by is needed")
        return df.orderBy(*map(col, order_by)).limit(int(n))
    raise InputError(f"unknown method: {method}")


def page(df: DataFrame, page: int = 1, page_size: int = 50, sort: str | None = None, order: str = "asc", filters: dict | None = None, order_by=()) -> tuple[DataFrame, int, int]:
    """(rows of the page, rows after the filters, rows before them). ``__NULL__`` in a filter stands for missing."""
    if not 1 <= page_size <= 500:
        raise InputError("page_size must be 1..500")
    out = df
    for c, values in (filters or {}).items():
        need_columns(df, [c])
        if values:
            given = [v for v in values if v != "__NULL__"]
            hit = col(c).isin(*given) if given else F.lit(False)
            out = out.where(F.coalesce(hit, F.lit(False)) | (_absent(df, c) if len(given) < len(values) else F.lit(False)))
    total = out.count()
    keys = []
    if sort:
        need_columns(df, [sort])
        keys = [col(sort).desc_nulls_last() if order == "desc" else col(sort).asc_nulls_last()]
    keys += [col(c) for c in order_by]
    out = out.orderBy(*keys) if keys else out
    return out.offset((page - 1) * page_size).limit(page_size), total, df.count()


#: Rows that chart suggestions look at.
LOOKED_AT = 20_000


def _interest(df: DataFrame) -> dict:
    """What a bounded sample tells of the columns: kind, share of known values, distinct values, spread, skew, outliers, correlations."""
    some = fixed(df.limit(LOOKED_AT))
    kind, aggs = kinds(some), [F.count(F.lit(1)).alias("n")]
    for i, (c, k) in enumerate(kind.items()):
        aggs += [F.avg((~_absent(some, c)).cast("int")).alias(f"known{i}"), F.approx_count_distinct(col(c)).alias(f"distinct{i}")]
        if k == "numeric":
            aggs += [F.abs(stats.skewness(number(some, c))).alias(f"skew{i}"), F.try_divide(F.stddev_samp(number(some, c)), F.abs(F.avg(number(some, c)))).alias(f"spread{i}")]
        elif k == "text":
            aggs.append(F.avg(F.when(col(c).isNotNull(), dates.parse_date(col(c)).isNotNull().cast("int"))).alias(f"dated{i}"))
    got = some.agg(*aggs).first().asDict()
    out = {c: {"kind": k} | {name: got.get(f"{name}{i}") or 0 for name in ("known", "distinct", "skew", "spread", "dated")} for i, (c, k) in enumerate(kind.items())}
    for c, x in out.items():
        if x["kind"] == "datetime" or x["dated"] >= 0.8:
            x["kind"] = "time"
        elif x["kind"] in ("text", "boolean"):
            x["kind"] = "group"
        # a value of its own in each row tells rows apart, not groups
        x["labels"] = x["kind"] == "group" and 1 < x["distinct"] <= max(30, got["n"] / 20)
    numeric = [c for c, x in out.items() if x["kind"] == "numeric" and x["distinct"] > 1]
    for r in outliers(some, numeric).collect() if numeric else []:
        out[r["column"]]["beyond"] = r["n_outliers"]
    pairs = moments.pearson_matrix(some, numeric) if len(numeric) > 1 else np.zeros((1, 1))
    return {"columns": out, "numeric": numeric, "pairs": np.nan_to_num(np.abs(np.triu(pairs, 1)))}


def suggest_charts(df: DataFrame, limit: int = 10) -> list[dict]:
    """Titled specs (kind and parameters), each runnable by ``run``, the most telling first.

    Every analysis names the columns that it takes and how much they have to tell: a measure by its spread, a group by how
    few and how complete its labels are, a pair by its correlation, a distribution by its skew. What scores nothing is left out.
    """
    if df.isEmpty():
        return []
    seen = _interest(df)
    about, numeric, pairs = seen["columns"], seen["numeric"], seen["pairs"]
    pick = lambda names, worth: max(names, key=lambda c: (worth(about[c]), -df.columns.index(c)), default=None)
    measure = pick(numeric, lambda x: x["spread"] * x["known"])
    skewed, odd = pick(numeric, lambda x: x["skew"]), pick(numeric, lambda x: x.get("beyond", 0))
    time = pick([c for c, x in about.items() if x["kind"] == "time"], lambda x: x["known"] * x["distinct"])
    labels = sorted((c for c, x in about.items() if x["labels"]), key=lambda c: (about[c]["distinct"] > 12, -about[c]["known"], about[c]["distinct"]))
    group, other = (labels + [None, None])[:2]
    x, y = (numeric[i] for i in np.unravel_index(pairs.argmax(), pairs.shape)) if len(numeric) > 1 else (None, None)
    scored = [
        (bool(time and measure) * (2 + about[time]["known"] if time else 0), f"{measure} over time", "trend", {"date_column": time, "value_column": measure, "freq": "M"}),
        (bool(group and measure) * (2 + about[group]["known"] / 2 if group else 0), f"{measure} by {group}", "groupby", {"by": [group], "metrics": [{"column": measure, "agg": "sum"}]}),
        (bool(group and about[group]["distinct"] <= 12) * 1.5, f"shares of {group}", "value_counts", {"column": group, "top": 10}),
        (bool(x) * (1 + pairs.max()), f"{x} and {y}", "scatter", {"x": x, "y": y, "order_by": list(df.columns)}),
        (bool(skewed) * (1 + min(1, about[skewed]["skew"] / 4) if skewed else 0), f"distribution of {skewed}", "histogram", {"column": skewed, "bins": 20}),
        (bool(odd and about[odd].get("beyond")) * 1.4, f"outliers of {odd}", "boxplot", {"columns": sorted(numeric, key=lambda c: -about[c].get("beyond", 0))[:6]}),
        (bool(group and other) * 1.2, f"{group} by {other}", "crosstab", {"row": group, "column": other}),
        (bool(len(numeric) > 2) * (0.5 + pairs.max()), "correlations", "corr", {}),
    ]
    return [{"title": t, "kind": k, "params": p} for s, t, k, p in sorted(scored, key=lambda s: -s[0])[:limit] if s > 0]


KINDS = {f.__name__: f for f in (describe, groupby, corr, histogram, boxplot, value_counts, trend, outliers, kpi, funnel, crosstab, profile, missing_matrix, duplicates, text_stats, scatter)}


def run(df: DataFrame, kind: str, params: dict | None = None) -> DataFrame:
    """One analysis by name: what saved cards and tools call."""
    if kind not in KINDS:
        raise InputError(f"unknown analysis: {kind}")
    return KINDS[kind](df, **(params or {}))
