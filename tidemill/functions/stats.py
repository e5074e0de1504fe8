"""Aggregate expressions: outlier bounds, sample skewness, correlations that survive constant columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def kinds(df: DataFrame) -> dict[str, str]:
    """numeric, datetime, boolean, text or other, by column."""
    out = {}
    for name, kind in df.dtypes:
        base = kind.split("(")[0]
        out[name] = "numeric" if base in NUMERIC or base == "decimal" else "datetime" if base in ("date", "timestamp", "timestamp_ntz") else base if base == "boolean" else "text" if base in ("string", "varchar", "char") else "other"
    return out


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k == "numeric"]


def need_columns(df: DataFrame, columns) -> None:
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise InputError(f"unknown columns: {', '.join(map(str, unknown))}")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double with not-a-number as null."""
    c = col(name).cast("double")
    return F.when(~F.isnan(c), c)


#: Up to so many rows one buffer may hold a column's values; beyond it quantiles are bracketed first.
EXACT_ROWS = 400_000
#: Accuracy of the brackets: a quantile's bracket holds about 4/BRACKETS of the rows of the one before.
BRACKETS = 10_000
#: Values that the sketch of a bracket is made from; all values are counted against what it says.
SKETCHED = 1_000_000


def quantiles(df: DataFrame, columns: dict[str, Column], at: list[float], n_rows: int | None = None) -> dict[str, list | None]:
    """Exact quantiles (linear between neighbours) of each named column, None for a column without values.

    ``percentile`` keeps every distinct value of a column in one buffer. On many rows a pass brackets each quantile
    approximately (from about SKETCHED values) and another counts what lies below and inside among all rows, again and again
    until a bracket holds few rows or a single value; only what lies inside the last one is looked at exactly. A bracket
    that the count shows to miss its quantile is widened.
    """
    names, x = list(columns), list(columns.values())
    if not names:
        return {}
    n_rows = df.count() if n_rows is None else n_rows
    if n_rows <= EXACT_ROWS:
        row = df.agg(*[F.percentile(c, F.array(*map(F.lit, at))).alias(str(i)) for i, c in enumerate(x)]).first()
        return {name: row[i] for i, name in enumerate(names)}
    row = df.agg(*[F.count(c).alias(str(i)) for i, c in enumerate(x)]).first()
    every = [(i, j) for i in range(len(names)) if row[i] for j in range(len(at))]
    rank = {(i, j): at[j] * (row[i] - 1) for i, j in every}
    low, high, below, inside, edge = {}, {}, dict.fromkeys(every, 0), {k: row[k[0]] for k in every}, dict.fromkeys(every, 2.0 / BRACKETS)

    def within(k) -> Column:
        return F.when((x[k[0]] >= low[k]) & (x[k[0]] <= high[k]), x[k[0]]) if k in low else x[k[0]]

    while todo := [k for k in every if inside[k] > EXACT_ROWS and edge[k] < 1 and not (k in low and low[k] == high[k])]:
        place = {k: (rank[k] - below[k]) / max(inside[k] - 1, 1) for k in todo}
        # quantiles that lie in one bracket share its sketch
        shared: dict[tuple, list] = {}
        for k in todo:
            shared.setdefault((k[0], low.get(k), high.get(k)), []).append(k)
        asked = list(shared.values())
        share = min(1.0, SKETCHED / min(inside[k] for k in todo))
        wide = {k: edge[k] if share == 1 else max(edge[k], 4 / math.sqrt(share * inside[k])) for k in todo}
        some = df if share == 1 else df.sample(share)
        found = some.agg(*[F.percentile_approx(within(ks[0]), [min(1.0, max(0.0, place[k] + e)) for k in ks for e in (-wide[k], wide[k])], BRACKETS).alias(str(j)) for j, ks in enumerate(asked)]).first()
        ends = {str(k): found[j][2 * t : 2 * t + 2] for j, ks in enumerate(asked) for t, k in enumerate(ks)}
        counted = df.agg(*[F.sum(f.cast("long")).alias(f"{name}{k}") for k in todo for name, f in (("b", x[k[0]] < ends[str(k)][0]), ("m", (x[k[0]] >= ends[str(k)][0]) & (x[k[0]] <= ends[str(k)][1])))]).first()
        for k in todo:
            b, m = counted[f"b{k}"], counted[f"m{k}"]
            if b <= rank[k] <= b + m - 1 and m < inside[k]:
                (low[k], high[k]), below[k], inside[k] = ends[str(k)], b, m
            elif b <= rank[k] <= b + m - 1 and ends[str(k)][0] == ends[str(k)][1]:
                low[k] = high[k] = ends[str(k)][0]
            else:  # between two brackets' edges
                edge[k] = 32 * wide[k]
    exact = [k for k in every if not (k in low and low[k] == high[k])]
    found = df.agg(*[F.percentile(within(k), min(1.0, (rank[k] - below[k]) / max(inside[k] - 1, 1))).alias(str(k)) for k in exact]).first() if exact else {}
    return {name: [found[str((i, j))] if (i, j) in exact else low[i, j] for j in range(len(at))] if row[i] else None for i, name in enumerate(names)}


def outlier_bounds(df: DataFrame, columns, method: str = "iqr") -> dict[str, tuple]:
    """(low, high) by column from one aggregation; (None, None) where nothing can be an outlier."""
    if method not in ("iqr", "zscore"):
        raise InputError("method must be iqr or zscore")
    need_columns(df, columns)
    wrong = [c for c in columns if kinds(df)[c] != "numeric"]
    if wrong or not columns:
        raise InputError(f"not numeric: {', '.join(wrong)}" if wrong else "no column selected")
    out = {}
    if method == "iqr":
        for c, q in quantiles(df, {c: number(df, c) for c in columns}, [0.25, 0.75]).items():
            gap = 1.5 * (q[1] - q[0]) if q else None
            out[c] = (q[0] - gap, q[1] + gap) if q else (None, None)
        return out
    row = df.agg(*[a for i, c in enumerate(columns) for a in (F.avg(number(df, c)).alias(f"m{i}"), F.stddev_pop(number(df, c)).alias(f"s{i}"))]).first()
    for i, c in enumerate(columns):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (m - 3 * s, m + 3 * s) if s else (None, None)
    return out


def is_outlier(df: DataFrame, name: str, bounds: tuple) -> Column:
    low, high = bounds
    if low is None:
        return F.lit(False)
    x = number(df, name)
    return F.coalesce((x < low) | (x > high), F.lit(False))


def skewness(x: Column) -> Column:
    """Sample-adjusted; null below three values, 0 for a constant column."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.coalesce(F.skewness(x), F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Over rows where both are present; null if one is constant there."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
