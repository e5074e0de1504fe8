"""Cleaning and transform operators: ``op(df, **params) -> DataFrame``.

Plans stay lazy. Where a literal or the schema depends on the data, one small aggregation is run first. Operators on row order take
``order_by``: the columns that define it. ``apply_op`` runs one by name and reports what it did.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions import dates, numbers, ranges, stats, text
from ..functions.stats import col, kinds, need_columns, number


#: Mappings of more pairs are joined instead of written into the plan.
MAP_LITERAL = 500
#: Characters of a mapping that is broadcast.
MAP_BROADCAST = 16 << 20


def _default(df: DataFrame, columns) -> list[str]:
    columns = list(columns or df.columns)
    need_columns(df, columns)
    return columns


def _numeric(df: DataFrame, column: str) -> None:
    need_columns(df, [column])
    if kinds(df)[column] != "numeric":
        raise InputError(f"{column} is not numeric")


def _free(df: DataFrame, *names: str) -> None:
    taken = [n for n in names if n in df.columns]
    if taken:
        raise InputError(f"column exists: {', '.join(taken)}")


def _absent(df: DataFrame, name: str):
    return numbers.missing(col(name), dict(df.dtypes)[name])


def drop_duplicates(df: DataFrame, columns=None, order_by=None) -> DataFrame:
    """Keep the first row of equal keys in ``order_by``'s order, by the other columns where that ties or isn't given; missing equals missing.

    Without ``columns`` equal rows are one, whatever the order.
    """
    if not columns and not order_by:
        return df.dropDuplicates()
    keys = _default(df, columns)
    plain = [c for c, k in df.dtypes if not k.startswith(("map", "variant"))]
    order_by = [*(order_by or ()), *[c for c in plain if c not in keys and c not in (order_by or ())]] or keys
    need_columns(df, order_by)
    if len(plain) < len(df.columns):  # values without an order can't be compared, so the first row is found by sorting
        rank = F.row_number().over(Window.partitionBy(*map(col, keys)).orderBy(*map(col, order_by)))
        return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    # the least row of a key, map-side first: only one row of a key leaves a task
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates()
    named = [col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    least = F.min_by(F.struct(*[col(c).alias(f"v{i}") for i, c in enumerate(rest)]), F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order_by)]))
    got = df.groupBy(*named).agg(least.alias("row"))
    at = {c: F.col(f"k{i}") for i, c in enumerate(keys)} | {c: F.col(f"row.v{i}") for i, c in enumerate(rest)}
    return got.select(*[at[c].alias(c) for c in df.columns])


def drop_missing(df: DataFrame, columns=None, how: str = "any") -> DataFrame:
    if how not in ("any", "all"):
        raise InputError("how must be any or all")
    return df.dropna(how, subset=_default(df, columns))


def fill_missing(df: DataFrame, columns=None, method: str = "constant", value=None, order_by=None) -> DataFrame:
    columns, out = _default(df, columns), {}
    if method == "constant":
        if value is None:
            raise InputError("a value is needed")
        for c in columns:
            kind = kinds(df)[c]
            if kind == "numeric" and isinstance(value, str) or kind == "text" and not isinstance(value, str):
                raise InputError(f"{c} can't hold {value!r}")
            out[c] = F.when(_absent(df, c), F.lit(value)).otherwise(col(c))
    elif method in ("mean", "median"):
        for c in columns:
            _numeric(df, c)
        if method == "mean":
            row = df.agg(*[F.avg(number(df, c)).alias(str(i)) for i, c in enumerate(columns)]).first()
        else:
            row = [q[0] if q else None for q in stats.quantiles(df, {c: number(df, c) for c in columns}, [0.5]).values()]
        out = {c: F.when(_absent(df, c), F.lit(row[i])).otherwise(col(c)) for i, c in enumerate(columns)}
    elif method == "mode":
        row = df.agg(*[F.mode(F.when(~_absent(df, c), col(c)), True).alias(str(i)) for i, c in enumerate(columns)]).first()
        out = {c: F.when(_absent(df, c), F.lit(row[i])).otherwise(col(c)) for i, c in enumerate(columns) if row[i] is not None}
    elif method in ("ffill", "bfill", "interpolate"):
        if not order_by:
            raise InputError("order_by is needed: rows have no order of their own")
        need_columns(df, order_by)
        if method == "interpolate":
            for c in columns:
                _numeric(df, c)
        names = df.columns
        here = {str(i): F.when(~_absent(df, c), col(c)) for i, c in enumerate(columns)}
        df = ranges.neighbours(df, here, list(map(col, order_by)))
        for i, c in enumerate(columns):
            prev, next_ = F.col(f"__prev_{i}"), F.col(f"__next_{i}")
            last, first = prev["value"], next_["value"]
            if method == "interpolate":
                last, first = last.cast("double"), first.cast("double")
                between = last + (first - last) * F.try_divide(F.col("__at") - prev["at"], (next_["at"] - prev["at"]).cast("double"))
                out[c] = F.when(~_absent(df, c), col(c).cast("double")).otherwise(F.coalesce(between, last, first))
            else:
                out[c] = last if method == "ffill" else first
        return df.withColumns(out).select(*map(col, names))
    else:
        raise InputError(f"unknown method: {method}")
    return df.withColumns(out) if out else df


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    if not mapping:
        raise InputError("nothing to rename")
    need_columns(df, mapping)
    if len(set(mapping.values())) < len(mapping):
        raise InputError("two columns would get one name")
    _free(df.drop(*mapping), *mapping.values())
    return df.withColumnsRenamed(mapping)


def cast_type(df: DataFrame, column: str, to: str, format: str | None = None) -> DataFrame:
    need_columns(df, [column])
    c, kind = col(column), kinds(df)[column]
    as_number = c.cast("double") if kind in ("numeric", "boolean") else numbers.to_number(c)
    if to == "int":
        new = numbers.round_to_long(as_number)
    elif to == "float":
        new = as_number
    elif to == "str":
        new = c.cast("string")
    elif to == "datetime":
        new = c.cast("timestamp_ntz") if kind == "datetime" else dates.parse_as(c.cast("string"), format) if format else dates.parse_date(c)
    else:
        raise InputError(f"unknown type: {to}")
    return df.withColumn(column, new)


def _condition(df: DataFrame, column: str, op: str, value=None):
    c, kind = col(column), kinds(df)[column]
    if op in ("isnull", "notnull"):
        absent = _absent(df, column)
        return absent if op == "isnull" else ~absent
    if kind == "numeric" and op in ("gt", "ge", "lt", "le", "eq", "ne") and isinstance(value, str):
        try:
            value = float(value)
        except ValueError as e:
            raise InputError(f"{column} can't be compared with {value!r}") from e
    if op in ("gt", "ge", "lt", "le"):
        c = number(df, column) if kind == "numeric" else c
        return {"gt": c > value, "ge": c >= value, "lt": c < value, "le": c <= value}[op]
    if op == "eq":
        return c == F.lit(value)
    if op == "ne":  # missing values differ from any value
        return ~c.eqNullSafe(F.lit(value))
    if op == "contains":
        return F.contains(F.lower(c.cast("string")), F.lower(F.lit(str(value))))
    if op == "startswith":
        return c.cast("string").startswith(str(value))
    if op == "between":
        if not isinstance(value, (list, tuple)) or len(value) != 2:
            raise InputError("between needs two values")
        return c.between(*value)
    if op == "isin":
        return c.isin(*(value if isinstance(value, (list, tuple, set)) else [value]))
    raise InputError(f"unknown operator: {op}")


def filter_rows(df: DataFrame, column: str, op: str, value=None) -> DataFrame:
    need_columns(df, [column])
    return df.where(_condition(df, column, op, value))


def drop_columns(df: DataFrame, columns) -> DataFrame:
    if not columns:
        raise InputError("no column selected")
    need_columns(df, columns)
    return df.drop(*columns)


def drop_outliers(df: DataFrame, columns, method: str = "iqr") -> DataFrame:
    bounds = stats.outlier_bounds(df, list(columns or []), method)
    keep = F.lit(True)
    for c, b in bounds.items():
        keep = keep & ~stats.is_outlier(df, c, b)
    return df.where(keep)


def cap_outliers(df: DataFrame, columns, method: str = "iqr") -> DataFrame:
    out = {}
    for c, (low, high) in stats.outlier_bounds(df, list(columns or []), method).items():
        if low is not None:
            x = number(df, c)
            out[c] = F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
    return df.withColumns(out) if out else df


def _bin_names(edges: list[float], lowest: bool) -> list[str]:
    """``(a, b]`` for each bin: edges with three decimals (three digits where there is no whole part), more where they would coincide.

    With ``lowest`` the first bin holds its lower edge too, so that edge is shown a little lower.
    """

    def shown(x: float, digits: int) -> float:
        frac, whole = math.modf(x)
        return x if not x else float(np.round(x, digits if whole else digits - 1 - math.floor(math.log10(abs(frac)))))

    digits = next((d for d in range(3, 20) if len({shown(x, d) for x in edges}) == len(edges)), 19)
    cut = [shown(x, digits) for x in edges]
    if lowest:
        cut[0] = float(np.round(cut[0] - 10.0**-digits, digits + 1))
    return [f"({a}, {b}]" for a, b in zip(cut, cut[1:])]


def bin_column(df: DataFrame, column: str, method: str = "equal_width", bins: int = 5, labels=None, new_column: str | None = None) -> DataFrame:
    """Right-closed bins of equal width or of equal frequency, as text ``(a, b]``; labels go to the bins that occur, in order."""
    _numeric(df, column)
    new_column = new_column or f"{column}_箱"
    _free(df, new_column)
    if not 2 <= int(bins) <= 50:
        raise InputError("bins must be 2..50")
    bins, x = int(bins), number(df, column)
    if method == "equal_width":
        low, high = df.agg(F.min(x), F.max(x)).first()
        if low is None:
            raise InputError("no values")
        if low == high:
            low, high = (low - abs(low) * 0.001, high + abs(high) * 0.001) if low else (-0.001, 0.001)
            edges = [low + (high - low) * i / bins for i in range(bins + 1)]
        else:
            edges = [low + (high - low) * i / bins for i in range(bins)] + [high]
            edges[0] = low - (high - low) * 0.001
    elif method == "equal_freq":
        found = stats.quantiles(df, {column: x}, [i / bins for i in range(bins + 1)])[column]
        if found is None:
            raise InputError("no values")
        edges = sorted(set(found))
        if len(edges) < 2:
            raise InputError("all values are equal")
    else:
        raise InputError(f"unknown method: {method}")
    names = _bin_names(edges, method == "equal_freq")
    number_of = F.lit(None).cast("int")
    for i in range(len(names) - 1, -1, -1):
        inside = (x <= edges[i + 1]) & ((x >= edges[i]) if method == "equal_freq" and i == 0 else (x > edges[i]))
        number_of = F.when(inside, F.lit(i)).otherwise(number_of)
    if labels:
        occurs = [r[0] for r in df.select(number_of.alias("b")).where("b is not null").distinct().orderBy("b").collect()]
        for label, i in zip(labels, occurs):
            names[i] = str(label)
    return df.withColumn(new_column, F.element_at(F.array(*map(F.lit, names)), number_of + 1))


def one_hot_encode(df: DataFrame, column: str, prefix: str | None = None, max_columns: int = 30) -> DataFrame:
    """0/1 columns for the most frequent values (ties by value); missing gives 0."""
    need_columns(df, [column])
    value = col(column).cast("string")
    top = df.select(value.alias("v")).where("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(int(max_columns)).collect()
    made = {}
    for r in top:
        name = f"{(prefix or column)[:20]}_{r['v']}"[:60]
        if name not in df.columns and name not in made:
            made[name] = F.coalesce((value == r["v"]).cast("int"), F.lit(0))
    if not made:
        raise InputError("no column was made")
    return df.withColumns(made)


def standardize_column(df: DataFrame, column: str, method: str = "zscore") -> DataFrame:
    _numeric(df, column)
    x = number(df, column)
    m, s, low, high = df.agg(F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    if method == "zscore":
        if not s:
            raise InputError("the deviation is 0")
        return df.withColumn(f"{column}_z", F.round((x - m) / s, 6))
    if method == "minmax":
        if low is None or low == high:
            raise InputError("the range is 0")
        return df.withColumn(f"{column}_归一", F.round((x - low) / (high - low), 6))
    raise InputError(f"unknown method: {method}")


def log_transform(df: DataFrame, column: str, base: str = "ln") -> DataFrame:
    _numeric(df, column)
    x = number(df, column)
    low = df.agg(F.min(x)).first()[0]
    if low is not None and low < 0:
        raise InputError("negative values have no logarithm")
    return df.withColumn(f"{column}_log", F.round(F.log1p(x) if base == "ln" else F.log10(x + 1), 6))


def extract_date_parts(df: DataFrame, column: str, parts=("year", "month", "day")) -> DataFrame:
    need_columns(df, [column])
    parts = [p for p in parts if p in dates.PARTS]
    if not parts:
        raise InputError("no part selected")
    when = col(column) if kinds(df)[column] == "datetime" else dates.parse_date(col(column))
    if df.where(when.isNotNull()).isEmpty():
        raise InputError(f"{column} holds no dates")
    return df.withColumns({f"{column}_{dates.PARTS[p]}": dates.date_part(when, p) for p in parts})


def regex_extract(df: DataFrame, column: str, pattern: str, group: int = 0, new_column: str | None = None) -> DataFrame:
    """Capture group ``group`` (from 0) of the first match, the whole match without groups; no match gives null."""
    need_columns(df, [column])
    new_column = new_column or f"{column}_提取"
    _free(df, new_column)
    try:
        groups = re.compile(pattern).groups if pattern else None
    except re.error as e:
        raise InputError(f"bad pattern: {e}") from e
    if groups is None:
        raise InputError("a pattern is needed")
    if groups and not 0 <= int(group) < groups:
        raise InputError("no such group")
    c, p = col(column).cast("string"), f"(?U){pattern}"
    return df.withColumn(new_column, F.when(c.rlike(p), F.regexp_extract(c, p, int(group) + 1 if groups else 0)))


def _texts(df: DataFrame, columns) -> list[str]:
    if not columns:
        raise InputError("no column selected")
    need_columns(df, columns)
    return [c for c in columns if kinds(df)[c] == "text"]


def trim_whitespace(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: text.trim_edges(col(c)) for c in _texts(df, columns)})


def normalize_text(df: DataFrame, columns, empty_to_na: bool = False) -> DataFrame:
    new = {c: text.normalize(col(c)) for c in _texts(df, columns)}
    return df.withColumns({c: F.nullif(x, F.lit("")) if empty_to_na else x for c, x in new.items()})


def parse_number(df: DataFrame, column: str, percent_scale: bool = False, new_column: str | None = None) -> DataFrame:
    need_columns(df, [column])
    kind = kinds(df)[column]
    new = F.lit(None).cast("double") if kind == "boolean" else number(df, column) if kind == "numeric" else numbers.parse_number(col(column), percent_scale)
    return df.withColumn(new_column or f"{column}_数值", new)


def map_values(df: DataFrame, column: str, mapping: dict, keep_original: bool = True) -> DataFrame:
    need_columns(df, [column])
    if not mapping:
        raise InputError("nothing to map")
    c = col(column).cast("string")
    if len(mapping) > MAP_LITERAL:
        made, key, new = df.sparkSession.createDataFrame([(str(k), str(v)) for k, v in mapping.items()], "k string, v string"), "__map_key", "__map_value"
        # a mapping that the driver holds anyway; beyond a size that every executor can hold too, rows are shuffled to it
        held = sum(len(str(k)) + len(str(v)) for k, v in mapping.items())
        made = made.toDF(key, new)
        met = df.join(F.broadcast(made) if held <= MAP_BROADCAST else made.hint("shuffle_hash"), c == F.col(key), "left")
        return met.withColumn(column, F.coalesce(F.col(new), c) if keep_original else F.col(new)).drop(key, new)
    pairs = F.create_map(*[F.lit(str(x)) for pair in mapping.items() for x in pair])
    return df.withColumn(column, F.coalesce(F.element_at(pairs, c), c) if keep_original else F.element_at(pairs, c))


def split_column(df: DataFrame, column: str, sep: str, into=None) -> DataFrame:
    need_columns(df, [column])
    if not sep:
        raise InputError("a separator is needed")
    parts = F.split(col(column).cast("string"), text.literal_pattern(sep))
    n = df.agg(F.max(F.size(parts))).first()[0] or 0
    names = [*(into or [])][: max(n, 0)]
    names += [f"{column}_{i + 1}" for i in range(len(names), n)]
    _free(df, *names)
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(names)}) if names else df


def drop_high_missing(df: DataFrame, threshold: float = 0.5, axis: str = "column") -> DataFrame:
    if not 0 < threshold <= 1:
        raise InputError("threshold must be in (0, 1]")
    if axis == "row":
        share = sum((_absent(df, c).cast("int") for c in df.columns), F.lit(0)) / len(df.columns)
        return df.where(share <= threshold)
    row = df.agg(*[F.avg(_absent(df, c).cast("double")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    gone = [c for i, c in enumerate(df.columns) if row[i] is not None and row[i] > threshold]
    if len(gone) == len(df.columns):
        raise InputError("no column would be left")
    return df.drop(*gone)


def unify_boolean_text(df: DataFrame, column: str) -> DataFrame:
    need_columns(df, [column])
    kind = kinds(df)[column]
    if kind == "boolean":
        return df.withColumn(column, F.when(col(column), "是").when(~col(column), "否"))
    return df.withColumn(column, text.unify_boolean(col(column))) if kind == "text" else df


OPS = {f.__name__: f for f in (drop_duplicates, drop_missing, fill_missing, rename_columns, cast_type, filter_rows, drop_columns, drop_outliers, bin_column, one_hot_encode, standardize_column, log_transform, extract_date_parts, regex_extract, trim_whitespace, normalize_text, parse_number, map_values, split_column, cap_outliers, drop_high_missing, unify_boolean_text)}
#: Operators whose empty result is an error when they are applied interactively.
_NOT_EMPTY = ("filter_rows", "drop_outliers")
#: Operators after which rows have to be counted again.
_CHANGES_ROWS = ("drop_duplicates", "drop_missing", "filter_rows", "drop_outliers")


def build(df: DataFrame, op: str, params: dict | None = None) -> DataFrame:
    """The lazy plan of one operator."""
    if op not in OPS:
        raise InputError(f"unknown operator: {op}")
    return OPS[op](df, **(params or {}))


def apply_op(df: DataFrame, op: str, params: dict | None = None) -> tuple[DataFrame, str]:
    """Build, guard and report: (result, message with row and column counts before and after)."""
    out = build(df, op, params)
    if op in _NOT_EMPTY and out.isEmpty():
        raise InputError("no row would be left")
    if op == "parse_number":
        made = (params or {}).get("new_column") or f"{(params or {})['column']}_数值"
        if out.where(col(made).isNotNull()).isEmpty():
            raise InputError("nothing could be read as a number")
    changes_rows = op in _CHANGES_ROWS or op == "drop_high_missing" and (params or {}).get("axis") == "row"
    c = (params or {}).get("column") if op == "cast_type" else None
    lost = F.lit(0) if c is None else F.sum(_absent(df, c).cast("long"))
    before = df.agg(F.count(F.lit(1)), lost).first()
    after = before if not changes_rows and c is None else out.agg(F.count(F.lit(1)), lost if c is None else F.sum(col(c).isNull().cast("long"))).first()
    message = f"{op}: {before[0]} -> {after[0]} rows, {len(df.columns)} -> {len(out.columns)} columns"
    if c is not None:
        message += f", {max((after[1] or 0) - (before[1] or 0), 0)} values could not be converted"
    return out, message
