"""Ordered work over whole tables, range by range.

Rows are dealt into sorted ranges once and written to a reliable checkpoint. Without
it two branches of a plan could sample different bounds and number rows differently. Only one row
for each range goes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fixed

_BITS = 33  # monotonically_increasing_id: partition above, row in the partition below


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``__part``, their range, and ``__in``, their place in it from 0."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = {"__part": F.shiftright("__id", _BITS), "__in": F.col("__id").bitwiseAND(F.lit((1 << _BITS) - 1))}
    return fixed(dealt).withColumns(placed).drop("__id")


def _before(value: Column, how) -> Column:
    return how(value).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))


def row_numbers(df: DataFrame, order: list[Column], name: str = "__row") -> DataFrame:
    """Rows numbered from 0 in order: places are shifted by the sizes of the ranges before."""
    ranged = in_ranges(df, order)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    shift = sizes.select("__part", F.coalesce(_before(F.col("__n"), F.sum), F.lit(0)).alias("__shift"))
    return ranged.join(F.broadcast(shift), "__part").withColumn(name, F.col("__in") + F.col("__shift")).drop("__part", "__in", "__shift")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str]) -> DataFrame:
    """For each column of ``totals`` its sum over the rows before, under the name given: ranges are summed apart, then shifted by the sums of those before."""
    ranged = in_ranges(df, [F.col(c) for c in order])
    inside = Window.partitionBy("__part").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(*[F.sum(n).alias(f"__sum_{i}") for i, n in enumerate(totals)])
    shift = sums.select("__part", *[F.coalesce(_before(F.col(f"__sum_{i}"), F.sum), F.lit(0)).alias(f"__shift_{i}") for i in range(len(totals))])
    here = {f"__here_{i}": F.coalesce(F.sum(n).over(inside), F.lit(0)) for i, n in enumerate(totals)}
    made = {name: F.col(f"__here_{i}") + F.col(f"__shift_{i}") for i, name in enumerate(totals.values())}
    spare = [f"__{k}_{i}" for k in ("here", "shift") for i in range(len(totals))]
    return ranged.withColumns(here).join(F.broadcast(shift), "__part").withColumns(made).drop("__part", "__in", *spare)


def running_total(df: DataFrame, order: str, n: str, name: str) -> DataFrame:
    """Sum of ``n`` over the rows before, as ``name``."""
    return running_totals(df, [order], {n: name})


def neighbours(df: DataFrame, values: dict[str, Column], order: list[Column], ahead: bool = True) -> DataFrame:
    """The rows with ``__at``, their number, and for each name of ``values`` the structs ``__prev_<name>`` and (``ahead``) ``__next_<name>``:
    ``at`` and ``value`` of the nearest row, itself included, where the value isn't null; null where there is none."""
    ranged = in_ranges(df, order)
    known = {n: F.when(v.isNotNull(), F.struct(F.col("__in").alias("at"), v.alias("value"))) for n, v in values.items()}
    sides = ("last", "first") if ahead else ("last",)
    # a range hands on its first and last known value
    edges = [(F.max_by if side == "last" else F.min_by)(k, F.when(k.isNotNull(), F.col("__in"))).alias(f"__{side}_{n}") for n, k in known.items() for side in sides]
    parts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *edges)
    parts = parts.withColumn("__shift", F.coalesce(_before(F.col("__n"), F.sum), F.lit(0)))

    def moved(k: Column) -> Column:
        return F.when(k.isNotNull(), F.struct((k["at"] + F.col("__shift")).alias("at"), k["value"].alias("value")))

    # a frame that shrinks is worked out anew for each row, one that grows over the mirrored order is not
    ways = {"last": (F.col("__part"), F.col("__in")), "first": (F.col("__part").desc(), F.col("__in").desc())}
    carried = [F.last(moved(F.col(f"`__{side}_{n}`")), True).over(Window.orderBy(ways[side][0]).rowsBetween(Window.unboundedPreceding, -1)).alias(f"__far_{side}_{n}") for n in values for side in sides]
    rows = ranged.join(F.broadcast(parts.select("__part", "__shift", *carried)), "__part")
    found = {"__at": F.col("__in") + F.col("__shift")}
    for n, k in known.items():
        for side, name in zip(sides, ("prev", "next")):
            inside = Window.partitionBy("__part").orderBy(ways[side][1]).rowsBetween(Window.unboundedPreceding, 0)
            found[f"__{name}_{n}"] = F.coalesce(moved(F.last(k, True).over(inside)), F.col(f"`__far_{side}_{n}`"))
    return rows.withColumns(found).drop("__part", "__in", "__shift", *[f"__far_{side}_{n}" for n in values for side in sides])
