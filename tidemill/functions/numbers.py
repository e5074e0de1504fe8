"""Column expressions for numbers in text, rounding and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import halfwidth

PLAIN_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
# fixed values: unit suffixes and what they stand for
UNITS = {"亿": 1e8, "万": 1e4, "W": 1e4, "w": 1e4, "K": 1e3, "k": 1e3}
# fixed values: thousands in groups, and a number without them
_GROUPED = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"
_BARE = r"^[+-]?(\d+(\.\d+)?|\.\d+)$"


def to_number(c: Column) -> Column:
    """Double of a plainly written number, else null (Java's type suffixes are no numbers)."""
    text = c.cast("string")
    return F.when(text.rlike(PLAIN_NUMBER), F.trim(text).try_cast("double")).when(F.lower(F.trim(text)).isin("inf", "+inf", "infinity", "-inf", "-infinity"), F.trim(text).try_cast("double"))


def parse_number(c: Column, percent_scale: bool = False) -> Column:
    """Double of a formatted number: currency signs, units, thousands groups, percent; else null."""
    text = F.trim(F.regexp_replace(halfwidth(c.cast("string")), r"(?U)^\s+|\s+$", ""))
    unit = F.lit(1.0)
    for mark, times in UNITS.items():
        unit = F.when(text.endswith(mark), F.lit(times)).otherwise(unit)
    body = F.regexp_replace(text, "[" + "".join(UNITS) + "]$", "")
    body = F.regexp_replace(body, r"(?U)[¥￥$€£\s]", "")
    percent = body.endswith("%")
    body = F.regexp_replace(body, "%$", "")
    body = F.when(body.rlike(_GROUPED), F.replace(body, F.lit(","), F.lit(""))).otherwise(body)
    value = F.when(body.rlike(_BARE), body.try_cast("double")) * unit
    return F.when(percent, value / 100).otherwise(value) if percent_scale else value


def round_to_long(c: Column) -> Column:
    return F.bround(c, 0).try_cast("bigint")


def missing(c: Column, kind: str) -> Column:
    """Null, or not-a-number for floating columns."""
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()
