"""Column expressions for dates in text and for calendar periods."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InputError

# fixed values: formats that a text column is tried against, in this order
FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%Y年%m月%d日", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y-%m-%d %H:%M:%S")
PARTS = {"year": "年", "month": "月", "day": "日", "quarter": "季度", "weekday": "星期", "hour": "小时"}
#: Where a value fits several formats the month comes first, as in most parsers of mixed dates.
READ_ORDER = ("%Y/%m/%d", "%Y.%m.%d", "%Y年%m月%d日", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%Y/%m/%d %H:%M", "%Y/%m/%d %H:%M:%S", "%m/%d/%Y %H:%M", "%d/%m/%Y %H:%M")
#: Directives with Spark's letters: alone, and beside another directive, where only the full width can be told apart.
_DIRECTIVES = {"Y": ("yyyy", "yyyy"), "y": ("yy", "yy"), "m": ("M", "MM"), "d": ("d", "dd"), "H": ("H", "HH"), "I": ("h", "hh"), "M": ("m", "mm"), "S": ("s", "ss"), "f": ("[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "SSSSSS"), "p": ("a", "a"), "b": ("MMM", "MMM"), "B": ("MMMM", "MMMM"), "j": ("D", "DDD")}


def spark_format(fmt: str) -> str:
    """Spark's spelling of a strptime format; a format without directives is taken to be Spark's already."""
    if "%" not in fmt:
        return fmt
    out, i, beside = [], 0, False
    while i < len(fmt):
        if fmt[i] != "%":
            out.append(fmt[i] if not fmt[i].isalpha() and fmt[i] not in "'[]{}#" else "''" if fmt[i] == "'" else f"'{fmt[i]}'")
            i, beside = i + 1, False
            continue
        kind = fmt[i + 1 : i + 2]
        i += 2
        if kind == "%":
            out.append("%")
            beside = False
        elif kind in _DIRECTIVES:
            next_ = fmt[i : i + 1] == "%" and fmt[i + 1 : i + 2] != "%"
            out.append(_DIRECTIVES[kind][beside or next_])
            beside = True
        else:
            raise InputError(f"unknown directive in a date format: %{kind}")
    return "".join(out)


def _shape(fmt: str) -> str:
    """A pattern of the texts that a strptime format can fit."""
    kinds = {"Y": r"\d{4}", "f": r"\d{1,6}", "p": r"\p{L}+", "b": r"\p{L}+", "B": r"\p{L}+", "j": r"\d{1,3}", "%": "%"}
    parts = re.split(r"%(.)", fmt)
    return "^" + "".join(kinds.get(x, r"\d{1,2}") if i % 2 else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", x) for i, x in enumerate(parts)) + "$"


def parse_as(c: Column, fmt: str) -> Column:
    """Null where the text doesn't fit; only texts of the format's shape are handed to the parser, whose failures are slow."""
    parsed = F.try_to_timestamp(c, F.lit(spark_format(fmt))).cast("timestamp_ntz")
    return F.when(c.rlike(_shape(fmt)), parsed) if "%" in fmt else parsed


def parse_date(c: Column, formats=READ_ORDER) -> Column:
    """The first format that fits; bare digits of other lengths than eight are no dates."""
    text = F.trim(c.cast("string"))
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), text.try_cast("timestamp_ntz"))
    return F.coalesce(iso, *[parse_as(text, f) for f in formats], F.when(text.rlike(r"^\d{8}$"), parse_as(text, "%Y%m%d")))


def date_part(c: Column, part: str) -> Column:
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "weekday": lambda x: F.weekday(x) + 1, "hour": F.hour}[part](c).cast("bigint")


def period(c: Column, freq: str) -> Column:
    """The label of the period: its first day; weeks carry their Sunday."""
    if freq == "W":
        return F.next_day(F.date_sub(c.cast("date"), 1), "SUN").cast("timestamp_ntz")
    unit = {"D": "day", "M": "month", "Q": "quarter", "Y": "year"}.get(freq, "month")
    return F.date_trunc(unit, c).cast("timestamp_ntz")


STEPS = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 1 year"}
