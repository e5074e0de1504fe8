"""Column expressions for text: all of them run inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: characters that count as white space around a cell
EDGE_CHARS = " \t\r\n　 ​‌‍﻿"
# fixed values: vocabulary of truth values
TRUE_WORDS = ("是", "true", "yes", "y", "1")
FALSE_WORDS = ("否", "false", "no", "n", "0")

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
# fixed values: what text columns are looked through for, and the formats of whole columns, the first that fits deciding
FULL_WIDTH = "[０-９Ａ-Ｚａ-ｚ＄％＃＠＆]"
INNER_BLANKS = r"\S[ \t　]{2,}\S"
COLUMN_FORMATS = {
    "phone": r"^1[3-9]\d{9}$",
    "email": r"(?U)^[\w.+-]+@[\w-]+(\.[\w-]+)+$",
    "url": r"(?i)^(https?://|www\.)\S+$",
    "id_card": r"^\d{15}(\d{2}[0-9Xx])?$",
}
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‍﻿�]"


def halfwidth(c: Column) -> Column:
    return F.translate(c, _FULL, _HALF)


def trim_edges(c: Column) -> Column:
    return F.trim(c, F.lit(EDGE_CHARS))


def normalize(c: Column) -> Column:
    """Half width, no control characters, inner white space as one blank, no white space around."""
    return F.trim(F.regexp_replace(F.regexp_replace(halfwidth(c), CONTROL, ""), r"(?U)\s+", " "))


def canonical(c: Column) -> Column:
    """The spelling under which labels that differ only in form are equal."""
    return F.lower(F.trim(F.regexp_replace(trim_edges(halfwidth(c)), r"(?U)\s+", " ")))


def unify_boolean(c: Column) -> Column:
    word = F.lower(trim_edges(c))
    return F.when(word.isin(*TRUE_WORDS), "是").when(word.isin(*FALSE_WORDS), "否").otherwise(c)


def is_boolean_word(c: Column) -> Column:
    return F.lower(trim_edges(c)).isin(*TRUE_WORDS, *FALSE_WORDS)


def literal_pattern(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)
