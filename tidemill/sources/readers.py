"""Readers: delimited text, JSON records, pasted tables, XLSX, Parquet; columns have trimmed names."""

from __future__ import annotations

import datetime as dt
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..session import fixed
from . import delimited
from .files import Files

ENCODINGS = ("utf-8-sig", "gbk", "latin-1")
SEPARATORS = (",", "\t", ";", "|")
RECORD_KEYS = ("data", "rows", "records", "items", "list")
SNIFF_BYTES = 1 << 20


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of the first file with data."""
    files = Files(spark)
    return files.read(files.first_data_file(path), SNIFF_BYTES)


def _decoded(head: bytes) -> tuple[str, str]:
    """(encoding, text) of the first bytes of a file."""
    for encoding in ENCODINGS:
        try:
            return encoding, head.decode(encoding)
        except UnicodeDecodeError as e:
            if e.start >= len(head) - 4:  # a character cut at the end
                return encoding, head[: e.start].decode(encoding)
    raise AssertionError("latin-1 decodes anything")


def sniff(head: bytes) -> tuple[str, str]:
    """(encoding, separator) of delimited text; a comma where the first line has no separator."""
    encoding, text = _decoded(head)
    line = text.splitlines()[0] if text else ""
    return encoding, max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


def _layout(spark: SparkSession, path: str) -> tuple[delimited.Layout, str]:
    """The layout of delimited text, and its head: that of the first file, or of the largest one where the first is a mere header."""
    head = _head(spark, path)
    if not head.strip():
        raise InputError("the file is empty")
    layout, text = _laid_out(head)
    if len(head) < SNIFF_BYTES and delimited.bare(text, layout):
        files = Files(spark)
        return _laid_out(files.read(files.largest_data_file(path), SNIFF_BYTES))
    return layout, text


def _laid_out(head: bytes) -> tuple[delimited.Layout, str]:
    encoding, sep = sniff(head)
    text = _decoded(head)[1]
    return delimited.layout(text, encoding, sep), text


def trimmed_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [c for c, k in df.dtypes if k in ("float", "double")]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats}) if floats else df


def has_text(spark: SparkSession, path: str) -> bool:
    return bool(_head(spark, path).strip())


def layout_of(spark: SparkSession, path: str) -> delimited.Layout:
    """The layout of delimited text, from its head."""
    return _layout(spark, path)[0]


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Delimited text: a file, a folder or a pattern. Encoding and separator come from the first bytes; a comma separates where the other separator gives no table.

    Files are split between tasks whatever their values hold. Types are taken from all rows unless a schema is given.
    """
    layout, _ = _layout(spark, path)
    return delimited.read(spark, path, layout, T._parse_datatype_string(schema) if schema else None)


def ingest_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Delimited text written to a Parquet table, in one pass where the types of its first bytes fit all rows."""
    layout, text = _layout(spark, path)
    text = text.rsplit("\n", 1)[0] + "\n" if "\n" in text else text + "\n"
    return delimited.ingest(spark, path, layout, delimited.guess(text, layout), table, delimited.broken(text, layout))


def read_paste(spark: SparkSession, text: str) -> DataFrame:
    """A pasted table; tabs separate if the first line has a tab and no comma."""
    text = text.lstrip("﻿")
    if not text.strip():
        raise InputError("nothing was pasted")
    first = text.splitlines()[0]
    sep = "\t" if "\t" in first and "," not in first else ","
    return delimited.read_text(spark, text, delimited.layout(text, "utf-8-sig", sep))


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns with dotted names; arrays stay."""
    out = []

    def walk(column, name, kind):
        if isinstance(kind, T.StructType):
            for f in kind:
                walk(column.getField(f.name), f"{name}.{f.name}", f.dataType)
        else:
            out.append(column.alias(name))

    for f in df.schema:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*out)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records: one to a line, a list of them, an object that holds a list under a known key, an object of columns, or one record."""
    head = _head(spark, path).decode("utf-8-sig", "ignore").strip()
    lines = head.splitlines()
    by_line = len(lines) > 1 and all(x.startswith("{") and x.rstrip().endswith("}") for x in lines[:2])
    df = spark.read.option("multiLine", not by_line).json(path)
    if head.startswith("[") or by_line:
        return flatten(df)
    arrays = {f.name: f.dataType.elementType for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    for key in RECORD_KEYS:
        if key in arrays:
            rows = df.select(F.explode(f"`{key}`").alias("0"))
            return flatten(rows.select("0.*") if isinstance(arrays[key], T.StructType) else rows)
    if arrays and len(arrays) == len(df.columns):  # columns of equal length, as a table is often dumped
        zipped = F.arrays_zip(*[F.col(f"`{c}`") for c in df.columns])
        rows = df.select(F.explode(zipped).alias("r"))
        return flatten(rows.select(*[F.col("r")[name].alias(c) for name, c in zip(rows.schema["r"].dataType.names, df.columns)]))
    return flatten(df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Number formats of the standard that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: A cell: n(umber), d(ate), b(oolean) or s(tring), and its text.
_CELL = "struct<kind: string, value: string>"


def sheet_names(data: bytes) -> list[str]:
    return [name for name, _ in _sheets(data)]


def _sheets(data: bytes) -> list[tuple[str, str]]:
    """(name, file within the archive) of a workbook's sheets, in their order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        return [(s.get("name"), t.lstrip("/") if (t := targets[s.get(_REL)]).startswith("/") else f"xl/{t}") for s in sheets]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode") or "") for f in root.iter(f"{_MAIN}numFmt")}
    dated = _DATE_FORMATS | {i for i, code in own.items() if re.search(r"[dmyhs]", code, re.I)}
    styles = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId") or 0) in dated}


_ROW = re.compile(rb"<(?:\w+:)?row[\s/>]")
_END = re.compile(rb"</(?:\w+:)?sheetData>|<(?:\w+:)?sheetData\s*/>")
#: Rows of a sheet that are parsed at once, and bytes of a workbook for which one more task parses.
ROWS_AT_ONCE, BYTES_PER_TASK = 2000, 4 << 20


def _raw_rows(stream) -> Iterator[bytes]:
    """The opening of a sheet's XML, then its rows one by one, as they come out of the archive."""
    held, opened = b"", False
    while chunk := stream.read(1 << 18):
        held += chunk
        at = [m.start() for m in _ROW.finditer(held)]
        if not at:
            continue
        if not opened:
            yield held[: at[0]]
            opened = True
        for a, b in zip(at[:-1], at[1:]):
            yield held[a:b]
        held = held[at[-1] :]
    if not opened:
        yield held
        return
    end = _END.search(held)
    at = [m.start() for m in _ROW.finditer(held)]
    for a, b in zip(at, [*at[1:], end.start() if end else len(held)]):
        yield held[a:b]


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        with z.open("xl/sharedStrings.xml") as f:
            for _, element in ElementTree.iterparse(f):
                if element.tag == f"{_MAIN}si":
                    out.append("".join(t.text or "" for t in element.iter(f"{_MAIN}t")))
                    element.clear()
    return out


def sheet_rows(data: bytes, sheet: str | int = 0, share: int = 0, shares: int = 1) -> Iterator[tuple[int, list[tuple[str, str] | None]]]:
    """Number and cells of a sheet's rows; of several shares one has every so many stretches of rows.

    The XML comes out of the archive as a stream: rows of other shares are passed over unparsed, and only a stretch is in memory.
    """
    sheets = _sheets(data)
    if isinstance(sheet, str):
        if sheet not in dict(sheets):
            raise InputError(f"no such sheet: {sheet}")
        part = dict(sheets)[sheet]
    else:
        part = sheets[sheet][1]
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(part) as stream:
        shared, dated = _shared_strings(z), _date_styles(z)
        book = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_MAIN}workbookPr")
        base = dt.datetime(1904, 1, 1) if book is not None and book.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        raw = _raw_rows(stream)
        opening = re.search(rb"<(\w+:)?worksheet[^>]*>", next(raw))
        close = b"</" + (opening[1] or b"") + b"worksheet>" if opening else b""
        for block in itertools.count():
            some = list(itertools.islice(raw, ROWS_AT_ONCE))
            if not some:
                return
            if block % shares == share:
                for i, row in enumerate(ElementTree.fromstring(b"".join([opening[0], *some, close]))):
                    yield block * ROWS_AT_ONCE + i, _cells(row, shared, dated, base)


def _cells(row, shared: list[str], dated: set[int], base: dt.datetime) -> list[tuple[str, str] | None]:
    cells: dict[int, tuple[str, str]] = {}
    for place, c in enumerate(row.iter(f"{_MAIN}c")):
        at = place + 1
        if c.get("r"):
            at = 0
            for letter in re.match("[A-Z]+", c.get("r"))[0]:
                at = at * 26 + ord(letter) - 64
        value, kind = c.find(f"{_MAIN}v"), c.get("t")
        if kind == "inlineStr":
            cells[at - 1] = "s", "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        elif value is not None and value.text is not None and kind != "e":
            if kind == "s":
                cells[at - 1] = "s", shared[int(value.text)]
            elif kind == "b":
                cells[at - 1] = "b", "true" if value.text == "1" else "false"
            elif kind in ("str", "d"):
                cells[at - 1] = "s" if kind == "str" else "d", value.text
            elif int(c.get("s") or 0) in dated:
                cells[at - 1] = "d", (base + dt.timedelta(days=float(value.text))).isoformat(sep=" ", timespec="milliseconds")
            else:
                cells[at - 1] = "n", value.text
    return [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def read_xlsx(spark: SparkSession, source: bytes | str, sheet: str | int = 0) -> DataFrame:
    """One sheet of a workbook (a path, or its bytes): numbers, dates and truth values keep their kind where a whole column has it.

    A sheet has a million rows at most. Tasks parse stretches of them, in turn, and the parsed cells are kept in a checkpoint.
    """
    files = Files(spark)
    if isinstance(source, str):
        books, size = spark.read.format("binaryFile").load(source).select("content"), files.size(source)
    else:
        books, size = spark.createDataFrame([(bytearray(source),)], "content binary"), len(source)
    shares = max(1, min(spark.sparkContext.defaultParallelism, size // BYTES_PER_TASK))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def parse(batches):
        for batch in batches:
            for book, share in zip(*(c.to_pylist() for c in batch.columns)):
                found = sheet_rows(book, sheet, share, shares)
                while some := list(itertools.islice(found, ROWS_AT_ONCE)):
                    cells = [[None if c is None else {"kind": c[0], "value": c[1]} for c in r] for _, r in some]
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array(cells, kind)], names=["row", "cells"])

    if isinstance(sheet, str):
        head = source if isinstance(source, bytes) else files.read(source)
        if sheet not in sheet_names(head):
            raise InputError(f"no such sheet: {sheet}")
    books = books.select("content", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    rows = fixed((books.repartition(shares, "share") if shares > 1 else books).mapInArrow(parse, f"row long, cells array<{_CELL}>"))
    width = rows.agg(F.max(F.size("cells"))).first()[0]
    if not width:
        raise InputError("the sheet is empty")
    first = rows.where("row = 0").first()["cells"]
    names = [str(first[i]["value"] if i < len(first) and first[i] else f"列{i + 1}").strip() or f"列{i + 1}" for i in range(width)]
    body = rows.where("row > 0")
    cell = [F.get("cells", F.lit(i)) for i in range(width)]
    ends = body.agg(*[x for i, c in enumerate(cell) for x in (F.min(c["kind"]).alias(f"a{i}"), F.max(c["kind"]).alias(f"b{i}"))]).first()
    kinds = {"n": "double", "d": "timestamp_ntz", "b": "boolean"}
    out = [c["value"].try_cast(kinds[ends[f"a{i}"]]) if ends[f"a{i}"] == ends[f"b{i}"] and ends[f"a{i}"] in kinds else c["value"] for i, c in enumerate(cell)]
    return body.select(*[c.alias(n) for c, n in zip(out, names)])
