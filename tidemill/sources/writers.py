"""Exports: CSV with a byte-order mark, XLSX, result tables, JSON cells, file names."""

from __future__ import annotations

import csv
import io
import math
import re
import uuid
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import InputError
from .files import Files

XLSX_ROWS = 1_048_575


def safe_name(name: str) -> str:
    return re.sub(r'[<>:"/\\|?*]', "_", name)[:60] or "export"


def write_csv(df: DataFrame, path: str) -> None:
    """One file at ``path`` with a byte-order mark and one header line, whatever the number of rows.

    Rows are written by all tasks, without headers; their part files, which begin with the header's, are then joined by the store.
    """
    files, parts = Files(df.sparkSession), f"{path}.{uuid.uuid4().hex[:8]}.parts"
    df.write.options(quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(parts)
    head = io.StringIO()
    csv.writer(head, lineterminator="\n").writerow(df.columns)
    files.join_parts(parts, path, ("\ufeff" + head.getvalue()).encode())


_MAIN, _RELATED = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Characters that XML can't hold, and line ends, which a text file of rows can't.
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _cell(v) -> str:
    v = json_cell(v)
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f"<c><v>{v}</v></c>"
    text = escape(_UNFIT.sub("", str(v)), {"\n": "&#10;", "\r": "&#13;"})
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def _row(values) -> str:
    """A row without numbers: cells follow one another, so a task needn't know what stands before its rows."""
    return f"<row>{''.join(map(_cell, values))}</row>"


def write_xlsx(df: DataFrame, path: str) -> None:
    """One sheet; more rows than the format holds are refused. Tasks write the rows' XML, whose parts are then zipped a block at a time."""
    files, parts = Files(df.sparkSession), f"{path}.{uuid.uuid4().hex[:8]}.parts"

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([_row(r) for r in rows], pa.string())], names=["row"])

    seen = Observation()
    df.mapInArrow(run, "row string").observe(seen, F.count(F.lit(1)).alias("n")).write.text(parts)
    if seen.get["n"] > XLSX_ROWS:
        files.delete(parts)
        raise InputError(f"an XLSX sheet holds at most {XLSX_ROWS} rows")
    small = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATED}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_RELATED}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATED}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }
    head = f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{_row(df.columns)}\n'
    files.zip_parts(path, {k: v.encode() for k, v in small.items()}, "xl/worksheets/sheet1.xml", head.encode(), parts, b"</sheetData></worksheet>")


def json_cell(v):
    """Null for not-a-number and infinities, text for what JSON can't hold."""
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    return str(v)


def table_csv(columns, rows) -> str:
    """A result table as CSV; interval cells are spelt out, nameless columns numbered."""
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow([c or f"列{i + 1}" for i, c in enumerate(columns)])
    for r in rows:
        w.writerow([f"{v['value']}(下限{v.get('lower')}~上限{v.get('upper')})" if isinstance(v, dict) and "value" in v else json_cell(v) for v in r])
    return "﻿" + out.getvalue()


def rows_json(df: DataFrame) -> DataFrame:
    """One JSON text for each row, floats that JSON can't hold as null."""
    finite = [F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`")).alias(c) if k in ("float", "double") else F.col(f"`{c}`") for c, k in df.dtypes]
    return df.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("row"))
