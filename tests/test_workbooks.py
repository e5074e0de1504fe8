"""Large workbooks: written by tasks and read as streams."""

import io
import zipfile

import pytest

from tidemill.errors import InputError
from tidemill.sources import readers, writers


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "ROWS_AT_ONCE", 300)
    monkeypatch.setattr(readers, "BYTES_PER_TASK", 20_000)
    df = spark.range(5000).selectExpr("id", "id / 4 as x", "id % 2 = 0 as b", "if(id % 3 = 0, null, concat('<té&xt \"\\n\\r', char(7), '> ', id)) as s", "'row' as `a <row `").repartitionByRange(7, "id")
    path = str(tmp_path / "o.xlsx")
    writers.write_xlsx(df, path)
    got = readers.read_xlsx(spark, path)
    assert got.columns == ["id", "x", "b", "s", "a <row"]
    assert [k for _, k in got.dtypes] == ["double", "double", "boolean", "string", "string"]
    want = sorted((float(r[0]), r[1], r[2], r[3] and r[3].replace("\x07", ""), r[4]) for r in df.collect())
    assert sorted(map(tuple, got.collect())) == want
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        rows = [i for i, _ in readers.sheet_rows(open(path, "rb").read())]
    assert rows == list(range(5001))
    shares = [i for k in range(3) for i, _ in readers.sheet_rows(open(path, "rb").read(), 0, k, 3)]
    assert sorted(shares) == rows
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["o.xlsx"]


def test_prefixed_names_and_empty_rows(spark):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    sheet = f'<?xml version="1.0"?><x:worksheet xmlns:x="{main}"><x:sheetData><x:row r="1"><x:c r="A1" t="inlineStr"><x:is><x:t>n</x:t></x:is></x:c><x:c r="C1" t="inlineStr"><x:is><x:t>m</x:t></x:is></x:c></x:row><x:row r="2"/><x:row><x:c><x:v>4</x:v></x:c></x:row></x:sheetData></x:worksheet>'
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", sheet)
    assert [r for _, r in readers.sheet_rows(book.getvalue())] == [[("s", "n"), None, ("s", "m")], [], [("n", "4")]]
    assert [tuple(r) for r in readers.read_xlsx(spark, book.getvalue()).collect()] == [(None, None, None), (4.0, None, None)]


def test_rows_beyond_the_format_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "XLSX_ROWS", 10)
    with pytest.raises(InputError, match="at most 10"):
        writers.write_xlsx(spark.range(11), str(tmp_path / "o.xlsx"))
    assert list(tmp_path.iterdir()) == []
    writers.write_xlsx(spark.range(10), str(tmp_path / "o.xlsx"))
    writers.write_xlsx(spark.range(3), str(tmp_path / "o.xlsx"))
    assert readers.read_xlsx(spark, str(tmp_path / "o.xlsx")).count() == 3
