"""The front door: uploads of every kind, versions, tools, exports."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemill.api import Workspace
from tidemill.errors import InputError
from tidemill.operators import analyze
from tidemill.plans import usercode
from tidemill.sources import readers, sample, writers


@pytest.fixture()
def space(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "space"))


def workbook(sheets):
    """A workbook whose sheet files don't follow the sheets' order; cells are (reference, kind, style, value)."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        names, targets = [], []
        for i, (name, rows) in enumerate(sheets):
            number = len(sheets) - i
            cells = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{ref}" t="{kind}"><is><t>{v}</t></is></c>' if kind == "inlineStr" else f'<c r="{ref}" t="{kind}" s="{style}"><v>{v}</v></c>' for ref, kind, style, v in row) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{number}.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
            names.append(f'<sheet name="{name}" sheetId="{i + 1}" r:id="rId{i + 7}"/>')
            targets.append(f'<Relationship Id="rId{i + 7}" Target="worksheets/sheet{number}.xml"/>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(names)}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(targets)}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
    return book.getvalue()


def test_workbooks_by_relationship_with_dates_and_truth_values(space, tmp_path):
    head = [("A1", "inlineStr", 0, "when"), ("B1", "inlineStr", 0, "ok"), ("C1", "inlineStr", 0, "n")]
    first = [head, [("A2", "n", 1, "45292"), ("B2", "b", 0, "1"), ("C2", "n", 0, "1.5")], [("A3", "n", 1, "45292.5"), ("C3", "n", 0, "2")]]
    second = [[("A1", "inlineStr", 0, "x")], [("A2", "inlineStr", 0, "only")]]
    (tmp_path / "b.xlsx").write_bytes(workbook([("one", first), ("two", second)]))
    ds = space.upload(str(tmp_path / "b.xlsx"))
    assert dict(ds.df.dtypes) == {"when": "timestamp_ntz", "ok": "boolean", "n": "double"}
    assert [tuple(r) for r in ds.df.orderBy("when").collect()] == [(dt.datetime(2024, 1, 1), True, 1.5), (dt.datetime(2024, 1, 1, 12), None, 2.0)]
    project = space.store.create_project("p")["id"]
    ds.move(project)
    other = ds.import_sheet("two")
    assert other.df.collect()[0]["x"] == "only" and other.meta["project"] == project and other.meta["parent"] == ds.id
    with pytest.raises(InputError):
        ds.import_sheet("three")


def test_delimited_text(space, tmp_path, spark):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"p{i}.csv").write_text(f" a ,b\n{i},x\n")
    got = readers.read_csv(spark, str(folder))
    assert got.columns == ["a", "b"] and sorted(r["a"] for r in got.collect()) == [0, 1, 2]
    (tmp_path / "lines.csv").write_text('v,w\n1,"a\nb"\n2,"c ""q"" d"\n')
    ds = space.upload(str(tmp_path / "lines.csv"))
    assert sorted(map(tuple, ds.df.collect())) == [(1, "a\nb"), (2, 'c "q" d')]
    (tmp_path / "drift.csv").write_text("v,w\n" + "1,2\n" * 200000 + "text,3\n")
    ds = space.upload(str(tmp_path / "drift.csv"))
    assert dict(ds.df.dtypes) == {"v": "string", "w": "bigint"} and ds.df.count() == 200001
    (tmp_path / "one.csv").write_text("v\n1\n2\n")
    assert [r["v"] for r in space.upload(str(tmp_path / "one.csv")).df.collect()] == [1, 2]
    (tmp_path / "g.csv").write_bytes("地区;数量\n华东;1\n华北;2\n".encode("gbk"))
    assert sorted(map(tuple, space.upload(str(tmp_path / "g.csv")).df.collect())) == [("华东", 1), ("华北", 2)]
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "g.csv")).collect()} == {("华东", 1), ("华北", 2)}
    with pytest.raises(InputError):
        space.upload(str(tmp_path / "x.pdf"))


def test_json_shapes(spark, tmp_path):
    def read(text):
        (tmp_path / "j.json").write_text(text)
        return readers.read_json(spark, str(tmp_path / "j.json"))

    assert sorted(map(tuple, read('{"a": [1, 2], "b": ["x", "y"]}').collect())) == [(1, "x"), (2, "y")]
    assert sorted(map(tuple, read('{"a": 1, "b": 2}\n{"a": 3, "b": 4}\n').collect())) == [(1, 2), (3, 4)]
    assert read('{"rows": [1, 2, 3]}').count() == 3
    assert read('[{"a": 1, "b": {"c": 2}}]').columns == ["a", "b.c"]
    assert sorted(r["a"] for r in read('{"a": [{"x": 1}, {"x": 2}], "items": [{"a": 5}, {"a": 6}]}').collect()) == [5, 6]


def test_sample_data(spark):
    made = sample.make_sample(spark)
    assert made.count() == 370 and made.distinct().count() == 360
    orders = made.distinct()
    assert orders.where("`charge` is null").count() == 12 and orders.where("`harbour` is null").count() == 8
    assert orders.where("abs(`charge` - `hourly` * `hours`) > 0.006").count() == 0
    assert made.collect() == sample.make_sample(spark).collect()


def test_a_dataset_from_upload_to_export(space, tmp_path):
    ds = space.make_sample()
    assert ds.clean("drop_duplicates").startswith("drop_duplicates: 370 -> 360 rows")
    assert ds.clean("cast_type", {"column": "day", "to": "datetime", "format": "%Y-%m-%d"}).endswith("0 values could not be converted")
    assert ds.transform("df = df.withColumn('twice', F.col('hours') * 2)", preview=True).count() == 20
    assert "twice" not in ds.df.columns
    ds.transform("def pandas_batch(frame):\n    frame['hours'] = frame['hours'] + 1\n    return frame")
    assert ds.df.agg(F.min("hours")).first()[0] == 2
    assert ds.undo()["current"] == 2 and ds.df.agg(F.min("hours")).first()[0] == 1
    ds.pin([{"kind": "value_counts", "params": {"column": "harbour"}}])
    assert [d.count() for d in ds.replay()] == [5]
    assert ds.rows(page=2, page_size=50)["total"] == 360 and len(ds.rows(page=8, page_size=50)["rows"]) == 10
    part = ds.sample("stratified", 2, by="kind")
    assert part.df.count() == 6 and part.meta["parent"] == ds.id
    made = space.sql('SELECT "kind", count(*) AS n FROM df GROUP BY 1', ds.id, save_as="counts")
    assert made.df.agg(F.sum("n")).first()[0] == 360
    text = open(ds.export(str(tmp_path / "o.csv")), encoding="utf-8").read()
    assert text.startswith("﻿rental,") and text.count("rental") == 1 and len(text.splitlines()) == 361
    ds.export(str(tmp_path / "o.xlsx"), "xlsx")
    assert space.upload(str(tmp_path / "o.xlsx")).df.count() == 360
    points = ds.interactions("hourly", "hours", ["rental"])
    assert points["total_sampled"] == 360 and -0.2 < points["spearman"] < 0.2
    assert {s["kind"] for s in ds.chart_suggest()} >= {"trend", "groupby", "scatter", "histogram", "corr"}
    for spec in ds.chart_suggest():
        assert ds.analyze(spec["kind"], spec["params"]).columns
    assert ds.duplicates()["extra_rows"] == 0 and ds.reset()["current"] == 4 and ds.df.count() == 370


def test_tools_are_bounded_and_checked(space):
    ds = space.make_sample()
    described = {s["name"]: s["parameters"] for s in space.tools.schemas()}
    params = {"column_profile": {}, "read_rows": {"page_size": 1000}, "health_check": {}, "describe": {}, "groupby": {"by": ["model"], "metrics": [{"column": "charge", "agg": "sum"}]}, "correlation": {"columns": ["hourly", "hours"]}, "histogram": {"column": "hourly"}, "value_counts": {"column": "model"}, "trend": {"date_column": "day", "value_column": "charge"}, "sql_query": {"query": "SELECT * FROM df"}, "list_datasets": {}}
    assert set(params) == set(described)
    for name, p in params.items():
        p = p if name == "list_datasets" else p | {"dataset_id": ds.id}
        got = space.tools.run(name, p)
        json.dumps(got, default=str)
        assert len(got.get("rows", [])) <= 200
    assert len(space.tools.run("sql_query", {"query": "SELECT * FROM df", "dataset_id": ds.id})["rows"]) == 200
    assert space.tools.run("sql_query", {"query": "SELECT * FROM df", "dataset_id": ds.id})["truncated"]
    assert len(space.tools.brief("read_rows", {"dataset_id": ds.id, "page_size": 200})) == 3500
    assert len(space.tools.card(ds.id, {"kind": "value_counts", "params": {"column": "model"}})["rows"]) == 12
    for name, p in (("nothing", {}), ("describe", {}), ("describe", {"dataset_id": ds.id, "more": 1})):
        with pytest.raises(InputError):
            space.tools.run(name, p)


def test_prints_stay_with_their_thread(spark, capsys):
    out, said = usercode.run_code(spark.range(3), "print('inside')")
    print("outside")
    assert said == "inside\n" and capsys.readouterr().out == "outside\n" and out.count() == 3


def test_result_tables(spark):
    text = writers.table_csv(["a", ""], [[{"value": 1, "lower": 0, "upper": 2}, float("inf")]])
    assert text == "﻿a,列2\r\n1(下限0~上限2),\r\n"
    rows = writers.rows_json(spark.createDataFrame([(1.5, float("nan"))], "a double, b double")).collect()
    assert json.loads(rows[0]["row"]) == {"a": 1.5, "b": None}


def test_kendall_by_digits_matches_all_pairs(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 40, 400), rng.integers(0, 12, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    want = (sx * sy).sum() / np.sqrt((sx * sx).sum() * (sy * sy).sum())
    assert abs(analyze.kendall(df, "x", "y") - want) < 1e-12
    monkeypatch.setattr(analyze, "FEW_PAIRS", 10)
    assert abs(analyze.kendall(df, "x", "y") - want) < 1e-12


def test_bracketed_quantiles_are_exact(spark, monkeypatch):
    from tidemill.functions import stats

    df = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(700)) / 7).alias("x"), F.lit(None).cast("double").alias("none"))
    at = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = stats.quantiles(df, {"x": F.col("x"), "none": F.col("none")}, at)
    monkeypatch.setattr(stats, "EXACT_ROWS", 10)
    monkeypatch.setattr(stats, "BRACKETS", 100)
    assert stats.quantiles(df, {"x": F.col("x"), "none": F.col("none")}, at) == want and want["none"] is None


def test_strptime_formats(spark):
    from tidemill.functions import dates
    from tidemill.operators import clean

    given = [("2024-1-5", "%Y-%m-%d"), ("20240105", "%Y%m%d"), ("05/01/2024", "%d/%m/%Y"), ("2024年1月5日", "%Y年%m月%d日"), ("24-01-05 06:07:08", "%y-%m-%d %H:%M:%S"), ("Jan 5 2024", "%b %d %Y"), ("5'1'2024", "%d'%m'%Y")]
    for text, fmt in given:
        got = clean.build(spark.createDataFrame([(text,), ("bad",)], "t string"), "cast_type", {"column": "t", "to": "datetime", "format": fmt}).collect()
        want = dt.datetime.strptime(text, fmt)
        assert [r["t"] for r in got] == [want, None], fmt
    with pytest.raises(InputError):
        dates.spark_format("%Q")
    mixed = spark.createDataFrame([("01/25/2024",), ("25/01/2024",), ("01/02/2024",), ("2024.1.5",), ("12",)], "t string")
    assert [r["t"] for r in clean.build(mixed, "cast_type", {"column": "t", "to": "datetime"}).collect()] == [dt.datetime(2024, 1, 25), dt.datetime(2024, 1, 25), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5), None]


def test_keep_first_is_the_first(spark):
    from tidemill.operators import clean

    df = spark.createDataFrame([(i % 5, 100 - i, i) for i in range(50)], "k int, a int, b int").repartition(7)
    assert sorted(map(tuple, clean.drop_duplicates(df, ["k"], ["b"]).collect())) == [(k, 100 - k, k) for k in range(5)]
    assert sorted(map(tuple, clean.drop_duplicates(df, ["k"]).collect())) == [(k, 55 - k, 45 + k) for k in range(5)]
    big = {str(i): str(-i) for i in range(600)}
    mapped = clean.map_values(df.withColumn("t", F.col("b").cast("string")), "t", big).where("b = 7").first()["t"]
    assert mapped == "-7"


def test_new_files_are_ingested_once(spark, tmp_path):
    from tidemill.streaming.ingest import follow_csv

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.csv").write_text(f"a,b\n{k},x\n")
        follow_csv(spark, str(tmp_path / "in"), "a int, b string", str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
        assert sorted(r["a"] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == list(range(k + 1))
