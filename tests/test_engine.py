import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.errors import InputError
from tidemill.operators import analyze, clean, health
from tidemill.plans import console, usercode
from tidemill.plans.store import Store
from tidemill.sources import readers, writers


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("2024-01-05", "华东", "鼠标", 1200, 3), ("2024-01-05", "华东", "鼠标", 1200, 3), ("2024-02-01", None, "键盘", 600, 2), ("2024-03-09", "华北", "屏幕", 900, 1), ("2024-05-20", "华东", "屏幕", 3500, 1)]
    return spark.createDataFrame(rows, "d string, region string, product string, amount long, n long")


def column(df, name):
    return [r[name] for r in df.collect()]


def test_rows_and_guards(sales):
    assert clean.build(sales, "drop_duplicates").count() == 4
    assert clean.build(sales, "drop_missing", {"columns": ["region"]}).count() == 4
    assert clean.build(sales, "filter_rows", {"column": "region", "op": "ne", "value": "华东"}).count() == 2
    with pytest.raises(InputError):
        clean.apply_op(sales, "filter_rows", {"column": "amount", "op": "gt", "value": 10**9})
    with pytest.raises(InputError):
        clean.build(sales, "rename_columns", {"mapping": {"d": "x", "n": "x"}})
    with pytest.raises(InputError):
        clean.build(sales, "fill_missing", {"columns": ["region"], "method": "mean"})


def test_numbers_from_text(spark):
    given = [("¥1,200", 1200.0), ("1.5万", 15000.0), ("12%", 12.0), ("12,34", None), ("12d", None), ("１２", 12.0), (None, None), ("", None)]
    df = spark.createDataFrame(given, "t string, want double")
    out = clean.build(df, "parse_number", {"column": "t", "new_column": "got"}).collect()
    assert [r["got"] for r in out] == [w for _, w in given]
    cast = clean.build(spark.createDataFrame([("12d",), ("2.5",), ("x",)], "t string"), "cast_type", {"column": "t", "to": "int"})
    assert column(cast, "t") == [None, 2, None]


def test_interpolation_and_bins(spark):
    df = spark.createDataFrame(list(enumerate([10.0, None, None, 40.0, None, 70.0])), "id int, v double")
    out = clean.build(df, "fill_missing", {"columns": ["v"], "method": "interpolate", "order_by": ["id"]})
    assert [r["v"] for r in out.orderBy("id").collect()] == [10, 20, 30, 40, 55, 70]
    capped = spark.createDataFrame([(10.0,)] * 20 + [(1000.0,)], "v double")
    assert clean.build(capped, "cap_outliers", {"columns": ["v"]}).agg(F.max("v")).first()[0] == 10


def test_analysis(sales):
    out = analyze.groupby(sales, "region", [{"column": "amount", "agg": "sum"}]).collect()
    assert [(r[0], r[1]) for r in out] == [("华东", 5900), ("华北", 900), (None, 600)]
    t = analyze.trend(sales, "d", "amount")
    assert column(t, "value") == [2400.0, 600.0, 900.0, 0.0, 3500.0]
    assert sum(column(analyze.histogram(sales, "amount", 5), "count")) == 5
    assert analyze.corr(sales, ["amount", "n"], "kendall").count() == 2
    for spec in analyze.suggest_charts(sales):
        assert analyze.run(sales, spec["kind"], spec["params"]).columns


def test_every_fix_of_the_health_check_runs(spark):
    rows = [(f"A{i}", "¥1,200" if i % 2 else "1.5万", " Beijing" if i % 3 else "beijing", "是" if i % 2 else "yes", None, i) for i in range(12)]
    df = spark.createDataFrame([*rows, rows[0]], "id string, price string, city string, member string, note string, n long")
    found = health.health_check(df)
    rules = {f["rule"] for f in found["findings"]}
    assert {"H1", "H4", "H11", "H18", "H27"} <= rules and found["score"] < 90
    for f in found["findings"]:
        if f["fix"]:
            assert clean.build(df, f["fix"]["op"], f["fix"]["params"]).columns
    tidy = spark.createDataFrame([(float(i), f"v{i}") for i in range(6)], "a double, b string")
    good = health.health_check(tidy)
    assert good["score"] == 100 and not [f for f in good["findings"] if f["level"] != "info"]


CONSOLE_REFUSES = (
    "DROP TABLE df", "SELECT 1; SELECT 2", "", "-- nothing", "SET a=b", "CREATE VIEW v AS SELECT 1", "CREATE TABLE made AS SELECT 1", "REPLACE TABLE made USING parquet AS SELECT 1",
    "WITH x AS (SELECT 1) INSERT INTO df SELECT * FROM x", "WITH x AS (SELECT 1) FROM x INSERT INTO df SELECT *", "SELECT * FROM (INSERT INTO df SELECT 1)", "MERGE INTO df USING df ON 1 = 1 WHEN MATCHED THEN DELETE",
    "EXECUTE IMMEDIATE 'CREATE TABLE made (a INT)'", "BEGIN CREATE TABLE made (a INT); SELECT 1; END", "CLEAR CACHE", "SHOW TABLES", "EXPLAIN SELECT 1", "DESCRIBE df", "DECLARE VARIABLE x INT", "LIST JARS", "/* SELECT */ DROP TABLE df",
    "SELECT TRANSFORM(amount) USING 'cat' AS (x) FROM df", "SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`", "SELECT (SELECT count(*) FROM csv.`relative`)", "SELECT * FROM IDENTIFIER('parquet.`/x`')", "SELECT IDENTIFIER('reflect')('java.lang.Math', 'random')",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM reflect('a', 'b')", "SELECT builtin.try_reflect /* ' */ ('a', 'b') -- '", "SELECT x FROM df LATERAL VIEW java_method('a', 'b') t AS x", "SELECT 1 FROM df WHERE n IN (SELECT `reflect`('a', 'b'))", "SELECT transform(array(1), x -> reflect('a', 'b'))",
)


@pytest.mark.parametrize("query", CONSOLE_REFUSES)
def test_console_refuses(spark, sales, query):
    with pytest.raises(InputError):
        console.run_sql(spark, query, {"df": sales})


def test_console_reads(spark, sales):
    assert not spark.catalog.tableExists("made")
    for query, want in (("SELECT ';' AS x, count(*) AS n FROM df;", (";", 5)), ('SELECT max("amount") AS "a b", \'it\'\'s "x" -- y\' AS t FROM "df" -- end', (3500, 'it\'s "x" -- y')), ("with t as (select 1 as a) select * from t", (1,)), ("(SELECT 1 AS drop) UNION (SELECT 1)", (1,)), (r"SELECT r'\d' AS z, 'reflect(' AS y", (r"\d", "reflect("))):
        assert tuple(console.run_sql(spark, query, {"df": sales}).first()) == want


def test_console_saves_whole_results(spark, sales, tmp_path):
    store = Store(spark, str(tmp_path))
    project = store.create_project("p")["id"]
    base = store.create(sales, "sales", project=project)["id"]
    made = console.save_as(store, "SELECT product, sum(amount) AS total FROM df GROUP BY product", "totals", base)
    assert made["parent"] == base and made["project"] == project and store.load(made["id"]).count() == 3
    big = console.save_as(store, "SELECT id FROM range(100005)", "many", base)
    assert store.load(big["id"]).count() == 100005


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    ds = store.create(spark.range(5).toDF("a"), "t")["id"]
    store.save(ds, spark.range(3).toDF("a"), "cut")
    assert store.load(ds).count() == 3 and store.undo(ds)["current"] == 0
    store.restore(ds, 1)
    store.undo(ds)
    store.save(ds, spark.range(4).toDF("a"), "branch")
    assert store.versions(ds)["snapshots"] == [0, 2]
    assert store.load(store.reset(ds)["id"]).count() == 5
    store.save_dashboard(ds, [{"kind": "histogram", "params": {"column": "a", "bins": 2}}])
    assert [d.count() for d in store.replay(ds)] == [2]
    with pytest.raises(InputError):
        store.create_project(" ")
    store.delete(ds)
    assert store.list() == []


def test_sources_and_exports(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("地区;数量\n华东;1\n华北;2\n".encode("gbk"))
    assert readers.read_csv(spark, str(tmp_path / "g.csv")).columns == ["地区", "数量"]
    assert readers.read_paste(spark, "a\tb\n1\t2").first()["b"] == 2
    (tmp_path / "j.json").write_text('{"data": [{"a": 1, "b": {"c": 2}}]}')
    assert readers.read_json(spark, str(tmp_path / "j.json")).columns == ["a", "b.c"]
    df = spark.createDataFrame([("x<", 1.5), (None, 2.0)], "s string, v double")
    writers.write_xlsx(df, str(tmp_path / "o.xlsx"))
    back = readers.read_xlsx(spark, (tmp_path / "o.xlsx").read_bytes()).collect()
    assert [(r["s"], r["v"]) for r in back] == [("x<", 1.5), (None, 2.0)]
    assert writers.json_cell(float("nan")) is None and writers.safe_name("a/b") == "a_b"


def test_user_code(spark):
    out, said = usercode.run_code(spark.range(3), "print('hi'); df = df.where(F.col('id') > 0)")
    assert out.count() == 2 and said == "hi\n"
    with pytest.raises(InputError):
        usercode.run_code(spark.range(3), "df = 1")


def test_ordered_work_crosses_ranges(spark):
    from tidemill.functions import ranges

    rng = np.random.default_rng(7)
    values = [None if rng.random() < 0.7 or 400 < i < 800 else float(rng.integers(100)) for i in range(1200)]
    rows = [(int(i), values[i]) for i in rng.permutation(1200)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(7)
    series = pd.Series(values)
    for method, want in (("ffill", series.ffill()), ("bfill", series.bfill()), ("interpolate", series.interpolate(limit_direction="both"))):
        out = clean.fill_missing(df, ["v"], method, order_by=["id"]).toPandas().sort_values("id")
        assert list(out.columns) == ["id", "v"]
        np.testing.assert_allclose(out["v"].to_numpy(float), want.to_numpy(float))
    many = df.repartition(5).withColumn("one", F.lit(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ranges.in_ranges(many, [F.col("id")]).select("__part").distinct().count() > 1
        assert ranges.row_numbers(many, [F.col("id")]).where("__row <> id").isEmpty()
        assert ranges.running_total(many, "id", "one", "below").where("below <> id").isEmpty()
        back = clean.fill_missing(df, ["v"], "bfill", order_by=["id"]).toPandas().sort_values("id")
        np.testing.assert_allclose(back["v"].to_numpy(float), series.bfill().to_numpy(float))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert clean.fill_missing(df.limit(0), ["v"], "ffill", order_by=["id"]).count() == 0
