"""Forms of analysts' SQL: the same text in DuckDB and, by the console, in Spark."""

import duckdb
import pytest

from tidemill.errors import InputError
from tidemill.plans import console, dialect

QUERIES = [
    'SELECT CAST(CAST("k" AS BIGINT) AS VARCHAR) AS "k", round(x * 2, 2) AS y FROM t WHERE "k" IS NOT NULL AND s NOT LIKE \'c%\'',
    "SELECT x::VARCHAR AS a, s AS text, TRY_CAST(s AS TEXT) AS b FROM t",
    "SELECT (SELECT max(k) AS text FROM t) AS m FROM t",
    "SELECT * EXCLUDE (x, d) FROM t",
    "SELECT t.* EXCLUDE d FROM t",
    "SELECT k // 2 AS h, array_contains([k, 7], 7) AS one, len_of AS n FROM (SELECT k, 3 AS len_of FROM t)",
    "SELECT k FROM t WHERE list_contains([1, 2], k)",
    "SELECT k, row_number() OVER (PARTITION BY k ORDER BY x) AS r FROM t QUALIFY r = 1 ORDER BY k",
    "SELECT k, x FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY x DESC) <= 2",
    "WITH a AS (SELECT k, x FROM t QUALIFY rank() OVER (ORDER BY x) < 4) SELECT count(*) AS n, sum(k) AS s FROM a UNION ALL SELECT 0, count(*) FROM (SELECT s FROM t QUALIFY row_number() OVER (PARTITION BY s ORDER BY x) = 1)",
    "FROM t",
    "SELECT quantile_cont(x, 0.25) AS q, arg_max(s, x) AS m FROM t",
    "SELECT strftime(d, '%Y-%m o''clock %H:%M') AS f FROM t",
    "SELECT date_diff('month', d, TIMESTAMP '2024-03-01 00:00:00') AS m, date_diff('day', d, TIMESTAMP '2024-03-01 12:00:00') AS d FROM t",
    "SELECT {'a': k, 'b': s}.a AS a FROM t",
    "SELECT regexp_extract(s, '[a-c]') AS e, strpos(s, 'b') AS p, starts_with(s, 'a') AS w FROM t -- QUALIFY [1]",
    "SELECT 'CAST(x AS VARCHAR) [1] QUALIFY //' AS t, \"k\" AS \"[k]\" FROM t /* [2] */",
    "SELECT list_contains(list_transform([k, 2], lambda y: y + 1), 3) AS z, unnest(list_filter([k, 5], lambda y: y > 1)) AS u FROM t",
]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i % 4, i * 1.5, "ab"[i % 2] + "bc" * (i % 3), f"2024-01-{i + 5:02d} 10:{i:02d}:00") for i in range(20)]
    return spark.createDataFrame(rows, "k long, x double, s string, d string").selectExpr("k", "x", "s", "cast(d as timestamp_ntz) as d")


@pytest.mark.parametrize("query", QUERIES)
def test_same_text_same_rows(spark, table, query):
    t = table.toPandas()  # noqa: F841  read by DuckDB
    found = duckdb.sql(query)
    got = console.run_sql(spark, query, {"t": table})
    assert [c.lower() for c in got.columns] == [c.lower() for c in found.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in found.fetchall())


def test_words_that_stay():
    for text in ("SELECT a[1], `b`[0], f(x)[2] FROM t", "SELECT text FROM t", "SELECT CAST(x AS VARCHAR(3)) FROM t", "SELECT '[1]', 'it''s // QUALIFY' FROM t", "SELECT qualify FROM t WHERE a = 1"):
        assert dialect.in_spark(text) == text


def test_statements_are_still_refused(spark, table):
    for query in ("FROM t INSERT INTO x SELECT k", "SELECT reflect('java.lang.Math', 'random') FROM t QUALIFY true", "FROM t SELECT TRANSFORM(k) USING 'cat' AS (x)"):
        with pytest.raises(InputError):
            console.run_sql(spark, query, {"t": table})


def test_views_of_the_caller_are_left_alone(spark, table):
    spark.range(3).createOrReplaceTempView("t")
    assert console.run_sql(spark, "SELECT count(*) AS n FROM t", {"t": table, "other": table}).first()["n"] == 20
    assert spark.table("t").count() == 3 and not spark.catalog.tableExists("other")
    spark.catalog.dropTempView("t")
