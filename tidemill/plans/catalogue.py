"""Registered queries of the engine's operators and the SQL that checks them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyze, clean, health, joins
from ..session import shared_dir
from ..sources import readers
from . import console

QUERIES: dict = {}
ORACLES: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, table: str, build, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(_table(spark, sf_dir, table))
    if sql:
        ORACLES[name] = sql


def _op(name: str, table: str, op: str, params: dict, keep: list[str], sql: str, prepare=None) -> None:
    """A cleaning operator on (prepared) rows, cut to the columns ``keep``."""
    _query(name, table, lambda df: clean.build(prepare(df) if prepare else df, op, params).select(*keep), sql)


def _sql(name: str, query: str, oracle: str | None = None, tables=("customer", "orders", "lineitem", "nation", "region", "supplier", "part")) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return console.run_sql(spark, query, {t: _table(spark, sf_dir, t) for t in tables if t in query}, preview=False)

    QUERIES[name], ORACLES[name] = run, oracle or query


def _renamed(df: DataFrame, *names: str) -> DataFrame:
    return df.toDF(*names)


def _hot(d: DataFrame) -> DataFrame:
    """The made columns folded back into the value that they mark: their names depend on the data."""
    top = F.coalesce(*[F.when(F.col(c) == 1, F.lit(c[2:])) for c in d.columns if c.startswith("s_")])
    return d.select("o_orderkey", top.alias("top"))


# aggregations

_query("groupby_aggregates", "lineitem", lambda d: _renamed(analyze.groupby(d, ["l_returnflag", "l_linestatus"], [{"column": c, "agg": a} for c, a in (("l_quantity", "count"), ("l_quantity", "sum"), ("l_extendedprice", "mean"), ("l_extendedprice", "min"), ("l_extendedprice", "max"), ("l_extendedprice", "median"), ("l_discount", "std"), ("l_suppkey", "nunique"))]).select("*"), "l_returnflag", "l_linestatus", "n", "total", "mean", "lo", "hi", "med", "std", "suppliers").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 9), "total": F.round("total", 4)}),
       "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(sum(l_quantity), 4) AS total, round(avg(l_extendedprice), 6) AS mean, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, 0.5) AS med, round(stddev_samp(l_discount), 9) AS std, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL")
_query("groupby_first_last", "orders", lambda d: _renamed(analyze.groupby(d, "o_orderstatus", [{"column": "o_totalprice", "agg": "first"}, {"column": "o_totalprice", "agg": "last"}], order_by=["o_orderkey"]), "o_orderstatus", "first_price", "last_price"),
       "SELECT o_orderstatus, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1")
_query("groupby_top", "part", lambda d: _renamed(analyze.groupby(d, "p_brand", [{"column": "p_size", "agg": "sum"}], top=5), "p_brand", "size"),
       "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1 ORDER BY 1 LIMIT 5")
_DESCRIBED = ("mean", "std", "min", "p25", "p50", "p75", "max")
_query(
    "describe",
    "orders",
    lambda d: analyze.describe(d, ["o_totalprice", "o_custkey", "o_orderpriority"]).select("column", "count", "unique", "top", "freq", *[F.round(c, 4).alias(c) for c in _DESCRIBED]),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, NULL::BIGINT AS \"unique\", NULL::VARCHAR AS top, NULL::BIGINT AS freq, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min,"
        f" round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS max FROM orders"
        for c in ("o_totalprice", "o_custkey")
    )
    + " UNION ALL SELECT 'o_orderpriority', sum(k)::BIGINT, count(*), arg_min(v, (-k, v)), max(k), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT o_orderpriority AS v, count(*) AS k FROM orders GROUP BY 1)",
)
_query("value_counts", "orders", lambda d: analyze.value_counts(d, "o_orderpriority", 3),
       "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
_query("histogram", "lineitem", lambda d: analyze.histogram(d, "l_extendedprice", 10).select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count"),
       "WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) SELECT CAST(r.i AS INTEGER) AS bin, round(lo + r.i * ((hi - lo) / 10), 6) AS low, round(lo + (r.i + 1) * ((hi - lo) / 10), 6) AS high, coalesce(n, 0) AS count FROM range(10) r(i) CROSS JOIN b LEFT JOIN c ON c.bin = r.i")
_query("boxplot", "lineitem", lambda d: analyze.boxplot(d, ["l_quantity", "l_extendedprice"]).select("column", "min", "q1", "median", "q3", "max", F.round("low", 4).alias("low"), F.round("high", 4).alias("high")),
       " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max, round(quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS low, round(quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)), 4) AS high FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
_IQR = "WITH q AS (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {t}), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)"
_Z = "WITH f AS (SELECT avg({c}) - 3 * stddev_pop({c}) AS lo, avg({c}) + 3 * stddev_pop({c}) AS hi FROM {t})"
_query("outliers_iqr", "customer", lambda d: analyze.outliers(d.withColumn("c_acctbal", F.when(F.col("c_custkey") % 20 == 0, F.col("c_acctbal") * 50).otherwise(F.col("c_acctbal"))), ["c_acctbal"]).withColumns({"low": F.round("low", 4), "high": F.round("high", 4)}),
       _IQR.format(c="c_acctbal", t="(SELECT CASE WHEN c_custkey % 20 = 0 THEN c_acctbal * 50 ELSE c_acctbal END AS c_acctbal FROM customer)") + " SELECT 'c_acctbal' AS \"column\", round(min(lo), 4) AS low, round(min(hi), 4) AS high, count(*) FILTER (x < lo OR x > hi) AS n_outliers, round(count(*) FILTER (x < lo OR x > hi) * 100.0::DOUBLE / count(*), 2) AS percent, min(x) AS min, max(x) AS max FROM (SELECT CASE WHEN c_custkey % 20 = 0 THEN c_acctbal * 50 ELSE c_acctbal END AS x FROM customer), f")
_query("outliers_zscore", "events", lambda d: analyze.outliers(d, ["value"], "zscore"),
       _Z.format(c="value", t="events") + " SELECT 'value' AS \"column\", NULL::DOUBLE AS low, NULL::DOUBLE AS high, count(*) FILTER (value < lo OR value > hi) AS n_outliers, round(count(*) FILTER (value < lo OR value > hi) * 100.0::DOUBLE / count(*), 2) AS percent, min(value) AS min, max(value) AS max FROM events, f")
_query("corr_pearson", "lineitem", lambda d: analyze.corr(d, ["l_quantity", "l_extendedprice", "l_discount"]),
       "WITH c AS (SELECT round(corr(l_quantity, l_extendedprice), 4) AS ab, round(corr(l_quantity, l_discount), 4) AS ac, round(corr(l_extendedprice, l_discount), 4) AS bc FROM lineitem) SELECT 'l_quantity' AS \"column\", 1.0::DOUBLE AS l_quantity, ab AS l_extendedprice, ac AS l_discount FROM c UNION ALL SELECT 'l_extendedprice', ab, 1.0, bc FROM c UNION ALL SELECT 'l_discount', ac, bc, 1.0 FROM c")
_query("corr_spearman", "customer", lambda d: analyze.corr(d, ["c_acctbal", "c_nationkey"], "spearman"),
       "WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS a, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS b FROM customer), c AS (SELECT round(corr(a, b), 4) AS v FROM r) SELECT 'c_acctbal' AS \"column\", 1.0::DOUBLE AS c_acctbal, v AS c_nationkey FROM c UNION ALL SELECT 'c_nationkey', v, 1.0 FROM c")
_WIDE = {f"{c}_{v}": how.format(c=c, k=k + 2) for k, c in enumerate(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")) for v, how in (("all", "{c}"), ("some", "CASE WHEN l_orderkey % {k} > 0 THEN {c} END"), ("times", "{c} * l_linenumber"))}
_query("corr_matrix", "lineitem", lambda d: analyze.corr(d.selectExpr(*[f"{x} AS {c}" for c, x in _WIDE.items()]), list(_WIDE)).unpivot("column", list(_WIDE), "other", "r"),
       f"WITH t AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _WIDE.items())} FROM lineitem) " + " UNION ALL ".join(f"""SELECT '{a}' AS "column", '{b}' AS other, {f'round(corr({a}, {b}), 4)' if a != b else '1.0::DOUBLE'} AS r FROM {'t' if a != b else '(SELECT 1)'}""" for a in _WIDE for b in _WIDE))
_RANKED = {"p_partkey": "p_partkey", "p_size": "p_size", "price": "CASE WHEN p_partkey % 5 > 0 THEN p_retailprice END", "size_too": "CASE WHEN p_partkey % 5 > 0 THEN -p_size END", "other": "CASE WHEN p_partkey % 3 > 0 THEN p_retailprice + p_size END"}
_query("corr_spearman_matrix", "part", lambda d: analyze.corr(d.selectExpr(*[f"{x} AS {c}" for c, x in _RANKED.items()]), list(_RANKED), "spearman").unpivot("column", list(_RANKED), "other", "r"),
       f"WITH t AS (SELECT {', '.join(f'{x} AS {c}' for c, x in _RANKED.items())} FROM part) " + " UNION ALL ".join(f"""SELECT '{a}' AS "column", '{b}' AS other, round(corr(x, y), 4) AS r FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" if a != b else f"""SELECT '{a}' AS "column", '{a}' AS other, 1.0::DOUBLE AS r""" for a in _RANKED for b in _RANKED))
_query("corr_kendall", "supplier", lambda d: analyze.corr(d, ["s_acctbal", "s_nationkey"], "kendall"),
       "WITH p AS (SELECT sign(a.s_acctbal - b.s_acctbal) AS x, sign(a.s_nationkey - b.s_nationkey) AS y FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey), c AS (SELECT round(sum(x * y) / sqrt(sum(x * x)::DOUBLE * sum(y * y)), 4) AS v FROM p) SELECT 's_acctbal' AS \"column\", 1.0::DOUBLE AS s_acctbal, v AS s_nationkey FROM c UNION ALL SELECT 's_nationkey', v, 1.0 FROM c")
for _freq, _unit, _step in (("D", "day", "1 day"), ("M", "month", "1 month"), ("Q", "quarter", "3 months"), ("Y", "year", "1 year")):
    _query(f"trend_{_freq}", "orders", lambda d, f=_freq: analyze.trend(d, "o_orderdate", "o_totalprice", f, "sum").withColumn("value", F.round("value", 2)),
           f"WITH s AS (SELECT date_trunc('{_unit}', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT g.p AS period, round(coalesce(v, 0), 2) AS value FROM (SELECT unnest(generate_series((SELECT min(period) FROM s), (SELECT max(period) FROM s), INTERVAL '{_step}')) AS p) g LEFT JOIN s ON s.period = g.p")
_query("trend_W_mean", "orders", lambda d: analyze.trend(d, "o_orderdate", "o_totalprice", "W", "mean").select("period", F.round("value", 1).alias("value")),
       "SELECT (date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::TIMESTAMP AS period, round(round(avg(o_totalprice), 4), 1) AS value FROM orders GROUP BY 1")
_query("kpi_sum", "orders", lambda d: analyze.kpi(d, "sum", "o_totalprice", "o_orderdate").select(F.round("value", 2).alias("value"), F.round("previous", 2).alias("previous"), "delta_percent"),
       "WITH b AS (SELECT max(o_orderdate::DATE) AS hi, (date_diff('day', min(o_orderdate::DATE), max(o_orderdate::DATE)) + 1) // 2 AS half FROM orders), v AS (SELECT sum(o_totalprice) FILTER (o_orderdate::DATE > hi - half::INTEGER) AS a, sum(o_totalprice) FILTER (o_orderdate::DATE <= hi - half::INTEGER AND o_orderdate::DATE > hi - (2 * half)::INTEGER) AS p FROM orders, b) SELECT round(a, 2) AS value, round(p, 2) AS previous, round((a - p) * 100 / abs(p), 1) AS delta_percent FROM v")
_query("kpi_count", "events", lambda d: analyze.kpi(d, "count", "value").select("value"), "SELECT count(value)::DOUBLE AS value FROM events")
_STEPS = ["view", "click", "signup", "purchase"]
_FUNNEL = "WITH s AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click'), (2, 'signup'), (3, 'purchase')) t(i, step)), n AS (SELECT event_type, {n} AS n FROM events GROUP BY 1), j AS (SELECT i, step, coalesce(n, 0) AS n FROM s LEFT JOIN n ON step = event_type) SELECT step, n, round(n * 100.0::DOUBLE / lag(n) OVER (ORDER BY i), 1) AS conversion FROM j"
_query("funnel_users", "events", lambda d: analyze.funnel(d, column="event_type", steps=_STEPS, user_column="user_id"), _FUNNEL.format(n="count(DISTINCT user_id)"))
_query("funnel_rows", "events", lambda d: analyze.funnel(d, column="event_type", steps=_STEPS), _FUNNEL.format(n="count(*)"))
_query("funnel_columns", "orders", lambda d: analyze.funnel(d.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("paid")), "columns", columns=["o_orderkey", "paid"]),
       "SELECT 'o_orderkey' AS step, count(*) AS n, NULL::DOUBLE AS conversion FROM orders UNION ALL SELECT 'paid', count(*) FILTER (o_orderkey % 3 = 0), round(count(*) FILTER (o_orderkey % 3 = 0) * 100.0::DOUBLE / count(*), 1) FROM orders")
_query("crosstab", "lineitem", lambda d: analyze.crosstab(d, "l_returnflag", "l_linestatus"),
       "SELECT l_returnflag AS row, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
_query(
    "profile",
    "customer",
    lambda d: analyze.profile(d, ["c_acctbal", "c_mktsegment"]).select("column", "kind", "count", "missing", "missing_percent", "nunique", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p25", "median", "p75")], F.to_json("top_values").alias("top_values")),
    "SELECT 'c_acctbal' AS \"column\", 'numeric' AS kind, count(c_acctbal) AS count, count(*) - count(c_acctbal) AS missing, 0.0::DOUBLE AS missing_percent, count(DISTINCT c_acctbal) AS nunique, min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, round(quantile_cont(c_acctbal, 0.25), 6) AS p25, round(quantile_cont(c_acctbal, 0.5), 6) AS median, round(quantile_cont(c_acctbal, 0.75), 6) AS p75, '[]' AS top_values FROM customer"
    " UNION ALL SELECT 'c_mktsegment', 'text', sum(k)::BIGINT, 0, 0.0, count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, '[' || string_agg('{\"value\":\"' || v || '\",\"count\":' || k || '}', ',' ORDER BY k DESC, v) || ']' FROM (SELECT c_mktsegment AS v, count(*) AS k FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)",
)
_query("profile_dates", "orders", lambda d: analyze.profile(d, ["o_orderdate"]).select("column", "kind", "first", "last", "nunique"), "SELECT 'o_orderdate' AS \"column\", 'datetime' AS kind, min(o_orderdate)::VARCHAR AS first, max(o_orderdate)::VARCHAR AS last, count(DISTINCT o_orderdate) AS nunique FROM orders")
_gaps = lambda d: d.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("p"))
_GAPS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders)"
_query("missing_matrix", "orders", lambda d: analyze.missing_matrix(_gaps(d), ["o_orderkey"], 10).select("bucket", "p"),
       f"WITH r AS (SELECT p, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM {_GAPS}) SELECT CAST(i * 10 // n AS INTEGER) AS bucket, round(avg((p IS NULL)::INTEGER) * 100, 2) AS p FROM r GROUP BY 1")
_query("duplicates", "orders", lambda d: analyze.duplicates(d.select("o_custkey", "o_orderstatus")),
       "WITH g AS (SELECT count(*) AS c FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1) SELECT CAST(sum(c) AS BIGINT) AS duplicate_rows, CAST(sum(c - 1) AS BIGINT) AS extra_rows, count(*) AS groups FROM g")
_query("text_stats", "part", lambda d: analyze.text_stats(d, "p_name"),
       "SELECT CAST(min(length(p_name)) AS INTEGER) AS min_length, CAST(max(length(p_name)) AS INTEGER) AS max_length, avg(length(p_name)) AS mean_length, CAST(sum((trim(p_name) = '')::INTEGER) AS BIGINT) AS blank, CAST(sum((trim(p_name) <> p_name)::INTEGER) AS BIGINT) AS edge_space FROM part")
_query("scatter", "lineitem", lambda d: analyze.scatter(d, "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]),
       "WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS i, greatest(1, count(*) OVER () // 1000) AS k FROM lineitem) SELECT x, y FROM r WHERE i % k = 0")

# cleaning

_OK = ["o_orderkey", "o_totalprice"]
for _name, _o, _v, _where in (("gt", "gt", 200000, "o_totalprice > 200000"), ("ge", "ge", "150000", "o_totalprice >= 150000"), ("lt", "lt", 5000, "o_totalprice < 5000"), ("le", "le", 5000, "o_totalprice <= 5000"), ("between", "between", [1000, 2000], "o_totalprice BETWEEN 1000 AND 2000")):
    _op(f"filter_{_name}", "orders", "filter_rows", {"column": "o_totalprice", "op": _o, "value": _v}, _OK, f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_where}")
for _name, _v, _where in (("eq", "F", "o_orderstatus = 'F'"), ("isin", ["F", "P"], "o_orderstatus IN ('F', 'P')")):
    _op(f"filter_{_name}", "orders", "filter_rows", {"column": "o_orderstatus", "op": _name, "value": _v}, ["o_orderkey"], f"SELECT o_orderkey FROM orders WHERE {_where}")
_op("filter_contains", "part", "filter_rows", {"column": "p_name", "op": "contains", "value": "A"}, ["p_partkey"], "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a')")
_op("filter_startswith", "customer", "filter_rows", {"column": "c_mktsegment", "op": "startswith", "value": "B"}, ["c_custkey"], "SELECT c_custkey FROM customer WHERE starts_with(c_mktsegment, 'B')")
_op("filter_isnull", "orders", "filter_rows", {"column": "p", "op": "isnull"}, ["o_orderkey"], f"SELECT o_orderkey FROM {_GAPS} WHERE p IS NULL", _gaps)
_op("filter_notnull", "orders", "filter_rows", {"column": "p", "op": "notnull"}, ["o_orderkey", "p"], f"SELECT o_orderkey, p FROM {_GAPS} WHERE p IS NOT NULL", _gaps)
_op("drop_duplicates_first", "orders", "drop_duplicates", {"columns": ["o_custkey"], "order_by": ["o_orderkey"]}, ["o_custkey", "o_orderkey"], "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
_query("drop_duplicates_rows", "orders", lambda d: clean.drop_duplicates(d.select("o_custkey", "o_orderstatus")), "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
_op("drop_missing", "orders", "drop_missing", {"columns": ["p"]}, ["o_orderkey", "p"], f"SELECT * FROM {_GAPS} WHERE p IS NOT NULL", _gaps)
_op("fill_constant", "orders", "fill_missing", {"columns": ["p"], "value": 0.5}, ["o_orderkey", "p"], f"SELECT o_orderkey, coalesce(p, 0.5) AS p FROM {_GAPS}", _gaps)
_query("fill_mean", "orders", lambda d: clean.fill_missing(_gaps(d), ["p"], "mean").select("o_orderkey", F.round("p", 4).alias("p")), f"SELECT o_orderkey, round(coalesce(p, avg(p) OVER ()), 4) AS p FROM {_GAPS}")
_op("fill_median", "orders", "fill_missing", {"columns": ["p"], "method": "median"}, ["o_orderkey", "p"], f"SELECT o_orderkey, coalesce(p, (SELECT quantile_cont(p, 0.5) FROM {_GAPS})) AS p FROM {_GAPS}", _gaps)
_status = lambda d: d.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("s"))
_STATUS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS s FROM orders)"
_op("filter_ne", "orders", "filter_rows", {"column": "s", "op": "ne", "value": "1-URGENT"}, ["o_orderkey", "s"], f"SELECT o_orderkey, s FROM {_STATUS} WHERE s IS DISTINCT FROM '1-URGENT'", _status)
_op("fill_mode", "orders", "fill_missing", {"columns": ["s"], "method": "mode"}, ["o_orderkey", "s"], f"SELECT o_orderkey, coalesce(s, (SELECT s FROM {_STATUS} WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS s FROM {_STATUS}", _status)
_op("fill_ffill", "orders", "fill_missing", {"columns": ["p"], "method": "ffill", "order_by": ["o_orderkey"]}, ["o_orderkey", "p"], f"SELECT o_orderkey, last_value(p IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS p FROM {_GAPS}", _gaps)
_op("fill_bfill", "orders", "fill_missing", {"columns": ["p"], "method": "bfill", "order_by": ["o_orderkey"]}, ["o_orderkey", "p"], f"SELECT o_orderkey, first_value(p IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p FROM {_GAPS}", _gaps)
_query("fill_interpolate", "orders", lambda d: clean.fill_missing(_gaps(d), ["p"], "interpolate", order_by=["o_orderkey"]).select("o_orderkey", F.round("p", 4).alias("p")),
       f"WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM {_GAPS}), k AS (SELECT *, last_value(p IGNORE NULLS) OVER b AS p0, first_value(p IGNORE NULLS) OVER f AS p1, last_value(CASE WHEN p IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN p IS NOT NULL THEN i END IGNORE NULLS) OVER f AS i1 FROM r WINDOW b AS (ORDER BY i ROWS UNBOUNDED PRECEDING), f AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT o_orderkey, round(coalesce(p, p0 + (p1 - p0) * (i - i0) / (i1 - i0), p0, p1), 4) AS p FROM k")
_op("rename_columns", "nation", "rename_columns", {"mapping": {"n_name": "country"}}, ["n_nationkey", "country"], "SELECT n_nationkey, n_name AS country FROM nation")
_op("drop_columns", "nation", "drop_columns", {"columns": ["n_name"]}, ["n_nationkey", "n_regionkey"], "SELECT n_nationkey, n_regionkey FROM nation")
_mixed = lambda d: d.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("n/a")).when(F.col("c_custkey") % 3 == 1, F.concat(F.col("c_custkey").cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).alias("x"))
_MIXED = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN c_custkey + 0.5 ELSE c_custkey END::DOUBLE AS x FROM customer"
_op("cast_float", "customer", "cast_type", {"column": "x", "to": "float"}, ["c_custkey", "x"], _MIXED, _mixed)
_op("cast_int", "customer", "cast_type", {"column": "x", "to": "int"}, ["c_custkey", "x"], f"SELECT c_custkey, CAST(round_even(x, 0) AS BIGINT) AS x FROM ({_MIXED})", _mixed)
_op("cast_str", "customer", "cast_type", {"column": "c_nationkey", "to": "str"}, ["c_custkey", "c_nationkey"], "SELECT c_custkey, c_nationkey::VARCHAR AS c_nationkey FROM customer")
_op("cast_datetime", "orders", "cast_type", {"column": "d", "to": "datetime"}, ["o_orderkey", "d"], "SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS d FROM orders", lambda d: d.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy/M/d")).alias("d")))
_spiked = lambda d: d.select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 50 == 0, F.col("l_extendedprice") * 100).otherwise(F.col("l_extendedprice")).alias("x"))
_SPIKED = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 50 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS x FROM lineitem)"
_op("drop_outliers_iqr", "lineitem", "drop_outliers", {"columns": ["x"]}, ["l_orderkey", "l_linenumber", "x"], _IQR.format(c="x", t=_SPIKED) + f" SELECT l_orderkey, l_linenumber, x FROM {_SPIKED}, f WHERE NOT (x < lo OR x > hi)", _spiked)
_op("drop_outliers_zscore", "events", "drop_outliers", {"columns": ["value"], "method": "zscore"}, ["event_id"], _Z.format(c="value", t="events") + " SELECT event_id FROM events, f WHERE NOT (value < lo OR value > hi)")
_query("cap_outliers_iqr", "events", lambda d: clean.cap_outliers(d, ["value"]).select("event_id", F.round("value", 6).alias("value")), _IQR.format(c="value", t="events") + " SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value FROM events, f")
_query("cap_outliers_zscore", "events", lambda d: clean.cap_outliers(d, ["value"], "zscore").select("event_id", F.round("value", 6).alias("value")), _Z.format(c="value", t="events") + " SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value FROM events, f")
_query("bin_equal_width", "part", lambda d: clean.bin_column(d, "p_size", bins=4, labels=["a", "b", "c", "d"], new_column="bin").groupBy("bin").count(),
       "WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT chr(97 + CAST(greatest(0, ceil((p_size - lo) / ((hi - lo) / 4.0)) - 1) AS INTEGER)) AS bin, count(*) AS count FROM part, b GROUP BY 1")
_query("bin_intervals", "part", lambda d: clean.bin_column(d, "p_size", bins=4, new_column="bin").select("p_partkey", "bin"),
       "WITH b AS (SELECT min(p_size)::DOUBLE AS lo, (max(p_size) - min(p_size)) / 4.0::DOUBLE AS w FROM part), n AS (SELECT p_partkey, lo, w, greatest(0, ceil((p_size - lo) / w) - 1)::DOUBLE AS i FROM part, b) SELECT p_partkey, '(' || round(CASE WHEN i = 0 THEN lo - 4 * w * 0.001 ELSE lo + i * w END, 3)::VARCHAR || ', ' || round(lo + (i + 1) * w, 3)::VARCHAR || ']' AS bin FROM n")
# sizes 10 to 20 don't occur, so one bin is empty and labels shift
_query("bin_empty_bin", "part", lambda d: clean.bin_column(d.where("p_size < 10 or p_size > 30"), "p_size", bins=5, labels=["a", "b", "c", "d"], new_column="bin").groupBy("bin").count(),
       "WITH t AS (SELECT p_size FROM part WHERE p_size < 10 OR p_size > 30), b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM t), n AS (SELECT greatest(0, ceil((p_size - lo) / ((hi - lo) / 5.0)) - 1) AS i FROM t, b), o AS (SELECT i, count(*) AS count, row_number() OVER (ORDER BY i) AS r FROM n GROUP BY i) SELECT chr(96 + r::INTEGER) AS bin, count FROM o")
_query("bin_equal_freq", "part", lambda d: clean.bin_column(d, "p_retailprice", "equal_freq", 4, ["a", "b", "c", "d"], "bin").groupBy("bin").count(),
       "WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part) SELECT CASE WHEN p_retailprice <= a THEN 'a' WHEN p_retailprice <= b THEN 'b' WHEN p_retailprice <= c THEN 'c' ELSE 'd' END AS bin, count(*) AS count FROM part, q GROUP BY 1")
_query("one_hot", "orders", lambda d: _hot(clean.one_hot_encode(d, "o_orderstatus", "s", 2)),
       "SELECT o_orderkey, CASE o_orderstatus WHEN a THEN a WHEN b THEN b END AS top FROM orders, (SELECT max(s) FILTER (i = 1) AS a, max(s) FILTER (i = 2) AS b FROM (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS i FROM orders GROUP BY 1))")
_query("standardize_zscore", "customer", lambda d: clean.standardize_column(d, "c_acctbal").select("c_custkey", F.col("c_acctbal_z").alias("z")), "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS z FROM customer")
_query("standardize_minmax", "customer", lambda d: clean.standardize_column(d, "c_acctbal", "minmax").select("c_custkey", F.col("c_acctbal_归一").alias("m")), "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS m FROM customer")
_op("log_transform", "part", "log_transform", {"column": "p_size"}, ["p_partkey", "p_size_log"], "SELECT p_partkey, round(ln(1 + p_size), 6) AS p_size_log FROM part")
_query("date_parts", "orders", lambda d: _renamed(clean.extract_date_parts(d, "o_orderdate", ["year", "month", "day", "quarter", "weekday", "hour"]).select("o_orderkey", *[f"o_orderdate_{p}" for p in ("年", "月", "日", "季度", "星期", "小时")]), "o_orderkey", "y", "m", "d", "q", "w", "h"),
       "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, isodow(o_orderdate) AS w, hour(o_orderdate) AS h FROM orders")
_op("regex_extract", "customer", "regex_extract", {"column": "c_name", "pattern": r"#0*(\d+)", "new_column": "n"}, ["c_custkey", "n"], r"SELECT c_custkey, CASE WHEN regexp_matches(c_name, '#0*(\d+)') THEN regexp_extract(c_name, '#0*(\d+)', 1) END AS n FROM customer")
_spaced = lambda d: d.select("c_custkey", F.concat(F.lit(" \t"), F.col("c_name"), F.lit("  ａ　 ")).alias("t"))
_op("trim_whitespace", "customer", "trim_whitespace", {"columns": ["t"]}, ["c_custkey", "t"], "SELECT c_custkey, c_name || '  ａ' AS t FROM customer", _spaced)
_op("normalize_text", "customer", "normalize_text", {"columns": ["t"]}, ["c_custkey", "t"], "SELECT c_custkey, c_name || ' a' AS t FROM customer", _spaced)
_op("parse_number", "customer", "parse_number", {"column": "t", "new_column": "n"}, ["c_custkey", "n"], "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey + 1000000.5 WHEN 1 THEN c_custkey * 10000 WHEN 2 THEN c_custkey END::DOUBLE AS n FROM customer",
    lambda d: d.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("￥"), F.format_number(F.col("c_custkey") + 1000000.5, 1))).when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_custkey").cast("string"), F.lit("万"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.col("c_custkey").cast("string"), F.lit("%"))).otherwise(F.lit("12,34")).alias("t")))
_op("map_values", "orders", "map_values", {"column": "o_orderstatus", "mapping": {"F": "done", "O": "open"}}, ["o_orderkey", "o_orderstatus"], "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
_op("split_column", "customer", "split_column", {"column": "c_name", "sep": "#", "into": ["a", "b"]}, ["c_custkey", "a", "b"], "SELECT c_custkey, split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b FROM customer")
_query("drop_high_missing_columns", "orders", lambda d: clean.drop_high_missing(d.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, 1).alias("gone")), 0.5), "SELECT o_orderkey FROM orders")
_query("drop_high_missing_rows", "orders", lambda d: clean.drop_high_missing(_gaps(d), 0.4, "row"), f"SELECT * FROM {_GAPS} WHERE p IS NOT NULL")
_op("unify_boolean", "orders", "unify_boolean_text", {"column": "b"}, ["o_orderkey", "b"], "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '是' WHEN 1 THEN '否' ELSE 'maybe' END AS b FROM orders", lambda d: d.select("o_orderkey", F.element_at(F.array(*map(F.lit, (" YES", "no", "maybe"))), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("b")))
_query("page", "customer", lambda d: analyze.page(d, 2, 50, "c_acctbal", "desc", {"c_mktsegment": ["BUILDING"]}, ["c_custkey"])[0].select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 50")
_query("sample_top", "customer", lambda d: analyze.sample(d, "top", 20, order_by=["c_custkey"]).select("c_custkey"), "SELECT c_custkey FROM customer ORDER BY 1 LIMIT 20")
_query("sample_random", "customer", lambda d: analyze.sample(d.select("c_custkey", "c_name"), "random", 50), "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || '|' || c_name || '|42') LIMIT 50")
_query("sample_random_of_many", "orders", lambda d: analyze.sample(d.select("o_orderkey", "o_orderstatus"), "random", 20, seed=7), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey || '|' || o_orderstatus || '|7') LIMIT 20")
_query("sample_stratified", "customer", lambda d: analyze.sample(d.select("c_custkey", "c_nationkey"), "stratified", 10, "c_nationkey"), "SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || '|' || c_nationkey || '|42')) <= 10")

# health check

_query("health_findings", "customer", lambda d: health.findings_frame(d))


def _watched(frame: DataFrame, watched) -> DataFrame:
    """The findings of some rules on some columns."""
    found = health.findings_frame(frame).select("rule", F.coalesce("column", F.lit("")).alias("column"), "count")
    return found.where(F.concat("rule", F.lit(":"), "column").isin([f"{r}:{c}" for r, c, _ in watched]))


def _expected(frame: str, watched) -> str:
    """What these findings should count, each worked out on its own."""
    return f"WITH t AS ({frame}) " + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{c}' AS \"column\", CAST({n} AS BIGINT) AS count FROM t" for r, c, n in watched)


#: Columns with one fault each, in words that both engines read, and what the rules should count.
_FAULTY_TEXT = {
    "edge": "CASE WHEN c_custkey % 10 = 0 THEN concat(' ', c_name) ELSE c_name END",
    "blank": "CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE concat('n', CAST(c_custkey AS STRING)) END",
    "wide": "CASE WHEN c_custkey % 8 = 0 THEN concat('Ａ', c_name) ELSE c_name END",
    "control": "CASE WHEN c_custkey % 7 = 0 THEN concat('a\u200b', c_name) ELSE c_name END",
    "inner": "CASE WHEN c_custkey % 6 = 0 THEN concat('a  b', c_name) ELSE c_name END",
    "plain": "CAST(c_custkey AS STRING)",
    "mixed": "CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE concat('item ', CAST(c_custkey AS STRING)) END",
    "money": "concat('¥', CAST(c_custkey AS STRING))",
    "day": "concat('2024-01-', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'))",
    "days": "concat(CASE WHEN c_custkey % 2 = 0 THEN '2024-01-' ELSE '2024/01/' END, lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0'))",
    "truth": "CASE c_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '是' END",
    "city": "CASE c_custkey % 5 WHEN 0 THEN 'Beijing' WHEN 1 THEN 'beijing ' WHEN 2 THEN 'Shanghai' WHEN 3 THEN 'SHANGHAI' ELSE 'Wuhan' END",
    "one": "CASE WHEN c_custkey % 4 < 3 THEN 'a' ELSE concat('b', CAST(c_custkey % 7 AS STRING)) END",
    "mail": "CASE WHEN c_custkey % 20 = 0 THEN 'broken' ELSE concat('u', CAST(c_custkey AS STRING), '@example.org') END",
    "length": "CASE WHEN c_custkey % 50 = 0 THEN repeat('x', 60) ELSE 'abcdef' END",
    "ident": "concat('ID', CAST(CASE WHEN c_custkey % 40 = 1 THEN c_custkey - 1 ELSE c_custkey END AS STRING))",
    "same": "'x'",
    "none": "CAST(NULL AS STRING)",
}
_TEXT_RULES = (
    ("H11", "edge", "count(*) FILTER (edge <> trim(edge))"),
    ("H12", "blank", "count(*) FILTER (trim(blank) = '')"),
    ("H13", "wide", "count(*) FILTER (contains(wide, 'Ａ'))"),
    ("H14", "control", "count(*) FILTER (contains(control, '\u200b'))"),
    ("H15", "inner", "count(*) FILTER (contains(\"inner\", '  '))"),
    ("H16", "plain", "count(TRY_CAST(plain AS DOUBLE))"),
    ("H17", "mixed", "count(TRY_CAST(mixed AS DOUBLE))"),
    ("H18", "money", "count(*) FILTER (money LIKE '¥%')"),
    ("H19", "day", "count(TRY_CAST(day AS DATE))"),
    ("H20", "days", "count(DISTINCT substr(days, 5, 1))"),
    ("H27", "truth", "count(*) FILTER (lower(truth) IN ('yes', 'no', '是'))"),
    ("H28", "city", "max((SELECT count(*) FROM (SELECT lower(trim(city)) FROM t GROUP BY 1 HAVING count(DISTINCT city) > 1)))"),
    ("H29", "one", "count(*) FILTER (one = 'a')"),
    ("H32", "mail", "count(*) FILTER (NOT regexp_full_match(mail, '[a-z0-9]+@[a-z]+\\.org'))"),
    ("H33", "length", "count(*) FILTER (length(length) > 18)"),
    ("H6", "ident", "count(DISTINCT ident)"),
    ("H7", "ident", "count(ident) - count(DISTINCT ident)"),
    ("H5", "same", "max(0)"),
    ("H4", "none", "count(*)"),
    ("H9", "", "max(1)"),
)
_query("health_text_rules", "customer", lambda d: _watched(d.select(*[F.expr(x).alias(c) for c, x in _FAULTY_TEXT.items()]), _TEXT_RULES),
       _expected("SELECT " + ", ".join(f'{x} AS "{c}"' for c, x in _FAULTY_TEXT.items()) + " FROM customer", _TEXT_RULES))

_FAULTY_NUMBERS = {
    "x": "l_quantity",
    "y": "CAST(l_partkey % 97 + 1 AS DOUBLE)",
    "z": "l_quantity * (l_partkey % 97 + 1) + CASE WHEN l_orderkey % 101 = 0 THEN 5000 ELSE 0 END",
    "neg": "CASE WHEN l_orderkey % 50 = 0 THEN -1 ELSE l_suppkey % 50 + 1 END",
    "zero": "CASE WHEN l_orderkey % 3 = 0 THEN 5 ELSE 0 END",
    "far_out": "CASE WHEN l_orderkey % 10 = 0 THEN 1000000 + l_partkey ELSE l_partkey % 43 + 1 END",
    "skewed": "CASE WHEN l_orderkey % 100 = 0 THEN 1000 ELSE l_linenumber END",
    "finer": "CASE WHEN l_orderkey % 40 = 0 THEN l_linenumber + 0.123 ELSE l_suppkey % 61 END",
    "scale": "CASE WHEN l_orderkey % 100 = 0 THEN 1000000000 ELSE l_partkey % 37 + 1 END",
    "gap": "CASE WHEN l_orderkey % 5 < 2 THEN NULL ELSE l_suppkey % 17 END",
}
_NUMBER_RULES = (
    ("H30", "z", "count(*) FILTER (abs(x * y - z) > 0.01 * abs(z))"),
    ("H25", "neg", "count(*) FILTER (neg < 0)"),
    ("H26", "zero", "count(*) FILTER (zero = 0)"),
    ("H23", "far_out", "count(*) FILTER (far_out > 1000)"),
    ("H24", "skewed", "max(0)"),
    ("H34", "finer", "count(*) FILTER (finer <> floor(finer))"),
    ("H35", "scale", "count(*) FILTER (scale > 1000000)"),
    ("H10", "", "max(1)"),
)
_query("health_number_rules", "lineitem", lambda d: _watched(d.select(*[F.expr(x).cast("double").alias(c) for c, x in _FAULTY_NUMBERS.items()]), _NUMBER_RULES),
       _expected("SELECT " + ", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in _FAULTY_NUMBERS.items()) + " FROM lineitem", _NUMBER_RULES))

_SECOND = "CASE WHEN o_orderkey % 20 = 1 THEN o_orderkey - 1 ELSE o_orderkey END"
_TIME_RULES = (
    ("H21", "late", "count(*) FILTER (o_orderkey % 100 = 0)"),
    ("H22", "early", "count(*) FILTER (o_orderkey % 200 = 1)"),
    ("H36", "stamp", "count(*) FILTER (o_orderkey % 20 = 1)"),
    ("H31", "id", "count(*) FILTER (o_orderkey % 20 = 1)"),
)
_query(
    "health_time_rules",
    "orders",
    lambda d: _watched(
        d.select(
            F.when(F.col("o_orderkey") % 100 == 0, F.expr("timestamp_ntz'2999-01-01'")).otherwise(F.col("o_orderdate")).alias("late"),
            F.when(F.col("o_orderkey") % 200 == 1, F.expr("timestamp_ntz'1850-01-01'")).otherwise(F.col("o_orderdate")).alias("early"),
            F.timestamp_seconds(F.expr(_SECOND) + 1700000000).cast("timestamp_ntz").alias("stamp"),
            F.concat(F.lit("O"), F.expr(_SECOND).cast("string")).alias("id"),
            (F.col("o_orderkey") % 5).cast("string").alias("depends"),
        ),
        _TIME_RULES,
    ),
    _expected("SELECT o_orderkey FROM orders", _TIME_RULES),
)
_query("health_duplicates", "orders", lambda d: health.findings_frame(d.select("o_custkey", "o_orderstatus")).where("rule = 'H1'").select("rule", "count"),
       "SELECT 'H1' AS rule, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) AS count FROM orders")
_query("health_missing", "orders", lambda d: health.findings_frame(_gaps(d)).where("rule = 'H8'").select("rule", "count"), f"SELECT 'H8' AS rule, count(*) FILTER (p IS NULL) AS count FROM {_GAPS}")
_query("health_dates", "orders", lambda d: health.findings_frame(d.where("month(o_orderdate) = 1 and year(o_orderdate) in (1995, 1998)").select("o_orderdate")).where("rule = 'H37'").select("rule", "count"),
       "SELECT 'H37' AS rule, date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 - count(DISTINCT o_orderdate::DATE) AS count FROM orders WHERE month(o_orderdate) = 1 AND year(o_orderdate) IN (1995, 1998) HAVING count(*) >= 30")
_query("health_trend", "orders", lambda d: health.trend_frame(d.select("o_orderdate", "o_totalprice")))

# SQL console: joins, windows, set operations, grouping sets

_sql("sql_join_inner", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("sql_join_left", "SELECT s_suppkey, count(l_orderkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 45 GROUP BY s_suppkey")
_sql("sql_join_full", "SELECT coalesce(a.k, b.k) AS k, a.x, b.y FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier GROUP BY 1) b ON a.k = b.k")
_sql("sql_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_sql("sql_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_sql("sql_join_right", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name")
_sql("sql_lateral", "SELECT r_name, x.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) x")
_sql("sql_range_join", "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey >= r_regionkey GROUP BY r_name")
_sql("sql_correlated", "SELECT s_suppkey, (SELECT max(l_quantity) FROM lineitem WHERE l_suppkey = s_suppkey) AS q FROM supplier")
_sql("sql_windows", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, lag(o_orderkey) OVER w AS lg, lead(o_orderkey) OVER w AS ld FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None)
_sql("sql_frames", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS k, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders")
_sql("sql_distributions", "SELECT o_orderkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice)")
_sql("sql_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 5000 PRECEDING AND CURRENT ROW) AS k FROM orders")
_sql("sql_set_operations_all", "(SELECT c_nationkey AS k FROM customer WHERE c_custkey < 300 EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)")
_sql("sql_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events", ("events",))
_sql("sql_arrays", "SELECT vec_id, size(embedding) AS n, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + x * x), 4) AS norm, embedding[0] AS head FROM embeddings", "SELECT vec_id, len(embedding)::INTEGER AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) AS norm, embedding[1] AS head FROM embeddings", ("embeddings",))
_sql("sql_maps", "SELECT o_orderstatus, map_from_entries(collect_list(struct(o_orderpriority, n)))['1-URGENT'] AS urgent FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")
_sql("sql_set_operations", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
_sql("sql_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("sql_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("sql_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
_sql("sql_cte_filter", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) AS n FROM big GROUP BY o_orderstatus")
# days on which a chain of orders goes on: each step is the next day that has an order
_sql("sql_recursive", "WITH RECURSIVE days AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS d FROM orders), chain(d, step) AS (SELECT min(d), 0 FROM days UNION ALL SELECT days.d, step + 1 FROM chain JOIN days ON days.d = chain.d + INTERVAL '1' DAY WHERE step < 12) SELECT step, CAST(extract(YEAR FROM d) * 10000 + extract(MONTH FROM d) * 100 + extract(DAY FROM d) AS BIGINT) AS d FROM chain")


# analysts' forms: the text is its own oracle
_sql("sql_dialect_cast", """SELECT CAST(CAST("c_custkey" AS BIGINT) AS VARCHAR) AS "c_custkey", c_name, round(c_acctbal * 2, 2) AS twice FROM customer WHERE c_custkey IS NOT NULL AND c_acctbal > 0 AND c_name NOT LIKE 'C%1'""")
_sql("sql_dialect_qualify", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
_sql("sql_dialect_qualify_name", "WITH ranked AS (SELECT n_regionkey, n_name, rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS place FROM nation QUALIFY place = 1) SELECT r_name, n_name FROM ranked JOIN region ON r_regionkey = n_regionkey")
_sql("sql_dialect_exclude", "SELECT * EXCLUDE (p_name, p_type) FROM part WHERE p_size // 10 = 2")
_sql("sql_dialect_lists", "SELECT p_partkey, unnest(list_filter([p_size, p_partkey % 7, 3], lambda v: v > 4)) AS v FROM part WHERE list_contains([1, 5, 9], p_size)")
_sql("sql_dialect_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 6) AS q, arg_max(l_orderkey, l_extendedprice * 1000000 + l_linenumber) AS top FROM lineitem GROUP BY ALL")
_sql("sql_dialect_dates", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(date_diff('month', o_orderdate, TIMESTAMP '1999-01-15 00:00:00'))::BIGINT AS months FROM orders GROUP BY 1")
_sql("sql_dialect_from_first", "FROM region")
_sql("sql_dialect_texts", "SELECT c_custkey, regexp_extract(c_name, '[0-9]+') AS digits, strpos(c_name, '#') AS at, starts_with(c_mktsegment, 'B') AS b FROM customer")


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    clicks, views = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return joins.asof_join(clicks, views, "ts", ["user_id"], ["view_id"]).select("event_id", "view_id")


QUERIES["asof_join"] = _asof
ORACLES["asof_join"] = "WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT p.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose price lies in the band of a small part, 10 to 10.01 times its retail price."""
    bands = _table(spark, sf_dir, "part").where("p_size <= 5").selectExpr("p_partkey", "p_retailprice * 10 AS low", "p_retailprice * 10.01 AS high")
    return joins.range_join(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), bands, "l_extendedprice", "low", "high").select("l_orderkey", "l_linenumber", "p_partkey")


def _range_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user within two days before each of their purchases."""
    events = _table(spark, sf_dir, "events")
    spans = events.where("event_type = 'purchase'").selectExpr("user_id", "event_id AS purchase_id", "ts - INTERVAL 2 DAYS AS since", "ts AS until")
    return joins.range_join(events.select("user_id", "event_id", "ts"), spans, "ts", "since", "until", ["user_id"], "left").select("purchase_id", "event_id")


QUERIES["range_join"], QUERIES["range_join_by"] = _range, _range_by
ORACLES["range_join"] = "SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON p_size <= 5 AND l_extendedprice BETWEEN p_retailprice * 10 AND p_retailprice * 10.01::DOUBLE"
ORACLES["range_join_by"] = "SELECT p.event_id AS purchase_id, e.event_id FROM events e JOIN events p ON p.event_type = 'purchase' AND e.user_id = p.user_id AND e.ts >= p.ts - INTERVAL 2 DAYS AND e.ts < p.ts"


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as text whose values hold quotes, separators and line breaks, ingested again, and summed up."""
    path = f"{shared_dir(spark).rstrip('/')}/ingested-{uuid.uuid4().hex}"
    note = F.concat(F.lit('"'), F.col("l_returnflag"), F.lit('",\n'), F.col("l_linestatus"), F.lit("\n"))
    text = _table(spark, sf_dir, "lineitem").select("l_orderkey", note.alias("note"), "l_extendedprice", F.when(F.col("l_linenumber") > 2, F.col("l_shipdate").cast("date")).alias("day"))
    text.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/text")
    rows = readers.ingest_csv(spark, f"{path}/text", f"{path}/table")
    return rows.groupBy("note").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count("day").alias("days"), F.date_format(F.max("day"), "yyyyMMdd").cast("long").alias("last"))


QUERIES["ingest_quoted_text"] = _ingested
ORACLES["ingest_quoted_text"] = """
    SELECT '"' || l_returnflag || '",' || chr(10) || l_linestatus || chr(10) AS note, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS orders, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
           count(*) FILTER (l_linenumber > 2) AS days, CAST(strftime(max(l_shipdate) FILTER (l_linenumber > 2), '%Y%m%d') AS BIGINT) AS last
    FROM lineitem GROUP BY 1"""
