"""Medians and distinct counts of groups, and quantiles of large columns, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import stats
from tidemill.operators import analyze


def table(rng, n=3000):
    out = pd.DataFrame({"k": rng.choice(["a", "b", "c", None], n, p=[0.6, 0.3, 0.06, 0.04]), "j": rng.integers(0, 2, n), "x": rng.normal(size=n), "y": rng.integers(0, 5, n).astype(float), "t": rng.choice(list("pqrs"), n)})
    out.loc[out.k == "b", "x"] = 2.5  # one value only
    out.loc[rng.random(n) < 0.1, "x"] = np.nan
    out.loc[::7, "y"] = -0.0
    out.loc[out.k == "c", "y"] = np.nan
    return out


METRICS = [{"column": c, "agg": a} for c, a in (("x", "median"), ("y", "median"), ("x", "nunique"), ("y", "nunique"), ("t", "nunique"), ("x", "count"), ("x", "median"))]


@pytest.mark.parametrize("exact, groups", [(10**6, 2000), (40, 2000), (40, 1), (0, 2000)])
def test_groups(spark, monkeypatch, exact, groups):
    monkeypatch.setattr(stats, "EXACT_ROWS", exact)
    monkeypatch.setattr(stats, "BRACKETS", 1000)
    monkeypatch.setattr(analyze, "GROUPS", groups)
    monkeypatch.setattr(analyze, "GRID", 20)
    rows = table(np.random.default_rng(5))
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "k string, j long, x double, y double, t string").repartition(5)
    got = analyze.groupby(df, ["k", "j"], METRICS).collect()
    want = rows.assign(k=rows.k.fillna("none")).groupby(["k", "j"])
    assert [(r[0], r[1]) for r in got] == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0), ("c", 1), (None, 0), (None, 1)]
    for r in got:
        part = want.get_group((r[0] or "none", r[1]))
        for value, m in zip(r[2:], METRICS):
            expected = getattr(part[m["column"]], m["agg"])()
            assert value is None if expected != expected else value == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("exact", [5, 60, 2000])
def test_quantiles_by_brackets(spark, monkeypatch, exact):
    monkeypatch.setattr(stats, "EXACT_ROWS", exact)
    monkeypatch.setattr(stats, "BRACKETS", 100)
    rng = np.random.default_rng(exact)
    rows = pd.DataFrame({"a": rng.normal(size=1500), "b": rng.integers(0, 3, 1500).astype(float), "c": np.full(1500, 4.0), "d": np.r_[np.zeros(1499), 1e9], "e": np.nan})
    df = spark.createDataFrame(rows).repartition(4)
    got = stats.quantiles(df, {c: stats.number(df, c) for c in rows}, [0.0, 0.25, 0.5, 0.9995, 1.0])
    for c in "abcd":
        assert got[c] == pytest.approx(rows[c].quantile([0.0, 0.25, 0.5, 0.9995, 1.0]).tolist(), abs=1e-9)
    assert got["e"] is None


def test_zero_has_one_sign(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (1.0, "a"), (float("nan"), "a"), (None, "a")], "x double, k string")
    assert analyze.groupby(df, "k", [{"column": "x", "agg": "nunique"}]).first()[1] == 2
    assert analyze.profile(df, ["x"]).first()["nunique"] == 2


def test_values_are_not_expanded(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id % 7 as a", "id % 5 as b")
    plan = analyze.groupby(df, "k", [{"column": c, "agg": "nunique"} for c in "ab"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_quantiles_are_exact_though_brackets_come_from_some_values(spark, monkeypatch):
    monkeypatch.setattr(stats, "EXACT_ROWS", 100)
    monkeypatch.setattr(stats, "BRACKETS", 100)
    monkeypatch.setattr(stats, "SKETCHED", 300)
    rng = np.random.default_rng(8)
    rows = [(float(x), float(i % 7), 1e9 if i % 50 == 0 else float(i)) for i, x in enumerate(rng.normal(size=6000))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = stats.quantiles(df, {c: F.col(c) for c in "abc"}, [0.0, 0.25, 0.5, 0.75, 1.0])
    for c, values in zip("abc", zip(*rows)):
        assert got[c] == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.75, 1]), rel=1e-12)
