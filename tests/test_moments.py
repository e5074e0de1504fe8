"""Correlation matrices of many columns against numpy and pandas, pair by pair."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemill.operators import analyze, health, moments


def frame(rng, n, width):
    data = rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) + rng.uniform(-1e6, 1e6, width)
    data[rng.random((n, width)) < 0.2] = np.nan
    data[:, 0] = np.arange(n)
    data[:, 1] = 7.25  # constant
    data[:, 2] = np.where(np.arange(n) % 2, 3.0, np.arange(n))
    data[:, 3] = np.where(np.arange(n) % 2, data[:, 3], np.nan)  # column 2 is constant where this is
    data[:, 4] = np.nan
    return pd.DataFrame(data, columns=[f"c{i}" for i in range(width)])


def test_matrix_against_pairs(spark, monkeypatch):
    monkeypatch.setattr(moments, "BLOCK", 5)
    monkeypatch.setattr(moments, "BLOCKS_AT_ONCE", 4)
    table = frame(np.random.default_rng(1), 400, 17)
    got = moments.co_moments(spark.createDataFrame(table).repartition(6))
    r = got.correlations()
    for i, a in enumerate(table):
        for j, b in enumerate(table):
            both = table[[a, b]].dropna() if a != b else table[[a]].dropna()
            assert got.n[i, j] == len(both)
            if not len(both):
                continue
            assert got.mean[i, j] == pytest.approx(both[a].mean(), rel=1e-12, abs=1e-9)
            if both[a].nunique() > 1 and both[b].nunique() > 1:
                assert r[i, j] == pytest.approx(np.corrcoef(both[a], both[b])[0, 1], abs=1e-9)
            else:
                assert math.isnan(r[i, j])


def test_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(2)
    table = frame(rng, 300, 500)
    got = moments.pearson_matrix(spark.createDataFrame(table).repartition(4), list(table))
    want = table.corr().to_numpy()
    known = ~np.isnan(got)
    known[[1, 2, 4]] = known[:, [1, 2, 4]] = False  # pandas has rounding where a column is constant
    assert known.sum() > 490**2 and np.allclose(got[known], want[known], atol=1e-9)


def test_infinite_values_spoil_their_own_pairs_only(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 5.0), (math.inf, None, 2.0), (4.0, 5.0, 3.0), (0.5, 7.0, 1.0)]
    r = moments.pearson_matrix(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert math.isnan(r[0, 2]) and math.isnan(r[0, 0]) and not math.isnan(r[0, 1]) and not math.isnan(r[1, 2])
    assert r[0, 1] == pytest.approx(np.corrcoef([1, 2, 4, 0.5], [2, 1, 5, 7])[0, 1])


def test_ranks_of_columns_that_miss_rows(spark):
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"a": rng.integers(0, 9, 300).astype(float), "b": rng.normal(size=300), "c": rng.integers(0, 40, 300).astype(float), "d": np.r_[np.zeros(150), -np.zeros(150)]})
    table["e"] = table["b"] ** 3 + table["c"]
    table.loc[::4, "c"] = np.nan
    got = analyze.corr(spark.createDataFrame(table).repartition(5), list(table), "spearman").toPandas().set_index("column")
    want = table.corr("spearman").round(4)
    for a in table:
        for b in table:
            if "d" not in (a, b):
                assert got.loc[a, b] == pytest.approx(want.loc[a, b], abs=1.5e-4)
            elif a != b:
                assert math.isnan(got.loc[a, b])


def test_no_rows(spark):
    none = spark.createDataFrame([], ", ".join(f"c{i} double" for i in range(12)))
    assert {v for r in analyze.corr(none).drop("column").collect() for v in r} == {1.0, None}


def test_health_check_of_many_numbers(spark):
    rng = np.random.default_rng(4)
    table = pd.DataFrame(rng.normal(size=(200, 14)), columns=[f"n{i}" for i in range(14)])
    table["n13"] = 2 * table["n0"] + 0.01 * table["n1"]
    found = health.health_check(spark.createDataFrame(table))["strong_correlations"]
    assert [(a, b) for a, b, _ in found] == [("n0", "n13")] and found[0][2] == round(table.corr().loc["n0", "n13"], 3)
