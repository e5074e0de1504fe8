"""The range join against all pairs."""

import datetime as dt
import math

import numpy as np
import pytest

from tidemill.errors import InputError
from tidemill.operators import joins


@pytest.mark.parametrize("closed, piece", [("both", 1 << 30), ("both", 25), ("left", 25), ("right", 25), ("neither", 25)])
def test_numbers(spark, monkeypatch, closed, piece):
    monkeypatch.setattr(joins, "POINTS_PER_BIN", 40)
    monkeypatch.setattr(joins, "PIECE", piece)
    monkeypatch.setattr(joins, "SHARE", 10)
    monkeypatch.setattr(joins, "PAIRS", 50)
    rng = np.random.default_rng(6)
    points = [(i, float(x), int(rng.integers(0, 2))) for i, x in enumerate(np.r_[rng.integers(0, 60, 200), np.full(120, 30)])] + [(900, None, 0), (901, math.nan, 1), (902, math.inf, 1), (903, 5.0, None)]
    spans = [(i, float(a), float(a + w), int(rng.integers(0, 2))) for i, (a, w) in enumerate(zip(rng.integers(0, 60, 90), rng.integers(-2, 9, 90)))] + [(500, -1e9, 1e9, 1), (501, None, 4.0, 0), (502, 30.0, 30.0, 0), (503, 0.0, math.inf, 1), (504, 0.0, 9.0, None)]
    inside = {"both": lambda a, x, b: a <= x <= b, "left": lambda a, x, b: a <= x < b, "right": lambda a, x, b: a < x <= b, "neither": lambda a, x, b: a < x < b}[closed]
    p, s = spark.createDataFrame(points, "pid int, x double, k int").repartition(5), spark.createDataFrame(spans, "sid int, a double, b double, k int").repartition(3)
    known = [(i, x, k) for i, x, k in points if x is not None and not math.isnan(x)]
    for by in ([], ["k"]):
        want = sorted((i, j) for i, x, k in known for j, a, b, g in spans if a is not None and a <= b and inside(a, x, b) and (not by or k == g and k is not None))
        got = joins.range_join(p if by else p.drop("k"), s, "x", "a", "b", by, closed)
        assert sorted((r["pid"], r["sid"]) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_hot_bin_is_spread(spark, monkeypatch):
    monkeypatch.setattr(joins, "PIECE", 100)
    monkeypatch.setattr(joins, "SHARE", 10)
    points = spark.range(2000).selectExpr("id", "cast(if(id % 2 = 0, 7, id) as double) as x")
    spans = spark.createDataFrame([(7.0, 7.0, "seven"), (0.0, 10.0, "low")], "a double, b double, name string")
    assert joins._pieces(points.selectExpr("0L as h", "cast(x as int) as bin"), "n").collect()[0]["n"] == 6
    got = joins.range_join(points, spans, "x", "a", "b").groupBy("name").count().collect()
    assert dict(map(tuple, got)) == {"seven": 1001, "low": 1005}


def test_intervals_of_many_keys_go_to_few_bins(spark, monkeypatch):
    # a wide interval holds most of the axis, yet few points of its own key
    monkeypatch.setattr(joins, "POINTS_PER_BIN", 10)
    sent = []
    counted = joins._pieces
    monkeypatch.setattr(joins, "_pieces", lambda rows, name: (sent.append(rows.count()), counted(rows, name))[1])
    points = spark.range(6000).selectExpr("id % 200 as k", "id as pid", "cast(id as double) as x")
    spans = spark.range(200).selectExpr("id as k", "id as sid", "500d as a", "5500d as b")
    got = joins.range_join(points, spans, "x", "a", "b", ["k"]).groupBy("k").count().collect()
    assert sent[0] == 6000 and sent[1] <= 2000 and len(got) == 200 and sum(r["count"] for r in got) == 5001


def test_places_among_pairs():
    rng = np.random.default_rng(3)
    pairs = sorted(zip(rng.integers(-3, 4, 60).tolist(), rng.integers(0, 9, 60).astype(float).tolist()))
    asked = [(k, v) for k in range(-5, 6) for v in (-1.0, 0.0, 2.5, 4.0, 8.0, 9.0, math.inf)]
    for some in (pairs, pairs[:1], []):
        h, x, k, v = (np.array(c) for c in (*(zip(*some) if some else ((), ())), *zip(*asked)))
        for side, before in (("left", lambda p, q: p < q), ("right", lambda p, q: p <= q)):
            assert joins._places(h, x, k, v, side).tolist() == [sum(before(p, q) for p in some) for q in asked]


def test_days_and_times(spark):
    days = [(i, dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(40)]
    spans = [("jan", dt.date(2024, 1, 10), dt.date(2024, 1, 12)), ("none", dt.date(2025, 1, 1), dt.date(2025, 2, 1)), ("back", dt.date(2024, 1, 12), dt.date(2024, 1, 10))]
    got = joins.range_join(spark.createDataFrame(days, "i int, d date"), spark.createDataFrame(spans, "name string, since date, until date"), "d", "since", "until")
    assert sorted((r["i"], r["name"]) for r in got.collect()) == [(9, "jan"), (10, "jan"), (11, "jan")]
    # whole numbers that a double can't tell apart
    big = spark.createDataFrame([(2**60,), (2**60 + 1,)], "x long")
    one = spark.createDataFrame([(2**60 + 1, 2**60 + 1)], "a long, b long")
    assert [tuple(r) for r in joins.range_join(big, one, "x", "a", "b").collect()] == [(2**60 + 1,) * 3]


def test_nothing_and_wrong_columns(spark):
    none = spark.createDataFrame([], "x double")
    spans = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert joins.range_join(none, spans, "x", "a", "b").collect() == []
    assert joins.range_join(spans.selectExpr("a as x"), spans.where("a > 5"), "x", "a", "b").collect() == []
    with pytest.raises(InputError, match="both sides"):
        joins.range_join(spans.selectExpr("a as x", "b"), spans, "x", "a", "b")
    with pytest.raises(InputError, match="closed"):
        joins.range_join(none, spans, "x", "a", "b", closed="open")
