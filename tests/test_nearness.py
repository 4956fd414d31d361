"""Joins by time and by distance, and several axes at once, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from clearwell.operators.bi import grouped_axes
from clearwell.operators.temporal import as_of_join, band_join


@pytest.mark.parametrize("partitions", [1, 9])
def test_as_of_join_equals_brute_force(spark, partitions):
    """One key holds most rows, so its history crosses many partitions; some partitions see no value at all."""
    rng = random.Random(partitions)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", None])
    left = [(i, key(), rng.choice([None, *range(0, 3000)])) for i in range(400)]
    right = [(key(), rng.choice([None, *range(500, 2600, 7)]), rng.choice([None, 1.5, 2.5, float(i)])) for i in range(25)]
    right += [("hot", 700, None), ("hot", 700, 9.0)]
    got = as_of_join(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, at long, v double"),
                     ["k"], "t", "at", ["v", "at"], partitions)
    assert got.columns == ["id", "k", "t", "v", "at"]
    want = []
    for i, k, t in left:
        known = [(at, v is not None, v or 0.0, v) for q, at, v in right if k is not None and q == k and at is not None and t is not None and at <= t]
        best = max(known, default=None)
        want.append((i, k, t, best and best[3], best and best[0]))
    assert sorted((tuple(r) for r in got.collect())) == sorted(want, key=lambda r: r[0])


def test_as_of_join_of_empty_tables(spark):
    left, right = spark.createDataFrame([(1, 2, 3)], "id long, k long, t long"), spark.createDataFrame([], "k long, at long, v double")
    assert [tuple(r) for r in as_of_join(left, right, ["k"], "t", "at", ["v"]).collect()] == [(1, 2, 3, None)]
    assert as_of_join(left.limit(0), right, ["k"], "t", "at", ["v"]).count() == 0


def test_band_join_equals_brute_force(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, float("nan"), 0.0, 0.1, -0.1, 0.3, rng.uniform(-2, 2), rng.uniform(-2, 2)])
    left = [(i, value(), rng.randrange(2)) for i in range(120)]
    right = [(i, value(), rng.randrange(2)) for i in range(150)]
    a, b = spark.createDataFrame(left, "i long, x double, g long"), spark.createDataFrame(right, "j long, y double, h long")
    near = lambda x, y: x is not None and y is not None and abs(x - y) <= 0.1
    got = band_join(a, b, "x", "y", 0.1)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, x, _ in left for j, y, _ in right if near(x, y))
    keyed = band_join(a, b, "x", "y", 0.1, [("g", "h")])
    assert sorted((r.i, r.j) for r in keyed.collect()) == sorted((i, j) for i, x, g in left for j, y, h in right if near(x, y) and g == h)
    with pytest.raises(ValueError):
        band_join(a, b, "x", "y", 0)


def test_axes_with_nulls(spark):
    rows = [("a", None, 1), ("a", "x", 2), (None, "x", 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "p string, q string, v long")
    got = grouped_axes(df, {"p": ["p"], "both": ["q", "p"], "all": []}, [F.sum("v").alias("v")])
    assert sorted(((r.axis, sorted((r.labels or {}).items()), r.v) for r in got.collect()), key=repr) == sorted([
        ("p", [("p", "a")], 3), ("p", [("p", None)], 7), ("all", [], 10), *[("both", [("p", p), ("q", q)], v) for p, q, v in rows]], key=repr)
