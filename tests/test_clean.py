import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clearwell.functions.text import strip, title_case
from clearwell.operators.clean import clean, fill_nulls, normalize_headers
from clearwell.operators.dedup import drop_duplicates
from clearwell.operators.normalize import convert_case, convert_units, scale, to_utc
from clearwell.operators.quantiles import exact_quantiles


def test_clean_fills_and_normalizes_headers(spark):
    df = spark.createDataFrame([("CNC-01 ", 75.0), ("CNC-02", None), (None, 68.0)], "`Machine ID` string, `Motor-Temp` double")
    done = clean(df)
    assert done.df.columns == ["machine_id", "motor_temp"]
    assert done.null_cells_filled == 2 and done.rows_cleaned == 0 and done.rows_input == 3
    assert sorted(map(tuple, done.df.collect())) == [("CNC-01", 75.0), ("CNC-02", 71.5), ("UNKNOWN", 68.0)]


def test_colliding_headers(spark):
    with pytest.raises(ValueError, match="collide"):
        normalize_headers(spark.createDataFrame([(1, 2)], "`a b` int, `A-B` int"))


@pytest.mark.parametrize("how,expected", [("median", 2.0), ("mean", 7.0 / 3), ("zero", 0.0)])
def test_numeric_fills(spark, how, expected):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    assert sorted(r[0] for r in fill_nulls(df, numeric=how).df.collect()) == pytest.approx(sorted([1.0, 2.0, 4.0, expected]))


def test_integer_column_takes_fractional_median(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x bigint")
    done = fill_nulls(df).df
    assert dict(done.dtypes)["x"] == "double" and sorted(r[0] for r in done.collect()) == [1.0, 1.5, 2.0]
    whole = fill_nulls(spark.createDataFrame([(1,), (3,), (None,)], "x bigint")).df
    assert dict(whole.dtypes)["x"] == "bigint"


def test_rows_dropped_left_do_not_count_right(spark):
    df = spark.createDataFrame([(None, 100.0), (1, 1.0), (2, 3.0), (3, None)], "d int, x double").withColumn(
        "d", F.timestamp_seconds("d"))
    done = fill_nulls(df)
    assert done.rows_cleaned == 1 and done.null_cells_filled == 1
    assert sorted(r["x"] for r in done.df.collect()) == [1.0, 2.0, 3.0]


def test_all_null_numeric_column_stays(spark):
    done = fill_nulls(spark.createDataFrame([(None, 1), (None, 2)], "x double, y int"))
    assert done.null_cells_filled == 0 and [r["x"] for r in done.df.collect()] == [None, None]


def test_unknown_strategies(spark):
    df = spark.createDataFrame([(1,)], "x int")
    for call in (lambda: fill_nulls(df, numeric="guess"), lambda: scale(df, "log"), lambda: convert_case(df, "camel"),
                 lambda: drop_duplicates(df, keep="any"),
                 lambda: convert_units(df, {"x": {"to": "y", "formula": "none"}})):
        with pytest.raises(ValueError):
            call()


def test_dedup(spark):
    rows = [(1, "a"), (2, "b"), (2, "b"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "id long, value string")
    assert drop_duplicates(df).count() == 3
    assert [r["id"] for r in drop_duplicates(df, keep=False).collect()] == [1]
    seq = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 3), (None, "w", 4)], "k int, v string, n int")
    first = drop_duplicates(seq, ["k"], "first", ["n"])
    assert first.columns == ["k", "v", "n"]
    assert {r["v"] for r in first.collect()} == {"x", "z"}
    assert {r["v"] for r in drop_duplicates(seq, ["k"], "last", ["n"]).collect()} == {"y", "w"}
    assert drop_duplicates(first, ["k"], "first", ["n"]).count() == first.count()
    assert drop_duplicates(seq, ["k"], False).count() == 0
    assert {r["v"] for r in drop_duplicates(seq.coalesce(1), ["k"]).collect()} == {"x", "z"}


def test_scaling(spark):
    df = spark.createDataFrame([("ALICE", 10.0, 5), ("BOB", 20.0, 5), ("EVE", None, 5)], "name string, score double, k int")
    got = {r["name"]: r for r in scale(convert_case(df, "lower"), "minmax").collect()}
    assert got["alice"]["score"] == 0.0 and got["bob"]["score"] == 1.0 and got["eve"]["score"] is None
    assert got["bob"]["k"] == 5
    z = sorted(r["score"] for r in scale(df.na.drop(), "zscore").collect())
    assert z == pytest.approx([-1 / math.sqrt(2), 1 / math.sqrt(2)])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abZéßÀ '-_1\t\n　.ñ", max_size=12), min_size=1, max_size=40))
def test_text_functions_equal_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", strip(F.col("t")).alias("s"), title_case(F.col("t")).alias("c")).collect():
        assert r["s"] == r["t"].strip()
        assert r["c"] == r["t"].title()


def test_utc_and_units(spark):
    df = spark.sql("select timestamp_ntz'2024-06-01 12:00:00' as a, timestamp'2024-06-01 12:00:00+02:00' as b, 212.0D as f")
    row = to_utc(df).select(F.unix_seconds("a").alias("a"), F.unix_seconds("b").alias("b")).first()
    assert row["a"] - row["b"] == 7200
    assert convert_units(df, {"f": {"to": "c", "formula": "fahrenheit_to_celsius"}}).first()["c"] == 100.0


@pytest.mark.parametrize("max_inside", [50_000, 20])
def test_quantiles_by_narrowing(spark, max_inside):
    """A third of the rows is one value, another third spreads; every quantile equals the built-in one."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 3 == 1, F.pmod(F.hash("id"), F.lit(1000)) / 7)
        .otherwise(F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") * 1.5)).alias("x"),
        F.lit(None).cast("double").alias("none"), F.when(F.col("id") == 5, 1).alias("one"))
    probabilities = [0.0, 0.1, 0.25, 0.3333, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["x", "none", "one"], probabilities, max_inside)
    want = df.agg(F.percentile("x", probabilities).alias("q")).first()["q"]
    assert got["x"] == pytest.approx(want, rel=1e-12)
    assert got["none"] == [None] * len(probabilities)
    assert got["one"] == [1.0] * len(probabilities)
