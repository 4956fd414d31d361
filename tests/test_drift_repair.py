import json
import random

import pytest
from pyspark.sql import functions as F

from clearwell.operators.drift import Thresholds, detect_drift, null_spikes, outlier_alerts, outlier_stats
from clearwell.operators.profile import profile
from clearwell.operators.repair import apply_repairs, backfill_nulls, cast_columns, clamp_bounds, resolve_alerts

BASE = [("timestamp", "string", 100), ("machine_id", "string", 5), ("temperature", "float", 80), ("status", "string", 3)]
ALERT = ("id bigint, alert_order int, alert_type string, severity string, column_name string, drift_kind string, "
         "description string, details string")


@pytest.fixture(scope="module")
def baseline(spark):
    return spark.createDataFrame(BASE, "column_name string, data_type string, distinct_values bigint")


def alerts_of(df, baseline, **kw):
    return detect_drift(df, baseline, **kw).collect()


def test_new_column(spark, baseline):
    df = spark.createDataFrame([("t", "m", 1.0, "s", 9.0)],
                               "timestamp string, machine_id string, temperature double, status string, new_sensor double")
    kinds = [(a["drift_kind"], a["column_name"]) for a in alerts_of(df, baseline) if a["alert_type"] == "schema_drift"]
    assert kinds == [("new_column", "new_sensor")]


def test_missing_columns_are_critical(spark, baseline):
    found = [a for a in alerts_of(spark.createDataFrame([("t", "m")], "timestamp string, machine_id string"), baseline)
             if a["drift_kind"] == "missing_column"]
    assert {a["column_name"] for a in found} == {"temperature", "status"}
    assert {a["severity"] for a in found} == {"critical"}
    assert json.loads(found[0]["details"])["expected_type"] in ("float", "string")


def test_type_mismatch(spark, baseline):
    df = spark.createDataFrame([("t", "m", "warm", "s")], "timestamp string, machine_id string, temperature string, status string")
    found = [a for a in alerts_of(df, baseline) if a["alert_type"] == "type_mismatch"]
    assert [a["column_name"] for a in found] == ["temperature"]


def test_null_spike_of_seventy_percent(spark, baseline):
    values = [72.5, None, None, 68.0, None, None, 70.0, None, None, None]
    df = spark.createDataFrame([(v,) for v in values], "temperature double")
    spike = null_spikes(profile(df)).first()
    assert (spike["alert_type"], spike["severity"], spike["column_name"]) == ("null_spike", "critical", "temperature")
    assert json.loads(spike["details"]) == {"null_rate": 0.7, "null_count": 7, "threshold": 0.3}


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(1.0,)] * 7, "x double")
    assert null_spikes(profile(df)).isEmpty()


@pytest.mark.parametrize("approximate", [True, False])
def test_outliers(spark, approximate):
    rng = random.Random(42)
    df = spark.createDataFrame([(rng.gauss(70, 0.5),) for _ in range(90)] + [(9999.0,)] * 10, "temperature double")
    found = outlier_alerts(outlier_stats(df, approximate=approximate), Thresholds(outlier_share_max=0.02)).collect()
    assert [a["alert_type"] for a in found] == ["value_anomaly"]
    assert json.loads(found[0]["details"])["outlier_count"] == 10


def test_empty_batch_and_booleans(spark, baseline):
    empty = spark.createDataFrame([], "timestamp string, machine_id string, temperature double, status string")
    assert alerts_of(empty, baseline) == []
    flags = spark.createDataFrame([(True,)] * 50 + [(False,)], "f boolean")
    assert outlier_stats(flags).isEmpty()


def test_cardinality_shift(spark, baseline):
    df = spark.range(200).select(F.col("id").cast("string").alias("machine_id"))
    found = [a for a in alerts_of(df, baseline) if a["drift_kind"] == "cardinality"]
    assert found[0]["severity"] == "info" and found[0]["measure"] == 39.0


def test_backfill_is_applied_and_resolves(spark):
    df = spark.createDataFrame([(70.0,), (None,), (None,), (80.0,), (None,)], "temperature double")
    alerts = spark.createDataFrame(
        [(1, 4, "null_spike", "warning", "temperature", "null_rate", "", '{"null_rate":0.6}')], ALERT)
    out, actions = apply_repairs(df, alerts)
    assert sorted(r[0] for r in out.collect()) == [70.0, 75.0, 75.0, 75.0, 80.0]
    action = actions.collect()
    assert [(a["strategy"], a["status"], a["drift_alert_id"]) for a in action] == [("null_backfill", "applied", 1)]
    assert json.loads(action[0]["before_snapshot"])["null_count"] == 3
    assert json.loads(action[0]["after_snapshot"])["nulls_after"] == 0
    done = resolve_alerts(alerts, actions).first()
    assert done["resolved"] and done["resolved_by"] == "auto_repair"


def test_gate_queues_schema_drift(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "other_col long")
    alerts = spark.createDataFrame([(1, 2, "schema_drift", "critical", "missing_col", "missing_column", "", "{}")], ALERT)
    out, actions = apply_repairs(df, alerts)
    assert [a["status"] for a in actions.collect()] == ["queued_for_approval"] and out.columns == ["other_col"]


def test_coercion_and_cast_under_medium_risk(spark):
    df = spark.createDataFrame([("1.9",), ("x",), (None,)], "n string")
    alerts = spark.createDataFrame(
        [(1, 3, "type_mismatch", "warning", "n", "type_mismatch", "", '{"expected_type":"integer"}'),
         (2, 2, "schema_drift", "critical", "ok", "missing_column", "", "{}"),
         (3, 6, "value_anomaly", "info", "n", "cardinality", "", '{"drift_kind":"cardinality"}'),
         (4, 9, "other", "info", "n", "other", "", "{}")], ALERT)
    out, actions = apply_repairs(df, alerts, [("n", "integer"), ("ok", "boolean")], "medium")
    assert sorted(map(tuple, out.collect())) == [(0, False), (0, False), (1, False)]
    status = {a["drift_alert_id"]: a["status"] for a in actions.collect()}
    assert status == {1: "applied", 2: "applied", 3: "skipped"}
    errors = [json.loads(a["after_snapshot"]) for a in actions.collect() if a["drift_alert_id"] == 1]
    assert errors[0]["coercion_errors"] == 1


def test_modes_prefer_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    out, fills = backfill_nulls(df, ["s"])
    assert fills == {"s": "a"} and out.where("s is null").isEmpty()
    empty = spark.createDataFrame([(None,), (None,)], "s string")
    assert backfill_nulls(empty, ["s"])[1] == {"s": "UNKNOWN"}


def test_clamp_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(10_000.0,)], "x double")
    sigma, iqr = clamp_bounds(df, ["x"])["x"], clamp_bounds(df, ["x"], method="iqr")["x"]
    assert sigma.high > iqr.high
    with pytest.raises(ValueError):
        clamp_bounds(df, ["x"], method="other")


def test_casts(spark):
    df = spark.createDataFrame([("12.7", "true", "2024-01-02"), ("-3.2", "maybe", "7/17/2026"), ("nan", None, "soon")],
                               "i string, b string, d string")
    rows = cast_columns(df, {"i": "integer", "b": "boolean", "d": "datetime"}).collect()
    assert [r["i"] for r in rows] == [12, -3, 0]
    assert [r["b"] for r in rows] == [True, None, None]
    assert [r["d"] is not None for r in rows] == [True, True, False]
