"""Strategy choice, risk gate and the repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.operators.drift import detect_drift
from clearwell.operators.frequent import most_frequent
from clearwell.operators.profile import profile
from clearwell.operators.repair import (
    Bounds,
    apply_repairs,
    backfill_nulls,
    cast_columns,
    cast_errors,
    choose_repair,
    clamp_bounds,
    clamp_count_row,
    clamp_outliers,
    coerce_schema,
    gate,
    resolve_alerts,
    snapshot,
    split_quarantine,
)
from clearwell.plans.registered.base import GAPPED, Registry, gapped_events, table
from clearwell.plans.registered.drifting import baseline, batch, whole
from clearwell.session import scratch_path

REGISTRY = Registry()

# Events read as alerts: one alert per event, its type by event type; purchases have no strategy.
ALERT_TYPE = """CASE event_type WHEN 'signup' THEN 'null_spike' WHEN 'click' THEN 'value_anomaly'
    WHEN 'view' THEN 'type_mismatch' WHEN 'error' THEN 'schema_drift' ELSE 'other' END"""
STRATEGY_SQL = """CASE alert_type WHEN 'null_spike' THEN 'null_backfill' WHEN 'value_anomaly' THEN 'outlier_clamp'
    WHEN 'type_mismatch' THEN 'type_cast' WHEN 'schema_drift' THEN 'schema_coercion' END"""
RISK_SQL = "CASE WHEN alert_type IN ('null_spike', 'value_anomaly') THEN 'low' WHEN alert_type <> 'other' THEN 'medium' END"


def _alerts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(ALERT_TYPE).alias("alert_type"))


@REGISTRY.add(
    "choose_repair",
    f"""WITH a AS (SELECT event_id AS id, {ALERT_TYPE} AS alert_type FROM events)
    SELECT id, alert_type, {STRATEGY_SQL} AS strategy, {RISK_SQL} AS risk_level FROM a""",
)
def choose(spark, sf_dir):
    return choose_repair(_alerts(spark, sf_dir)).drop("repair_description")


for _risk, _applied in (("low", "('null_spike', 'value_anomaly')"),
                        ("medium", "('null_spike', 'value_anomaly', 'type_mismatch', 'schema_drift')")):
    REGISTRY.add(
        f"repair_gate_{_risk}",
        f"""WITH a AS (SELECT event_id AS id, {ALERT_TYPE} AS alert_type FROM events)
        SELECT id, {STRATEGY_SQL} AS strategy,
               CASE WHEN alert_type IN {_applied} THEN 'applied' ELSE 'queued_for_approval' END AS status
        FROM a WHERE alert_type <> 'other'""",
    )(lambda spark, sf_dir, risk=_risk: gate(choose_repair(_alerts(spark, sf_dir)), risk).select("id", "strategy", "status"))


@REGISTRY.add(
    "backfill_median",
    f"""WITH e AS (SELECT event_id, {GAPPED} AS v FROM events)
    SELECT event_id, round(coalesce(v, (SELECT median(v) FROM e)), 6) AS value FROM e""",
)
def backfill_median(spark, sf_dir):
    filled, _ = backfill_nulls(gapped_events(spark, sf_dir).select("event_id", "value"), ["value"])
    return filled.withColumn("value", F.round("value", 6))


@REGISTRY.add(
    "backfill_mode",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS p FROM orders),
    m AS (SELECT p FROM o WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
    SELECT o_orderkey, coalesce(p, (SELECT p FROM m)) AS o_orderpriority FROM o""",
)
def backfill_mode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("o_orderpriority"))
    return backfill_nulls(orders, ["o_orderpriority"])[0]


@REGISTRY.add(
    "clamp_sigma",
    """WITH s AS (SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM events)
    SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value FROM events, s""",
)
def clamp_sigma(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return clamp_outliers(events, clamp_bounds(events, ["value"])).withColumn("value", F.round("value", 6))


@REGISTRY.add(
    "clamp_iqr",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT event_id, round(least(greatest(value, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)), 6) AS value FROM events, q""",
)
def clamp_iqr(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return clamp_outliers(events, clamp_bounds(events, ["value"], method="iqr")).withColumn("value", F.round("value", 6))


@REGISTRY.add(
    "clamp_counts",
    """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem)
    SELECT count(*) FILTER (WHERE l_extendedprice < m - d) AS clamped_low,
           count(*) FILTER (WHERE l_extendedprice > m + d) AS clamped_high
    FROM lineitem, s""",
)
def clamp_count_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    counts = clamp_count_row(lines, clamp_bounds(lines, ["l_extendedprice"], sigma=1.0))
    return counts.select(F.col("l0").alias("clamped_low"), F.col("h0").alias("clamped_high"))


# Readings as text: purchases are words, views lose their fraction, the others are plain numbers.
TEXT_VALUE = """CASE event_type WHEN 'purchase' THEN 'n/a ' || event_type WHEN 'view' THEN CAST(user_id AS {text})
    WHEN 'error' THEN NULL ELSE CAST(value AS {text}) END"""


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr(TEXT_VALUE.format(text="string")).alias("reading"))


TEXTS_SQL = f"WITH e AS (SELECT event_id, {TEXT_VALUE.format(text='VARCHAR')} AS reading FROM events)"
REGISTRY.add(
    "cast_int",
    f"{TEXTS_SQL} SELECT event_id, coalesce(CAST(trunc(try_cast(reading AS DOUBLE)) AS BIGINT), 0) AS reading FROM e",
)(lambda spark, sf_dir: cast_columns(_texts(spark, sf_dir), {"reading": "integer"}))
REGISTRY.add("cast_float", f"{TEXTS_SQL} SELECT event_id, try_cast(reading AS DOUBLE) AS reading FROM e")(
    lambda spark, sf_dir: cast_columns(_texts(spark, sf_dir), {"reading": "float"}))
REGISTRY.add("cast_string", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id FROM events")(
    lambda spark, sf_dir: cast_columns(table(spark, sf_dir, "events").select("event_id", "user_id"), {"user_id": "string"}))
REGISTRY.add(
    "cast_errors",
    f"{TEXTS_SQL} SELECT count(*) FILTER (WHERE reading IS NOT NULL AND try_cast(reading AS DOUBLE) IS NULL) AS coercion_errors FROM e",
)(lambda spark, sf_dir: _texts(spark, sf_dir).agg(
    F.count_if(cast_errors(F.col("reading"), "integer")).alias("coercion_errors")))


@REGISTRY.add(
    "cast_ts",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE epoch_us(o_orderdate) END AS micros FROM orders""",
)
def cast_ts(spark, sf_dir):
    """Dates as ISO text, in US layout, or as a word that cannot be read."""
    texts = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "M/d/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day"))
    return cast_columns(texts, {"day": "datetime"}).select("o_orderkey", F.coalesce(F.unix_micros("day"), F.lit(-1)).alias("micros"))


@REGISTRY.add(
    "coerce_schema",
    """SELECT s_suppkey, s_name, CAST(0 AS BIGINT) AS orders, CAST(0 AS DOUBLE) AS rating, FALSE AS active,
              TRUE AS since, 'UNKNOWN' AS region, s_acctbal FROM supplier""",
)
def coerce(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    expected = [("s_suppkey", "integer"), ("s_name", "string"), ("orders", "integer"), ("rating", "float"),
                ("active", "boolean"), ("since", "datetime"), ("region", "string")]
    out, _, _ = coerce_schema(supplier, expected)
    return out.withColumn("since", F.col("since").isNull())


@REGISTRY.add(
    "quarantine",
    """SELECT event_id, value, CASE WHEN coalesce(v BETWEEN 1 AND 100, FALSE) THEN 'clean' ELSE 'quarantine' END AS zone
       FROM (SELECT event_id, value, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)""",
)
def quarantine(spark, sf_dir):
    """Rows that break a rule go to a quarantine folder of their own."""
    events = table(spark, sf_dir, "events").select(
        "event_id", "value", F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    good, bad = split_quarantine(events, F.col("v").between(1, 100))
    path = scratch_path(spark, "quarantine")
    bad.write.parquet(path)
    kept = good.select("event_id", "value", F.lit("clean").alias("zone"))
    return kept.unionByName(spark.read.parquet(path).select("event_id", "value", F.lit("quarantine").alias("zone")))


@REGISTRY.add(
    "snapshot",
    f"""WITH e AS (SELECT event_type, {GAPPED} AS value FROM events)
    SELECT 'value' AS column_name, 'float' AS dtype, count(*) - count(value) AS null_count,
           count(DISTINCT value) AS distinct_values, round_even(min(value), 4) AS min, round_even(max(value), 4) AS max,
           round_even(avg(value), 4) AS mean, round_even(stddev_samp(value), 4) AS std FROM e
    UNION ALL SELECT 'event_type', 'string', count(*) - count(event_type), count(DISTINCT event_type),
           NULL, NULL, NULL, NULL FROM e""",
)
def snapshot_rows(spark, sf_dir):
    return snapshot(gapped_events(spark, sf_dir), ["value", "event_type"])


# The batch of the drift suite repaired up to medium risk: props added, users cast back, readings filled, then clamped.
REPAIRED_SQL = """WITH b AS (SELECT event_id, user_id, event_type,
        CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value * value * value END AS v
        FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
    m AS (SELECT event_id, user_id, event_type, coalesce(v, (SELECT median(v) FROM b)) AS v FROM b),
    s AS (SELECT avg(v) - 3 * stddev_samp(v) AS lo, avg(v) + 3 * stddev_samp(v) AS hi FROM m)"""


@REGISTRY.add(
    "apply_repairs",
    f"""{REPAIRED_SQL} SELECT event_id, user_id, event_type, round(least(greatest(v, lo), hi), 4) AS value,
    'channel-' || event_type AS channel, 'UNKNOWN' AS props FROM m, s""",
)
def repaired(spark, sf_dir):
    found = batch(spark, sf_dir)
    columns = baseline(spark, sf_dir).collect()  # one row per column, profiled once
    base = spark.createDataFrame(columns, "column_name string, data_type string, distinct_values bigint")
    expected = [(r["column_name"], r["data_type"]) for r in columns]
    out, _ = apply_repairs(found, detect_drift(found, base), expected, "medium")
    return out.select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"), "channel", "props")


@REGISTRY.add(
    "repair_ledger",
    """SELECT * FROM (VALUES
        ('schema_coercion', 'medium', 'queued_for_approval', CAST(2 AS BIGINT)),
        ('type_cast', 'medium', 'queued_for_approval', CAST(1 AS BIGINT)),
        ('null_backfill', 'low', 'applied', CAST(1 AS BIGINT)),
        ('outlier_clamp', 'low', 'applied', CAST(1 AS BIGINT))) AS t(strategy, risk_level, status, actions)
       WHERE (SELECT count(*) FROM events) > 0""",
)
def repair_ledger(spark, sf_dir):
    """Actions of a low-risk repair of the drifted batch by strategy and status."""
    found = batch(spark, sf_dir)
    _, actions = apply_repairs(found, detect_drift(found, baseline(spark, sf_dir)))
    return actions.groupBy("strategy", "risk_level", "status").agg(F.count(F.lit(1)).alias("actions"))


@REGISTRY.add(
    "resolved_alerts",
    f"""WITH a AS (SELECT event_id AS id, {ALERT_TYPE} AS alert_type FROM events)
    SELECT id, alert_type, alert_type IN ('null_spike', 'value_anomaly') AS resolved,
           CASE WHEN alert_type IN ('null_spike', 'value_anomaly') THEN 'auto_repair' END AS resolved_by FROM a""",
)
def resolved(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    actions = gate(choose_repair(alerts)).withColumnRenamed("id", "drift_alert_id")
    return resolve_alerts(alerts, actions)


@REGISTRY.add(
    "profile_after_repair",
    "SELECT 'value' AS column_name, CAST(0 AS BIGINT) AS null_count, count(*) AS row_count FROM events",
)
def profile_after(spark, sf_dir):
    found = whole(spark, sf_dir)
    out, _ = backfill_nulls(found, ["value"])
    return profile(out.select("value"), probe_dates=False).select("column_name", "null_count", "row_count")


@REGISTRY.add(
    "clamp_whole",
    """WITH k AS (SELECT o_orderkey, 9007199254740993 + o_custkey % 1000 * 2 AS big, o_custkey FROM orders),
    s AS (SELECT avg(o_custkey) - stddev_samp(o_custkey) AS lo, avg(o_custkey) + stddev_samp(o_custkey) AS hi FROM orders)
    SELECT o_orderkey, big, CASE WHEN o_custkey < lo THEN ceil(lo)::BIGINT WHEN o_custkey > hi THEN floor(hi)::BIGINT ELSE o_custkey END AS o_custkey
    FROM k, s""",
)
def clamp_whole(spark, sf_dir):
    """Whole numbers stay whole, also those that no double holds."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.lit(9007199254740993) + F.col("o_custkey") % 1000 * 2).alias("big"), F.col("o_custkey").cast("bigint").alias("o_custkey"))
    bounds = clamp_bounds(orders, ["o_custkey"], sigma=1.0) | {"big": Bounds(0.0, 1e17)}
    return clamp_outliers(orders, bounds)


MODE_COLUMNS = ("l_returnflag", "l_linestatus", "note", "mark")


@REGISTRY.add("column_modes", "WITH l AS (SELECT *, 'n' || l_orderkey || '-' || l_linenumber AS note, 'm' || l_orderkey % 97 AS mark FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, v AS mode, n AS times FROM (SELECT {c} AS v, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, v LIMIT 1)" for c in MODE_COLUMNS))
def modes(spark, sf_dir):
    """Most frequent values of four columns, one of them of distinct values, with their counts."""
    lines = table(spark, sf_dir, "lineitem").withColumns({
        "note": F.concat(F.lit("n"), "l_orderkey", F.lit("-"), "l_linenumber"), "mark": F.concat(F.lit("m"), F.col("l_orderkey") % 97)})
    found = most_frequent(lines, list(MODE_COLUMNS))
    # one row a column, made from what the jobs counted
    return spark.createDataFrame([(c, *found[c]) for c in MODE_COLUMNS if found[c]], "column_name string, mode string, times long")
