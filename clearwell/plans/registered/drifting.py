"""Drift checks of the second half of a month of events against the first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwell.operators.drift import (
    cardinality_shifts,
    detect_drift,
    null_spikes,
    outlier_alerts,
    outlier_stats,
    schema_drift,
)
from clearwell.operators.profile import profile
from clearwell.operators.repair import choose_repair, gate
from clearwell.plans.registered.base import Registry, table
from clearwell.plans.runs import confirm_schema, ingest_batch, run_table
from clearwell.session import scratch_path
from clearwell.sources.ledger import Catalog

REGISTRY = Registry()

SPLIT = "2024-01-16"
ALERTS = ("alert_type", "severity", "column_name", "drift_kind", "measure")

# The batch differs from the baseline: errors and views carry no reading, readings are cubed, user ids are text,
# props is gone and channel is new.
WHOLE_SQL = """SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_id, event_type,
    CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value * value * value END AS value,
    'channel-' || event_type AS channel FROM events"""
BATCH_SQL = f"{WHOLE_SQL} WHERE ts >= TIMESTAMP '{SPLIT}'"
BASE_SQL = f"SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT}'"
SHARED = ("event_id", "ts", "user_id", "event_type", "value")
FENCES_SQL = """f AS (SELECT q1, q3, q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (
    SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM b))"""
NEW_SQL = ("SELECT 'schema_drift' AS alert_type, 'warning' AS severity, 'channel' AS column_name, "
           "'new_column' AS drift_kind, CAST(NULL AS DOUBLE) AS measure FROM b HAVING count(*) > 0")
MISSING_SQL = ("SELECT 'schema_drift' AS alert_type, 'critical' AS severity, 'props' AS column_name, "
               "'missing_column' AS drift_kind, CAST(NULL AS DOUBLE) AS measure FROM b HAVING count(*) > 0")
TYPE_SQL = ("SELECT 'type_mismatch' AS alert_type, 'warning' AS severity, 'user_id' AS column_name, "
            "'type_mismatch' AS drift_kind, CAST(NULL AS DOUBLE) AS measure FROM b HAVING count(*) > 0")


def null_sql(column: str) -> str:
    rate = f"(count(*) - count({column})) / CAST(count(*) AS DOUBLE)"
    return (f"SELECT 'null_spike' AS alert_type, CASE WHEN {rate} > 0.6 THEN 'critical' ELSE 'warning' END AS severity, "
            f"'{column}' AS column_name, 'null_rate' AS drift_kind, round({rate}, 6) AS measure FROM b "
            f"HAVING {rate} > 0.3")


def cardinality_sql(column: str) -> str:
    current, base = f"(SELECT count(DISTINCT {column}) FROM b)", f"(SELECT count(DISTINCT {column}) FROM a)"
    change = f"abs({current} - {base}) / CAST({base} AS DOUBLE)"
    return (f"SELECT 'value_anomaly' AS alert_type, 'info' AS severity, '{column}' AS column_name, "
            f"'cardinality' AS drift_kind, round({change}, 6) AS measure WHERE {change} > 0.5")


OUTLIER_SQL = """SELECT 'value_anomaly' AS alert_type, 'warning' AS severity, 'value' AS column_name,
    'outliers' AS drift_kind, round(count_if(value < lo OR value > hi) / CAST(count(value) AS DOUBLE), 6) AS measure
    FROM b, f HAVING count_if(value < lo OR value > hi) / CAST(count(value) AS DOUBLE) > 0.05"""
NULLS_SQL = " UNION ALL ".join(null_sql(c) for c in (*SHARED, "channel"))
CARDINALITY_SQL = " UNION ALL ".join(cardinality_sql(c) for c in SHARED)
SUITE_SQL = f"""WITH a AS ({BASE_SQL}), b AS ({BATCH_SQL}), {FENCES_SQL}
    {NEW_SQL} UNION ALL {MISSING_SQL} UNION ALL {TYPE_SQL} UNION ALL {NULLS_SQL} UNION ALL {OUTLIER_SQL}
    UNION ALL {CARDINALITY_SQL}"""


def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(baseline_rows(spark, sf_dir), exact=True).select("column_name", "data_type", "distinct_values")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(spark, sf_dir).where(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in the shape of the batch, for checks that need no baseline."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").cast("string").alias("user_id"), "event_type",
        F.when(~F.col("event_type").isin("error", "view"), F.col("value") * F.col("value") * F.col("value")).alias("value"),
        F.concat(F.lit("channel-"), "event_type").alias("channel"),
    )


def compared(alerts: DataFrame) -> DataFrame:
    return alerts.select(*ALERTS[:-1], F.round("measure", 6).alias("measure"))


def _drift_of(kind):
    def run(spark, sf_dir):
        alerts = schema_drift(profile(batch(spark, sf_dir)), baseline(spark, sf_dir))
        return compared(alerts).where(F.col("drift_kind") == kind)

    return run


for _name, _kind, _sql in (("drift_new", "new_column", NEW_SQL), ("drift_missing", "missing_column", MISSING_SQL),
                           ("drift_type", "type_mismatch", TYPE_SQL)):
    REGISTRY.add(_name, f"WITH a AS ({BASE_SQL}), b AS ({BATCH_SQL}) {_sql}")(_drift_of(_kind))


@REGISTRY.add("null_spike", f"WITH b AS ({WHOLE_SQL}) {NULLS_SQL}")
def null_spike(spark, sf_dir):
    return compared(null_spikes(profile(whole(spark, sf_dir), probe_dates=False)))


@REGISTRY.add(
    "iqr_fences",
    f"""WITH b AS ({WHOLE_SQL}), {FENCES_SQL}
    SELECT 'value' AS column_name, (SELECT count(value) FROM b) AS value_count,
           (SELECT count(*) FILTER (WHERE value < lo OR value > hi) FROM b, f) AS outlier_count,
           round(q1, 6) AS q1, round(q3, 6) AS q3, round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence FROM f""",
)
def iqr_fences(spark, sf_dir):
    stats = outlier_stats(whole(spark, sf_dir).select("value"))
    return stats.select("column_name", "value_count", "outlier_count",
                        *[F.round(c, 6).alias(c) for c in ("q1", "q3", "lower_fence", "upper_fence")])


@REGISTRY.add("iqr_outliers", f"WITH b AS ({WHOLE_SQL}), {FENCES_SQL} {OUTLIER_SQL}")
def iqr_outliers(spark, sf_dir):
    return compared(outlier_alerts(outlier_stats(whole(spark, sf_dir))))


@REGISTRY.add("cardinality_shift", f"""WITH a AS ({BASE_SQL}), b AS (SELECT * REPLACE (event_type || '-' || CAST(event_id % 7 AS VARCHAR)
    AS event_type, value % 10 AS value) FROM ({BATCH_SQL})) {CARDINALITY_SQL}""")
def cardinality_shift(spark, sf_dir):
    """Event types are split in seven, so they shift by more than half; user ids and times do not."""
    rows = batch(spark, sf_dir).withColumns({
        "event_type": F.concat_ws("-", "event_type", (F.col("event_id") % 7).cast("string")), "value": F.col("value") % 10})
    return compared(cardinality_shifts(profile(rows, exact=True, probe_dates=False), baseline(spark, sf_dir)))


@REGISTRY.add("drift_suite", SUITE_SQL)
def drift_suite(spark, sf_dir):
    return compared(detect_drift(batch(spark, sf_dir), baseline(spark, sf_dir)))


@REGISTRY.add(
    "drift_details",
    f"""WITH b AS ({WHOLE_SQL})
    SELECT 'value' AS column_name, round_even((count(*) - count(value)) / CAST(count(*) AS DOUBLE), 4) AS null_rate,
           count(*) - count(value) AS null_count FROM b""",
)
def drift_details(spark, sf_dir):
    """Evidence of an alert, read back from its JSON."""
    spikes = null_spikes(profile(whole(spark, sf_dir), probe_dates=False))
    evidence = F.from_json("details", "null_rate double, null_count bigint")
    return spikes.select("column_name", evidence.alias("e")).select("column_name", "e.*")


@REGISTRY.add(
    "suite_repairs",
    f"""WITH alerts AS ({SUITE_SQL})
    SELECT alert_type, column_name, drift_kind,
           CASE alert_type WHEN 'null_spike' THEN 'null_backfill' WHEN 'value_anomaly' THEN 'outlier_clamp'
                WHEN 'type_mismatch' THEN 'type_cast' ELSE 'schema_coercion' END AS strategy,
           CASE WHEN alert_type IN ('null_spike', 'value_anomaly') THEN 'applied' ELSE 'queued_for_approval' END AS status
    FROM alerts""",
)
def suite_repairs(spark, sf_dir):
    """What the repair gate does with the alerts of the whole suite."""
    gated = gate(choose_repair(detect_drift(batch(spark, sf_dir), baseline(spark, sf_dir))))
    return gated.select("alert_type", "column_name", "drift_kind", "strategy", "status")


@REGISTRY.add(
    "run_flow_ledger",
    f"""WITH b AS ({BATCH_SQL}) SELECT 'success' AS status, 1 AS version, count(*) AS rows_input, count(*) AS rows_output,
        count(*) AS clean_rows, 'channel,props' AS schema_drift FROM b""",
)
def run_flow_ledger(spark, sf_dir):
    """The upload flow end to end: land and profile a file, confirm its schema, run the next batch, read the ledgers."""
    root, now = scratch_path(spark, "flow"), datetime(2024, 2, 1)
    source, catalog = f"{root}/incoming", Catalog(spark, f"{root}/lake")
    baseline_rows(spark, sf_dir).write.option("header", True).option("escape", '"').csv(source)
    ingest_batch(spark, catalog, source, "csv", "events", now, exact=True)
    confirm_schema(spark, catalog, "events", now)
    done = run_table(spark, catalog, batch(spark, sf_dir), "events", now)
    clean_rows = done.df.agg(F.count(F.lit(1)).alias("clean_rows"))
    drifted = catalog["drift_alerts"].latest().where("alert_type = 'schema_drift'").agg(
        F.array_join(F.sort_array(F.collect_set("column_name")), ",").alias("schema_drift"))
    runs = catalog["pipeline_runs"].latest().select("status", "version", "rows_input", "rows_output")
    parts = runs.unionByName(clean_rows, True).unionByName(drifted, True)  # a row each
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])
