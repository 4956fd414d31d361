"""Schema drift and value anomalies against a baseline.

Alerts are rows ``(alert_order, alert_type, severity, column_name, drift_kind, measure, description, details)``.
Both sides of every comparison are one row per column of a table, however many rows the table has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.functions.fixed_values import (
    CARDINALITY_CHANGE_MAX,
    IQR_MULTIPLIER,
    NULL_RATE_CRITICAL,
    NULL_RATE_MAX,
    OUTLIER_SHARE_MAX,
)
from clearwell.functions.numeric import missing, present
from clearwell.functions.types import LOGICAL_TYPES, numeric_columns, quoted
from clearwell.operators.profile import profile
from clearwell.operators.quantiles import exact_quantiles

ALERT_COLUMNS = (
    "alert_order", "alert_type", "severity", "column_name", "drift_kind", "measure", "description", "details",
)


@dataclass(frozen=True)
class Thresholds:
    null_rate_max: float = NULL_RATE_MAX
    iqr_multiplier: float = IQR_MULTIPLIER
    outlier_share_max: float = OUTLIER_SHARE_MAX
    cardinality_change_max: float = CARDINALITY_CHANGE_MAX


def _alert(order: int, kind: str, severity: Column, drift_kind: str, measure: Column, text: Column, details: Column):
    return F.struct(
        F.lit(order).alias("alert_order"),
        F.lit(kind).alias("alert_type"),
        severity.alias("severity"),
        F.col("column_name"),
        F.lit(drift_kind).alias("drift_kind"),
        measure.cast("double").alias("measure"),
        text.alias("description"),
        F.to_json(details).alias("details"),
    )


def _percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.bround(c * 100, digits)), F.lit("%"))


def _joined(current: DataFrame, baseline: DataFrame) -> DataFrame:
    base = baseline.select(
        "column_name", F.coalesce("data_type", F.lit("string")).alias("base_type"),
        F.col("distinct_values").alias("base_distinct"), F.lit(True).alias("in_base"),
    )
    return current.withColumn("in_current", F.lit(True)).join(base, "column_name", "full_outer")


def _schema_alerts() -> list[Column]:
    name, none = F.col("column_name"), F.lit(None).cast("double")
    unknown = ~F.col("base_type").isin(*LOGICAL_TYPES)
    mismatch = F.col("in_current") & F.col("in_base") & (unknown | (F.col("data_type") != F.col("base_type")))
    return [
        F.when(
            F.col("in_base").isNull(),
            _alert(1, "schema_drift", F.lit("warning"), "new_column", none,
                   F.concat(F.lit("New column '"), name,
                            F.lit("' detected that is not in the registered baseline schema.")),
                   F.struct(F.lit("new_column").alias("drift_kind"), name.alias("column"),
                            F.col("data_type").alias("current_dtype"))),
        ),
        F.when(
            F.col("in_current").isNull(),
            _alert(2, "schema_drift", F.lit("critical"), "missing_column", none,
                   F.concat(F.lit("Expected column '"), name, F.lit("' is missing from the current batch.")),
                   F.struct(F.lit("missing_column").alias("drift_kind"), name.alias("column"),
                            F.col("base_type").alias("expected_type"))),
        ),
        F.when(
            mismatch,
            _alert(3, "type_mismatch", F.lit("warning"), "type_mismatch", none,
                   F.concat(F.lit("Column '"), name, F.lit("' type mismatch: expected '"), F.col("base_type"),
                            F.lit("', but got '"), F.col("data_type"), F.lit("'.")),
                   F.struct(F.lit("type_mismatch").alias("drift_kind"), name.alias("column"),
                            F.col("base_type").alias("expected_type"), F.col("data_type").alias("actual_dtype"))),
        ),
    ]


def _null_alert(t: Thresholds) -> Column:
    rate = F.try_divide("null_count", "row_count")
    return F.when(
        (F.col("row_count") > 0) & (rate > t.null_rate_max),
        _alert(4, "null_spike", F.when(rate > NULL_RATE_CRITICAL, F.lit("critical")).otherwise(F.lit("warning")),
               "null_rate", rate,
               F.concat(F.lit("Column '"), F.col("column_name"), F.lit("' has "), _percent(rate),
                        F.lit(f" null values (threshold: {t.null_rate_max:.0%}).")),
               F.struct(F.bround(rate, 4).alias("null_rate"), F.col("null_count"),
                        F.lit(t.null_rate_max).alias("threshold"))),
    )


def _outlier_alert(t: Thresholds) -> Column:
    share = F.try_divide("outlier_count", "value_count")
    return F.when(
        share > t.outlier_share_max,
        _alert(5, "value_anomaly", F.lit("warning"), "outliers", share,
               F.concat(F.lit("Column '"), F.col("column_name"), F.lit("' has "), _percent(share),
                        F.lit(f" statistical outliers (IQR method, {t.iqr_multiplier}×IQR). Count: "),
                        F.col("outlier_count"), F.lit("/"), F.col("value_count"), F.lit(".")),
               F.struct(F.lit("outliers").alias("drift_kind"), F.col("outlier_count"),
                        F.bround(share, 4).alias("outlier_pct"),
                        *[F.bround(c, 4).alias(c) for c in ("q1", "q3", "iqr", "lower_fence", "upper_fence")])),
    )


def _cardinality_alert(t: Thresholds) -> Column:
    change = F.try_divide(F.abs(F.col("distinct_values") - F.col("base_distinct")), F.col("base_distinct"))
    return F.when(
        (F.col("row_count") > 0) & (F.col("base_distinct") > 0) & (change > t.cardinality_change_max),
        _alert(6, "value_anomaly", F.lit("info"), "cardinality", change,
               F.concat(F.lit("Column '"), F.col("column_name"), F.lit("' cardinality shifted: baseline="),
                        F.col("base_distinct"), F.lit(", current="), F.col("distinct_values"), F.lit(" ("),
                        _percent(change, 0), F.lit(" change).")),
               F.struct(F.lit("cardinality").alias("drift_kind"), F.col("base_distinct").alias("baseline_distinct"),
                        F.col("distinct_values").alias("current_distinct"), F.bround(change, 4).alias("change_pct"))),
    )


def _emit(stats: DataFrame, alerts: list[Column]) -> DataFrame:
    found = F.filter(F.array(*alerts), lambda a: a.isNotNull())
    return stats.select(F.inline(found)).select(*ALERT_COLUMNS)


def schema_drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """New, missing and retyped columns. ``current`` is a profile, ``baseline`` has column_name, data_type,
    distinct_values."""
    return _emit(_joined(current, baseline), _schema_alerts())


def outlier_stats(
    df: DataFrame, columns: list[str] | None = None, multiplier: float = IQR_MULTIPLIER, approximate: bool = False,
    quartiles: dict[str, tuple] | None = None,
) -> DataFrame:
    """Quartiles, fences and the number of values outside them, one row per numeric column with a spread.

    Exact quartiles come from :func:`exact_quantiles`; ``approximate`` reads them from one sketch pass, and ``quartiles`` gives
    them, for instance from merged states. The outliers
    of all columns are then counted in one pass with the fences as literals.
    """
    columns = numeric_columns(df) if columns is None else columns
    types = dict(df.dtypes)
    value = {c: present(F.col(quoted(c)), types[c]).cast("double") for c in columns}
    if quartiles is not None:
        quartiles = {c: quartiles.get(c, (None, None)) for c in columns}
    elif not columns:
        quartiles = {}
    elif approximate:
        row = df.agg(*[F.percentile_approx(value[c], [0.25, 0.75], 10_000).alias(f"q{i}")
                       for i, c in enumerate(columns)]).first()
        quartiles = {c: row[f"q{i}"] or [None, None] for i, c in enumerate(columns)}
    else:
        quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    spread = {c: (q1, q3) for c, (q1, q3) in quartiles.items() if q1 is not None and q3 > q1}
    spark = df.sparkSession
    schema = ("column_name string, value_count bigint, outlier_count bigint, q1 double, q3 double, iqr double, "
              "lower_fence double, upper_fence double")
    if not spread:
        return spark.createDataFrame([], schema)
    aggs, entries = [], []
    for i, (c, (q1, q3)) in enumerate(spread.items()):
        low, high = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
        aggs += [F.count(value[c]).alias(f"n{i}"), F.count_if((value[c] < low) | (value[c] > high)).alias(f"o{i}")]
        entries.append(F.struct(
            F.lit(c).alias("column_name"), F.col(f"n{i}").alias("value_count"), F.col(f"o{i}").alias("outlier_count"),
            F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.lit(q3 - q1).alias("iqr"),
            F.lit(low).alias("lower_fence"), F.lit(high).alias("upper_fence")))
    return df.agg(*aggs).select(F.inline(F.array(*entries))).where("value_count > 2")


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, null_count, row_count) in one aggregation."""
    names = df.columns
    types = dict(df.dtypes)
    one_row = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(missing(F.col(quoted(c)), types[c])).alias(f"m{i}") for i, c in enumerate(names)])
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("null_count"), F.col("n").alias("row_count"))
        for i, c in enumerate(names)])))


def null_spikes(current: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return _emit(current, [_null_alert(thresholds)])


def outlier_alerts(outliers: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return _emit(outliers, [_outlier_alert(thresholds)])


def cardinality_shifts(current: DataFrame, baseline: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    return _emit(_joined(current, baseline), [_cardinality_alert(thresholds)])


def detect_drift(
    df: DataFrame,
    baseline: DataFrame,
    thresholds: Thresholds = Thresholds(),
    raw: DataFrame | None = None,
    exact: bool = True,
    probe_dates: bool = True,
    current: DataFrame | None = None,
    quartiles: dict[str, tuple] | None = None,
) -> DataFrame:
    """All alerts of a batch, schema alerts first.

    ``current`` and ``quartiles`` stand for the profile and the fences of ``df`` where they are known already.

    Null rates are taken from ``raw`` where given, since a cleaned batch has none left. A baseline registered under
    raw headers should go through the same header normalization first.
    """
    if current is None:
        current = profile(df, exact=exact, probe_dates=probe_dates)
    if raw is not None:
        nulls = null_counts(raw)
        current = current.drop("null_count", "row_count").join(nulls, "column_name", "left")
    stats = _joined(current, baseline).join(
        outlier_stats(df, multiplier=thresholds.iqr_multiplier, approximate=not exact, quartiles=quartiles), "column_name", "left"
    )
    alerts = [*_schema_alerts(), _null_alert(thresholds), _outlier_alert(thresholds), _cardinality_alert(thresholds)]
    return _emit(stats, alerts).orderBy(F.col("alert_order") > 3, "alert_order", "column_name")
