"""Repair strategies, the risk gate and the repairs themselves."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearwell.functions.fixed_values import IQR_MULTIPLIER, REPAIR_STRATEGIES, RISK_ORDER
from clearwell.functions.numeric import clamp, present
from clearwell.functions.text import parse_timestamp
from clearwell.functions.types import numeric_columns, physical_type, quoted
from clearwell.operators.frequent import COUNTED_TYPES, most_frequent
from clearwell.operators.profile import profile
from clearwell.operators.quantiles import exact_medians, exact_quantiles

ACTION_SCHEMA = (
    "drift_alert_id bigint, strategy string, risk_level string, status string, description string, "
    "before_snapshot string, after_snapshot string"
)


def choose_repair(alerts: DataFrame) -> DataFrame:
    """Add strategy, risk and description: the first registry entry that lists the alert type.

    The registry is five fixed rules, so it is a case expression and not a join.
    """
    chain = None
    for name, risk, kinds, text in REPAIR_STRATEGIES:
        entry = F.struct(F.lit(name).alias("strategy"), F.lit(risk).alias("risk_level"),
                         F.lit(text).alias("repair_description"))
        hit = F.col("alert_type").isin(*kinds)
        chain = F.when(hit, entry) if chain is None else chain.when(hit, entry)
    return alerts.withColumn("_choice", chain).select("*", "_choice.*").drop("_choice")


def risk_rank(c: Column) -> Column:
    chain = None
    for rank, name in enumerate(RISK_ORDER):
        chain = F.when(c == name, rank) if chain is None else chain.when(c == name, rank)
    return chain.otherwise(len(RISK_ORDER) - 1)


def gate(chosen: DataFrame, max_risk: str = "low") -> DataFrame:
    """Repairs up to ``max_risk`` may run, the others wait for approval; alerts without a strategy are left out."""
    ceiling = RISK_ORDER.index(max_risk) if max_risk in RISK_ORDER else 0
    status = F.when(risk_rank(F.col("risk_level")) <= ceiling, F.lit("applied")).otherwise("queued_for_approval")
    return chosen.where(F.col("strategy").isNotNull()).withColumn("status", status)


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent non-null value per column, the smallest on ties, ``None`` for an empty column.

    Texts, booleans and dates of all columns share two or three jobs (``most_frequent``); other types are counted by key, a
    job each. No task ever holds all distinct values of a column.
    """
    types = dict(df.dtypes)
    together = [c for c in columns if types[c] in COUNTED_TYPES]
    found = most_frequent(df, together)
    modes: dict[str, object] = {c: found[c][0] if found[c] else None for c in together}
    typed = [c for c in together if types[c] != "string" and modes[c] is not None]
    if typed:
        row = df.sparkSession.range(1).select(*[F.lit(modes[c]).cast(types[c]).alias(f"m{i}") for i, c in enumerate(typed)]).first()
        modes.update(zip(typed, row))
    for c in columns:
        if c in modes:
            continue
        counted = df.where(F.col(quoted(c)).isNotNull()).groupBy(F.col(quoted(c)).alias("v")).count()
        best = counted.agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("v"))).alias("best")).first()["best"]
        modes[c] = best["v"] if best is not None else None
    return {c: modes[c] for c in columns}


def backfill_nulls(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, object]]:
    """Fill nulls with the median of a numeric column and the mode of any other; returns the fills too."""
    types, numbers = dict(df.dtypes), numeric_columns(df)
    fills: dict[str, object] = dict(exact_medians(df, [c for c in columns if c in numbers]))
    modes = column_modes(df, [c for c in columns if c not in numbers])
    fills.update({c: "UNKNOWN" if v is None and types[c] == "string" else v for c, v in modes.items()})
    filled = {}
    for c, value in fills.items():
        if value is None:
            continue
        col = present(F.col(quoted(c)), types[c])
        if c in numbers and types[c] != "double":
            whole = float(value).is_integer()
            fill = F.lit(int(value)).cast(types[c]) if whole else F.lit(float(value))
        else:
            fill = F.lit(value)
        filled[c] = F.coalesce(col, fill)
    return (df.withColumns(filled) if filled else df), fills


@dataclass(frozen=True)
class Bounds:
    low: float
    high: float


def clamp_bounds(
    df: DataFrame, columns: list[str], sigma: float = 3.0, method: str = "sigma"
) -> dict[str, Bounds]:
    """Mean ± ``sigma`` sample deviations, or IQR fences with ``method="iqr"``; columns without spread are left out."""
    if method not in ("sigma", "iqr"):
        raise ValueError(f"unknown clamp method {method!r}")
    columns = [c for c in columns if c in numeric_columns(df)]
    if not columns:
        return {}
    if method == "iqr":
        quartiles = exact_quantiles(df, columns, [0.25, 0.75])
        return {c: Bounds(q1 - IQR_MULTIPLIER * (q3 - q1), q3 + IQR_MULTIPLIER * (q3 - q1))
                for c, (q1, q3) in quartiles.items() if q1 is not None}
    types = dict(df.dtypes)
    value = {c: present(F.col(quoted(c)), types[c]).cast("double") for c in columns}
    row = df.agg(*[f(value[c]).alias(f"{k}{i}") for i, c in enumerate(columns)
                   for k, f in (("mean", F.avg), ("std", F.stddev_samp))]).first()
    return {c: Bounds(row[f"mean{i}"] - sigma * row[f"std{i}"], row[f"mean{i}"] + sigma * row[f"std{i}"])
            for i, c in enumerate(columns) if row[f"std{i}"] is not None}


def clamp_outliers(df: DataFrame, bounds: dict[str, Bounds]) -> DataFrame:
    """Values outside the bounds become the bounds. Whole numbers stay whole and keep their type: a cell inside is left as it is, and one
    outside takes the nearest whole number inside, or the bound itself, rounded, where there is none."""
    types = dict(df.dtypes)
    fields = {f.name: f.dataType for f in df.schema.fields}

    def clamped(c: str, b: Bounds) -> Column:
        col = present(F.col(quoted(c)), types[c])
        as_double = col.cast("double")
        if not _is_whole(fields[c]):
            return clamp(as_double, b.low, b.high)
        low, high = math.ceil(b.low), math.floor(b.high)
        if low > high:
            low = high = round((b.low + b.high) / 2)
        bound = lambda v: F.lit(v).cast("decimal(38,0)").try_cast(types[c])
        return F.when(as_double < b.low, F.coalesce(bound(low), col)).when(as_double > b.high, F.coalesce(bound(high), col)).otherwise(col)

    return df.withColumns({c: clamped(c, b) for c, b in bounds.items()})


def _is_whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)


def clamp_counts(df: DataFrame, bounds: dict[str, Bounds]) -> dict[str, tuple[int, int]]:
    if not bounds:
        return {}
    row = clamp_count_row(df, bounds).first()
    return {c: (row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(bounds)}


def clamp_count_row(df: DataFrame, bounds: dict[str, Bounds]) -> DataFrame:
    """One row: values below (``l0``, ``l1``, ...) and above (``h0``, ...) the bounds, by the order of the columns."""
    types = dict(df.dtypes)
    aggs = []
    for i, (c, b) in enumerate(bounds.items()):
        v = present(F.col(quoted(c)), types[c]).cast("double")
        aggs += [F.count_if(v < b.low).alias(f"l{i}"), F.count_if(v > b.high).alias(f"h{i}")]
    return df.agg(*aggs)


def cast_expression(c: Column, target: str) -> Column:
    """Safe cast by logical type: integers truncate and default to 0, the others become null where unparseable."""
    if target in ("integer", "int64"):
        return F.coalesce(integer_or_null(c), F.lit(0).cast("bigint"))
    if target in ("float", "float64"):
        return c.try_cast("double")
    if target == "datetime":
        return parse_timestamp(c.cast("string"))
    if target == "boolean":
        return c.cast("string").try_cast("boolean")
    return c.cast("string")


def integer_or_null(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number.try_cast("bigint"))


def cast_errors(c: Column, target: str) -> Column:
    """True where a value was there and the cast lost it."""
    result = integer_or_null(c) if target in ("integer", "int64") else cast_expression(c, target)
    return c.isNotNull() & result.isNull()


def cast_columns(df: DataFrame, targets: dict[str, str]) -> DataFrame:
    return df.withColumns({c: cast_expression(F.col(quoted(c)), t) for c, t in targets.items()})


def coerce_schema(
    df: DataFrame, baseline: list[tuple[str, str]], drop_extra: bool = False
) -> tuple[DataFrame, list[str], list[str]]:
    """Add the baseline columns a batch lacks; returns the table, the columns added and the extra ones found."""
    defaults = {"integer": F.lit(0), "float": F.lit(0), "boolean": F.lit(False), "datetime": F.lit(None)}
    expected = dict(baseline)
    added = [n for n in expected if n not in df.columns]
    extra = [c for c in df.columns if c not in expected]
    out = df.withColumns(
        {n: defaults.get(expected[n], F.lit("UNKNOWN")).cast(physical_type(expected[n])) for n in added}
    ) if added else df
    return (out.drop(*extra) if drop_extra else out), added, extra


def split_quarantine(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that satisfy ``valid`` and all the others; a null condition means not valid."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def snapshot(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Null count, distinct values, type and rounded statistics of some columns."""
    stats = profile(df.select(*[quoted(c) for c in columns]), exact=exact, probe_dates=False)
    return stats.select(
        "column_name", "null_count", "distinct_values", F.col("data_type").alias("dtype"),
        *[F.bround(c, 4).alias(a) for c, a in (("min", "min"), ("max", "max"), ("mean", "mean"), ("stddev", "std"))],
    )


def _snapshots(df: DataFrame, columns: list[str], exact: bool) -> dict[str, dict]:
    wanted = [c for c in dict.fromkeys(columns) if c in df.columns]
    if not wanted:
        return {}
    rows = snapshot(df, wanted, exact).collect()  # one row per repaired column
    return {r["column_name"]: {k: v for k, v in r.asDict().items() if k != "column_name" and v is not None}
            for r in rows}


def apply_repairs(
    df: DataFrame,
    alerts: DataFrame,
    baseline: list[tuple[str, str]] | None = None,
    max_risk: str = "low",
    exact: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Repair a batch by its alerts; returns the repaired table and one action row per alert.

    Alerts are one row per column and finding, which is all the driver reads. Repairs of different columns do not
    touch each other, so they run in rounds: the first alert of every column in one round, the second in the next.
    ``alerts`` may carry an ``id``.
    """
    ids = alerts if "id" in alerts.columns else alerts.withColumn("id", F.lit(None).cast("bigint"))
    pending = gate(choose_repair(ids), max_risk).orderBy("alert_order", "column_name").collect()
    actions: list[tuple] = []
    rounds: list[list[Row]] = []
    seen: dict[object, int] = {}
    for alert in pending:
        if alert["status"] != "applied":
            actions.append(_action(alert, "queued_for_approval", {}, {}))
            continue
        at = seen.get(alert["column_name"], 0)
        seen[alert["column_name"]] = at + 1
        if at == len(rounds):
            rounds.append([])
        rounds[at].append(alert)
    known: dict[str, dict] = {}  # snapshots after one round are those before the next
    for batch in rounds:
        df, done, known = _repair_round(df, batch, baseline, exact, known)
        actions += done
    return df, df.sparkSession.createDataFrame(actions, ACTION_SCHEMA)


def _action(alert: Row, status: str, before: dict, after: dict) -> tuple:
    dump = lambda d: json.dumps(d, ensure_ascii=False, sort_keys=True, default=str) if d else None
    return (alert["id"], alert["strategy"], alert["risk_level"], status, alert["repair_description"],
            dump(before), dump(after))


def _repair_round(
    df: DataFrame, batch: list[Row], baseline, exact: bool, known: dict[str, dict]
) -> tuple[DataFrame, list[tuple], dict[str, dict]]:
    by: dict[str, list[Row]] = {}
    outcome: dict[int, tuple[str, dict]] = {}
    numbers = numeric_columns(df)
    for i, alert in enumerate(batch):
        c = alert["column_name"]
        details = json.loads(alert["details"]) if alert["details"] else {}
        if alert["strategy"] != "schema_coercion" and c not in df.columns:
            outcome[i] = ("failed", {"error": f"no column {c!r}"})
        elif alert["strategy"] == "outlier_clamp" and c not in numbers:
            outcome[i] = ("skipped", {"skipped": True, "reason": "non-numeric column"})
        elif alert["strategy"] == "outlier_clamp" and "outlier_count" not in details:
            outcome[i] = ("skipped", {"skipped": True, "reason": "no outlier evidence"})
        elif alert["strategy"] == "schema_coercion" and baseline is None:
            outcome[i] = ("skipped", {"skipped": True, "reason": "no applicable handler"})
        else:
            by.setdefault(alert["strategy"], []).append((i, c, details))
    touched = [c for group in by.values() for _, c, _ in group]
    before = {c: known[c] for c in touched if c in known}
    before |= _snapshots(df, [c for c in touched if c not in before], exact)

    if group := by.get("null_backfill"):
        df, fills = backfill_nulls(df, [c for _, c, _ in group])
        for i, c, _ in group:
            outcome[i] = ("applied", {"column": c, "fill_value": str(fills[c]),
                                      "nulls_before": before[c]["null_count"],
                                      "nulls_after": 0 if fills[c] is not None else before[c]["null_count"]})
    if group := by.get("outlier_clamp"):
        bounds = clamp_bounds(df, [c for _, c, _ in group])
        counts = clamp_counts(df, bounds)
        df = clamp_outliers(df, bounds)
        for i, c, _ in group:
            if c in bounds:
                low, high = counts[c]
                outcome[i] = ("applied", {"column": c, "clamped_low": low, "clamped_high": high,
                                          "bounds": {"lower": round(bounds[c].low, 4),
                                                     "upper": round(bounds[c].high, 4)}})
            else:
                outcome[i] = ("skipped", {"skipped": True, "reason": "no spread"})
    if group := by.get("type_cast"):
        targets = {c: d.get("expected_type", "string") for _, c, d in group}
        row = df.agg(*[F.count_if(cast_errors(F.col(quoted(c)), t)).alias(f"e{k}")
                       for k, (c, t) in enumerate(targets.items())]).first()
        errors = {c: row[f"e{k}"] for k, c in enumerate(targets)}
        types = dict(df.dtypes)
        df = cast_columns(df, targets)
        for i, c, _ in group:
            outcome[i] = ("applied", {"column": c, "from_type": types[c], "to_type": targets[c],
                                      "coercion_errors": errors[c]})
    if group := by.get("schema_coercion"):
        df, added, extra = coerce_schema(df, baseline)
        for i, _, _ in group:
            outcome[i] = ("applied", {"columns_added": added, "extra_columns_detected": extra})

    after = _snapshots(df, touched, exact)
    done = []
    for i, alert in enumerate(batch):
        status, details = outcome[i]
        c = alert["column_name"]
        done.append(_action(alert, status, before.get(c, {}), {**after.get(c, {}), **details}))
    return df, done, known | after


def resolve_alerts(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Mark the alerts whose repair was applied; both sides are keyed by alert id."""
    done = actions.where("status = 'applied'").select(F.col("drift_alert_id").alias("id")).distinct()
    return (
        alerts.join(done.withColumn("_done", F.lit(True)), "id", "left")
        .withColumns({"resolved": F.coalesce("_done", F.lit(False)),
                      "resolved_by": F.when(F.col("_done"), F.lit("auto_repair"))})
        .drop("_done")
    )
