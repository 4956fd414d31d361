"""Grouped measures, trends and their wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_total(df: DataFrame, by: list[Column | str], value: Column, name: str, where: Column | None = None) -> DataFrame:
    """Sum of one value per group after an optional filter, which reaches the scan."""
    source = df if where is None else df.where(where)
    return source.groupBy(*by).agg(F.sum(value).alias(name))


def period_totals(df: DataFrame, time: Column, unit: str, value: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum per calendar period (``month``, ``quarter``, …) and optional dimensions."""
    return df.groupBy(F.date_trunc(unit, time).alias("period"), *by).agg(F.sum(value).alias(name))


def period_share(df: DataFrame, time: Column, unit: str, hit: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Percentage of rows that satisfy a condition per period, e.g. uptime."""
    share = 100.0 * F.count_if(hit) / F.count(F.lit(1))
    return df.groupBy(F.date_trunc(unit, time).alias("period"), *by).agg(share.alias(name))


def group_counts(df: DataFrame, by: list[Column | str], name: str = "event_count") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def grouped_axes(df: DataFrame, axes: dict[str, list[str]], measures: list[Column]) -> DataFrame:
    """Measures by several axes from one scan: ``(axis, labels, measures...)``, a row for each group of each axis.

    ``axes`` names sets of columns; ``labels`` maps a group's columns to its values as text, null for a null. Every row is counted once for
    each axis on the map side, so what is shuffled are the groups. Columns of an axis may be null: a null is a group of its own.
    """
    columns = list(dict.fromkeys(c for own in axes.values() for c in own))
    sets = [[F.col(c) for c in own] for own in axes.values()]
    grouped = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("_set"), *measures)
    # a bit is set for each column that a grouping set leaves out, the first column's in front
    def mark(own: list[str]) -> int:
        return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in own)

    name, labels = F.lit(None).cast("string"), F.lit(None).cast("map<string, string>")
    for axis, own in axes.items():
        is_it = F.col("_set") == mark(own)
        name = F.when(is_it, axis).otherwise(name)
        labels = F.when(is_it, F.create_map(*[x for c in own for x in (F.lit(c), F.col(c).cast("string"))])).otherwise(labels)
    return grouped.select(name.alias("axis"), labels.alias("labels"), *[c for c in grouped.columns if c not in columns and c != "_set"])


def kpi_trend(series: DataFrame) -> DataFrame:
    """Change against the period before and its wording, for ``series(kpi, period, value)``.

    The series is already one row per KPI and calendar period, so a window holds a calendar and not the raw rows.
    """
    before = F.lag("value").over(Window.partitionBy("kpi").orderBy("period"))
    change = F.col("value") - F.col("previous")
    word = F.when(change > 0, "improved").when(change < 0, "declined").otherwise("remained stable")
    direction = F.when(change > 0, "up").when(change < 0, "down").otherwise("neutral")
    return series.withColumn("previous", before).withColumns(
        {"change": change, "trend_direction": direction, "trend_word": word}
    )


def kpi_sentence(trend: DataFrame, digits: int = 1) -> DataFrame:
    """One sentence per KPI and period."""
    number = lambda c: F.format_string(f"%.{digits}f", F.bround(c, digits))
    change = F.coalesce(F.col("change"), F.lit(0.0))
    signed = F.concat(F.when(change > 0, F.lit("+")).otherwise(F.lit("")), number(change))
    return trend.withColumn("sentence", F.concat(
        F.col("kpi"), F.lit(" is at "), number(F.col("value")), F.lit(" and has "), F.col("trend_word"), F.lit(" ("),
        signed, F.lit(")")))


def narrative(dashboards: DataFrame, sentences: DataFrame) -> DataFrame:
    """One text per dashboard: ``dashboards(goal_id, goal, widgets)``, ``sentences(goal_id, kpi, sentence)``.

    The sentences of a goal are those of its KPI row, a handful by design of the dashboard.
    """
    joined = sentences.groupBy("goal_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("kpi", "sentence")))["sentence"], " ").alias("summary"))
    return dashboards.join(joined, "goal_id", "left").select(
        "goal_id",
        F.size("widgets").alias("widget_count"),
        F.concat(F.lit('This dashboard was generated for the goal: "'), "goal", F.lit('". It contains '),
                 F.size("widgets"), F.lit(" widgets. "), F.coalesce("summary", F.lit("")),
                 F.lit(" Use the what-if simulation widgets to explore the impact of different interventions.")).alias(
            "narrative"),
    )
