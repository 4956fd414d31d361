"""Keyword classification of requests, tasks and dashboard goals: generated substring tests over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.functions.fixed_values import (
    DASHBOARD_PHRASES,
    DASHBOARD_WIDGETS,
    DEFAULT_AGENT,
    DEFAULT_DASHBOARD,
    DEFAULT_INTENT,
    INTENT_PHRASES,
    RISKY_TASK_PHRASES,
    SPECIALIST_PHRASES,
)
from clearwell.functions.text import contains_any, first_group


def intent(c: Column) -> Column:
    return first_group(c, INTENT_PHRASES, DEFAULT_INTENT)


def specialist(c: Column) -> Column:
    return first_group(c, SPECIALIST_PHRASES, DEFAULT_AGENT)


def route(messages: DataFrame, text: str = "text") -> DataFrame:
    """Agent per message; what a specialist handles needs approval."""
    agent = specialist(F.col(text))
    return messages.withColumn("agent", agent).withColumn("requires_approval", F.col("agent") != DEFAULT_AGENT)


def routed_requests(routed: DataFrame, id: str, text: str, at: str) -> DataFrame:
    """Approval requests of the routed messages that need one, in the form ``queue_actions`` takes."""
    return routed.where("requires_approval").select(
        F.col(id).alias("id"), F.col("agent").alias("agent_name"), F.lit("chat_recommendation").alias("action_type"),
        F.to_json(F.struct(F.col(text).alias("message"))).alias("proposed_payload"),
        F.concat("agent", F.lit(" agent needs approval")).alias("reasoning"), F.col(at).alias("created_at"))


def task_gate(tasks: DataFrame, text: str = "task") -> DataFrame:
    """External or high-risk tasks are queued for approval, all others run."""
    risky = contains_any(F.lower(F.col(text)), RISKY_TASK_PHRASES)
    return tasks.withColumn("status", F.when(risky, F.lit("queued_for_approval")).otherwise(F.lit("executed")))


def task_requests(gated: DataFrame, id: str, text: str, at: str, agent_name: str = "assistant") -> DataFrame:
    return gated.where("status = 'queued_for_approval'").select(
        F.col(id).alias("id"), F.lit(agent_name).alias("agent_name"),
        F.lit("external_report_dispatch").alias("action_type"),
        F.to_json(F.struct(F.col(text).alias("task"))).alias("proposed_payload"),
        F.lit("External task gated for explicit human review.").alias("reasoning"), F.col(at).alias("created_at"))


def dashboard_group(c: Column) -> Column:
    return first_group(c, DASHBOARD_PHRASES, DEFAULT_DASHBOARD)


WIDGET_SETTINGS = ("data_source", "x_axis", "y_axis", "simulation_endpoint", "value", "max")


def dashboards(goals: DataFrame, text: str = "goal") -> DataFrame:
    """Group and widget list per goal; the widget sets are fixed, so they are literals of a case expression."""

    def widgets(group: str) -> Column:
        return F.array(*[
            F.struct(F.lit(name).alias("id"), F.lit(kind).alias("type"), F.lit(row).alias("row"),
                     F.lit(col).alias("col"), F.lit(width).alias("width"), F.lit(title).cast("string").alias("title"),
                     *[F.lit(settings.get(s)).cast("string").alias(s) for s in WIDGET_SETTINGS])
            for g, name, kind, row, col, width, title, settings in DASHBOARD_WIDGETS if g in ("all", group)
        ])

    chosen = None
    for group, _ in DASHBOARD_PHRASES:
        hit = F.col("dashboard") == group
        chosen = F.when(hit, widgets(group)) if chosen is None else chosen.when(hit, widgets(group))
    return goals.withColumn("dashboard", dashboard_group(F.col(text))).withColumn(
        "widgets", chosen.otherwise(widgets(DEFAULT_DASHBOARD)))
