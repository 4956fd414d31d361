"""Requests, tasks and goals classified by their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.functions.fixed_values import DASHBOARD_PHRASES, INTENT_PHRASES, RISKY_TASK_PHRASES, SPECIALIST_PHRASES
from clearwell.operators.bi import kpi_sentence, kpi_trend, narrative
from clearwell.operators.routing import WIDGET_SETTINGS, dashboards, intent, route, routed_requests, task_gate, task_requests
from clearwell.operators.state import queue_actions
from clearwell.plans.registered.base import Registry, table

REGISTRY = Registry()

# Messages: every conversation turn in full, and one request per event in words that fit its type.
WORDING = """CASE event_type WHEN 'signup' THEN 'How many users signed up like user ' || user_id
    WHEN 'click' THEN 'How is page ' || user_id || ' RELATED TO supply?' WHEN 'view' THEN 'Recommend a budget for ' || user_id
    WHEN 'error' THEN 'Export and send the board summary of production line ' || user_id
    ELSE 'Total revenue of customer ' || user_id END"""
MESSAGES_SQL = f"""m AS (SELECT 'turn-' || conv_id || '-' || turn AS id, text FROM conversations
    UNION ALL SELECT 'event-' || event_id, {WORDING} FROM events)"""


def _messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("turn-"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("event-"), "event_id").alias("id"), F.expr(WORDING).alias("text"))
    return turns.unionByName(events)


def groups_sql(groups, default: str, column: str = "text") -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), '{p}')" for p in phrases) + f" THEN '{name}'"
        for name, phrases in groups
    )
    return f"CASE {cases} ELSE '{default}' END"


@REGISTRY.add("intent", f"WITH {MESSAGES_SQL} SELECT id, {groups_sql(INTENT_PHRASES, 'unknown')} AS intent FROM m")
def intents(spark, sf_dir):
    return _messages(spark, sf_dir).select("id", intent(F.col("text")).alias("intent"))


ROUTE_SQL = groups_sql(SPECIALIST_PHRASES, "Executive")


@REGISTRY.add("route", f"WITH {MESSAGES_SQL} SELECT id, {ROUTE_SQL} AS agent, {ROUTE_SQL} <> 'Executive' AS requires_approval FROM m")
def routes(spark, sf_dir):
    return route(_messages(spark, sf_dir)).drop("text")


@REGISTRY.add(
    "route_approvals",
    f"""WITH {MESSAGES_SQL} SELECT id, {ROUTE_SQL} AS agent_name, 'chat_recommendation' AS action_type, 'pending' AS status
        FROM m WHERE {ROUTE_SQL} <> 'Executive'""",
)
def route_approvals(spark, sf_dir):
    routed = route(_messages(spark, sf_dir)).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    return queue_actions(routed_requests(routed, "id", "text", "at")).select("id", "agent_name", "action_type", "status")


RISKY_SQL = " OR ".join(f"contains(lower(text), '{p}')" for p in RISKY_TASK_PHRASES)


@REGISTRY.add(
    "task_gate",
    f"WITH {MESSAGES_SQL} SELECT id, CASE WHEN {RISKY_SQL} THEN 'queued_for_approval' ELSE 'executed' END AS status FROM m",
)
def task_status(spark, sf_dir):
    return task_gate(_messages(spark, sf_dir), "text").drop("text")


@REGISTRY.add(
    "task_approvals",
    f"""WITH {MESSAGES_SQL} SELECT id, 'external_report_dispatch' AS action_type, 'pending' AS status FROM m WHERE {RISKY_SQL}""",
)
def task_approvals(spark, sf_dir):
    gated = task_gate(_messages(spark, sf_dir), "text").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    return queue_actions(task_requests(gated, "id", "text", "at")).select("id", "action_type", "status")


GOAL = """CASE c_mktsegment WHEN 'MACHINERY' THEN 'Improve Production at ' || c_name WHEN 'BUILDING'
    THEN 'Track maintenance budget of ' || c_name WHEN 'FURNITURE' THEN 'Quarterly REVENUE review of ' || c_name
    ELSE 'Overview of ' || c_name END"""
GROUP_SQL = groups_sql(DASHBOARD_PHRASES, "overview", "goal")
GOALS_SQL = f"g AS (SELECT c_custkey AS goal_id, {GOAL} AS goal FROM customer)"
# Every field of every widget, in the order of the dashboard.
WIDGETS_SQL = """CASE dashboard WHEN 'production' THEN
    'kpi-row;kpi_row;0;0;12;;;;;;;,production-trend;line_chart;1;0;6;Production Uptime Trend;/api/v1/bi/query;month;uptime_pct;;;'
    || ',maintenance-schedule;bar_chart;1;6;6;Maintenance Events by Region;/api/v1/bi/query;region;event_count;;;'
    || ',what-if-sim;what_if_widget;2;0;12;What-If: Adjust Maintenance Budget;;;;/api/v1/decision/simulate;;'
    WHEN 'finance' THEN
    'kpi-row;kpi_row;0;0;12;;;;;;;,revenue-breakdown;bar_chart;1;0;6;Revenue by Product Line;/api/v1/bi/query;product;revenue;;;'
    || ',cost-trend;line_chart;1;6;6;Operating Cost Trend;/api/v1/bi/query;quarter;cost;;;'
    ELSE 'kpi-row;kpi_row;0;0;12;;;;;;;,data-quality;gauge_chart;1;0;4;Data Quality Score;;;;;87;100'
    || ',agent-activity;table;1;4;8;Recent Agent Actions;/api/v1/agents/approvals;;;;;' END"""


def _goals(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("goal_id"), F.expr(GOAL).alias("goal"))


@REGISTRY.add(
    "goal_widgets",
    f"""WITH {GOALS_SQL}, d AS (SELECT goal_id, {GROUP_SQL} AS dashboard FROM g)
    SELECT goal_id, dashboard, {WIDGETS_SQL} AS widgets FROM d""",
)
def goal_widgets(spark, sf_dir):
    done = dashboards(_goals(spark, sf_dir))
    fields = ("id", "type", "row", "col", "width", "title", *WIDGET_SETTINGS)
    shown = lambda w: F.array_join(F.array(*[F.coalesce(w[f].cast("string"), F.lit("")) for f in fields]), ";")
    return done.select("goal_id", "dashboard", F.array_join(F.transform("widgets", shown), ",").alias("widgets"))


@REGISTRY.add(
    "narrative",
    f"""WITH {GOALS_SQL}, d AS (SELECT goal_id, goal, {GROUP_SQL} AS dashboard FROM g),
    s AS (SELECT o_custkey AS kpi, year(o_orderdate) AS period, round(CAST(sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS DOUBLE), 0) AS value FROM orders GROUP BY 1, 2),
    t AS (SELECT *, lag(value) OVER (PARTITION BY kpi ORDER BY period) AS previous FROM s),
    l AS (SELECT * FROM t WHERE (kpi, period) IN (SELECT kpi, max(period) FROM t GROUP BY kpi)),
    x AS (SELECT kpi AS goal_id, 'Spend is at ' || printf('%.0f', value) || ' and has ' || CASE WHEN value > previous THEN
          'improved' WHEN value < previous THEN 'declined' ELSE 'remained stable' END || ' (' ||
          CASE WHEN value > previous THEN '+' ELSE '' END || printf('%.0f', coalesce(value - previous, 0)) || ')' AS sentence FROM l)
    SELECT goal_id, CASE WHEN dashboard = 'production' THEN 4 ELSE 3 END AS widget_count,
        'This dashboard was generated for the goal: "' || goal || '". It contains ' ||
        CASE WHEN dashboard = 'production' THEN 4 ELSE 3 END || ' widgets. ' || coalesce(sentence, '') ||
        ' Use the what-if simulation widgets to explore the impact of different interventions.' AS narrative
    FROM d LEFT JOIN x USING (goal_id)""",
)
def narratives(spark, sf_dir):
    """A text per goal from its widgets and the newest yearly trend of its customer."""
    series = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("kpi"), F.year("o_orderdate").alias("period")).agg(
        F.round(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double"), 0).alias("value"))
    trend = kpi_trend(series)
    newest = trend.groupBy("kpi").agg(F.max_by(F.struct("value", "change", "trend_word"), "period").alias("t"))
    spoken = kpi_sentence(newest.select(F.col("kpi").alias("goal_id"), F.lit("Spend").alias("kpi"), "t.*"), 0)
    return narrative(dashboards(_goals(spark, sf_dir)), spoken.select("goal_id", "kpi", "sentence"))
