"""Scenario simulation, recommendations, KPIs and dashboards data."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.functions.fixed_values import FALLBACK_OUTCOMES, NOTE_LOW_CONFIDENCE
from clearwell.operators.bi import (
    group_counts,
    group_total,
    kpi_sentence,
    kpi_trend,
    period_share,
    period_totals,
)
from clearwell.operators.causal import (
    apply_to_kpis,
    match_events,
    outcome_counts,
    rank_outcomes,
    recommend,
    shown,
    simulate_interventions,
    simulate_scenarios,
    with_fallback,
)
from clearwell.plans.registered.base import Registry, table

REGISTRY = Registry()

# One link per part name: the name is the event, its average size the confidence.
LINKS_SQL = """links AS (SELECT min(p_partkey) AS link_id, replace(p_name, ' ', '_') AS source_event,
    CASE WHEN p_name < 'm' THEN 'production_uptime' ELSE 'revenue' END AS target_metric,
    (avg(p_size) + 15) / 50 AS confidence_score, 'Parts named ' || p_name AS description FROM part GROUP BY p_name)"""
# Scenarios: a sentence per part in mixed case, one word for large parts, and every conversation turn.
SCENARIOS_SQL = """scenarios AS (SELECT 'part-' || p_partkey AS scenario_id,
        CASE WHEN p_size > 45 THEN upper(split_part(p_name, ' ', 2)) ELSE 'Delay of ' || upper(p_name) || ' from ' || p_brand
        END AS scenario FROM part
    UNION ALL SELECT 'turn-' || conv_id || '-' || turn, text FROM conversations)"""
MATCHED_SQL = """m AS (SELECT scenario_id, links.* FROM scenarios JOIN links
    ON contains(lower(scenario), replace(source_event, '_', ' ')) OR contains(replace(source_event, '_', ' '), lower(scenario)))"""
OUTCOMES_SQL = f"""{LINKS_SQL}, {SCENARIOS_SQL}, {MATCHED_SQL}, outcomes AS (
    SELECT scenario_id, 'Address ' || source_event AS intervention, target_metric AS affected_metric,
           confidence_score * 10 AS change_pct, confidence_score AS confidence,
           CASE WHEN confidence_score > 0.8 THEN 'low' ELSE 'medium' END AS risk_level, description AS explanation,
           link_id AS input_order FROM m)"""
FALLBACK_SQL = " UNION ALL ".join(
    f"SELECT CAST({r} AS BIGINT) AS rank, '{i}' AS intervention, '{m}' AS affected_metric, CAST({c} AS DOUBLE) AS change_pct, "
    f"CAST({k} AS DOUBLE) AS confidence, '{risk}' AS risk_level, '{why}' AS explanation"
    for r, i, m, c, k, risk, why in FALLBACK_OUTCOMES
)


def _links(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(
        F.min("p_partkey").alias("link_id"), ((F.avg("p_size") + 15) / 50).alias("confidence_score")
    ).select(
        "link_id", F.replace("p_name", F.lit(" "), F.lit("_")).alias("source_event"),
        F.when(F.col("p_name") < "m", "production_uptime").otherwise("revenue").alias("target_metric"),
        "confidence_score", F.concat(F.lit("Parts named "), "p_name").alias("description"))


def _scenarios(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("scenario_id"),
        F.when(F.col("p_size") > 45, F.upper(F.split_part("p_name", F.lit(" "), F.lit(2))))
        .otherwise(F.concat(F.lit("Delay of "), F.upper("p_name"), F.lit(" from "), "p_brand")).alias("scenario"))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("turn-"), "conv_id", F.lit("-"), "turn"), "text")
    return parts.union(turns)


SHOWN = "scenario_id, intervention, affected_metric, change_pct, confidence, risk_level, explanation"


@REGISTRY.add("simulate_scenarios", f"WITH {OUTCOMES_SQL} SELECT {SHOWN} FROM outcomes")
def scenarios_(spark, sf_dir):
    return simulate_scenarios(_scenarios(spark, sf_dir), _links(spark, sf_dir)).drop("input_order")


@REGISTRY.add("match_many_events", f"WITH {LINKS_SQL}, {SCENARIOS_SQL}, {MATCHED_SQL} SELECT scenario_id, source_event FROM m")
def match_many(spark, sf_dir):
    """Which events each text touches."""
    return match_events(_scenarios(spark, sf_dir), _links(spark, sf_dir))


@REGISTRY.add(
    "ranked_outcomes",
    f"""WITH {OUTCOMES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY scenario_id
            ORDER BY confidence DESC, input_order) AS rank FROM outcomes),
    f AS ({FALLBACK_SQL})
    SELECT rank, {SHOWN} FROM ranked UNION ALL
    SELECT rank, {SHOWN} FROM (SELECT scenario_id FROM scenarios WHERE scenario_id NOT IN
        (SELECT scenario_id FROM outcomes)), f""",
)
def ranked(spark, sf_dir):
    """Ranked outcomes of every scenario, the two fixed ones where nothing matched."""
    scenarios = _scenarios(spark, sf_dir)
    outcomes = rank_outcomes(simulate_scenarios(scenarios, _links(spark, sf_dir)))
    return with_fallback(scenarios, outcomes)


@REGISTRY.add(
    "fallback",
    f"""WITH {OUTCOMES_SQL}, f AS ({FALLBACK_SQL})
    SELECT scenario_id, count(*) AS total_outcomes FROM (
        SELECT scenario_id FROM outcomes UNION ALL
        SELECT scenario_id FROM scenarios, f WHERE scenario_id NOT IN (SELECT scenario_id FROM outcomes))
    GROUP BY scenario_id""",
)
def fallback_counts(spark, sf_dir):
    scenarios = _scenarios(spark, sf_dir)
    return outcome_counts(with_fallback(scenarios, simulate_scenarios(scenarios, _links(spark, sf_dir))))


@REGISTRY.add(
    "recommend",
    f"""WITH {OUTCOMES_SQL}, f AS ({FALLBACK_SQL}), best AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY confidence DESC, input_order) AS r
        FROM outcomes) WHERE r = 1),
    top AS (SELECT {SHOWN}
            FROM best UNION ALL SELECT scenario_id, intervention, affected_metric, change_pct, confidence, risk_level, explanation
            FROM scenarios, f WHERE rank = 1 AND scenario_id NOT IN (SELECT scenario_id FROM best))
    SELECT scenario_id, intervention AS recommendation, affected_metric, change_pct,
           confidence, risk_level, explanation,
           CASE WHEN confidence < 0.6 THEN 'warning' WHEN risk_level = 'high' THEN 'flagged' ELSE 'passed' END
           AS governance_status,
           CASE WHEN confidence < 0.6 THEN '{NOTE_LOW_CONFIDENCE}' ELSE '' END AS notes,
           'Event:' || intervention AS lineage FROM top""",
)
def recommendations(spark, sf_dir):
    scenarios = _scenarios(spark, sf_dir)
    done = recommend(scenarios, simulate_scenarios(scenarios, _links(spark, sf_dir)))
    return done.withColumn("notes", F.array_join("governance_notes", "|")).drop("governance_notes")


# Interventions: fifty scenarios by part size, one intervention per part, its price the magnitude.
STEPS_SQL = f"""{LINKS_SQL}, steps AS (SELECT p_size AS scenario_id, p_partkey AS seq,
    CASE WHEN p_brand = 'Brand#1' THEN 'unknown_event' ELSE replace(p_name, ' ', '_') END AS event,
    p_retailprice / 1000 - 0.5 AS magnitude FROM part),
    adj AS (SELECT scenario_id, seq, event, target_metric, description, link_id,
            least(greatest(confidence_score * magnitude, 0), 1) AS c, round_even(c, 2) AS rc
            FROM steps JOIN links ON event = source_event)"""


def _steps(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_size").alias("scenario_id"), F.col("p_partkey").alias("seq"),
        F.when(F.col("p_brand") == "Brand#1", "unknown_event").otherwise(
            F.replace("p_name", F.lit(" "), F.lit("_"))).alias("event"),
        (F.col("p_retailprice") / 1000 - 0.5).alias("magnitude"))


@REGISTRY.add(
    "simulate_interventions",
    f"""WITH {STEPS_SQL} SELECT scenario_id, seq, target_metric AS affected_metric, c * 10 AS change_pct, rc AS confidence,
        CASE WHEN c > 0.8 THEN 'low' WHEN c > 0.5 THEN 'medium' ELSE 'high' END AS risk_level,
        description AS explanation FROM adj""",
)
def interventions(spark, sf_dir):
    done = simulate_interventions(_steps(spark, sf_dir), _links(spark, sf_dir))
    return done.withColumn("seq", F.col("input_order.seq")).drop("input_order", "intervention")


@REGISTRY.add(
    "rank_interventions",
    f"""WITH {STEPS_SQL} SELECT scenario_id, seq, row_number() OVER (PARTITION BY scenario_id
        ORDER BY rc DESC, seq, link_id) AS rank FROM adj""",
)
def rank_interventions(spark, sf_dir):
    """Ranks inside fifty large scenarios, whose rows spread over all tasks."""
    done = rank_outcomes(simulate_interventions(_steps(spark, sf_dir), _links(spark, sf_dir)))
    return done.select("scenario_id", F.col("input_order.seq").alias("seq"), "rank")


@REGISTRY.add(
    "outcome_labels",
    f"""WITH {STEPS_SQL} SELECT seq, rc AS confidence,
        '+' || printf('%.1f', round_even(c * 10, 1)) || '%' AS predicted_change FROM adj""",
)
def outcome_labels(spark, sf_dir):
    done = shown(simulate_interventions(_steps(spark, sf_dir), _links(spark, sf_dir)))
    return done.select(F.col("input_order.seq").alias("seq"), "confidence", "predicted_change")


@REGISTRY.add(
    "kpi_apply",
    f"""WITH {STEPS_SQL}, k AS (SELECT p_size AS scenario_id, 94.3 - CAST(p_size AS DECIMAL(4, 0)) * 0.1 AS u,
            2.4 + CAST(p_size AS DECIMAL(4, 0)) * 0.1 AS v FROM part
            GROUP BY p_size),
    last AS (SELECT scenario_id, target_metric, round_even(c * 10, 1) AS change FROM (SELECT *, row_number() OVER (
             PARTITION BY scenario_id, target_metric ORDER BY rc, seq DESC, link_id DESC) AS r FROM adj) WHERE r = 1)
    SELECT k.scenario_id AS scenario_id,
        CASE WHEN a.change IS NULL THEN CAST(u AS DOUBLE) ELSE least(100, floor((CAST(u AS DOUBLE) + a.change) * 10 + 0.5) / 10)
        END AS production_uptime,
        coalesce(floor((CAST(v AS DOUBLE) + b.change / 10) * 10 + 0.5) / 10, CAST(v AS DOUBLE)) AS revenue
    FROM k LEFT JOIN last a ON a.scenario_id = k.scenario_id AND a.target_metric = 'production_uptime'
    LEFT JOIN last b ON b.scenario_id = k.scenario_id AND b.target_metric = 'revenue'""",
)
def kpi_apply(spark, sf_dir):
    kpis = table(spark, sf_dir, "part").select(F.col("p_size").alias("scenario_id")).distinct().withColumns({
        "production_uptime": (F.lit(94.3).cast("decimal(4,1)") - F.col("scenario_id") * F.lit(0.1).cast("decimal(2,1)")).cast("double"),
        "revenue": (F.lit(2.4).cast("decimal(4,1)") + F.col("scenario_id") * F.lit(0.1).cast("decimal(2,1)")).cast("double")})
    return apply_to_kpis(kpis, simulate_interventions(_steps(spark, sf_dir), _links(spark, sf_dir)))


def _day(c):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _revenue_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("revenue"))


def _customer_regions(spark, sf_dir):
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = regions.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"))
    return table(spark, sf_dir, "customer").join(named, "c_nationkey").select("c_custkey", "region")


@REGISTRY.add(
    "revenue_by_region",
    """SELECT r_name AS region, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
       FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
       JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
       JOIN region ON r_regionkey = n_regionkey WHERE p_type = 'PROMO' GROUP BY r_name""",
)
def revenue_by_region(spark, sf_dir):
    """Revenue per region for one category. The category cuts the line items first, and every join is met by sums: an
    order or a customer with a third of all rows is one row before it is joined."""
    promo = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select("p_partkey")
    sold = _revenue_lines(spark, sf_dir).join(promo, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    per_order = sold.groupBy("l_orderkey").agg(F.sum("revenue").alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    per_customer = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey").agg(F.sum("revenue").alias("revenue"))
    )
    joined = per_customer.join(_customer_regions(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return group_total(joined, ["region"], F.col("revenue"), "revenue").withColumn("revenue", F.col("revenue").cast("double"))


@REGISTRY.add(
    "uptime_trend",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, round(100.0 * count_if(event_type <> 'error') / count(*), 6) AS uptime_pct
       FROM events GROUP BY 1""",
)
def uptime_trend(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    done = period_share(events, F.col("ts"), "day", F.col("event_type") != "error", "uptime_pct")
    return done.select(_day("period"), F.round("uptime_pct", 6).alias("uptime_pct"))


@REGISTRY.add(
    "monthly_trend",
    "SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS period, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1",
)
def monthly_trend(spark, sf_dir):
    done = period_totals(table(spark, sf_dir, "lineitem"), F.col("l_shipdate"), "month", F.col("l_extendedprice"), "revenue")
    return done.select(_day("period"), F.round("revenue", 2).alias("revenue"))


@REGISTRY.add(
    "quarterly_cost",
    """SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, o_orderpriority, round(sum(o_totalprice), 2) AS cost
       FROM orders GROUP BY 1, 2""",
)
def quarterly_cost(spark, sf_dir):
    done = period_totals(table(spark, sf_dir, "orders"), F.col("o_orderdate"), "quarter", F.col("o_totalprice"), "cost",
                         ("o_orderpriority",))
    return done.select(_day("period"), "o_orderpriority",
                       F.round("cost", 2).alias("cost"))


@REGISTRY.add(
    "events_by_region",
    """SELECT r_name AS region, count(*) AS event_count FROM orders JOIN customer ON c_custkey = o_custkey
       JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
)
def events_by_region(spark, sf_dir):
    per_customer = group_counts(table(spark, sf_dir, "orders"), ["o_custkey"])
    joined = per_customer.join(_customer_regions(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return group_total(joined, ["region"], F.col("event_count"), "event_count")


@REGISTRY.add(
    "revenue_by_product",
    """SELECT p_brand AS product, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS revenue
       FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand""",
)
def revenue_by_product(spark, sf_dir):
    lines = _revenue_lines(spark, sf_dir)
    # a part that sells a third of all lines is one row before the join
    per_part = lines.groupBy("l_partkey").agg(F.sum("revenue").alias("revenue"))
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("product"))
    joined = per_part.join(brands, F.col("l_partkey") == F.col("p_partkey"))
    return group_total(joined, ["product"], F.col("revenue"), "revenue").withColumn("revenue", F.col("revenue").cast("double"))


TREND_SQL = """s AS (SELECT o_orderpriority AS kpi, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period,
        round(CAST(sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS DOUBLE), 0) AS value FROM orders GROUP BY 1, 2),
    t AS (SELECT *, lag(value) OVER (PARTITION BY kpi ORDER BY period) AS previous FROM s),
    w AS (SELECT *, value - previous AS change, CASE WHEN value > previous THEN 'improved' WHEN value < previous
          THEN 'declined' ELSE 'remained stable' END AS trend_word FROM t)"""


def _trend(spark, sf_dir):
    series = period_totals(table(spark, sf_dir, "orders"), F.col("o_orderdate"), "quarter", F.col("o_totalprice").cast("decimal(15,2)"), "value",
                           ("o_orderpriority",))
    return kpi_trend(series.select(F.col("o_orderpriority").alias("kpi"), _day("period"),
                                   F.round(F.col("value").cast("double"), 0).alias("value")))


@REGISTRY.add(
    "kpi_trend",
    f"""WITH {TREND_SQL} SELECT kpi, period, value, previous, change, trend_word,
        CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' ELSE 'neutral' END AS trend_direction FROM w""",
)
def trend(spark, sf_dir):
    return _trend(spark, sf_dir)


@REGISTRY.add(
    "kpi_sentences",
    f"""WITH {TREND_SQL} SELECT kpi, period, kpi || ' is at ' || printf('%.0f', value) || ' and has ' || trend_word || ' (' ||
        CASE WHEN change > 0 THEN '+' ELSE '' END || printf('%.0f', coalesce(change, 0)) || ')' AS sentence FROM w""",
)
def sentences(spark, sf_dir):
    return kpi_sentence(_trend(spark, sf_dir), 0).select("kpi", "period", "sentence")
