"""Scenario and intervention simulation over causal links, ranking, recommendation and KPI effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.functions.fixed_values import FALLBACK_OUTCOMES, NOTE_HIGH_RISK, NOTE_LOW_CONFIDENCE
from clearwell.functions.numeric import clamp
from clearwell.operators.ranking import number_rows
from clearwell.operators.substrings import parts_of, text_size

OUTCOME_COLUMNS = (
    "scenario_id", "intervention", "affected_metric", "change_pct", "confidence", "risk_level", "explanation",
    "input_order",
)


def _phrase(event: Column) -> Column:
    return F.replace(event, F.lit("_"), F.lit(" "))


def match_events(scenarios: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs ``(scenario_id, source_event)`` where the event phrase is part of the lower-cased scenario or the
    scenario is part of the phrase.

    Both ways, the texts that may be parts are put into automata of bounded size, and every other text is walked once through each
    (``parts_of``). Texts are known by their hash from then on; none is multiplied. Copies of a text are matched once.
    """
    texts = scenarios.select(F.lower("scenario").alias("text")).where("text is not null").distinct()
    named = events.select("source_event").where("source_event is not null").distinct().select(
        "source_event", _phrase(F.col("source_event")).alias("text"))
    phrases = named.select("text").distinct()
    of_texts, of_phrases = text_size(texts), text_size(phrases)
    inside = parts_of(phrases, texts, of_phrases, of_texts).select(F.col("part").alias("phrase_id"), F.col("whole").alias("text_id"))
    around = parts_of(texts, phrases, of_texts, of_phrases).select(F.col("whole").alias("phrase_id"), F.col("part").alias("text_id"))
    pairs = inside.union(around).distinct()
    keyed = scenarios.select("scenario_id", F.md5(F.lower("scenario")).alias("text_id"))
    return keyed.join(pairs, "text_id").join(
        named.select("source_event", F.md5("text").alias("phrase_id")), "phrase_id").select("scenario_id", "source_event")


def _risk(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "low").when(confidence > 0.5, "medium").otherwise("high")


def simulate_scenarios(scenarios: DataFrame, links: DataFrame) -> DataFrame:
    """Outcomes of the links each scenario text touches. ``scenarios(scenario_id, scenario)``,
    ``links(link_id, source_event, target_metric, confidence_score, description)``.

    Ties keep the order in which events first appear among the links, and within an event that of its links.
    """
    first = links.groupBy("source_event").agg(F.min("link_id").alias("first_link"))
    matched = match_events(scenarios, links).join(first, "source_event").join(links, "source_event")
    confidence = F.col("confidence_score")
    return matched.select(
        "scenario_id",
        F.concat(F.lit("Address "), "source_event").alias("intervention"),
        F.col("target_metric").alias("affected_metric"),
        (confidence * 10).alias("change_pct"),
        confidence.alias("confidence"),
        F.when(confidence > 0.8, "low").otherwise("medium").alias("risk_level"),
        F.col("description").alias("explanation"),
        F.struct("first_link", "link_id").alias("input_order"),
    )


def simulate_interventions(interventions: DataFrame, links: DataFrame) -> DataFrame:
    """Outcomes of explicit interventions ``(scenario_id, seq, event, magnitude)``; unknown events give none.

    The confidence is rounded to two digits, halves of the decimal number to even, and ranked in that form; change and
    risk come from the unrounded one.
    """
    magnitude = F.coalesce("magnitude", F.lit(1.0))
    adjusted = clamp(F.col("confidence_score") * magnitude, 0.0, 1.0)
    joined = interventions.join(links, interventions["event"] == links["source_event"]).withColumn("adjusted", adjusted)
    return joined.select(
        "scenario_id",
        F.concat(F.lit("Adjust "), "event", F.lit(" by "), magnitude.cast("string"), F.lit("x")).alias("intervention"),
        F.col("target_metric").alias("affected_metric"),
        (F.col("adjusted") * 10).alias("change_pct"),
        F.bround("adjusted", 2).alias("confidence"),
        _risk(F.col("adjusted")).alias("risk_level"),
        F.col("description").alias("explanation"),
        F.struct("seq", "link_id").alias("input_order"),
    )


def shown(outcomes: DataFrame) -> DataFrame:
    """Rounded confidence and a change label such as ``+9.2%``."""
    label = F.concat(F.lit("+"), F.format_string("%.1f", F.bround("change_pct", 1)), F.lit("%"))
    return outcomes.withColumns({"predicted_change": label, "confidence": F.bround("confidence", 2)})


def rank_outcomes(outcomes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Add ``rank`` per scenario, by confidence and then in input order."""
    return number_rows(outcomes, ["scenario_id"], [F.desc("confidence"), F.asc("input_order")], "rank", partitions)


def with_fallback(scenarios: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Two fixed outcomes for every scenario nothing matched; ranks stay those of the outcomes."""
    entries = F.array(*[
        F.struct(F.lit(rank).cast("bigint").alias("rank"), F.lit(name).alias("intervention"),
                 F.lit(metric).alias("affected_metric"), F.lit(change).alias("change_pct"),
                 F.lit(confidence).alias("confidence"), F.lit(risk).alias("risk_level"), F.lit(why).alias("explanation"))
        for rank, name, metric, change, confidence, risk, why in FALLBACK_OUTCOMES
    ])
    empty = scenarios.join(outcomes.select("scenario_id"), "scenario_id", "left_anti")
    fallback = empty.select("scenario_id", F.inline(entries))
    columns = ["scenario_id", "rank", *OUTCOME_COLUMNS[1:-1]]
    if "rank" not in outcomes.columns:
        columns.remove("rank")
    return outcomes.select(columns).unionByName(fallback.select(columns))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("total_outcomes"))


def recommend(scenarios: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Top outcome per scenario (fallback included) with its governance status and notes.

    The top outcome is a minimum per scenario, reduced before the shuffle; no group is sorted.
    """
    order = F.col("input_order") if "input_order" in outcomes.columns else F.lit(0)
    body = ("intervention", "affected_metric", "change_pct", "confidence", "risk_level", "explanation")
    best = outcomes.groupBy("scenario_id").agg(
        F.min(F.struct((-F.col("confidence")).alias("_c"), order.alias("_o"), F.struct(*body).alias("row"))).alias("_b")
    ).select("scenario_id", "_b.row.*")
    first = with_fallback_top(scenarios, best)
    low, high = F.col("confidence") < 0.6, F.col("risk_level") == "high"
    return first.select(
        "scenario_id",
        F.col("intervention").alias("recommendation"),
        "affected_metric", "change_pct", "confidence", "risk_level", "explanation",
        F.when(low, "warning").when(high, "flagged").otherwise("passed").alias("governance_status"),
        F.array_compact(F.array(F.when(high, NOTE_HIGH_RISK), F.when(low, NOTE_LOW_CONFIDENCE))).alias(
            "governance_notes"),
        F.concat(F.lit("Event:"), "intervention").alias("lineage"),
    )


def with_fallback_top(scenarios: DataFrame, best: DataFrame) -> DataFrame:
    _, name, metric, change, confidence, risk, why = FALLBACK_OUTCOMES[0]
    default = {"intervention": name, "affected_metric": metric, "change_pct": change, "confidence": confidence,
               "risk_level": risk, "explanation": why}
    joined = scenarios.select("scenario_id").join(best, "scenario_id", "left")
    missing = F.col("confidence").isNull()
    return joined.select(
        "scenario_id", *[F.when(missing, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in default.items()]
    )


def apply_to_kpis(kpis: DataFrame, outcomes: DataFrame) -> DataFrame:
    """KPI values after a simulation: ``kpis(scenario_id, production_uptime, revenue)``.

    The outcome ranked last wins where several name one metric. Uptime adds the change and stops at 100, revenue adds
    a tenth of it; both round half up to one digit.
    """
    change = F.bround("change_pct", 1)

    def last_of(metric: str) -> Column:
        return F.max(F.when(F.col("affected_metric") == metric, F.struct(
            (-F.col("confidence")).alias("c"), F.col("input_order").alias("o"), change.alias("change"))))["change"]

    changes = outcomes.groupBy("scenario_id").agg(
        last_of("production_uptime").alias("_u"), last_of("revenue").alias("_r"))
    half_up = lambda c: F.floor(c * 10 + 0.5) / 10
    return kpis.join(changes, "scenario_id", "left").withColumns({
        "production_uptime": F.when(
            F.col("_u").isNotNull(), F.least(F.lit(100.0), half_up(F.col("production_uptime") + F.col("_u")))
        ).otherwise(F.col("production_uptime")),
        "revenue": F.when(
            F.col("_r").isNotNull(), half_up(F.col("revenue") + F.col("_r") / 10)
        ).otherwise(F.col("revenue")),
    }).drop("_u", "_r")
