import numpy as np
import pytest
from pyspark.sql import functions as F

from clearwell.operators.bi import kpi_sentence, kpi_trend
from clearwell.operators.causal import (
    apply_to_kpis,
    match_events,
    rank_outcomes,
    recommend,
    shown,
    simulate_interventions,
    simulate_scenarios,
    with_fallback,
)
from clearwell.operators.routing import dashboards, intent, route, task_gate
from clearwell.operators.vectors import index_vectors, nearest, nearest_batch

LINKS = [(1, "supply_disruptions", "revenue", 0.85, "d1"), (2, "transformer_maintenance", "production_uptime", 0.92, "d2"),
         (3, "weather_anomaly_storm", "delivery_delay_hours", 0.78, "d3"), (4, "supply_disruptions", "cost", 0.55, "d4")]


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(
        LINKS, "link_id long, source_event string, target_metric string, confidence_score double, description string")


def scenarios_of(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "scenario_id int, scenario string")


def test_matching_both_ways(spark, links):
    s = scenarios_of(spark, "What about Supply Disruptions now", "storm", "s", "nothing", "TRANSFORMER", "", None)
    got = {(r[0], r[1]) for r in match_events(s, links).collect()}
    events = {e for _, e, *_ in LINKS}
    want = {(i, e) for i, t in [(0, "what about supply disruptions now"), (1, "storm"), (2, "s"), (3, "nothing"),
                                (4, "transformer"), (5, "")]
            for e in events if e.replace("_", " ") in t or t in e.replace("_", " ")}
    assert got == want


def test_pieces_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = lambda k, n: ["".join(rng.choice(list("abc "), size=rng.integers(1, k))) for _ in range(n)]
    texts, events = words(30, 150), sorted(set(words(12, 60)))
    s = scenarios_of(spark, *(texts + [texts[0]] * 100))
    e = spark.createDataFrame([(x,) for x in events], "source_event string")
    got = sorted((r[0], r[1]) for r in match_events(s, e).collect())
    all_texts = texts + [texts[0]] * 100
    assert got == sorted((i, x) for i, t in enumerate(all_texts) for x in events if x in t.lower() or t.lower() in x)


def test_interventions(spark, links):
    steps = spark.createDataFrame(
        [(1, 1, "transformer_maintenance", 1.0), (1, 2, "supply_disruptions", 0.7), (1, 3, "weather_anomaly_storm", 0.5),
         (2, 1, "unknown", 1.0), (3, 1, "transformer_maintenance", 9.0), (3, 2, "transformer_maintenance", None)],
        "scenario_id int, seq int, event string, magnitude double")
    done = simulate_interventions(steps, links)
    one = {r["affected_metric"]: r for r in done.where("scenario_id = 1").collect()}
    assert one["production_uptime"]["confidence"] == 0.92 and one["production_uptime"]["risk_level"] == "low"
    assert one["revenue"]["confidence"] == 0.6 and one["revenue"]["risk_level"] == "medium"
    assert one["delivery_delay_hours"]["risk_level"] == "high"
    assert shown(done).where("affected_metric = 'production_uptime' and scenario_id = 1").first()["predicted_change"] == "+9.2%"
    assert sorted(r["confidence"] for r in done.where("scenario_id = 3").collect()) == [0.92, 1.0]
    scenarios = spark.createDataFrame([(1,), (2,), (3,)], "scenario_id int")
    full = with_fallback(scenarios, rank_outcomes(done, 3))
    assert [r["intervention"] for r in full.where("scenario_id = 2").orderBy("rank").collect()] == [
        "Increase maintenance frequency", "Reduce supplier lead time"]
    ranks = [r["affected_metric"] for r in full.where("scenario_id = 1").orderBy("rank").collect()]
    assert ranks == ["production_uptime", "revenue", "delivery_delay_hours", "cost"]


def test_recommendations(spark, links):
    s = scenarios_of(spark, "supply disruptions and weather anomaly storm", "quiet")
    rows = {r["scenario_id"]: r for r in recommend(s, simulate_scenarios(s, links)).collect()}
    assert rows[0]["recommendation"] == "Address supply_disruptions" and rows[0]["governance_status"] == "passed"
    assert rows[1]["recommendation"] == "Increase maintenance frequency" and rows[1]["confidence"] == 0.88
    weak = simulate_interventions(
        spark.createDataFrame([(1, 1, "weather_anomaly_storm", 0.5)], "scenario_id int, seq int, event string, magnitude double"), links)
    row = recommend(spark.createDataFrame([(1,)], "scenario_id int"), weak).first()
    assert row["governance_status"] == "warning" and len(row["governance_notes"]) == 2


def test_kpis(spark, links):
    steps = spark.createDataFrame([(1, 1, "transformer_maintenance", 1.0), (1, 2, "supply_disruptions", 1.0)],
                                  "scenario_id int, seq int, event string, magnitude double")
    kpis = spark.createDataFrame([(1, 94.3, 2.4), (2, 50.0, 1.0)], "scenario_id int, production_uptime double, revenue double")
    got = {r[0]: (r[1], r[2]) for r in apply_to_kpis(kpis, simulate_interventions(steps, links)).collect()}
    assert got == {1: (100.0, 3.3), 2: (50.0, 1.0)}


def test_trend_sentences(spark):
    series = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 12.5), ("k", 3, 12.5), ("k", 4, 1.0)], "kpi string, period int, value double")
    rows = kpi_sentence(kpi_trend(series)).orderBy("period").collect()
    assert [r["trend_word"] for r in rows] == ["remained stable", "improved", "remained stable", "declined"]
    assert rows[1]["sentence"] == "k is at 12.5 and has improved (+2.5)"


def test_routing(spark):
    texts = ["How is A related to B", "Please FIX the plan", "show me revenue", "hello", "plan the lineage of x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(intent(F.col("text"))).collect()] == [
        "graph_query", "agent_workflow", "sql_generation", "unknown", "graph_query"]
    routed = route(spark.createDataFrame([("Production costs",), ("budget",), ("hi",)], "text string")).collect()
    assert [(r["agent"], r["requires_approval"]) for r in routed] == [
        ("Manufacturing", True), ("Finance", True), ("Executive", False)]
    gated = task_gate(spark.createDataFrame([("Export it",), ("tidy up",)], "task string")).collect()
    assert [r["status"] for r in gated] == ["queued_for_approval", "executed"]
    goals = dashboards(spark.createDataFrame([("maintenance cost",), ("Finance",), ("x",)], "goal string")).collect()
    assert [(r["dashboard"], len(r["widgets"])) for r in goals] == [("production", 4), ("finance", 3), ("overview", 3)]


def test_nearest_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(400, 8)).astype("float32")
    points[200:300] = points[0]  # a quarter of all vectors are copies, ties go to the lower id
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>").repartition(6)
    queries = [points[0], points[7], rng.normal(size=8)]
    table = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "query_id long, embedding array<double>")
    want = []
    for q, target in enumerate(queries):
        d = np.sqrt(((points.astype("float64") - np.asarray(target, dtype="float64")) ** 2).sum(axis=1))
        want += [(q, int(i), r + 1) for r, i in enumerate(np.lexsort((np.arange(400), d))[:5])]
    for blocks in ((16_384, 1_024), (50, 1), (33, 2)):
        got = nearest_batch(vectors, table, 5, block_vectors=blocks[0], block_queries=blocks[1])
        assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()) == sorted(want)
    one = [r["vec_id"] for r in nearest(vectors, [float(x) for x in queries[1]], 5).collect()]
    assert one == [i for q, i, _ in want if q == 1]
    assert nearest_batch(vectors, table.limit(0), 5).isEmpty()


def test_index_rejects_unusable_vectors(spark):
    content = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, None])], "id int, embedding array<double>")
    stored, rejected = index_vectors(content, vectors, "id", 2)
    assert [r["id"] for r in stored.collect()] == [1] and {r["id"] for r in rejected.collect()} == {2, 3, 4}
