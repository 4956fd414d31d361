import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from clearwell.operators.learning import grade, learning_paths, scores
from clearwell.operators.ranking import number_rows
from clearwell.operators.state import (
    fold_feedback,
    latest_state,
    pending,
    queue_actions,
    resolve,
    rollback_runs,
    trust_after,
    update_trust,
    upsert_catalog,
)

CATALOG = "table_name string, zone string, storage_path string, trust_score double, freshness_timestamp timestamp, seq long"


def test_upsert_and_trust(spark):
    old = spark.createDataFrame([("a", "raw", "p", 100.0, None, 1)], CATALOG)
    new = spark.createDataFrame([("a", "clean", "q", None, None, 3), ("b", "raw", "r", 7.0, None, 2)], CATALOG)
    catalog = upsert_catalog(old, new)
    assert {(r["table_name"], r["zone"], r["trust_score"]) for r in catalog.collect()} == {("a", "clean", 100.0), ("b", "raw", 7.0)}
    scored, errors = update_trust(catalog, spark.createDataFrame(
        [("a", 1, 250.0), ("a", 2, 30.0), ("b", 1, -4.0), ("c", 1, 1.0)], "table_name string, seq int, trust_score double"))
    assert {r["table_name"]: r["trust_score"] for r in scored.collect()} == {"a": 30.0, "b": 0.0}
    assert [r["error"] for r in errors.collect()] == ["Table 'c' not found."]


def test_latest_state_keeps_column_order_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "k string, seq int, v string")
    got = latest_state(df, ["k"], ["seq"])
    assert got.columns == df.columns and got.first()["v"] is None


def test_single_feedback(spark):
    df = spark.createDataFrame([("approved", 99.0), ("rejected", 2.0), ("odd", 50.0)], "s string, t double")
    assert [r[0] for r in df.select(trust_after(F.col("s"), F.col("t"))).collect()] == [100.0, 0.0, 47.0]


@pytest.mark.parametrize("partitions", [1, 7])
def test_fold_of_one_hot_table(spark, partitions):
    rng = random.Random(7)
    rows = [("hot", i, "approved" if rng.random() < 0.66 else "rejected") for i in range(3000)]
    rows += [(f"t{i % 50}", i, rng.choice(["approved", "rejected"])) for i in range(500)]
    want: dict[str, float] = {}
    for name, _, status in rows:
        x = want.get(name, 100.0)
        want[name] = min(100.0, max(0.0, x + (1.5 if status == "approved" else -3.0)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "table_name string, seq int, status string").withColumn("seq", F.col("seq").cast("long"))
    assert {r[0]: r[1] for r in fold_feedback(df, partitions=partitions).collect()} == want


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_row_numbers_equal_the_window(spark, partitions):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("g"), F.col("id") % 400)).alias("g"),
        (F.hash("id") % 50).alias("v"), "id", F.array("id").alias("payload"))
    got = number_rows(df, ["g"], [F.desc("v"), F.asc("id")], "rank", partitions)
    window = Window.partitionBy("g").orderBy(F.desc("v"), F.asc("id"))
    want = df.withColumn("rank", F.row_number().over(window).cast("long"))
    assert got.columns == [*df.columns, "rank"]
    assert got.count() == 5000 and got.exceptAll(want).isEmpty()


def test_row_numbers_of_two_keys(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("b"), "id")
    got = number_rows(df, ["a", "b"], [F.asc("id")], partitions=5)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy("id")).cast("long"))
    assert got.exceptAll(want).isEmpty() and got.count() == 1000


def test_approvals(spark):
    requests = spark.createDataFrame(
        [(1, "a", "t", "{}", "why"), (2, "a", "t", "{}", "why"), (3, "a", "t", "{}", "why")],
        "id long, agent_name string, action_type string, proposed_payload string, reasoning string",
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    queue = queue_actions(requests)
    decisions = spark.createDataFrame(
        [(1, "approved", "ok", 1), (2, "rejected", "no", 1), (2, "approved", "late", 2), (3, "maybe", "", 1), (9, "approved", "", 1)],
        "id long, decision string, feedback string, at int").select(
        "id", "decision", "feedback", F.timestamp_seconds("at").alias("decided_at"))
    done, errors = resolve(queue, decisions)
    assert {r["id"]: (r["status"], r["feedback"]) for r in done.collect()} == {
        1: ("executed", "ok"), 2: ("rejected", "no"), 3: ("pending", None)}
    assert [r["id"] for r in pending(done).collect()] == [3]
    assert {(r["id"], r["error"]) for r in errors.collect()} == {
        (2, "Already resolved"), (3, "Decision must be 'approved' or 'rejected'"), (9, "Approval not found")}
    again, errors = resolve(done, decisions.where("id = 1"))
    assert again.where("id = 1").first()["status"] == "executed"
    assert [r["error"] for r in errors.collect()] == ["Already resolved"]


def test_rollback_checks_the_target_first(spark):
    runs = spark.createDataFrame([("p", 1, "success", "c1"), ("p", 2, "success", "c2"), ("q", 1, "success", "d1")],
                                 "pipeline_name string, version int, status string, config_snapshot string")
    asked = spark.createDataFrame([("p", 1), ("q", 5)], "pipeline_name string, to_version int")
    updated, targets, errors = rollback_runs(runs, asked)
    assert {(r[0], r[1]): r[2] for r in updated.collect()} == {
        ("p", 1): "success", ("p", 2): "rolled_back", ("q", 1): "success"}
    assert targets.first()["config_snapshot"] == "c1" and errors.first()["pipeline_name"] == "q"


def test_lessons(spark):
    lessons = spark.createDataFrame(
        [("lesson-1", "Zones", "Analyst", "Clean Zone", 10), ("lesson-2", "Links", "Engineer", "Production Uptime", 20)],
        "id string, title string, role string, correct_answer string, points int")
    learners = spark.createDataFrame([("u", "Analyst"), ("v", "Pilot"), ("w", None)], "user_id string, role string")
    paths = learning_paths(learners, lessons).groupBy("user_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert {r["user_id"]: r["ids"] for r in paths.collect()} == {
        "u": ["lesson-1"], "v": ["lesson-1", "lesson-2"], "w": ["lesson-1", "lesson-2"]}
    answers = spark.createDataFrame(
        [("u", "lesson-1", "Clean Zone"), ("u", "lesson-2", "clean"), ("v", "lesson-9", "x"), ("v", "lesson-1", None)],
        "user_id string, lesson_id string, answer string")
    graded = grade(answers, lessons)
    rows = {(r["user_id"], r["lesson_id"]): r for r in graded.collect()}
    assert rows["u", "lesson-1"]["points_awarded"] == 10 and rows["u", "lesson-1"]["explanation"].endswith("Excellent work!")
    assert rows["u", "lesson-2"]["points_awarded"] == 0 and not rows["u", "lesson-2"]["correct"]
    assert rows["v", "lesson-9"]["status"] == "error" and rows["v", "lesson-1"]["correct"] is False
    assert {r["user_id"]: r["score"] for r in scores(graded).collect()} == {"u": 110, "v": 100}
