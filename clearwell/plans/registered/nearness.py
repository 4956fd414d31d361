"""Joins by time and by distance, dashboards of several axes, answered requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.operators.bi import grouped_axes
from clearwell.operators.temporal import as_of_join, band_join
from clearwell.plans.registered.base import Registry, table
from clearwell.session import scratch_path
from clearwell.streaming.ingest import answered_requests, read_folder, write_files

REGISTRY = Registry()

# One key holds a third of all events.
KEYED_SQL = "SELECT *, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS subject FROM events"


@REGISTRY.add(
    "as_of_baseline",
    f"""WITH e AS ({KEYED_SQL}), v AS (SELECT subject, ts, max(value) AS trust FROM e WHERE event_type = 'view' GROUP BY ALL),
    p AS (SELECT event_id, subject, ts FROM e WHERE event_type <> 'view')
    SELECT event_id, p.subject, trust FROM p ASOF LEFT JOIN v ON p.subject = v.subject AND p.ts >= v.ts""",
)
def as_of_baseline(spark, sf_dir):
    """The score of a subject, set by its views, as it stood at each of its other events."""
    events = table(spark, sf_dir, "events").withColumn("subject", F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    scores = events.where("event_type = 'view'").groupBy("subject", "ts").agg(F.max("value").alias("trust"))
    runs = events.where("event_type <> 'view'").select("event_id", "subject", "ts")
    return as_of_join(runs, scores, ["subject"], "ts", "ts", ["trust"]).select("event_id", "subject", "trust")


@REGISTRY.add("band_edges", """SELECT o_orderkey, l_orderkey, l_linenumber FROM orders JOIN lineitem ON abs(o_totalprice - l_extendedprice) <= 0.25""")
def band_edges(spark, sf_dir):
    """Orders and line items whose amounts differ by a quarter or less."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return band_join(orders, lines, "o_totalprice", "l_extendedprice", 0.25).select("o_orderkey", "l_orderkey", "l_linenumber")


AXES = {"type": ["event_type"], "user": ["user_id"], "day": ["day"], "type_by_day": ["event_type", "day"]}


@REGISTRY.add("dashboard_axes", "WITH e AS (SELECT *, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) " + " UNION ALL ".join(
    f"SELECT '{axis}' AS axis, {' || chr(44) || '.join(f'CAST({c} AS VARCHAR)' for c in own)} AS label, count(*) AS n, min(value) AS lowest, max(value) AS highest "
    f"FROM e GROUP BY {', '.join(own)}" for axis, own in AXES.items()))
def dashboard_axes(spark, sf_dir):
    """Four datasets of a dashboard from one scan of events."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    found = grouped_axes(events.select("event_type", "user_id", "day", "value"), AXES, [
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest")])
    label = F.array_join(F.filter(F.array(*[F.try_element_at("labels", F.lit(c)) for c in ("event_type", "user_id", "day")]), lambda x: x.isNotNull()), ",")
    return found.select("axis", label.alias("label"), "n", "lowest", "highest")


@REGISTRY.add(
    "answered_requests",
    """WITH r AS (SELECT event_id AS id, ts AS requested_at FROM events),
    d AS (SELECT event_id AS id, ts + CASE WHEN event_type = 'click' THEN INTERVAL 20 MINUTE ELSE INTERVAL 3 HOUR END AS decided_at FROM events WHERE event_type <> 'error'),
    j AS (SELECT r.id, requested_at, d.id IS NOT NULL AS answered FROM r LEFT JOIN d ON r.id = d.id AND decided_at <= requested_at + INTERVAL 1 HOUR)
    SELECT id, answered FROM j
    WHERE answered OR requested_at + INTERVAL 1 HOUR < (SELECT least((SELECT max(requested_at) FROM r), (SELECT max(decided_at) FROM d))) - INTERVAL 10 MINUTE""",
)
def answered(spark, sf_dir):
    """Requests as a stream, answered in time, too late or never; the last hour's are still open when the streams end."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked, told, out, checkpoint = (scratch_path(spark, p) for p in ("requests", "decisions", "answers", "checkpoint"))
    events.select(F.col("event_id").alias("id"), F.col("ts").alias("requested_at")).write.parquet(asked)
    delay = F.when(F.col("event_type") == "click", F.expr("interval 20 minutes")).otherwise(F.expr("interval 3 hours"))
    events.where("event_type <> 'error'").select(F.col("event_id").alias("id"), (F.col("ts") + delay).alias("decided_at"), F.lit("approved").alias("decision")).write.parquet(told)
    requests = read_folder(spark, asked, "id bigint, requested_at timestamp", "parquet")
    decisions = read_folder(spark, told, "id bigint, decided_at timestamp, decision string", "parquet")
    write_files(answered_requests(requests, decisions), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("id", F.col("decision").isNotNull().alias("answered"))
