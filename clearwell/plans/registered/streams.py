"""Streams over the events table: files in, files out, everything there is and then stop."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.plans.registered.base import Registry, table
from clearwell.plans.registered.drifting import SUITE_SQL, baseline, batch, compared
from clearwell.session import scratch_path
from clearwell.operators.state import feedback_windows, trust_from_windows
from clearwell.operators.sketches import merge_states, state_profile, stored_states
from clearwell.plans.registered.profiling import EVENT_KINDS, checked_sketches, sketched_sql
from clearwell.streaming.ingest import (
    dedup_events, ingest_events, read_folder, rollup, to_payload, watch_drift, watch_states, write_files)

REGISTRY = Registry()

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
COLUMNS = ("event_id", "ts", "user_id", "event_type", "value")


def _ingested(spark, sf_dir):
    """Events as JSON messages; those of errors are cut off, those of views lack their id."""
    events = table(spark, sf_dir, "events").select(*COLUMNS[1:], "event_id")
    whole = events.withColumns({
        "event_id": F.when(F.col("event_type") != "view", F.col("event_id")), "ts": F.col("ts").cast("timestamp")})
    messages = to_payload(whole.select(*COLUMNS)).select(
        F.when(F.contains("value", F.lit('"error"')), F.expr("substr(value, 1, length(value) - 3)")).otherwise(
            F.col("value")).alias("payload"))
    source, good, bad, checkpoint = (scratch_path(spark, p) for p in ("messages", "good", "bad", "checkpoint"))
    messages.write.parquet(source)
    stream = read_folder(spark, source, "payload string", "parquet")
    ingest_events(stream, good, bad, checkpoint, EVENT_SCHEMA, ("event_id", "ts")).awaitTermination()
    return spark.read.parquet(good).drop("batch_id"), spark.read.parquet(bad).drop("batch_id")


@REGISTRY.add("stream_ingest", "SELECT event_id, epoch_us(ts) AS micros, user_id, event_type, value FROM events "
                               "WHERE event_type NOT IN ('error', 'view')")
def stream_ingest(spark, sf_dir):
    good, _ = _ingested(spark, sf_dir)
    return good.select("event_id", F.unix_micros("ts").alias("micros"), "user_id", "event_type", "value")


@REGISTRY.add("stream_quarantine", "SELECT count(*) AS messages, count(*) FILTER (WHERE event_type = 'view') AS without_id FROM events "
                                   "WHERE event_type IN ('error', 'view')")
def stream_quarantine(spark, sf_dir):
    _, bad = _ingested(spark, sf_dir)
    return bad.agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.contains("payload", F.lit('"view"'))).alias("without_id"))


def _event_files(spark, sf_dir, copies=1):
    path = scratch_path(spark, "events")
    events = table(spark, sf_dir, "events").select(*COLUMNS).withColumn("ts", F.col("ts").cast("timestamp"))
    for _ in range(copies):
        events.write.mode("append").parquet(path)
    return read_folder(spark, path, EVENT_SCHEMA, "parquet")


def _written(spark, stream):
    path, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    write_files(stream, path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@REGISTRY.add("stream_dedup", "SELECT event_id, epoch_us(ts) AS micros, user_id, event_type, value FROM events")
def stream_dedup(spark, sf_dir):
    """Every event arrives twice and is kept once."""
    out = _written(spark, dedup_events(_event_files(spark, sf_dir, copies=2), ["event_id"], "ts", "40 days"))
    return out.select("event_id", F.unix_micros("ts").alias("micros"), "user_id", "event_type", "value")


@REGISTRY.add(
    "stream_rollup",
    """WITH e AS (SELECT *, time_bucket(INTERVAL 1 DAY, ts) AS w FROM events)
    SELECT epoch_us(w) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total, min(value) AS lowest,
           max(value) AS highest FROM e
    WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY w, event_type""",
)
def stream_rollup(spark, sf_dir):
    """Daily windows that no later event can change any more."""
    out = _written(spark, rollup(_event_files(spark, sf_dir), "ts", "1 day", ["event_type"], "value"))
    return out.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"),
                      "lowest", "highest")


@REGISTRY.add("stream_drift", SUITE_SQL)
def stream_drift(spark, sf_dir):
    """The second half of the month arrives as a stream and is checked against the first."""
    source, target, checkpoint = (scratch_path(spark, p) for p in ("batch", "alerts", "checkpoint"))
    arrived = batch(spark, sf_dir)
    arrived.write.parquet(source)
    stream = read_folder(spark, source, arrived.schema, "parquet")
    watch_drift(stream, baseline(spark, sf_dir), target, checkpoint, exact=True).awaitTermination()
    return compared(spark.read.parquet(target))


def _watched(spark, sf_dir):
    """Events arrive in three files, one a micro-batch; returns the folder of states, that of alerts, and the rows."""
    events = table(spark, sf_dir, "events").select(*COLUMNS)
    source, root, target, checkpoint = (scratch_path(spark, p) for p in ("parts", "states", "alerts", "checkpoint"))
    for i in range(3):
        events.where(f"user_id % 3 = {i}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    watch_states(stream, baseline(spark, sf_dir), root, "events", target, checkpoint).awaitTermination()
    return root, target, events


@REGISTRY.add("stream_states", sketched_sql("events", {c: EVENT_KINDS[c] for c in COLUMNS}))
def stream_states(spark, sf_dir):
    """Profile after three micro-batches, merged from their states."""
    root, _, events = _watched(spark, sf_dir)
    return checked_sketches(state_profile(merge_states(stored_states(spark, root, "events").drop("batch_id"))), events)


@REGISTRY.add(
    "stream_feedback",
    """WITH e AS (SELECT * FROM events WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY)
    SELECT event_type AS table_name, round_even(list_reduce(
        list_prepend(CAST(100 AS DOUBLE), list(CAST(CASE WHEN value > 20 THEN 1.5 ELSE -3.0 END AS DOUBLE) ORDER BY event_id)),
        lambda x, a: least(100, greatest(0, x + a))), 2) AS trust_score
    FROM e GROUP BY event_type""",
)
def stream_feedback(spark, sf_dir):
    """Feedback in three files whose times overlap by a day; trust after all windows that no event can change any more."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("table_name"), F.col("event_id").alias("seq"),
        F.when(F.col("value") > 20, "approved").otherwise("rejected").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    source, out, checkpoint = (scratch_path(spark, p) for p in ("feedback", "windows", "checkpoint"))
    part = F.least(F.floor((F.dayofmonth("ts") + F.col("seq") % 2) / 11), F.lit(2))
    for i in range(3):
        events.where(part == i).coalesce(1).write.mode("append").parquet(source)
    stream = read_folder(spark, source, events.schema, "parquet", maxFilesPerTrigger=1)
    write_files(feedback_windows(stream, "ts", "6 hours", "2 days"), out, checkpoint).awaitTermination()
    return trust_from_windows(spark.read.parquet(out))
