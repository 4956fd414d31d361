"""Event streams and landing folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clearwell.operators.drift import Thresholds, detect_drift
from clearwell.operators.sketches import merge_states, state_profile, store_state, stored_states

DEFAULT_TOPIC = "iot-sensor-stream"
SENSOR_SCHEMA = (
    "timestamp timestamp, machine_id string, temperature_celsius double, vibration_amplitude_mms double, "
    "rotational_speed_rpm double, system_load_pct double"
)


#: Take what is there now and stop.
ONCE = {"availableNow": True}


def read_topic(spark: SparkSession, servers: str, topic: str = DEFAULT_TOPIC) -> DataFrame:
    """Messages of a topic as text; needs the Kafka connector on the class path."""
    stream = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    )
    return stream.select(F.col("value").cast("string").alias("payload"))


def to_payload(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, the form a topic takes (column ``value``); timestamps keep their microseconds."""
    layout = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    return df.select(F.to_json(F.struct("*"), layout).alias("value"))


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return (
        to_payload(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("topic", topic).option("checkpointLocation", checkpoint).start()
    )


def read_folder(spark: SparkSession, path: str, schema: T.StructType | str, file_format: str, **options) -> DataFrame:
    return spark.readStream.format(file_format).schema(schema).options(**options).load(path)


def parse_events(messages: DataFrame, schema: str = SENSOR_SCHEMA, required: tuple[str, ...] = ("timestamp", "machine_id"),
                 payload: str = "payload") -> DataFrame:
    """Typed fields of JSON messages plus ``payload`` and ``valid``: all required fields there and readable."""
    parsed = messages.withColumn("_e", F.from_json(payload, schema))
    ok: Column = F.col("_e").isNotNull()
    for name in required:
        ok = ok & F.col(f"_e.{name}").isNotNull()
    return parsed.select("_e.*", payload, F.coalesce(ok, F.lit(False)).alias("valid"))


def ingest_events(
    messages: DataFrame, target: str, quarantine: str, checkpoint: str, schema: str = SENSOR_SCHEMA,
    required: tuple[str, ...] = ("timestamp", "machine_id"), trigger: dict | None = None,
) -> StreamingQuery:
    """Write readable messages to ``target`` and the others, untouched, to ``quarantine``.

    Each batch goes to its own ``batch_id`` folder with overwrite, so a repeated batch replaces itself. ``trigger`` is what
    ``DataStreamWriter.trigger`` takes, ``{"processingTime": "10 seconds"}`` for a stream that keeps running.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_events(batch, schema, required)
        parsed.persist()
        try:
            parsed.where("valid").drop("payload", "valid").write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
            parsed.where("not valid").select("payload").write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or ONCE)).start()


def ingest_landing(
    spark: SparkSession, landing: str, schema: T.StructType | str, target: str, checkpoint: str,
    pattern: str = "machine_logs_*.csv", processed: str | None = None, options: dict[str, str] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Take in every new file of a landing folder that matches a pattern.

    The checkpoint is what keeps a file from being read twice. With ``processed`` files are also moved there, one run
    after the one that read them.
    """
    reader = spark.readStream.schema(schema).options(**(options or {})).option("header", True).option(
        "pathGlobFilter", pattern)
    if processed:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", processed)
    rows = reader.csv(landing).withColumn("_source_file", F.col("_metadata.file_path"))
    return rows.writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def dedup_events(events: DataFrame, keys: list[str], time: str, lateness: str = "10 minutes") -> DataFrame:
    """Drop repeats of a key that arrive within the lateness; the state forgets older keys."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def rollup(events: DataFrame, time: str, window: str, by: list[str], value: str, lateness: str = "10 minutes") -> DataFrame:
    """Count, sum, minimum and maximum per tumbling window; a window is emitted once no row can change it."""
    return (
        events.withWatermark(time, lateness)
        .groupBy(F.window(time, window), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest"),
             F.max(value).alias("highest"))
        .select(F.col("window.start").alias("window_start"), *by, "n", "total", "lowest", "highest")
    )


def write_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to Parquet files; without a ``trigger`` it stops at the end of what is there now."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def watch_drift(
    stream: DataFrame, baseline: DataFrame, target: str, checkpoint: str, thresholds: Thresholds = Thresholds(),
    exact: bool = False, trigger: dict | None = None,
) -> StreamingQuery:
    """Check every micro-batch against a baseline and write its alerts to its own ``batch_id`` folder."""

    def check(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            alerts = detect_drift(batch, baseline, thresholds, exact=exact)
            alerts.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(
        **(trigger or ONCE)).start()


def watch_states(
    stream: DataFrame, baseline: DataFrame, root: str, table: str, target: str, checkpoint: str,
    thresholds: Thresholds = Thresholds(), trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the state of every micro-batch and check the table as it stands behind it against a baseline.

    Profile and fences come from the merged states of all batches so far; only the new batch's rows are read. Outliers are counted in
    the new batch. Alerts go to the batch's own ``batch_id`` folder; a batch that is run again replaces its state and its alerts.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            store_state(batch, root, table, batch_id)
            kept = stored_states(batch.sparkSession, root, table).where(F.col("batch_id") <= batch_id).drop("batch_id")
            profile = state_profile(merge_states(kept))
            fences = {r.column_name: (r.q1, r.q3) for r in profile.where("q1 is not null").select("column_name", "q1", "q3").collect()}
            alerts = detect_drift(batch, baseline, thresholds, current=profile.drop("q1", "median", "q3"), quartiles=fences)
            alerts.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def answered_requests(
    requests: DataFrame, decisions: DataFrame, wait: str = "1 hour", request_lateness: str = "10 minutes", decision_lateness: str = "10 minutes",
) -> DataFrame:
    """Requests ``(id, requested_at, ...)`` joined with their decisions ``(id, decided_at, decision)``, both streams: a decision answers
    a request up to ``wait`` after it. A request without one comes out with nulls once no decision that is still allowed can
    come; later decisions are dropped with their state. Both sides keep what the watermarks leave open and no more.
    """
    left = requests.withWatermark("requested_at", request_lateness)
    right = decisions.select(F.col("id").alias("_id"), "decided_at", "decision").withWatermark("decided_at", decision_lateness)
    on = (F.col("id") == F.col("_id")) & (F.col("decided_at") >= F.col("requested_at")) & (F.col("decided_at") <= F.col("requested_at") + F.expr(f"interval {wait}"))
    return left.join(right, on, "left_outer").drop("_id")
