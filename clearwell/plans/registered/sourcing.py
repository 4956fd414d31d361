"""Scans, landing and schema artifacts: whole tables go out to files and come back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clearwell.operators.profile import baseline_of, schema_document
from clearwell.plans.registered.base import Registry, table
from clearwell.session import scratch_path
from clearwell.sources.files import land_raw, publish_schema, read_csv, read_json, read_raw
from clearwell.streaming.ingest import ingest_landing

REGISTRY = Registry()

ORDERS_SQL = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate, "
              "o_orderpriority FROM orders")


@REGISTRY.add("csv_roundtrip", ORDERS_SQL)
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    return read_csv(spark, path).withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")))


@REGISTRY.add(
    "csv_null_cells",
    """SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
       CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type FROM events""",
)
def csv_null_cells(spark, sf_dir):
    """Texts such as NA in a numeric and a text column become null and do not spoil the inferred type."""
    path = scratch_path(spark, "csv-null")
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.when(F.col("event_type") == "error", F.lit("NA")).otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_type") == "view", F.lit("null")).otherwise(F.col("event_type")).alias("event_type"),
    )
    events.write.option("header", True).csv(path)
    return read_csv(spark, path)


@REGISTRY.add("json_roundtrip", "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, "
                                "c_mktsegment FROM customer")
def json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "json")
    table(spark, sf_dir, "customer").write.json(path)
    return read_json(spark, path, lines=True).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@REGISTRY.add(
    "raw_landing",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, value,
       '20240201_000000' AS ingest_ts, TRUE AS has_source FROM events""",
)
def raw_landing(spark, sf_dir):
    source, root = scratch_path(spark, "incoming"), scratch_path(spark, "lake")
    table(spark, sf_dir, "events").write.option("header", True).csv(source)
    land_raw(spark, source, "csv", root, "events", datetime(2024, 2, 1))
    lines = read_raw(spark, root, "events").where(F.col("value") != "event_id,ts,user_id,event_type,value,props")
    cell = F.from_csv("value", "event_id string, ts string, user_id string, event_type string, value double, props string", {"escape": '"'})
    return lines.withColumn("r", cell).select(
        "r.event_id", "r.event_type", "r.user_id", "r.value",
        F.col("ingest_ts").cast("string").alias("ingest_ts"),
        F.contains("_source_file", F.lit("incoming")).alias("has_source"),
    )


@REGISTRY.add("json_array_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_array_roundtrip(spark, sf_dir):
    """Files that each hold one array of records."""
    path = scratch_path(spark, "json-array")
    records = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("j"))
    # an array holds at most 500 customers
    arrays = records.groupBy(F.expr("c_custkey div 500").alias("part")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return read_json(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@REGISTRY.add("json_lines_landing", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_lines_landing(spark, sf_dir):
    """JSON lines are landed line by line and parsed from the landed text."""
    source, root = scratch_path(spark, "incoming"), scratch_path(spark, "lake")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.json(source)
    land_raw(spark, source, "json", root, "customer", datetime(2024, 2, 1))
    return read_raw(spark, root, "customer").select(
        F.from_json("value", "c_custkey bigint, c_name string, c_acctbal double").alias("r")).select("r.*")


@REGISTRY.add(
    "csv_quoted_breaks", "SELECT o_orderkey, o_orderstatus || chr(10) || '\"' || o_orderpriority || '\"' AS note FROM orders")
def csv_quoted_breaks(spark, sf_dir):
    """Line breaks and quotes inside quoted cells."""
    path = scratch_path(spark, "csv-breaks")
    note = F.concat("o_orderstatus", F.lit('\n"'), "o_orderpriority", F.lit('"'))
    table(spark, sf_dir, "orders").select("o_orderkey", note.alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return read_csv(spark, path, multi_line=True)


@REGISTRY.add("landing_ingest", "SELECT event_id, user_id, event_type, value, props FROM events")
def landing_ingest(spark, sf_dir):
    """New files of a landing folder, read once each by a checkpointed stream."""
    landing, target, checkpoint = (scratch_path(spark, p) for p in ("landing", "landed", "checkpoint"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    events.write.option("header", True).option("escape", '"').csv(landing)
    schema = "event_id bigint, user_id bigint, event_type string, value double, props string"
    reader = ingest_landing(spark, landing, schema, target, checkpoint, "part-*.csv",
                            options={"escape": '"'})
    reader.awaitTermination()
    return spark.read.parquet(target).drop("_source_file")


@REGISTRY.add(
    "schema_artifact",
    """
    SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, 'integer' AS data_type,
           count(DISTINCT o_orderkey) AS distinct_values FROM orders
    UNION ALL SELECT 'orders', 'o_custkey', 'integer', count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'orders', 'o_orderstatus', 'string', count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'orders', 'o_totalprice', 'float', count(DISTINCT o_totalprice) FROM orders
    UNION ALL SELECT 'orders', 'o_orderdate', 'datetime', count(DISTINCT o_orderdate) FROM orders
    UNION ALL SELECT 'orders', 'o_orderpriority', 'string', count(DISTINCT o_orderpriority) FROM orders
    """,
)
def schema_artifact(spark, sf_dir):
    """Profile a table, publish its schema document as JSON and read the baseline back from it."""
    root = scratch_path(spark, "artifact")
    path = publish_schema(schema_document(table(spark, sf_dir, "orders"), "orders", exact=True), root, "orders")
    from clearwell.plans.runs import DOCUMENT_SCHEMA

    return baseline_of(read_json(spark, path, DOCUMENT_SCHEMA, lines=True))
