import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clearwell.plans.runs import (
    RunConfig,
    confirm_schema,
    confirmed_baseline,
    ingest_batch,
    rollback,
    run_table,
)
from clearwell.sources.files import read_batch, read_json, read_raw
from clearwell.sources.ledger import Catalog
from clearwell.streaming.ingest import ingest_events, ingest_landing, parse_events, read_folder

NOW = datetime(2026, 7, 17, 12)
CSV = """timestamp,machine_id,temperature,status
2025-03-04T05:06:07Z,press-a,61.25,RUN
2025-03-04T05:21:07Z,press-b,,HALT
2025-03-04T05:21:07Z,press-b,,HALT
2025-03-04T06:00:30Z,press-a,64.75,RUN
"""


@pytest.fixture()
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "lake"))


@pytest.fixture()
def csv_file(tmp_path):
    path = tmp_path / "batch.csv"
    path.write_text(CSV)
    return str(path)


def test_draft_then_confirmed(spark, catalog, csv_file):
    draft = ingest_batch(spark, catalog, csv_file, "csv", "machine_logs", NOW, exact=True).first()
    document = json.loads(draft["schema_json"])
    assert [c["name"] for c in document["columns"]] == ["timestamp", "machine_id", "temperature", "status"]
    assert document["columns"][0]["data_type"] == "datetime" and document["row_count"] == 4
    registry = catalog["schema_registry"]
    assert [r["status"] for r in registry.latest().collect()] == ["draft"]
    assert confirmed_baseline(catalog, "machine_logs") is None
    confirm_schema(spark, catalog, "machine_logs", NOW)
    assert [r["status"] for r in registry.latest().collect()] == ["confirmed"]
    assert confirmed_baseline(catalog, "machine_logs").count() == 4
    published = read_json(spark, f"{catalog.root}/schemas/machine_logs", lines=True).first()
    assert published["table_name"] == "machine_logs"
    assert read_raw(spark, catalog.root, "machine_logs").count() == 5  # with the header
    override = {"table_name": "machine_logs", "columns": [{"name": "a", "data_type": "float"}]}
    confirm_schema(spark, catalog, "machine_logs", NOW, override)
    assert [r["column_name"] for r in confirmed_baseline(catalog, "machine_logs").collect()] == ["a"]
    ingest_batch(spark, catalog, csv_file, "csv", "machine_logs", NOW)
    assert [r["status"] for r in registry.latest().collect()] == ["draft"]
    with pytest.raises(ValueError):
        confirm_schema(spark, catalog, "nowhere", NOW)
    with pytest.raises(ValueError):
        read_batch(spark, csv_file, "xml")


def test_end_to_end_run(spark, catalog, csv_file):
    df = read_batch(spark, csv_file, "csv")
    done = run_table(spark, catalog, df, "machine_logs", NOW)
    assert (done.run["status"], done.run["version"]) == ("success", 1)
    assert (done.run["rows_input"], done.run["rows_deduplicated"], done.run["rows_output"]) == (4, 1, 3)
    assert {r["status"] for r in done.df.collect()} == {"run", "halt"}
    assert [r["version"] for r in catalog["pipeline_runs"].listing(pipeline_name="default_transform").collect()] == [1]
    assert done.alerts is None


def test_versions_and_rollback(spark, catalog):
    df = spark.createDataFrame([(1, 10.0), (2, None), (2, 20.0), (3, 30.0)], "id long, value double")
    first = run_table(spark, catalog, df, "t", NOW, "test_pipeline")
    second = run_table(spark, catalog, df, "t", NOW, "test_pipeline", RunConfig(scaling="minmax", dedup=False))
    assert (first.run["version"], second.run["version"]) == (1, 2)
    assert first.run["rows_deduplicated"] == 1 and first.run["null_cells_filled"] == 1
    assert {r["value"] for r in second.df.collect()} == {0.0, 0.5, 1.0}
    with pytest.raises(ValueError):
        rollback(spark, catalog, "test_pipeline", 9, NOW)
    states = lambda: {r["version"]: r["status"] for r in catalog["pipeline_runs"].latest().collect()}
    assert states() == {1: "success", 2: "success"}
    config = rollback(spark, catalog, "test_pipeline", 1, NOW, df, "t")
    assert config == RunConfig() and states() == {1: "success", 2: "rolled_back"}
    assert {r["value"] for r in spark.read.parquet(f"{catalog.root}/clean/t").collect()} == {10.0, 20.0, 30.0}


def test_failed_run_is_recorded(spark, catalog):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    with pytest.raises(RuntimeError):
        run_table(spark, catalog, df, "t", NOW)
    assert [r["status"] for r in catalog["pipeline_runs"].latest().collect()] == ["failed"]


def test_drift_and_repair_reach_the_ledgers(spark, catalog, tmp_path, csv_file):
    ingest_batch(spark, catalog, csv_file, "csv", "machine_logs", NOW, exact=True)
    confirm_schema(spark, catalog, "machine_logs", NOW)
    rows = [("2026-07-18T10:00:00Z", "press-a", None if i % 3 else 70.0 + i, "extra") for i in range(30)]
    df = spark.createDataFrame(rows, "timestamp string, `Machine-ID` string, temperature double, note string")
    done = run_table(spark, catalog, df, "machine_logs", NOW)
    alerts = {(a["alert_type"], a["column_name"]): a for a in catalog["drift_alerts"].latest().collect()}
    assert ("schema_drift", "note") in alerts and ("schema_drift", "status") in alerts
    spike = alerts["null_spike", "temperature"]
    assert spike["severity"] == "critical" and spike["resolved"]
    assert not alerts["schema_drift", "status"]["resolved"]
    actions = {a["strategy"] for a in catalog["repair_actions"].listing(status="queued_for_approval").collect()}
    assert actions == {"schema_coercion"}
    assert done.df.where("temperature is null").isEmpty()


def test_ledger_appends_and_compacts(spark, tmp_path):
    ledger = Catalog(spark, str(tmp_path / "a"))["causal_links"]
    assert ledger.latest().isEmpty()
    rows = spark.createDataFrame([("e", "m", 0.5), ("f", "n", 0.7)], "source_event string, target_metric string, confidence_score double")
    ledger.append(rows)
    ledger.append(rows)
    assert ledger.latest().count() == 4 and ledger.events().select("id").distinct().count() == 4
    assert ledger.compacted(str(tmp_path / "b")).events().count() == 4
    metrics = Catalog(spark, str(tmp_path / "a"))["metric_log"]
    metrics.append(spark.sql("select timestamp'2024-01-01' as ts, 'test_latency' as metric, 120.5D as value, map('k','v') as tags"))
    assert metrics.listing(metric="test_latency").first()["value"] == 120.5


def test_config_round_trip():
    config = RunConfig(dedup_subset=("a",), dedup_keep=False, unit_conversions={"f": {"to": "c", "formula": "fahrenheit_to_celsius"}})
    assert RunConfig.from_json(config.to_json()) == config and RunConfig().with_(scaling="zscore").scaling == "zscore"


def test_landing_folder_reads_each_file_once(spark, tmp_path):
    landing, target, done = tmp_path / "landing", str(tmp_path / "out"), tmp_path / "processed"
    landing.mkdir()
    schema = "log_id string, current_state string"
    write = lambda name, body: (landing / name).write_text("log_id,current_state\n" + body)
    run = lambda: ingest_landing(spark, str(landing), schema, target, str(tmp_path / "cp"), processed=str(done)).awaitTermination()
    write("machine_logs_1.csv", "L1,RUN\n")
    write("other.csv", "LX,RUN\n")
    run()
    write("machine_logs_2.csv", "L2,HALT\n")
    run()
    run()
    assert sorted(r["log_id"] for r in spark.read.parquet(target).collect()) == ["L1", "L2"]
    assert not (landing / "machine_logs_1.csv").exists() and (landing / "other.csv").exists()


def test_sensor_events(spark, tmp_path):
    good = '{"timestamp":"2025-03-04T05:06:07Z","machine_id":"press-a","temperature_celsius":72.5}'
    rows = [(good,), ('{"timestamp":"soon","machine_id":"x"}',), ("not json",), (None,)]
    messages = spark.createDataFrame(rows, "payload string")
    parsed = parse_events(messages)
    assert [r["valid"] for r in parsed.collect()] == [True, False, False, False]
    messages.write.parquet(str(tmp_path / "in"))
    stream = read_folder(spark, str(tmp_path / "in"), "payload string", "parquet")
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    ingest_events(stream, out, bad, str(tmp_path / "cp")).awaitTermination()
    row = spark.read.parquet(out).first()
    assert row["machine_id"] == "press-a" and row["temperature_celsius"] == 72.5
    assert spark.read.parquet(bad).where(F.col("payload") == "not json").count() == 1
