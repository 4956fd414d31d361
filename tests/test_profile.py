import pytest
from pyspark.sql import functions as F

from clearwell.operators.profile import baseline_of, profile, schema_document, tag_columns
from clearwell.sources.files import read_csv

TELEMETRY = [
    ("2026-07-17T10:00:00Z", "CNC-01", 75.2, 1.25, 0, True),
    ("2026-07-17T10:01:00Z", "CNC-01", 80.5, 2.30, 1, True),
    ("2026-07-17T10:02:00Z", "CNC-02", 68.1, 0.95, 0, False),
]
SCHEMA = ("timestamp string, machine_id string, motor_temp_celsius double, vibration_amplitude double, "
          "error_count long, is_operational boolean")


@pytest.fixture(scope="module")
def telemetry(spark):
    return spark.createDataFrame(TELEMETRY, SCHEMA).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@pytest.mark.parametrize("exact", [True, False])
def test_profile_of_telemetry(telemetry, exact):
    rows = {r["column_name"]: r for r in tag_columns(profile(telemetry, exact=exact)).collect()}
    assert [rows[c]["data_type"] for c in telemetry.columns] == [
        "datetime", "string", "float", "float", "integer", "boolean"]
    assert not any(r["nullable"] for r in rows.values())
    assert all(r["row_count"] == 3 for r in rows.values())
    assert rows["machine_id"]["distinct_values"] == 2
    temp = rows["motor_temp_celsius"]
    assert (temp["min"], temp["max"]) == (68.1, 80.5) and temp["mean"] == pytest.approx(74.6, abs=0.1)
    assert rows["timestamp"]["tags"] == ["TIMESTAMP"]
    assert rows["machine_id"]["tags"] == ["IDENTIFIER"]
    assert "MEASUREMENT_TEMPERATURE" in rows["motor_temp_celsius"]["tags"]
    assert "METRIC_VIBRATION" in rows["vibration_amplitude"]["tags"]
    assert rows["is_operational"]["min"] is None


def test_default_tag_and_last_description(spark):
    names = spark.createDataFrame([("quux",), ("interval",), ("latency_id",)], "column_name string")
    got = {r["column_name"]: r for r in tag_columns(names).collect()}
    assert got["quux"]["tags"] == ["METRIC_GENERAL"]
    assert got["quux"]["description"] == "Generic raw input data column: quux"
    assert got["interval"]["tags"] == ["METRIC_FINANCE"]
    assert got["latency_id"]["tags"] == ["IDENTIFIER", "GEOLOCATION"]
    assert got["latency_id"]["description"] == "Geographic coordinates derived from column name 'latency_id'"


def test_nulls_nan_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, None), (float("nan"), None, "x"), (None, None, "x")],
                               "a double, b string, c string")
    rows = {r["column_name"]: r for r in profile(df, exact=True).collect()}
    assert rows["a"]["null_count"] == 2 and rows["a"]["distinct_values"] == 1 and rows["a"]["mean"] == 1.0
    assert rows["b"]["data_type"] == "string" and rows["b"]["distinct_values"] == 0 and rows["b"]["nullable"]


def test_date_probe(spark):
    df = spark.createDataFrame(
        [("07/17/2026", "Jul 17 2026", "20240101", "2024", "12", "10:00:00"),
         ("1/2/2026", "Jan 2 2026", "20240102", "2025", "13", "11:00:00")],
        "us string, words string, packed string, year string, number string, clock string")
    kinds = {r["column_name"]: r["data_type"] for r in profile(df).collect()}
    assert kinds == {"us": "datetime", "words": "datetime", "packed": "datetime", "year": "datetime",
                     "number": "string", "clock": "datetime"}


def test_date_probe_reads_every_row_and_ignores_padding(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01"), ("later", " " * 60 + "2024-01-01 10:00:00")], "d string, p string").coalesce(1)
    assert [r["data_type"] for r in profile(df).orderBy("ordinal").collect()] == ["string", "datetime"]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a")], "`a.b` int, `c d` string")
    assert {r["column_name"] for r in profile(df, exact=True).collect()} == {"a.b", "c d"}


def test_schema_document_round_trip(telemetry):
    document = schema_document(telemetry, "machine_telemetry", exact=True)
    row = document.first()
    assert row["row_count"] == 3 and [c["name"] for c in row["columns"]] == telemetry.columns
    base = {r["column_name"]: r["distinct_values"] for r in baseline_of(document).collect()}
    assert base["machine_id"] == 2


def test_csv_types_and_sentinels(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('n,x,b,s,q\n1,1.5,True,NA,"say ""hi"", ok"\nNA,2,False,u,\n3,nan,TRUE,v,w\n')
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "b": "boolean", "s": "string", "q": "string"}
    rows = df.collect()
    assert rows[1]["n"] is None and rows[2]["x"] is None and rows[0]["s"] is None and rows[0]["q"] == 'say "hi", ok'
