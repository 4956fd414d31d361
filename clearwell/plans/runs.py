"""Whole flows: ingest and confirm a schema; clean, deduplicate, normalize, check and repair a table; roll back."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwell.operators.clean import clean, normalized_name
from clearwell.operators.dedup import drop_duplicates
from clearwell.operators.drift import Thresholds, detect_drift
from clearwell.operators.normalize import normalize
from clearwell.operators.profile import baseline_of, schema_document
from clearwell.operators.repair import apply_repairs, resolve_alerts
from clearwell.sources.files import land_raw, publish_schema, read_batch, write_table
from clearwell.sources.ledger import Catalog

DOCUMENT_SCHEMA = (
    "table_name string, row_count bigint, columns array<struct<ordinal:int,name:string,data_type:string,"
    "nullable:boolean,statistics:struct<null_count:bigint,distinct_values:bigint,min:double,max:double,mean:double>,"
    "description:string,tags:array<string>>>"
)


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; frozen, so one run cannot change another's."""

    normalize_column_names: bool = True
    strip_whitespace: bool = True
    fill_numeric: str = "median"
    fill_string: str = "UNKNOWN"
    fill_datetime: str = "drop"
    dedup: bool = True
    dedup_subset: tuple[str, ...] | None = None
    dedup_keep: str | bool = "first"
    dedup_order: tuple[str, ...] | None = None
    scaling: str | None = None
    string_case: str | None = "lower"
    datetime_to_utc: bool = True
    unit_conversions: dict[str, dict[str, str]] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "RunConfig":
        values = json.loads(text)
        for key in ("dedup_subset", "dedup_order"):
            values[key] = tuple(values[key]) if values[key] is not None else None
        return RunConfig(**values)

    def with_(self, **changes: object) -> "RunConfig":
        return replace(self, **changes)


@dataclass(frozen=True)
class Transformed:
    """A transformed table that has been written, and its counts."""

    df: DataFrame
    rows_input: int
    rows_output: int
    rows_deduplicated: int
    rows_cleaned: int
    null_cells_filled: int


def transform(df: DataFrame, config: RunConfig, target: str) -> Transformed:
    """Clean, deduplicate and normalize into ``target``.

    The deduplicated table is written once, and what follows reads it back: scaling needs its own statistics, and
    nothing upstream is computed twice. Counts come from aggregates and from the written files, so a repeated task
    cannot inflate them.
    """
    cleaned = clean(
        df, config.normalize_column_names, config.strip_whitespace, config.fill_numeric, config.fill_string,
        config.fill_datetime,
    )
    rows = cleaned.df
    if config.dedup:
        rows = drop_duplicates(
            rows, list(config.dedup_subset) if config.dedup_subset else None, config.dedup_keep,
            list(config.dedup_order) if config.dedup_order else None,
        )
    units, case, utc = config.unit_conversions, config.string_case, config.datetime_to_utc
    if config.scaling:
        # scaling reads its statistics first: stage the rows so that they are deduplicated once
        staged = f"{target}_staged"
        rows.write.mode("overwrite").parquet(staged)
        rows = df.sparkSession.read.parquet(staged)
    normalize(rows, config.scaling, case, utc, units).write.mode("overwrite").parquet(target)
    out = df.sparkSession.read.parquet(target)
    output = out.count()
    return Transformed(
        out, cleaned.rows_input, output, cleaned.rows_input - cleaned.rows_cleaned - output, cleaned.rows_cleaned,
        cleaned.null_cells_filled,
    )


@dataclass(frozen=True)
class RunResult:
    df: DataFrame
    run: dict
    alerts: DataFrame | None = None
    actions: DataFrame | None = None


def ingest_batch(
    spark: SparkSession, catalog: Catalog, path: str | list[str], file_format: str, table: str, now: datetime,
    enrichment: DataFrame | None = None, read_options: dict | None = None, **profile_options,
) -> DataFrame:
    """Land a batch, profile it and register its schema as a draft, replacing an earlier registration.

    ``read_options`` go to the reader: ``lines`` for JSON with one record per line, ``multi_line`` for CSV.
    """
    raw_path = land_raw(spark, path, file_format, catalog.root, table, now)
    document = schema_document(read_batch(spark, path, file_format, **(read_options or {})), table, enrichment, **profile_options)
    row = document.select(F.to_json(F.struct("*")).alias("j")).first()["j"]  # as long as the table is wide
    _register(spark, catalog, table, "draft", row, now)
    return spark.createDataFrame([(row, raw_path)], "schema_json string, raw_path string")


def _register(spark: SparkSession, catalog: Catalog, table: str, status: str, schema_json: str, now: datetime) -> None:
    known = catalog["schema_registry"].events().where(F.col("table_name") == table)
    created = known.agg(F.min("created_at")).first()[0] or now
    catalog["schema_registry"].append(spark.createDataFrame(
        [(table, status, schema_json, created, now)],
        "table_name string, status string, schema_json string, created_at timestamp, updated_at timestamp"))


def confirm_schema(
    spark: SparkSession, catalog: Catalog, table: str, now: datetime, override: dict | None = None
) -> str:
    """Confirm the draft, or an override in its place, and publish it as JSON."""
    known = catalog["schema_registry"].latest().where(F.col("table_name") == table).first()
    if known is None:
        raise ValueError(f"no schema found for table {table!r} to confirm, ingest a batch first")
    final = json.dumps(override) if override else known["schema_json"]
    _register(spark, catalog, table, "confirmed", final, now)
    document = spark.createDataFrame([(final,)], "j string").select(F.from_json("j", DOCUMENT_SCHEMA).alias("d"))
    publish_schema(document.select("d.*"), catalog.root, table)
    return final


def confirmed_baseline(catalog: Catalog, table: str) -> DataFrame | None:
    """Columns of the confirmed schema of a table, or ``None``."""
    registry = catalog["schema_registry"].latest()
    found = registry.where((F.col("table_name") == table) & (F.col("status") == "confirmed"))
    if found.isEmpty():
        return None
    return baseline_of(found.select(F.from_json("schema_json", DOCUMENT_SCHEMA).alias("d")).select("d.*"))


def run_table(
    spark: SparkSession, catalog: Catalog, df: DataFrame, table: str, now: datetime,
    pipeline: str = "default_transform", config: RunConfig = RunConfig(), auto_heal: bool = True,
    thresholds: Thresholds = Thresholds(), exact: bool = True,
) -> RunResult:
    """Transform a batch, check it against the confirmed schema, repair low-risk findings and write the clean table.

    Every step leaves rows in the ledgers. Each run has its own folder ``run=…`` in the clean table, so earlier batches stay. Null rates are checked on the batch as it came, all else on the clean rows.
    """
    runs = catalog["pipeline_runs"]
    version = 1 + (runs.latest().where(F.col("pipeline_name") == pipeline).agg(F.max("version")).first()[0] or 0)
    run_id = 1 + (runs.events().agg(F.max("id")).first()[0] or 0)
    base = {
        "id": run_id, "pipeline_name": pipeline, "version": version, "status": "running",
        "source_table": f"raw_{table}", "target_table": f"clean_{table}", "config_snapshot": config.to_json(),
        "started_at": now, "created_at": now,
    }
    _log_run(spark, catalog, base)
    staged = f"{catalog.root}/staging/{table}/run={run_id}"
    try:
        done = transform(df, config, staged)
        base |= {
            "status": "success", "rows_input": done.rows_input, "rows_output": done.rows_output,
            "rows_deduplicated": done.rows_deduplicated, "rows_cleaned": done.rows_cleaned,
            "null_cells_filled": done.null_cells_filled, "completed_at": now,
        }
    except Exception as error:
        _log_run(spark, catalog, base | {"status": "failed", "completed_at": now})
        raise RuntimeError(f"pipeline {pipeline!r} v{version} failed: {error}") from error
    _log_run(spark, catalog, base)

    out, alerts, actions = done.df, None, None
    baseline = confirmed_baseline(catalog, table)
    if baseline is not None:
        if config.normalize_column_names:
            name = F.lower(F.replace(F.replace(F.trim("column_name"), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")))
            baseline = baseline.withColumn("column_name", name)
        raw = df.toDF(*[normalized_name(c) for c in df.columns]) if config.normalize_column_names else df
        found = detect_drift(out, baseline, thresholds, raw=raw, exact=exact)
        top = catalog["drift_alerts"].events().agg(F.max("id")).first()[0] or 0
        rows = [  # one alert per column and finding
            r.asDict() | {"id": top + i, "pipeline_run_id": run_id, "resolved": False, "resolved_by": None,
                          "created_at": now}
            for i, r in enumerate(found.collect(), 1)
        ]
        if rows:
            schema = ("id bigint, pipeline_run_id bigint, alert_order int, alert_type string, severity string, "
                      "column_name string, description string, details string, resolved boolean, resolved_by string, "
                      "created_at timestamp")
            alerts = spark.createDataFrame([{k: r[k] for k in _names(schema)} for r in rows], schema)
            catalog["drift_alerts"].append(alerts)
            if auto_heal:
                expected = [(r["column_name"], r["data_type"]) for r in baseline.collect()]
                out, actions = apply_repairs(out, alerts, expected, "low", exact)
                stamped = actions.withColumns({
                    "pipeline_run_id": F.lit(run_id), "created_at": F.lit(now),
                    "applied_at": F.when(F.col("status") == "applied", F.lit(now))})
                catalog["repair_actions"].append(stamped)
                alerts = resolve_alerts(alerts, actions)
                catalog["drift_alerts"].append(alerts.where("resolved"))
    written = write_table(out, catalog.root, "clean", f"{table}/run={run_id}")
    return RunResult(spark.read.parquet(written), base, alerts, actions)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _log_run(spark: SparkSession, catalog: Catalog, run: dict) -> None:
    schema = catalog["pipeline_runs"].schema
    row = [run.get(f.name) for f in schema.fields if f.name != "seq"]
    catalog["pipeline_runs"].append(spark.createDataFrame([row], type(schema)(schema.fields[:-1])))


def rollback(
    spark: SparkSession, catalog: Catalog, pipeline: str, to_version: int, now: datetime,
    raw: DataFrame | None = None, table: str | None = None,
) -> RunConfig:
    """Mark the newest run rolled back and return the target version's settings.

    With ``raw`` and ``table`` the newest run's folder of the clean table is written again from the raw rows under those
    settings.
    """
    runs = catalog["pipeline_runs"].latest().where(F.col("pipeline_name") == pipeline)
    target = runs.where(F.col("version") == to_version).first()
    if target is None:
        raise ValueError(f"no run of {pipeline!r} with version {to_version}")
    newest = runs.agg(F.max_by(F.struct(*runs.columns), "version").alias("r")).first()["r"].asDict()
    _log_run(spark, catalog, newest | {"status": "rolled_back"})
    config = RunConfig.from_json(target["config_snapshot"])
    if raw is not None and table is not None:
        restored = transform(raw, config, f"{catalog.root}/staging/{table}/rollback_to={to_version}_{now:%Y%m%d_%H%M%S}")
        write_table(restored.df, catalog.root, "clean", f"{table}/run={newest['id']}")
    return config
