"""Append-only ledgers on Parquet with latest-state views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from clearwell.operators.state import latest_state, newest_first

# Name, key and columns of every ledger; each also has ``seq``, the order of its events.
LEDGERS: dict[str, tuple[str, str]] = {
    "schema_registry": (
        "table_name",
        "table_name string, status string, schema_json string, created_at timestamp, updated_at timestamp",
    ),
    "pipeline_runs": (
        "id",
        "id bigint, pipeline_name string, version int, status string, source_table string, target_table string, "
        "rows_input bigint, rows_output bigint, rows_deduplicated bigint, rows_cleaned bigint, "
        "null_cells_filled bigint, config_snapshot string, started_at timestamp, completed_at timestamp, "
        "created_at timestamp",
    ),
    "drift_alerts": (
        "id",
        "id bigint, pipeline_run_id bigint, alert_type string, severity string, column_name string, "
        "description string, details string, resolved boolean, resolved_by string, created_at timestamp",
    ),
    "repair_actions": (
        "id",
        "id bigint, pipeline_run_id bigint, drift_alert_id bigint, strategy string, risk_level string, "
        "status string, description string, before_snapshot string, after_snapshot string, applied_at timestamp, "
        "created_at timestamp",
    ),
    "table_catalog": (
        "table_name",
        "table_name string, zone string, storage_path string, trust_score double, freshness_timestamp timestamp, "
        "created_at timestamp, updated_at timestamp",
    ),
    "causal_links": (
        "id",
        "id bigint, source_event string, target_metric string, confidence_score double, description string, "
        "created_at timestamp",
    ),
    "approvals": (
        "id",
        "id bigint, agent_name string, action_type string, proposed_payload string, reasoning string, "
        "status string, feedback string, created_at timestamp, resolved_at timestamp",
    ),
    "context_vectors": (
        "id",
        "id bigint, reference_id string, content_type string, content string, metadata_json string, "
        "embedding array<float>",
    ),
    "metric_log": ("ts", "ts timestamp, metric string, value double, tags map<string,string>"),
}


class Ledger:
    """One append-only table: events are only ever added, the state of a key is its newest event.

    One writer at a time per ledger. :meth:`compacted` writes the current state elsewhere when a history gets long.
    """

    def __init__(self, spark: SparkSession, root: str, name: str) -> None:
        self.key, columns = LEDGERS[name]
        self.spark, self.name, self.path = spark, name, f"{root}/catalog/{name}"
        self.schema = T.StructType.fromDDL(f"{columns}, seq bigint")

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)

    def latest(self) -> DataFrame:
        return self.events() if self.name == "metric_log" else latest_state(self.events(), [self.key], ["seq"])

    def listing(self, **equals: object) -> DataFrame:
        return newest_first(self.latest(), "ts" if self.name == "metric_log" else "created_at", **equals)

    def append(self, rows: DataFrame) -> None:
        """Add events; columns a ledger has and ``rows`` lacks are null, ``seq`` and a missing ``id`` continue."""
        top = self.events().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("seq")).first()["seq"]
        step = F.monotonically_increasing_id() + F.lit(top + 1)
        names = {f.name for f in self.schema.fields}
        given = {c: F.col(c) for c in rows.columns if c in names}
        given.setdefault("seq", step)
        if "id" in names:
            given["id"] = F.coalesce(given["id"], step) if "id" in given else step
        rows.select(
            *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        ).write.mode("append").parquet(self.path)

    def compacted(self, root: str) -> "Ledger":
        """Write the state to a ledger under another root and return it."""
        other = Ledger(self.spark, root, self.name)
        self.latest().write.mode("errorifexists").parquet(other.path)
        return other


class Catalog:
    """All ledgers under one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def __getitem__(self, name: str) -> Ledger:
        return Ledger(self.spark, self.root, name)
