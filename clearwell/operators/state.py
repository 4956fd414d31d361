"""Keyed state as append-only events: catalog, causal links, approvals, metrics and trust scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.functions.fixed_values import TRUST_APPROVED, TRUST_NOT_APPROVED
from clearwell.functions.numeric import clamp

DECISIONS = ("approved", "rejected")
#: Steps of a table's history that are folded to one triple.
STRETCH = 4096


def latest_state(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest event per key: one aggregation, so a key with very many events is reduced before the shuffle."""
    rest = [c for c in events.columns if c not in keys and c not in order]
    newest = F.max(F.struct(*order, F.struct(*(rest or [F.lit(0).alias("_")])).alias("_rest")))
    picked = events.groupBy(*keys).agg(newest.alias("_e"))
    columns = {c: F.col(f"_e.{c}") for c in order} | {c: F.col(f"_e._rest.{c}") for c in rest}
    return picked.select(*[F.col(c) if c in keys else columns[c].alias(c) for c in events.columns])


def newest_first(table: DataFrame, time: str = "created_at", **equals: object) -> DataFrame:
    """Rows that match every given column, newest first."""
    for column, value in equals.items():
        if value is not None:
            table = table.where(F.col(column) == F.lit(value))
    return table.orderBy(F.desc(time))


def upsert_catalog(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert or replace tables by name. Both sides: table_name, zone, storage_path, trust_score,
    freshness_timestamp, seq; a change has a higher ``seq`` than what it replaces. Where the catalog has ``created_at``, a
    table keeps that of its oldest entry."""
    changes = changes.withColumn("trust_score", F.coalesce("trust_score", F.lit(100.0)))
    both = catalog.unionByName(changes)
    state = latest_state(both, ["table_name"], ["seq"])
    if "created_at" not in catalog.columns:
        return state
    first = both.groupBy(F.col("table_name").alias("_name")).agg(F.min_by("created_at", "seq").alias("_created"))
    return state.join(first, F.col("table_name").eqNullSafe(F.col("_name")), "left").withColumn(
        "created_at", F.col("_created")).drop("_name", "_created")


def update_trust(catalog: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set clamped trust scores by ``scores(table_name, seq, trust_score)``; unknown tables come back as errors."""
    newest = latest_state(scores.select("table_name", "seq", "trust_score"), ["table_name"], ["seq"]).select(
        "table_name", F.col("trust_score").alias("_new")
    )
    updated = (
        catalog.join(newest, "table_name", "left")
        .withColumn("trust_score", F.coalesce(clamp(F.col("_new"), 0.0, 100.0), "trust_score"))
        .drop("_new")
    )
    errors = scores.join(catalog.select("table_name"), "table_name", "left_anti").withColumn(
        "error", F.concat(F.lit("Table '"), "table_name", F.lit("' not found."))
    )
    return updated, errors


def causal_links(rows: DataFrame) -> DataFrame:
    """Links with the confidence clamped to 0..1."""
    return rows.withColumn("confidence_score", clamp(F.col("confidence_score"), 0.0, 1.0))


def trust_after(status: Column, trust: Column) -> Column:
    """One feedback applied to one score."""
    change = F.when(status == "approved", TRUST_APPROVED).otherwise(TRUST_NOT_APPROVED)
    return F.bround(clamp(trust + change, 0.0, 100.0), 2)


def _idle() -> Column:
    """Nothing done yet: any score stays what it is."""
    return F.struct(F.lit(0.0).alias("shift"), F.lit(0.0).alias("low"), F.lit(100.0).alias("high"))


def _step(x: Column, a: Column) -> Column:
    """A triple with one more shift behind it."""
    bound = lambda v: F.least(F.lit(100.0), F.greatest(F.lit(0.0), v))
    return F.struct((x["shift"] + a["shift"]).alias("shift"), bound(x["low"] + a["shift"]).alias("low"),
                    bound(x["high"] + a["shift"]).alias("high"))


def _compose(x: Column, t: Column) -> Column:
    return F.least(t["high"], F.greatest(t["low"], x + t["shift"]))


def feedback_windows(feedback: DataFrame, time: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """A stream of ``feedback(table_name, seq, status, <time>)`` to (table_name, window_start, t): each window's feedback as one triple.

    Events may come in any order within the lateness: a window is folded by ``seq`` when the watermark passes its end. State is kept by table
    and window, so a hot table's windows lie on many tasks and each holds a window's events at most. Later events are dropped.
    ``seq`` rises with the time.
    """
    shift = F.when(F.col("status") == "approved", TRUST_APPROVED).otherwise(TRUST_NOT_APPROVED)
    run = F.sort_array(F.collect_list(F.struct("seq", shift.alias("shift"))))
    return feedback.withWatermark(time, lateness).groupBy("table_name", F.window(time, window).alias("w")).agg(run.alias("run")).select(
        "table_name", F.col("w.start").alias("window_start"), F.aggregate("run", _idle(), _step).alias("t"))


def trust_from_windows(windows: DataFrame, start: float = 100.0) -> DataFrame:
    """Trust per table after all closed windows: their triples composed in order, as many as the calendar has windows."""
    triples = F.sort_array(F.collect_list(F.struct("window_start", "t")))
    return windows.groupBy("table_name").agg(F.bround(F.aggregate(F.transform(triples, lambda x: x["t"]), F.lit(float(start)), _compose), 2).alias("trust_score"))


def fold_feedback(feedback: DataFrame, start: float = 100.0, partitions: int | None = None) -> DataFrame:
    """Trust per table after all its feedback in order: ``feedback(table_name, seq, status)``.

    Each step is ``min(100, max(0, x + a))``. Steps compose into the triple (shift, low, high), so a table's history
    can be cut anywhere: rows are range-partitioned and sorted by table and order, stretches of at most ``STRETCH`` rows are folded
    to one triple each, and a table's triples are then composed in order. A hot table spreads over many tasks. A null table name is a
    name of its own.
    """
    steps = feedback.select(
        F.struct("table_name").alias("name"), "seq",
        F.when(F.col("status") == "approved", TRUST_APPROVED).otherwise(TRUST_NOT_APPROVED).alias("shift"),
    ).withColumn("key", F.to_json("name"))
    n = partitions or int(feedback.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the id rises with the partition and with the row in it, in the order of the sort
    ordered = steps.repartitionByRange(n, "key", "seq", "shift").sortWithinPartitions("key", "seq", "shift").withColumn("at", F.monotonically_increasing_id())
    run = F.sort_array(F.collect_list(F.struct("at", "shift")))  # STRETCH rows at most
    stretches = ordered.groupBy("key", F.expr(f"at div {STRETCH}").alias("stretch")).agg(
        F.first("name").alias("name"), F.aggregate(run, _idle(), _step).alias("t"))
    triples = F.sort_array(F.collect_list(F.struct("stretch", "t")))
    return stretches.groupBy("key").agg(F.first("name").alias("name"), F.bround(F.aggregate(
        F.transform(triples, lambda x: x["t"]), F.lit(float(start)), _compose), 2).alias("trust_score")).select(
            "name.table_name", "trust_score")


def queue_actions(requests: DataFrame) -> DataFrame:
    """Approval rows in state pending from ``(id, agent_name, action_type, proposed_payload, reasoning,
    created_at)``."""
    return requests.select(
        "id", "agent_name", "action_type", "proposed_payload", "reasoning", F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("feedback"), "created_at", F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def pending(approvals: DataFrame) -> DataFrame:
    return approvals.where(F.col("status") == "pending")


def resolve(approvals: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``decisions(id, decision, feedback, decided_at)`` to pending rows; the rest come back as errors.

    The first valid decision of an id counts. Approved rows end as ``executed``, rejected ones stay ``rejected``.
    """
    valid = decisions.where(F.col("decision").isin(*DECISIONS))
    first = valid.groupBy("id").agg(F.min(F.struct("decided_at", "decision", "feedback")).alias("_d"))
    open_ids = pending(approvals).select("id")
    usable = first.join(open_ids, "id", "left_semi")
    status = F.when(F.col("_d.decision") == "approved", F.lit("executed")).otherwise(F.col("_d.decision"))
    hit = F.col("_d").isNotNull()
    resolved = (
        approvals.join(usable, "id", "left")
        .withColumns({
            "status": F.when(hit, status).otherwise(F.col("status")),
            "feedback": F.when(hit, F.col("_d.feedback")).otherwise(F.col("feedback")),
            "resolved_at": F.when(hit, F.col("_d.decided_at")).otherwise(F.col("resolved_at")),
        })
        .drop("_d")
    )
    known = approvals.select("id", F.col("status").alias("_status"))
    taken = usable.select("id", F.col("_d.decided_at").alias("_taken"))
    reason = (
        F.when(~F.col("decision").isin(*DECISIONS) | F.col("decision").isNull(),
               F.lit("Decision must be 'approved' or 'rejected'"))
        .when(F.col("_status").isNull(), F.lit("Approval not found"))
        .when((F.col("_status") != "pending") | (F.col("decided_at") > F.col("_taken")), F.lit("Already resolved"))
    )
    errors = (
        decisions.join(known, "id", "left").join(taken, "id", "left").withColumn("error", reason)
        .where("error is not null").drop("_status", "_taken")
    )
    return resolved, errors


def metric_rows(rows: DataFrame) -> DataFrame:
    """Metric log entries ``(ts, metric, value, tags)``; missing tags become an empty map."""
    tags = F.col("tags") if "tags" in rows.columns else F.lit(None).cast("map<string,string>")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select("ts", "metric", F.col("value").cast("double").alias("value"), F.coalesce(tags, empty).alias("tags"))


def list_metrics(log: DataFrame) -> DataFrame:
    return log.orderBy("ts")


def next_versions(runs: DataFrame) -> DataFrame:
    """Version of the next run of every pipeline."""
    return runs.groupBy("pipeline_name").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def confirm_drafts(registry: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirm many tables at once: ``registry(table_name, status, schema_json)`` is the current state,
    ``requests(table_name, seq, schema_override)`` the confirmations. Unknown tables come back as errors."""
    newest = latest_state(requests.select("table_name", "seq", "schema_override"), ["table_name"], ["seq"])
    confirmed = registry.join(newest, "table_name").select(
        "table_name", F.lit("confirmed").alias("status"),
        F.coalesce("schema_override", "schema_json").alias("schema_json"))
    errors = newest.join(registry.select("table_name"), "table_name", "left_anti").select(
        "table_name", F.concat(F.lit("No schema found for table '"), "table_name", F.lit("' to confirm.")).alias("error"))
    return confirmed, errors


def rollback_runs(runs: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roll many pipelines back: ``runs(pipeline_name, version, status, config_snapshot)``,
    ``requests(pipeline_name, to_version)``.

    Returns the runs with the newest one of each pipeline marked, the settings to go back to, and the requests whose
    version does not exist, which change nothing.
    """
    targets = requests.join(
        runs.select("pipeline_name", F.col("version").alias("to_version"), "config_snapshot"),
        ["pipeline_name", "to_version"])
    newest = runs.groupBy("pipeline_name").agg(F.max("version").alias("version"))
    marked = newest.join(targets.select("pipeline_name").distinct(), "pipeline_name", "left_semi").withColumn(
        "_mark", F.lit(True))
    updated = runs.join(marked, ["pipeline_name", "version"], "left").withColumn(
        "status", F.when(F.col("_mark"), F.lit("rolled_back")).otherwise(F.col("status"))).drop("_mark")
    errors = requests.join(runs.select("pipeline_name", F.col("version").alias("to_version")),
                           ["pipeline_name", "to_version"], "left_anti")
    return updated.select(*runs.columns), targets, errors
