"""Cleaning, deduplication, normalization and run counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.operators.clean import clean, fill_nulls, normalize_headers, strip_strings
from clearwell.operators.dedup import drop_duplicates
from clearwell.operators.normalize import convert_case, convert_units, scale, to_utc
from clearwell.operators.state import next_versions, rollback_runs
from clearwell.plans.registered.base import GAPPED, Registry, gapped_events, table
from clearwell.plans.runs import RunConfig, transform
from clearwell.session import scratch_path

REGISTRY = Registry()
ROWS = "event_id, user_id, event_type"


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@REGISTRY.add("clean_headers", "SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS brand_code FROM part")
def clean_headers(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return normalize_headers(part.toDF(" Part Key", "Part-Name ", "BRAND code"))


@REGISTRY.add("trim_strings", "SELECT p_partkey, p_name FROM part")
def trim_strings(spark, sf_dir):
    return strip_strings(
        table(spark, sf_dir, "part").select(
            "p_partkey", F.concat(F.lit("\t\n "), "p_name", F.lit("  \r\n")).alias("p_name")))


def _fill(numeric):
    def run(spark, sf_dir):
        rows = gapped_events(spark, sf_dir).select(*ROWS.split(", "), "value")
        return fill_nulls(rows, numeric=numeric).df.withColumn("value", F.round("value", 6))

    return run


V = f"SELECT {ROWS}, {GAPPED} AS v FROM events"
REGISTRY.add("fill_median", f"WITH e AS ({V}) SELECT {ROWS}, round(coalesce(v, (SELECT median(v) FROM e)), 6) AS value "
                            "FROM e")(_fill("median"))
REGISTRY.add("fill_mean", f"WITH e AS ({V}) SELECT {ROWS}, round(coalesce(v, (SELECT avg(v) FROM e)), 6) AS value FROM e")(
    _fill("mean"))
REGISTRY.add("fill_zero", f"WITH e AS ({V}) SELECT {ROWS}, round(coalesce(v, 0), 6) AS value FROM e")(_fill("zero"))
REGISTRY.add("fill_drop", f"WITH e AS ({V}) SELECT {ROWS}, round(v, 6) AS value FROM e WHERE v IS NOT NULL")(_fill("drop"))


@REGISTRY.add(
    "fill_string",
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'UNKNOWN' ELSE event_type END AS event_type FROM events",
)
def fill_string(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))
    return fill_nulls(rows).df


@REGISTRY.add("drop_null_ts", "SELECT event_id, epoch_us(ts) AS ts, value FROM events WHERE event_type <> 'click'")
def drop_null_ts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "click", F.col("ts")).alias("ts"), "value")
    return fill_nulls(rows).df.withColumn("ts", _micros("ts"))


@REGISTRY.add(
    "clean_metrics",
    """SELECT count(*) AS rows_input,
              count(*) FILTER (WHERE event_type = 'click') AS rows_cleaned,
              count(*) FILTER (WHERE event_type IN ('view', 'error')) AS null_cells_filled, true AS counts_agree
       FROM events""",
)
def clean_metrics(spark, sf_dir):
    rows = gapped_events(spark, sf_dir).select(
        "event_id", F.when(F.col("event_type") != "click", F.col("ts")).alias("ts"), "value",
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))
    done = clean(rows)
    return _counted(rows.where("ts is not null"), done.df, rows.where("ts is null"), ["value", "event_type"]).select(
        "rows_input", "rows_cleaned", "null_cells_filled",
        ((F.col("rows_input") == done.rows_input) & (F.col("rows_cleaned") == done.rows_cleaned)
         & (F.col("null_cells_filled") == done.null_cells_filled)).alias("counts_agree"))


def _counted(before, after, dropped, columns):
    """Rows and null cells of ``columns`` in the data before and after an operator, in one aggregation."""
    def side(df, name):
        nulls = sum((F.col(c).isNull().cast("bigint") for c in columns), start=F.lit(0))
        return df.select(F.lit(name).alias("side"), nulls.alias("nulls"))

    of = lambda *names: F.col("side").isin(*names)
    return side(before, "before").union(side(after, "after")).union(side(dropped, "dropped")).agg(
        F.count_if(of("before", "dropped")).alias("rows_input"), F.count_if(of("dropped")).alias("rows_cleaned"), F.count_if(of("after")).alias("rows_output"),
        (F.coalesce(F.sum(F.when(of("before"), F.col("nulls"))), F.lit(0)) - F.coalesce(F.sum(F.when(of("after"), F.col("nulls"))), F.lit(0))).alias("null_cells_filled"))


LINES = "l_partkey, l_suppkey, l_returnflag, l_linestatus"


@REGISTRY.add("dedup_all", f"SELECT DISTINCT {LINES} FROM lineitem")
def dedup_all(spark, sf_dir):
    return drop_duplicates(table(spark, sf_dir, "lineitem").select(*LINES.split(", ")))


def _dedup(keep):
    def run(spark, sf_dir):
        kept = drop_duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"], keep, ["event_id"])
        return kept.withColumn("ts", _micros("ts"))

    return run


for _keep, _direction in (("first", "ASC"), ("last", "DESC")):
    REGISTRY.add(
        f"dedup_{_keep}",
        f"""SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, props FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id {_direction}) AS r
            FROM events) WHERE r = 1""",
    )(_dedup(_keep))


@REGISTRY.add(
    "dedup_none",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM (
       SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""",
)
def dedup_none(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return drop_duplicates(lines, ["l_partkey", "l_suppkey"], False)


@REGISTRY.add(
    "dedup_removed",
    "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS rows_removed "
    "FROM lineitem",
)
def dedup_removed(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    kept = drop_duplicates(lines).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return lines.agg((F.count(F.lit(1)) - kept).alias("rows_removed"))


@REGISTRY.add(
    "scale_minmax",
    """SELECT event_id, event_type, round((value - lo) / (hi - lo), 6) AS value
       FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)""",
)
def scale_minmax(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return scale(rows, "minmax", ["value"]).withColumn("value", F.round("value", 6))


@REGISTRY.add(
    "scale_zscore",
    """SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / s, 4) + 0 AS l_extendedprice
       FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)""",
)
def scale_zscore(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return scale(rows, "zscore", ["l_extendedprice"]).withColumn("l_extendedprice", F.round("l_extendedprice", 4) + F.lit(0.0))


CUSTOMERS = ("c_custkey", "c_name", "c_mktsegment")
for _case in ("lower", "upper"):
    REGISTRY.add(
        f"case_{_case}",
        f"SELECT c_custkey, {_case}(c_name) AS c_name, {_case}(c_mktsegment) AS c_mktsegment FROM customer",
    )(lambda spark, sf_dir, case=_case: convert_case(table(spark, sf_dir, "customer").select(*CUSTOMERS), case))


@REGISTRY.add(
    "case_title",
    r"""SELECT conv_id, turn, array_to_string(list_transform(
            regexp_extract_all(lower(text), '[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+'),
            lambda p: (CASE WHEN p[1] = 'ß' THEN 'Ss' ELSE upper(p[1]) END) || p[2:]), '') AS text
        FROM conversations""",
)
def case_title(spark, sf_dir):
    return convert_case(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "title")


@REGISTRY.add("to_utc", "SELECT event_id, epoch_us(ts) AS micros FROM events")
def utc(spark, sf_dir):
    rows = to_utc(table(spark, sf_dir, "events").select("event_id", "ts"))
    return rows.select("event_id", _micros("ts").alias("micros"))


@REGISTRY.add("unit_convert", "SELECT event_id, round((value - 32) * 5 / 9, 6) AS value_c FROM events")
def unit_convert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    done = convert_units(rows, {"value": {"to": "value_c", "formula": "fahrenheit_to_celsius"}})
    return done.withColumn("value_c", F.round("value_c", 6))


@REGISTRY.add(
    "run_metrics",
    f"""
    WITH e AS (SELECT user_id, event_type, {GAPPED} AS v FROM events UNION ALL
               SELECT user_id, event_type, {GAPPED} FROM events),
    f AS (SELECT user_id, event_type, coalesce(v, (SELECT median(v) FROM e)) AS v FROM e)
    SELECT (SELECT count(*) FROM e) AS rows_input, (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS rows_output,
           (SELECT count(*) FROM f) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS rows_deduplicated,
           CAST(0 AS BIGINT) AS rows_cleaned, (SELECT count(*) FROM e WHERE v IS NULL) AS null_cells_filled, true AS counts_agree
    """,
)
def run_metrics(spark, sf_dir):
    """A whole run over the doubled events: null fill, dedup, normalization, written once and counted."""
    events = gapped_events(spark, sf_dir).select("user_id", "event_type", "value")
    doubled = events.unionAll(events)
    done = transform(doubled, RunConfig(), scratch_path(spark, "run"))
    names = ("rows_input", "rows_output", "rows_deduplicated", "rows_cleaned", "null_cells_filled")
    counted = _counted(doubled, done.df, doubled.where("false"), ["value"]).withColumn(
        "rows_deduplicated", F.col("rows_input") - F.col("rows_cleaned") - F.col("rows_output"))
    agree = [F.col(n) == getattr(done, n) for n in names]
    return counted.select(*names, (agree[0] & agree[1] & agree[2] & agree[3] & agree[4]).alias("counts_agree"))


@REGISTRY.add(
    "run_table",
    f"""
    WITH e AS (SELECT user_id, event_type, {GAPPED} AS v FROM events UNION ALL
               SELECT user_id, event_type, {GAPPED} FROM events)
    SELECT DISTINCT user_id, event_type, coalesce(v, (SELECT median(v) FROM e)) AS value FROM e
    """,
)
def run_table_rows(spark, sf_dir):
    events = gapped_events(spark, sf_dir).select("user_id", F.upper("event_type").alias("Event Type"), "value")
    return transform(events.unionAll(events), RunConfig(), scratch_path(spark, "run")).df


@REGISTRY.add("next_version", "SELECT l_orderkey AS pipeline_name, max(l_linenumber) + 1 AS next_version FROM lineitem "
                              "GROUP BY l_orderkey")
def next_version(spark, sf_dir):
    """Line items read as runs: one pipeline per order, its line numbers the versions."""
    runs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pipeline_name"), F.col("l_linenumber").alias("version"))
    return next_versions(runs)


@REGISTRY.add(
    "rollback",
    """
    WITH runs AS (SELECT DISTINCT l_orderkey AS pipeline_name, l_linenumber AS version FROM lineitem),
    asked AS (SELECT o_orderkey AS pipeline_name, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 99 END AS to_version
              FROM orders),
    ok AS (SELECT pipeline_name FROM asked a WHERE EXISTS (
           SELECT 1 FROM runs r WHERE r.pipeline_name = a.pipeline_name AND r.version = a.to_version))
    SELECT pipeline_name, version,
           CASE WHEN version = max(version) OVER (PARTITION BY pipeline_name)
                 AND pipeline_name IN (SELECT pipeline_name FROM ok) THEN 'rolled_back' ELSE 'success' END AS status
    FROM runs
    """,
)
def rollback_query(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pipeline_name"), F.col("l_linenumber").alias("version"),
        F.lit("success").alias("status"), F.lit("{}").alias("config_snapshot")).distinct()
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pipeline_name"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(99).alias("to_version"))
    return rollback_runs(runs, requests)[0].drop("config_snapshot")
