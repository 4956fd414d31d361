"""Keyed state: catalog, trust, links, approvals, metrics, lessons."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.operators.learning import grade, learning_paths, scores
from clearwell.operators.state import (
    causal_links,
    fold_feedback,
    list_metrics,
    metric_rows,
    pending,
    queue_actions,
    resolve,
    trust_after,
    update_trust,
    upsert_catalog,
)
from clearwell.plans.registered.base import Registry, table
from clearwell.session import scratch_path
from clearwell.sources.ledger import Catalog

REGISTRY = Registry()

# Orders read as catalog changes of one table per customer.
CHANGES = """SELECT 'tbl_' || o_custkey AS table_name, o_orderstatus AS zone, 'lake/' || o_orderpriority AS storage_path,
    CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice / 10000 END AS trust_score,
    o_orderdate AS freshness_timestamp, o_orderkey AS seq FROM orders"""
LATEST_SQL = f"""SELECT table_name, zone, storage_path, coalesce(trust_score, 100) AS trust_score, freshness_timestamp, seq
    FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY seq DESC) AS r FROM ({CHANGES})) WHERE r = 1"""


def _catalog(spark, sf_dir):
    changes = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("tbl_"), "o_custkey").alias("table_name"), F.col("o_orderstatus").alias("zone"),
        F.concat(F.lit("lake/"), "o_orderpriority").alias("storage_path"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 10000).alias("trust_score"),
        F.col("o_orderdate").alias("freshness_timestamp"), F.col("o_orderkey").alias("seq"))
    return upsert_catalog(changes.limit(0), changes)


@REGISTRY.add(
    "latest_catalog",
    f"SELECT table_name, zone, storage_path, trust_score, epoch_us(freshness_timestamp) AS freshness, seq FROM ({LATEST_SQL})",
)
def latest_catalog(spark, sf_dir):
    state = _catalog(spark, sf_dir)
    return state.withColumn("freshness", F.unix_micros(F.col("freshness_timestamp").cast("timestamp"))).drop(
        "freshness_timestamp")


@REGISTRY.add(
    "catalog_upsert",
    """WITH o AS (SELECT 'tbl_' || o_custkey AS table_name, o_orderstatus AS zone, o_totalprice / 10000 AS trust_score, o_orderdate, o_orderkey FROM orders)
    SELECT table_name, arg_max(zone, (o_orderdate, o_orderkey)) AS zone, arg_max(trust_score, (o_orderdate, o_orderkey)) AS trust_score,
           epoch_us(min(o_orderdate)) AS created FROM o GROUP BY table_name""",
)
def catalog_upsert(spark, sf_dir):
    """Orders of the later years replace the catalog of the earlier ones; a table keeps the time it was made."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("tbl_"), "o_custkey").alias("table_name"), F.col("o_orderstatus").alias("zone"),
        F.lit("lake").alias("storage_path"), (F.col("o_totalprice") / 10000).alias("trust_score"),
        F.col("o_orderdate").alias("freshness_timestamp"), F.col("o_orderdate").alias("created_at"),
        (F.unix_date(F.to_date("o_orderdate")).cast("long") * 10_000_000_000 + F.col("o_orderkey")).alias("seq"))
    early = F.year("created_at") < 1995
    catalog = upsert_catalog(orders.limit(0), orders.where(early))
    done = upsert_catalog(catalog, orders.where(~early))
    return done.select("table_name", "zone", "trust_score", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"))


@REGISTRY.add(
    "ledger_listing",
    "SELECT epoch_us(o_orderdate) AS at, o_totalprice AS value, CAST(o_orderkey AS VARCHAR) AS tag FROM orders WHERE o_orderstatus = 'F'")
def ledger_listing(spark, sf_dir):
    """Orders appended to the metric ledger in three batches, and one metric listed."""
    ledger = Catalog(spark, scratch_path(spark, "ledgers"))["metric_log"]
    orders = table(spark, sf_dir, "orders")
    for part in range(3):
        ledger.append(orders.where(F.col("o_orderkey") % 3 == part).select(
            F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderstatus").alias("metric"),
            F.col("o_totalprice").cast("double").alias("value"), F.create_map(F.lit("order"), F.col("o_orderkey").cast("string")).alias("tags")))
    return ledger.listing(metric="F").select(F.unix_micros("ts").alias("at"), "value", F.col("tags")["order"].alias("tag"))


def _scores(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.select(
        F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "gone_").otherwise("tbl_"), "c_custkey").alias("table_name"),
        F.col("c_custkey").alias("seq"), (F.col("c_acctbal") / 50).alias("trust_score"))


SCORES_SQL = """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'gone_' ELSE 'tbl_' END || c_custkey AS table_name,
    c_acctbal / 50 AS new_score FROM customer"""


@REGISTRY.add(
    "trust_update",
    f"""WITH c AS ({LATEST_SQL}), s AS ({SCORES_SQL})
    SELECT table_name, round(CASE WHEN new_score IS NULL THEN trust_score ELSE least(greatest(new_score, 0), 100) END, 6) AS trust_score
    FROM c LEFT JOIN s USING (table_name)""",
)
def trust_update(spark, sf_dir):
    updated, _ = update_trust(_catalog(spark, sf_dir), _scores(spark, sf_dir))
    return updated.select("table_name", F.round("trust_score", 6).alias("trust_score"))


@REGISTRY.add(
    "trust_update_errors",
    f"""WITH c AS ({LATEST_SQL}), s AS ({SCORES_SQL})
    SELECT table_name, 'Table ''' || table_name || ''' not found.' AS error FROM s ANTI JOIN c USING (table_name)""",
)
def trust_update_errors(spark, sf_dir):
    _, errors = update_trust(_catalog(spark, sf_dir), _scores(spark, sf_dir))
    return errors.select("table_name", "error")


@REGISTRY.add(
    "causal_links",
    """SELECT event_id AS id, event_type AS source_event, 'metric_' || user_id AS target_metric,
              least(greatest(value / 60 - 0.1, 0), 1) AS confidence_score, props AS description FROM events""",
)
def links(spark, sf_dir):
    return causal_links(table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("source_event"),
        F.concat(F.lit("metric_"), "user_id").alias("target_metric"),
        (F.col("value") / 60 - 0.1).alias("confidence_score"), F.col("props").alias("description")))


@REGISTRY.add(
    "feedback_row",
    """SELECT c_custkey, round_even(least(greatest(floor(c_acctbal) / 100 +
              CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.5 ELSE -3.0 END, 0), 100), 2) AS trust_score FROM customer""",
)
def feedback_row(spark, sf_dir):
    status = F.when(F.col("c_mktsegment") == "MACHINERY", "approved").otherwise("rejected")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", trust_after(status, F.floor("c_acctbal") / 100).alias("trust_score"))


@REGISTRY.add(
    "feedback_fold",
    """SELECT event_type AS table_name, list_reduce(
           list_prepend(CAST(100 AS DOUBLE),
                        list(CAST(CASE WHEN value > 20 THEN 1.5 ELSE -3.0 END AS DOUBLE) ORDER BY event_id)),
           lambda x, a: least(100, greatest(0, x + a))) AS trust_score
       FROM events GROUP BY event_type""",
)
def feedback_fold(spark, sf_dir):
    """Five hot tables, each with a fifth of all feedback."""
    return fold_feedback(table(spark, sf_dir, "events").select(
        F.col("event_type").alias("table_name"), F.col("event_id").alias("seq"),
        F.when(F.col("value") > 20, "approved").otherwise("rejected").alias("status")))


# Orders read as approval requests, line items as decisions on them.
def _approvals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    queued = queue_actions(orders.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("agent "), "o_orderstatus").alias("agent_name"),
        F.lit("report").alias("action_type"), F.to_json(F.struct(F.col("o_custkey").alias("customer"))).alias(
            "proposed_payload"),
        F.col("o_orderpriority").alias("reasoning"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_orderstatus").alias("s")))
    return queued.withColumn(
        "status", F.when(F.col("agent_name") == "agent F", F.lit("rejected")).otherwise(F.col("status")))


@REGISTRY.add(
    "queue_actions",
    """SELECT c_custkey AS id, c_name AS agent_name, 'mask_pii_columns' AS action_type,
              '{"segment":"' || c_mktsegment || '"}' AS proposed_payload, 'balance' AS reasoning, 'pending' AS status
       FROM customer""",
)
def queued(spark, sf_dir):
    rows = queue_actions(table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("agent_name"), F.lit("mask_pii_columns").alias("action_type"),
        F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("proposed_payload"),
        F.lit("balance").alias("reasoning"), F.lit("2024-01-01").cast("timestamp").alias("created_at")))
    return rows.drop("feedback", "created_at", "resolved_at")


@REGISTRY.add("pending", "SELECT o_orderkey AS id, 'agent ' || o_orderstatus AS agent_name FROM orders "
                         "WHERE o_orderstatus <> 'F'")
def pending_rows(spark, sf_dir):
    return pending(_approvals(spark, sf_dir)).select("id", "agent_name")


def _decisions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected")
        .otherwise("maybe").alias("decision"),
        F.col("l_linestatus").alias("feedback"),
        # one decision time per line, later for later lines
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(
            mins=F.col("l_linenumber"), secs=F.pmod(F.col("l_partkey"), F.lit(60)).cast("decimal(8,0)"))).alias("decided_at"))


DECISIONS_SQL = """o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'rejected' ELSE 'pending' END AS status
        FROM orders),
    d AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'maybe' END
            AS decision, l_linestatus AS feedback, l_shipdate + to_minutes(l_linenumber) + to_seconds(l_partkey % 60)
            AS decided_at FROM lineitem),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY decided_at, decision, feedback) AS r FROM d
          WHERE decision <> 'maybe' AND id IN (SELECT id FROM o WHERE status = 'pending')) WHERE r = 1)"""


@REGISTRY.add(
    "resolve",
    f"""WITH {DECISIONS_SQL}
    SELECT id, CASE WHEN decision IS NULL THEN status WHEN decision = 'approved' THEN 'executed' ELSE decision END AS status,
           w.feedback AS feedback FROM o LEFT JOIN w USING (id)""",
)
def resolved(spark, sf_dir):
    return resolve(_approvals(spark, sf_dir), _decisions(spark, sf_dir))[0].select("id", "status", "feedback")


@REGISTRY.add(
    "resolve_errors",
    f"""WITH {DECISIONS_SQL}, e AS (
      SELECT d.id AS id, CASE WHEN d.decision = 'maybe' THEN 'Decision must be ''approved'' or ''rejected'''
             WHEN o.id IS NULL THEN 'Approval not found'
             WHEN o.status <> 'pending' OR d.decided_at > w.decided_at THEN 'Already resolved' END AS error
      FROM d LEFT JOIN o USING (id) LEFT JOIN w USING (id))
    SELECT id, error FROM e WHERE error IS NOT NULL""",
)
def resolve_errors(spark, sf_dir):
    return resolve(_approvals(spark, sf_dir), _decisions(spark, sf_dir))[1].select("id", "error")


@REGISTRY.add("metric_list", "SELECT epoch_us(ts) AS micros, event_type AS metric, value, props AS source, "
                             "CAST(user_id AS VARCHAR) AS user_tag FROM events ORDER BY ts")
def metric_list(spark, sf_dir):
    """Events as a metric log with tag maps, listed in order of time."""
    log = metric_rows(table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), "value",
        F.create_map(F.lit("source"), "props", F.lit("user"), F.col("user_id").cast("string")).alias("tags")))
    return list_metrics(log).select(
        F.unix_micros("ts").alias("micros"), "metric", "value", F.col("tags")["source"].alias("source"),
        F.col("tags")["user"].alias("user_tag"))


# Lessons per conversation role and label quality, from what the tables hold.
LESSONS_SQL = """SELECT 'lesson-' || n_nationkey AS id, 'Lesson ' || n_name AS title,
    CASE n_regionkey WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'steward' END AS role,
    n_name AS correct_answer, 10 * (n_regionkey + 1) AS points FROM nation"""


def _lessons(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("lesson-"), "n_nationkey").alias("id"), F.concat(F.lit("Lesson "), "n_name").alias("title"),
        F.when(F.col("n_regionkey") == 0, "user").when(F.col("n_regionkey") == 1, "assistant").otherwise("steward").alias(
            "role"),
        F.col("n_name").alias("correct_answer"), (10 * (F.col("n_regionkey") + 1)).alias("points"))


@REGISTRY.add(
    "learning_path",
    f"""WITH l AS ({LESSONS_SQL})
    SELECT conv_id, turn, c.role AS role, l.id AS lesson_id FROM conversations c JOIN l ON l.role = c.role
    UNION ALL SELECT conv_id, turn, c.role, l.id FROM conversations c, l WHERE c.role NOT IN (SELECT role FROM l)""",
)
def learning_path(spark, sf_dir):
    """Speakers as learners; the system role has no lessons of its own and gets all."""
    learners = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return learning_paths(learners, _lessons(spark, sf_dir)).select(
        "conv_id", "turn", "role", F.col("id").alias("lesson_id"))


SUBMISSIONS_SQL = """SELECT c_custkey AS user_id, 'lesson-' || (CASE WHEN c_mktsegment = 'BUILDING' THEN 99
    ELSE c_nationkey END) AS lesson_id, CASE WHEN c_acctbal > 3000 THEN 'NATION_' || c_nationkey ELSE c_mktsegment END
    AS answer FROM customer
    UNION ALL SELECT o_custkey, 'lesson-' || (o_custkey % 25), 'NATION_' || (o_orderkey % 25) FROM orders"""


def _submissions(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("lesson-"), F.when(F.col("c_mktsegment") == "BUILDING", 99).otherwise(F.col("c_nationkey"))).alias(
            "lesson_id"),
        F.when(F.col("c_acctbal") > 3000, F.concat(F.lit("NATION_"), "c_nationkey")).otherwise(
            F.col("c_mktsegment")).alias("answer"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.concat(F.lit("lesson-"), F.pmod("o_custkey", F.lit(25))).alias("lesson_id"),
        F.concat(F.lit("NATION_"), F.pmod("o_orderkey", F.lit(25))).alias("answer"))
    return customers.unionByName(orders)


GRADED_SQL = f"""l AS ({LESSONS_SQL}), s AS ({SUBMISSIONS_SQL}),
    g AS (SELECT user_id, lesson_id, answer, CASE WHEN l.id IS NULL THEN 'error' ELSE 'success' END AS status,
    CASE WHEN l.id IS NOT NULL THEN correct_answer = answer END AS correct,
    CASE WHEN correct_answer = answer THEN points WHEN l.id IS NOT NULL THEN 0 END AS points_awarded
    FROM s LEFT JOIN l ON l.id = s.lesson_id)"""


@REGISTRY.add(
    "grade",
    f"""WITH {GRADED_SQL} SELECT user_id, lesson_id, answer, status, coalesce(correct, FALSE) AS correct,
        coalesce(points_awarded, -1) AS points_awarded FROM g""",
)
def graded(spark, sf_dir):
    done = grade(_submissions(spark, sf_dir), _lessons(spark, sf_dir))
    return done.select("user_id", "lesson_id", "answer", "status", F.coalesce("correct", F.lit(False)).alias("correct"),
                       F.coalesce("points_awarded", F.lit(-1)).alias("points_awarded"))


@REGISTRY.add("score", f"WITH {GRADED_SQL} SELECT user_id, CAST(100 + coalesce(sum(points_awarded), 0) AS BIGINT) AS score "
                       "FROM g GROUP BY user_id")
def score(spark, sf_dir):
    return scores(grade(_submissions(spark, sf_dir), _lessons(spark, sf_dir)))
