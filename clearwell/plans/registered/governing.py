"""Personal data, freshness, masking and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.functions.fixed_values import PII_PATTERNS
from clearwell.operators.governance import governance_scan, mask_columns, noise_mask, scan_pii, stale_tables
from clearwell.plans.registered.base import Registry, table

REGISTRY = Registry()

# Customers with contact cells: segments carry an e-mail address, a social security number, a phone number or prose.
CONTACT = """CASE c_mktsegment WHEN 'BUILDING' THEN 'user' || c_custkey || '@example.com' WHEN 'MACHINERY'
    THEN '+4912345' || (10000 + c_custkey) ELSE 'call ' || c_name END"""
NUMBER = "CASE c_mktsegment WHEN 'FURNITURE' THEN '123-45-' || (1000 + c_custkey % 9000) ELSE c_mktsegment END"
PII_SQL = f"SELECT c_custkey, c_name, {CONTACT} AS contact, {NUMBER} AS number FROM customer"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.expr(CONTACT).alias("contact"), F.expr(NUMBER).alias("number"))


def _findings_sql(source: str, columns: tuple[str, ...], order: str) -> str:
    parts = []
    for c in columns:
        hits = [f"regexp_matches({c}, '{p}')" for _, p in PII_PATTERNS]
        kind = " ".join(f"WHEN {h} THEN '{n}'" for h, (n, _) in zip(hits, PII_PATTERNS))
        counts = ", ".join(f"count(*) FILTER (WHERE {h}) AS {n}_cells" for h, (n, _) in zip(hits, PII_PATTERNS))
        any_hit = " OR ".join(hits)
        parts.append(f"SELECT '{c}' AS column_name, arg_min(CASE {kind} END, {order}) FILTER (WHERE {any_hit}) AS type, "
                     f"{counts} FROM {source} HAVING count_if({any_hit}) > 0")
    return " UNION ALL ".join(parts)


@REGISTRY.add("pii_columns", f"WITH c AS ({PII_SQL}) " + _findings_sql("c", ("c_name", "contact", "number"), "c_custkey"))
def pii_columns(spark, sf_dir):
    found = scan_pii(_customers(spark, sf_dir), order_by=["c_custkey"])
    return found.drop("risk", "description")


@REGISTRY.add(
    "pii_documents",
    """SELECT 'text' AS column_name,
        count(*) FILTER (WHERE regexp_matches(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+')) AS email_cells,
        count(*) FILTER (WHERE regexp_matches(text, '(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)')) AS ssn_cells FROM documents""",
)
def pii_documents(spark, sf_dir):
    """Personal data inside running text, over whole texts."""
    found = scan_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), "contains", ["doc_id"])
    return found.select("column_name", "email_cells", "ssn_cells")


NOW = "2001-08-01 00:00:00"
FRESH_SQL = "SELECT 'tbl_' || o_custkey AS table_name, max(o_orderdate) AS f FROM orders GROUP BY o_custkey"


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("tbl_"), "o_custkey").alias("table_name")).agg(
        F.max("o_orderdate").cast("timestamp").alias("freshness_timestamp"), F.lit(50.0).alias("trust_score"))


@REGISTRY.add(
    "freshness",
    f"""WITH c AS ({FRESH_SQL}) SELECT table_name, round(epoch(TIMESTAMP '{NOW}' - f) / 3600, 6) AS hours_stale FROM c
        WHERE epoch(TIMESTAMP '{NOW}' - f) / 3600 > 24""",
)
def freshness(spark, sf_dir):
    return stale_tables(_catalog(spark, sf_dir), F.lit(NOW)).select(
        "table_name", F.round("hours_stale", 6).alias("hours_stale"))


STALE_SQL = f"(SELECT count(*) FROM ({FRESH_SQL}) WHERE epoch(TIMESTAMP '{NOW}' - f) / 3600 > 24)"


@REGISTRY.add(
    "governance_scan",
    f"""WITH c AS ({PII_SQL}), p AS ({_findings_sql("c", ("c_name", "contact", "number"), "c_custkey")})
    SELECT 'tbl_1' AS table_name, 'scan_complete' AS status, count(*) AS pii_issues_found,
           {STALE_SQL} AS stale_tables_found, CAST(count(*) > 0 AS INTEGER) AS actions_queued FROM p""",
)
def scan_report(spark, sf_dir):
    report, _, _ = governance_scan(
        _customers(spark, sf_dir), "tbl_1", _catalog(spark, sf_dir), F.lit(NOW), order_by=["c_custkey"])
    return report


@REGISTRY.add(
    "governance_requests",
    f"""WITH c AS ({PII_SQL}), p AS ({_findings_sql("c", ("c_name", "contact", "number"), "c_custkey")})
    SELECT 'steward' AS agent_name, 'mask_pii_columns' AS action_type,
           'Detected PII in columns: ' || string_agg(column_name, ', ' ORDER BY column_name) ||
           '. Recommend applying dynamic data masking.' AS reasoning FROM p HAVING count(*) > 0""",
)
def scan_requests(spark, sf_dir):
    _, requests, _ = governance_scan(
        _customers(spark, sf_dir), "tbl_1", _catalog(spark, sf_dir), F.lit(NOW), order_by=["c_custkey"])
    return requests.select("agent_name", "action_type", "reasoning")


@REGISTRY.add(
    "stale_penalty",
    f"""WITH c AS ({FRESH_SQL}) SELECT table_name,
        CASE WHEN table_name = 'tbl_1' AND epoch(TIMESTAMP '{NOW}' - f) / 3600 > 24 THEN CAST(45 AS DOUBLE)
             ELSE CAST(50 AS DOUBLE) END AS trust_score FROM c""",
)
def stale_penalty(spark, sf_dir):
    _, _, catalog = governance_scan(_customers(spark, sf_dir), "tbl_1", _catalog(spark, sf_dir), F.lit(NOW))
    return catalog.select("table_name", "trust_score")


@REGISTRY.add("mask_columns", f"WITH c AS ({PII_SQL}) SELECT c_custkey, c_name, sha256('s1' || contact) AS contact, "
                              "sha256('s1' || number) AS number FROM c")
def mask_hash(spark, sf_dir):
    return mask_columns(_customers(spark, sf_dir), ["contact", "number"], salt="s1")


@REGISTRY.add(
    "redact_columns",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\p{L}', 'x', 'g'), '\p{N}', '0', 'g') AS text FROM documents""",
)
def mask_redact(spark, sf_dir):
    return mask_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "redact")


@REGISTRY.add(
    "noise_mask", "SELECT count(*) AS n, TRUE AS most_changed, TRUE AS mean_fits, TRUE AS tail_fits, TRUE AS balanced FROM orders")
def noise(spark, sf_dir):
    """What must hold of the draw: scale 2 is the mean distance, a quarter lies beyond 2 ln 4, and signs are balanced."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    noisy = noise_mask(orders.withColumn("noisy", F.col("o_totalprice")), 0.5, 42, row_key=["o_orderkey", "o_totalprice"])
    d = F.col("noisy") - F.col("o_totalprice")
    return noisy.agg(
        F.count(F.lit(1)).alias("n"), (F.avg((d != 0).cast("int")) > 0.95).alias("most_changed"), (F.abs(F.avg(F.abs(d)) - 2) < 0.2).alias("mean_fits"),
        (F.abs(F.avg((F.abs(d) > 2.772588722239781).cast("int")) - 0.25) < 0.03).alias("tail_fits"),
        (F.abs(F.avg((d > 0).cast("int")) - 0.5) < 0.05).alias("balanced"))


@REGISTRY.add("noise_mask_keys", "SELECT o_orderkey, o_orderstatus, TRUE AS changed_little FROM orders")
def noise_keys(spark, sf_dir):
    """Keys and texts stay, prices move by noise of scale 2: beyond 100 is a chance of 1 in 10^21 per row."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    noisy = noise_mask(orders.withColumn("noisy", F.col("o_totalprice")), 0.5, 42, row_key=["o_orderkey", "o_totalprice"])
    return noisy.select("o_orderkey", "o_orderstatus",
                        (F.abs(F.col("noisy") - F.col("o_totalprice")) < 100).alias("changed_little"))
