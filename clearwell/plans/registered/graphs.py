"""Customers, suppliers, orders and nations as a property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.operators.graph import (
    delete_label,
    er_diagram,
    er_edges,
    glossary,
    link_nodes,
    make_edges,
    make_nodes,
    resolve_entities,
)
from clearwell.plans.registered.base import Registry, table

REGISTRY = Registry()

NODES_SQL = """
    SELECT 'CUST-' || c_custkey AS id, ['Entity', 'Customer'] AS labels, c_name AS name, c_mktsegment AS type,
           ['c_' || c_custkey] AS variant_keys FROM customer
    UNION ALL SELECT DISTINCT 'CUST-' || o_custkey || '-' || o_orderstatus, ['Entity', 'Customer', 'Demo'],
           'Account ' || o_custkey, 'account', NULL FROM orders
    UNION ALL SELECT 'SUPP-' || s_suppkey, ['Entity', 'Supplier'], s_name, 'supplier', NULL FROM supplier
    UNION ALL SELECT 'EVT-' || o_orderkey, ['Event'], o_orderpriority, 'order', NULL FROM orders
    UNION ALL SELECT 'MET-' || n_nationkey, ['Metric', 'Golden'], n_name, 'financial', NULL FROM nation"""
EDGES_SQL = """
    SELECT 'CUST-' || o_custkey AS src, 'PLACED' AS rel, 'EVT-' || o_orderkey AS dst FROM orders
    UNION ALL SELECT 'EVT-' || o_orderkey, 'BOOKED_ON', 'CUST-' || o_custkey || '-' || o_orderstatus FROM orders
    UNION ALL SELECT 'CUST-' || c_custkey, 'IMPACTS', 'MET-' || c_nationkey FROM customer
    UNION ALL SELECT 'SUPP-' || s_suppkey, 'IMPACTS', 'MET-' || s_nationkey FROM supplier"""


def _graph(spark, sf_dir):
    customer, supplier, nation, orders = (table(spark, sf_dir, n) for n in ("customer", "supplier", "nation", "orders"))
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    account = F.concat(F.lit("CUST-"), "o_custkey", F.lit("-"), "o_orderstatus")
    nodes = (
        make_nodes(customer, key("CUST-", "c_custkey"), ["Entity", "Customer"], name=F.col("c_name"),
                   type=F.col("c_mktsegment"), variant_keys=F.array(key("c_", "c_custkey")))
        .unionByName(make_nodes(orders.select("o_custkey", "o_orderstatus").distinct(), account,
                                ["Entity", "Customer", "Demo"], name=key("Account ", "o_custkey"), type=F.lit("account")))
        .unionByName(make_nodes(supplier, key("SUPP-", "s_suppkey"), ["Entity", "Supplier"], name=F.col("s_name"),
                                type=F.lit("supplier")))
        .unionByName(make_nodes(orders, key("EVT-", "o_orderkey"), ["Event"], name=F.col("o_orderpriority"),
                                type=F.lit("order")))
        .unionByName(make_nodes(nation, key("MET-", "n_nationkey"), ["Metric", "Golden"], name=F.col("n_name"),
                                type=F.lit("financial")))
    )
    confidence = F.create_map(F.lit("confidence"), F.lit("0.85"))
    edges = (
        make_edges(orders, key("CUST-", "o_custkey"), "PLACED", key("EVT-", "o_orderkey"))
        .unionByName(make_edges(orders, key("EVT-", "o_orderkey"), "BOOKED_ON", account))
        .unionByName(make_edges(customer, key("CUST-", "c_custkey"), "IMPACTS", key("MET-", "c_nationkey"), confidence))
        .unionByName(make_edges(supplier, key("SUPP-", "s_suppkey"), "IMPACTS", key("MET-", "s_nationkey"), confidence))
    )
    return nodes, edges


@REGISTRY.add(
    "graph_nodes",
    f"SELECT id, array_to_string(labels, ':') AS labels, name, type, array_to_string(variant_keys, ',') AS variants "
    f"FROM ({NODES_SQL})",
)
def graph_nodes(spark, sf_dir):
    nodes, _ = _graph(spark, sf_dir)
    return nodes.select("id", F.array_join("labels", ":").alias("labels"), "name", "type",
                        F.array_join("variant_keys", ",").alias("variants"))


@REGISTRY.add("graph_edges", EDGES_SQL)
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("src", "rel", "dst")


@REGISTRY.add(
    "link_nodes",
    """SELECT 'CUST-' || c_custkey AS src, 'IMPACTS' AS rel, 'MET-' || n_nationkey AS dst FROM customer
       JOIN nation ON n_nationkey = c_custkey % 25""",
)
def linked(spark, sf_dir):
    """Edges found by matching properties: a number in the customer's name and in the nation's."""
    nodes, _ = _graph(spark, sf_dir)
    customers = nodes.where("type not in ('account') and array_contains(labels, 'Customer')")
    metrics = nodes.where("array_contains(labels, 'Metric')")
    number = F.regexp_extract("id", "([0-9]+)$", 1).cast("bigint")
    return link_nodes(customers, metrics, F.pmod(number, F.lit(25)), number, "IMPACTS").select("src", "rel", "dst")


@REGISTRY.add(
    "graph_delete",
    f"""WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL}), gone AS (SELECT id FROM n WHERE list_contains(labels, 'Demo'))
    SELECT 'node' AS kind, id AS a, '' AS b FROM n WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'edge', src, dst FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)""",
)
def graph_delete(spark, sf_dir):
    nodes, edges = delete_label(*_graph(spark, sf_dir), "Demo")
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


VARIANTS_SQL = f"""SELECT id, name, regexp_extract(id, '^([A-Z]+-[0-9]+)', 1) AS root FROM ({NODES_SQL})
    WHERE list_contains(labels, 'Customer')"""


@REGISTRY.add(
    "resolve_entities",
    f"SELECT id AS src, 'RESOLVES_TO' AS rel, 'GOLDEN-' || root AS dst FROM ({VARIANTS_SQL})",
)
def resolve_links(spark, sf_dir):
    return resolve_entities(*_graph(spark, sf_dir))[2].select("src", "rel", "dst")


@REGISTRY.add(
    "golden_nodes",
    f"""SELECT 'GOLDEN-' || root AS id, arg_min(name, id) || ' (Unified)' AS name FROM ({VARIANTS_SQL}) GROUP BY root""",
)
def golden_nodes(spark, sf_dir):
    """Golden nodes after two runs of the resolution, the second of which adds nothing."""
    nodes, edges, _ = resolve_entities(*_graph(spark, sf_dir))
    again, _, _ = resolve_entities(nodes, edges)
    return again.where(F.startswith("id", F.lit("GOLDEN-"))).select("id", "name")


ER_SQL = f"""WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL})
    SELECT DISTINCT a.labels[1] AS source, rel, b.labels[1] AS target FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst"""


@REGISTRY.add("er_edges", ER_SQL)
def er(spark, sf_dir):
    return er_edges(*_graph(spark, sf_dir))


@REGISTRY.add(
    "er_diagram",
    f"""WITH p AS ({ER_SQL})
    SELECT 0 AS line_no, 'erDiagram' AS line
    UNION ALL SELECT CAST(row_number() OVER (ORDER BY source, rel, target) AS INTEGER),
           '    ' || source || ' ||--o{{ ' || target || ' : "' || rel || '"' FROM p""",
)
def diagram(spark, sf_dir):
    return er_diagram(*_graph(spark, sf_dir))


@REGISTRY.add(
    "glossary",
    f"""SELECT DISTINCT term, 'Business entity or concept representing ' || term ||
           ' within the enterprise context graph.' AS definition, 'Graph Auto-Generated' AS source
    FROM (SELECT unnest(labels) AS term FROM ({NODES_SQL})) WHERE term NOT IN ('Demo', 'Golden')""",
)
def terms(spark, sf_dir):
    return glossary(_graph(spark, sf_dir)[0])
