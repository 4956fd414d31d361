import statistics

import pytest
from pyspark.sql import functions as F

from clearwell.operators.governance import governance_scan, mask_columns, noise_mask, scan_pii, stale_tables
from clearwell.operators.graph import (
    delete_label,
    er_diagram,
    er_edges,
    glossary,
    link_nodes,
    make_edges,
    make_nodes,
    resolve_entities,
    with_label,
)


def test_pii_first_hit_per_column(spark):
    df = spark.createDataFrame([(2, "a@b.org", "123-45-6789", "x"), (1, "15551234567", "n", "y"), (3, "see a@b.org", None, "z")],
                               "id long, contact string, ssn string, other string")
    found = {r["column_name"]: r for r in scan_pii(df, order_by=["id"]).collect()}
    assert set(found) == {"contact", "ssn"}
    assert found["contact"]["type"] == "phone" and found["contact"]["email_cells"] == 1
    assert found["ssn"]["type"] == "ssn" and found["ssn"]["risk"] == "high"
    inside = {r["column_name"]: r for r in scan_pii(df, "contains", ["id"]).collect()}
    assert inside["contact"]["email_cells"] == 2
    assert scan_pii(df.select("id")).isEmpty()


def test_governance_scan(spark):
    df = spark.createDataFrame([(1, "one@example.com", "123-45-6789")], "id long, email string, ssn string")
    now = F.lit("2024-01-10 00:00:00")
    catalog = spark.createDataFrame(
        [("t", "2024-01-08 00:00:00", 3.0), ("u", "2024-01-09 00:00:00", 80.0), ("v", "2024-01-01 00:00:00", 80.0)],
        "table_name string, f string, trust_score double").withColumn("freshness_timestamp", F.col("f").cast("timestamp"))
    assert {r["table_name"]: r["hours_stale"] for r in stale_tables(catalog, now).collect()} == {"t": 48.0, "v": 216.0}
    report, requests, after = governance_scan(df, "t", catalog, now, order_by=["id"])
    row = report.first()
    assert (row["pii_issues_found"], row["stale_tables_found"], row["actions_queued"]) == (2, 2, 1)
    assert requests.first()["proposed_payload"] == '{"table":"t","columns_to_mask":["email","ssn"]}'
    assert {r["table_name"]: r["trust_score"] for r in after.collect()} == {"t": 0.0, "u": 80.0, "v": 80.0}
    _, none, _ = governance_scan(df.select("id"), "t", catalog, now)
    assert none.isEmpty()


def test_masking(spark):
    df = spark.createDataFrame([(1, "Ab-9"), (2, None)], "id int, s string")
    assert [r["s"] for r in mask_columns(df, ["s"], "redact").collect()] == ["xx-0", None]
    hashed = [r["s"] for r in mask_columns(df, ["s"]).collect()]
    assert len(hashed[0]) == 64 and hashed[1] is None
    with pytest.raises(ValueError):
        mask_columns(df, ["s"], "swap")


def test_noise_has_the_laplace_scale_and_repeats(spark):
    df = spark.range(20_000).select("id", F.lit(100.0).alias("value"), F.lit(True).alias("flag"), F.lit("t").alias("t"))
    noisy = noise_mask(df, 0.5, 3, row_key=["id"])
    values = [r["value"] for r in noisy.orderBy("id").collect()]
    again = [r["value"] for r in noise_mask(df.repartition(7), 0.5, 3, row_key=["id"]).orderBy("id").collect()]
    assert values == again
    deviations = [abs(v - 100) for v in values]
    assert statistics.mean(values) == pytest.approx(100, abs=0.1)
    assert statistics.mean(deviations) == pytest.approx(2.0, abs=0.1)  # mean absolute deviation is the scale
    assert noisy.select("id", "flag", "t").exceptAll(df.select("id", "flag", "t")).isEmpty()
    plain = noise_mask(spark.createDataFrame([(1, 100.0)], "id long, value double"), 0.5, 1).first()
    assert plain["id"] == 1 and plain["value"] != 100.0
    with pytest.raises(ValueError):
        noise_mask(df, 0)


@pytest.fixture(scope="module")
def graph(spark):
    rows = spark.createDataFrame(
        [("CUST-100", "Acme Corp", None), ("CUST-100-A", "Acme", None), ("SUPP-50", "Global Tech", None),
         ("EVT-1", None, "supply_disruptions"), ("MET-1", "revenue", "financial")], "id string, name string, type string")
    pick = lambda p, labels: make_nodes(rows.where(F.startswith("id", F.lit(p))), F.col("id"), labels,
                                        name=F.col("name"), type=F.col("type"))
    nodes = (pick("CUST", ["Entity", "Customer", "Demo"]).unionByName(pick("SUPP", ["Entity", "Supplier", "Demo"]))
             .unionByName(pick("EVT", ["Event", "Demo"])).unionByName(pick("MET", ["Metric", "Demo"])))
    edges = link_nodes(nodes.where("id = 'CUST-100'"), nodes.where("name = 'revenue'"), F.lit(1), F.lit(1), "IMPACTS",
                       F.create_map(F.lit("confidence"), F.lit("0.85")))
    return nodes, edges


def test_entity_resolution_is_idempotent(graph):
    nodes, edges, links = resolve_entities(*graph)
    assert {(r["src"], r["dst"]) for r in links.collect()} == {
        ("CUST-100", "GOLDEN-CUST-100"), ("CUST-100-A", "GOLDEN-CUST-100")}
    assert nodes.where("id = 'GOLDEN-CUST-100'").first()["name"] == "Acme Corp (Unified)"
    again_nodes, again_edges, _ = resolve_entities(nodes, edges)
    assert again_nodes.count() == nodes.count() == 6 and again_edges.count() == edges.count() == 3


def test_diagram_and_glossary(graph, spark):
    nodes, edges, _ = resolve_entities(*graph)
    lines = [r["line"] for r in er_diagram(nodes, edges).orderBy("line_no").collect()]
    assert lines == ["erDiagram", '    Entity ||--o{ Metric : "IMPACTS"', '    Entity ||--o{ Entity : "RESOLVES_TO"']
    assert {r["term"] for r in glossary(nodes).collect()} == {"Entity", "Customer", "Supplier", "Event", "Metric"}
    empty_nodes, empty_edges = nodes.limit(0), edges.limit(0)
    assert er_diagram(empty_nodes, empty_edges).count() == 4
    assert {r["term"] for r in glossary(empty_nodes).collect()} == {"Customer", "Metric"}


def test_delete_by_label(graph, spark):
    nodes, edges = graph
    left_nodes, left_edges = delete_label(nodes, edges, "Metric")
    assert left_nodes.count() == 4 and left_edges.isEmpty() and with_label(nodes, "Customer").count() == 2


def test_hub_node(spark):
    """A third of all edges leaves one node."""
    keys = spark.range(900).withColumn("src", F.when(F.col("id") % 3 == 0, F.lit("n0")).otherwise(F.concat(F.lit("n"), "id")))
    nodes = make_nodes(spark.range(900), F.concat(F.lit("n"), "id"), ["A"])
    edges = make_edges(keys, F.col("src"), "R", F.concat(F.lit("n"), "id"))
    assert [tuple(r) for r in er_edges(nodes, edges).collect()] == [("A", "R", "A")]
