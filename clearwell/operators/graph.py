"""Property graph as two tables.

``nodes(id, labels array<string>, name, type, description, variant_keys array<string>)`` and
``edges(src, rel, dst, props map<string,string>)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.functions.fixed_values import BOOKKEEPING_LABELS, FALLBACK_ER_LINES, FALLBACK_GLOSSARY
from clearwell.operators.ranking import number_rows

NODE_COLUMNS = {
    "id": "string", "labels": "array<string>", "name": "string", "type": "string", "description": "string",
    "variant_keys": "array<string>",
}


def make_nodes(df: DataFrame, id: Column, labels: list[str], **properties: Column) -> DataFrame:
    """Nodes with ordered labels; properties not given are null."""
    values = {"id": id, "labels": F.array(*map(F.lit, labels)), **properties}
    return df.select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in NODE_COLUMNS.items()])


def make_edges(df: DataFrame, src: Column, rel: str, dst: Column, props: Column | None = None) -> DataFrame:
    props = F.lit(None) if props is None else props
    return df.select(src.cast("string").alias("src"), F.lit(rel).alias("rel"), dst.cast("string").alias("dst"),
                     props.cast("map<string,string>").alias("props"))


def link_nodes(
    left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, rel: str, props: Column | None = None
) -> DataFrame:
    """Edges between nodes whose properties match. The match is an equality of two expressions, so it is a hash or
    merge join and never all pairs."""
    a = left.select(F.col("id").alias("_a"), left_key.alias("_key"))
    b = right.select(F.col("id").alias("_b"), right_key.alias("_key"))
    return make_edges(a.join(b, "_key"), F.col("_a"), rel, F.col("_b"), props)


def with_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.array_contains("labels", label))


def delete_label(nodes: DataFrame, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Remove the nodes with a label and every edge that touches one of them."""
    gone = with_label(nodes, label).select("id")
    kept = edges.join(gone, edges["src"] == gone["id"], "left_anti")
    return nodes.where(~F.array_contains("labels", label)), kept.join(gone, kept["dst"] == gone["id"], "left_anti")


def resolve_entities(
    nodes: DataFrame, edges: DataFrame, label: str = "Customer", pattern: str = r"^([A-Z]+-[0-9]+)"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Link the variants of an entity (``CUST-100``, ``CUST-100-A``) to one golden node.

    Returns nodes, edges and the links of this run. Running it again adds nothing: nodes and links that exist are
    left out by anti joins. Every variant carries its golden id itself, so no group of variants is ever gathered.
    """
    variants = with_label(nodes, label).where(~F.array_contains("labels", "Golden"))
    keyed = variants.withColumn("_root", F.regexp_extract("id", pattern, 1)).where(F.length("_root") > 0)
    named = keyed.groupBy("_root").agg(F.min(F.struct(F.length("id"), "id", "name"))["name"].alias("_name"))
    golden = make_nodes(
        named, F.concat(F.lit("GOLDEN-"), "_root"), ["Entity", "Golden", label],
        name=F.concat(F.coalesce("_name", "_root"), F.lit(" (Unified)")),
    )
    links = make_edges(keyed, F.col("id"), "RESOLVES_TO", F.concat(F.lit("GOLDEN-"), "_root")).dropDuplicates(
        ["src", "dst"])
    new_nodes = golden.join(nodes.select("id"), "id", "left_anti")
    existing = edges.where(F.col("rel") == "RESOLVES_TO").select("src", "dst")
    new_links = links.join(existing, ["src", "dst"], "left_anti").select(*edges.columns)
    return nodes.unionByName(new_nodes), edges.unionByName(new_links), links


def er_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (first label, relation, first label).

    The source label replaces the source id before the second join, and copies are dropped on the map side in
    between, so a hub with a third of all edges shrinks to its distinct targets.
    """
    first = nodes.select("id", F.get("labels", F.lit(0)).alias("label")).where("label is not null")
    by_source = (
        edges.join(first.withColumnsRenamed({"id": "src", "label": "source"}), "src")
        .select("source", "rel", "dst").distinct()
    )
    return (
        by_source.join(first.withColumnsRenamed({"id": "dst", "label": "target"}), "dst")
        .select("source", "rel", "target").distinct()
    )


def er_diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a Mermaid ER diagram ``(line_no, line)``; a static set where the graph has no edge.

    Relations are numbered and rendered row by row, however many kinds there are.
    """
    found = er_edges(nodes, edges)
    spark = nodes.sparkSession
    static = spark.createDataFrame(FALLBACK_ER_LINES, "source string, rel string, target string")
    none = found.agg((F.count(F.lit(1)) == 0).alias("none")).select("none").scalar()
    numbered = number_rows(found.unionByName(static.where(none)).withColumn("_all", F.lit(0)), ["_all"],
                           [F.asc("source"), F.asc("rel"), F.asc("target")], "line_no")
    head = spark.range(1).select(F.lit(0).alias("line_no"), F.lit("erDiagram").alias("line"))
    return head.unionByName(numbered.select(F.col("line_no").cast("int").alias("line_no"), F.concat(
        F.lit("    "), "source", F.lit(" ||--o{ "), "target", F.lit(' : "'), "rel", F.lit('"')).alias("line")))


def glossary(nodes: DataFrame) -> DataFrame:
    """One templated entry per label in use, except the bookkeeping ones; static terms for an empty graph."""
    labels = (
        nodes.select(F.explode("labels").alias("term")).distinct().where(~F.col("term").isin(*BOOKKEEPING_LABELS))
    )
    terms = labels.select(
        "term",
        F.concat(F.lit("Business entity or concept representing "), "term",
                 F.lit(" within the enterprise context graph.")).alias("definition"),
        F.lit("Graph Auto-Generated").alias("source"),
    )
    found = labels.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    static = nodes.sparkSession.createDataFrame(FALLBACK_GLOSSARY, "term string, definition string, source string")
    return terms.unionByName(static.where(found == 0))
