"""Vector index and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearwell.operators.vectors import index_vectors, nearest, nearest_batch, pruned_search
from clearwell.plans.registered.base import Registry, table
from clearwell.session import scratch_path

REGISTRY = Registry()


@REGISTRY.add(
    "vector_index",
    """SELECT doc_id, lang, len(embedding) AS dimension, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total
       FROM documents JOIN embeddings ON vec_id = doc_id""",
)
def vector_index(spark, sf_dir):
    """Documents with the vector of the same number, appended to an index and read back."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    stored, _ = index_vectors(table(spark, sf_dir, "documents").select("doc_id", "lang"), vectors, "doc_id", 64)
    path = scratch_path(spark, "index")
    stored.write.mode("append").parquet(path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(path).select(
        "doc_id", "lang", F.size("embedding").cast("bigint").alias("dimension"), F.round(total, 4).alias("total"))


@REGISTRY.add("vector_rejects", "SELECT doc_id FROM documents ANTI JOIN embeddings ON vec_id = doc_id")
def vector_rejects(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return index_vectors(table(spark, sf_dir, "documents").select("doc_id"), vectors, "doc_id", 64)[1].select("doc_id")


CENTRES_SQL = """c AS (SELECT label, list(m ORDER BY i) AS q FROM (
        SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) AS r(i) GROUP BY label, i)
        GROUP BY label)"""


def _centres(spark, sf_dir):
    """Mean vector per label, the natural query of a topic."""
    cells = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one entry per dimension
    ordered = F.sort_array(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda e: e["m"]).alias("embedding"))


@REGISTRY.add(
    "knn_one",
    """WITH q AS (SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m
               FROM embeddings, range(1, 65) AS r(i) GROUP BY i))
    SELECT vec_id, label, round(list_distance(CAST(embedding AS DOUBLE[]), q), 5) AS distance
    FROM embeddings, q ORDER BY list_distance(CAST(embedding AS DOUBLE[]), q), vec_id LIMIT 10""",
)
def knn_one(spark, sf_dir):
    """The ten vectors nearest to the centre of all."""
    vectors = table(spark, sf_dir, "embeddings")
    means = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(
        F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()  # one row per dimension
    return nearest(vectors, [r["m"] for r in means], 10).select("vec_id", "label", F.round("distance", 5).alias("distance"))


@REGISTRY.add(
    "knn_all",
    """WITH d AS (
        SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
        FROM embeddings a, embeddings b)
    SELECT query_id, vec_id, round(distance, 5) AS distance, CAST(r AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM d) WHERE r <= 3""",
)
def knn_all(spark, sf_dir):
    """Three nearest vectors of every vector, by cells around pivots."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, _ = pruned_search(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 3)
    return found.select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


@REGISTRY.add(
    "knn_batch",
    f"""WITH {CENTRES_SQL}, d AS (
        SELECT c.label AS query_id, vec_id, list_distance(CAST(embedding AS DOUBLE[]), q) AS distance FROM c, embeddings)
    SELECT query_id, vec_id, round(distance, 5) AS distance, CAST(r AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM d) WHERE r <= 5""",
)
def knn_batch(spark, sf_dir):
    """Five nearest vectors for the centre of every label."""
    queries = _centres(spark, sf_dir).withColumnRenamed("label", "query_id")
    found = nearest_batch(table(spark, sf_dir, "embeddings"), queries, 5)
    return found.select(F.col("query_id").cast("int").alias("query_id"), "vec_id", F.round("distance", 5).alias("distance"),
                        "rank")
