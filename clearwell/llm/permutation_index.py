"""Approximate nearest neighbours by a permutation index.

A vector is represented by the ordered list of its nearest pivots. Blocks of vectors hold inverted files, pivot ->
(vector, rank of the pivot); a query reads the files of its own nearest pivots, which gives the footrule distance of
the two lists for every vector that shares a pivot with it. The nearest share of a block by footrule is reranked by the exact
inner product in double precision, and the best of all blocks are the answer. A block indexes each distinct vector once, so
copies take no places in that share, and vectors as far as the last one of the share are reranked as well.

Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2) with M the largest norm, so that nearness of the lifted
ones is the order of inner products. Pivots are a bounded sample of the distinct ones; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import stored

#: Pivots, and how many of the nearest are posted for a vector.
PIVOTS, POSTED = 256, 64  # ranks are kept as bytes, so POSTED is 255 at most
#: Share of a block's vectors that is reranked, and the least number.
RERANKED, LEAST_RERANKED = 0.15, 256
#: Vectors and queries of a cell.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding: array of double) of the vectors that take part: all finite, not all zero, of the commonest dimension.

    A null vec_id takes no part. Of two dimensions as common as each other, the larger one counts.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"]).first()[0]
    return rows.where(F.size("embedding") == (size or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lift(x: np.ndarray, largest: float | None) -> np.ndarray:
    """Queries (no ``largest``) are normalized and get 0; vectors get what is missing to the largest norm."""
    norm = np.linalg.norm(x, axis=1)
    if largest is None:
        return np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
    return np.hstack([x, np.sqrt(np.maximum(0, largest**2 - norm**2))[:, None]]) / largest


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The ``posted`` nearest pivots of each row, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :posted]


class Block:
    """The inverted files of the distinct vectors of one block, and the ids of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, pivots: np.ndarray, posted: int) -> None:
        vectors = np.ascontiguousarray(vectors + 0.0)  # no negative zeros: equal vectors have equal bytes
        raw = vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        order = np.lexsort((ids, which))
        # the ids of distinct vector i, smallest first, are those from at[i] to at[i + 1]
        self.ids, self.at = ids[order], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(first)))])
        self.vectors, self.posted = vectors[first], min(posted, len(pivots))
        lists = nearest_pivots(_lift(self.vectors, largest), pivots, self.posted)
        # the file of pivot p is row p: its rank in each vector's list, ``posted`` where it is not posted
        self.files = np.full((len(pivots), len(first)), self.posted, dtype=np.uint8)
        self.files[lists.ravel(), np.repeat(np.arange(len(first)), self.posted)] = np.tile(np.arange(self.posted, dtype=np.uint8), len(first))

    def farness(self, pivots_of_query: np.ndarray) -> np.ndarray:
        """Half the footrule distance plus a constant: absent pivots rank last, so each pivot of the query adds the larger rank."""
        ranks = np.arange(len(pivots_of_query), dtype=np.uint8)[:, None]
        return np.maximum(self.files[pivots_of_query], ranks).sum(axis=0, dtype=np.uint16)

    def search(self, query_id: int, query: np.ndarray, pivots_of_query: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        far = self.farness(pivots_of_query)
        n = min(len(far), max(least, k + 1, int(len(far) * share)))
        cand = np.flatnonzero(far <= np.partition(far, n - 1)[n - 1])  # ties with the n-th stay in
        score = (self.vectors[cand] * query).sum(axis=1)
        # of the ids of one vector, k besides the query's own are enough
        count = np.minimum(self.at[cand + 1] - self.at[cand], k + 1)
        ids = self.ids[np.repeat(self.at[cand] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        score = np.repeat(score, count)[ids != query_id]
        ids = ids[ids != query_id]
        if len(ids) > k:  # ties with the k-th stay in
            top = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            ids, score = ids[top], score[top]
        best = np.lexsort((ids, -score))[:k]
        return ids[best], score[best]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, posted: int = POSTED,
    share: float = RERANKED, least: int = LEAST_RERANKED,
) -> DataFrame:
    """The ``k`` nearest of ``vectors`` (vec_id, embedding) found for each of ``queries`` (the same columns), itself excepted.

    Columns: query_id, rank (from 1), vec_id, score (the inner product in double precision). Nearest first, ties to the
    smaller vec_id; fewer than ``k`` candidates give all. Vectors and queries that are null, zero, of another dimension
    than most, or hold null or non-finite components take no part. Rows that repeat a vec_id of one vector are one. Empty tables
    give an empty result; other columns are ignored. Jobs run when this is called.

    Queries and vectors meet in cells of bounded size, a block of each; a hot vector or list is spread over its blocks.
    """
    base = stored(usable(vectors).distinct(), "vectors")
    spark = base.sparkSession
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    n, largest = base.agg(F.count("*"), F.max(norm)).first()
    # copies of one vector are one pivot at most
    distinct = base.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"))
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect() if n else []
    dims = len(sample[0].embedding) if sample else 0
    largest = largest or 1.0
    chosen = spark.sparkContext.broadcast(_lift(np.array([r.embedding for r in sample]).reshape(len(sample), dims), largest))
    asked = usable_queries(queries, dims)
    n_queries = asked.count()
    cells_v, cells_q = max(1, -(-n // BLOCK_VECTORS)), max(1, -(-n_queries // BLOCK_QUERIES))

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        vs, qs = left.to_batches(), right.to_batches()
        out = []
        if vs and qs:
            ids = np.concatenate([b.column("vec_id").to_numpy() for b in vs])
            x = np.vstack([_matrix(b.column("embedding")) for b in vs])
            block = Block(ids, x, largest, chosen.value, posted)
            for b in qs:
                q = _matrix(b.column("embedding"))
                lists = nearest_pivots(_lift(q, None), chosen.value, posted)
                for i, row, own in zip(b.column("query_id").to_pylist(), q, lists):
                    found, score = block.search(i, row, own, k, share, least)
                    out.append((np.full(len(found), i), found, score))
        cols = [np.concatenate([o[j] for o in out]) if out else [] for j in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    # the salt differs from the pivots' order, so blocks are even
    left = base.withColumn("v", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(cells_v)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(cells_q - 1))))
    right = asked.withColumn("q", F.pmod(F.xxhash64("query_id", F.lit(7)), F.lit(cells_q)).cast("int")).withColumn(
        "v", F.explode(F.sequence(F.lit(0), F.lit(cells_v - 1))))
    met = left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(cell, "query_id long, vec_id long, score double")
    # each cell sends k rows a query; a query's rows are few
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))), 1, k)
    ranked = met.groupBy("query_id").agg(best.alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.down")).alias("score"))


def usable_queries(queries: DataFrame, dims: int) -> DataFrame:
    rows = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("query_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0) & (F.size("embedding") == dims)).distinct()
