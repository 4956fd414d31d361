"""Small helpers shared by the operators: stored tables, bounded text blocks, word and shingle hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwell.session import scratch_path

#: Most bytes of text that one step of a task holds at once (a single longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: The same where each word takes many times its own size in the worker.
SMALL_BLOCK = 2 << 20

_MIX = np.random.default_rng(20240229).integers(1, 2**63, 300, dtype=np.uint64) | np.uint64(1)
_BYTE_VALUE, _BASE, _SHINGLE = _MIX[:256], _MIX[256], _MIX[257:]
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps never recompute it, lost executors or not."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of tables that are stored by now are deleted: Spark does so when the driver collects its garbage, at no set time."""
    spark.sparkContext._jvm.System.gc()


#: Rows of a batch that goes to a Python worker, where texts are rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows for this session, unless it already asks for smaller ones.

    A batch is held by the executor and by its Python worker, each with room to grow; ten thousand whole texts are much of a
    task's memory on both sides.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked = int(spark.conf.get(name))
    if not 0 < asked <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker lives on, and other tasks beside it need the room


#: Bits of the map that ``rows_asked_for`` sends to the tasks: 8 MB, whatever the number of ids.
MAP_BITS = 1 << 26


def rows_asked_for(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among ``ids`` (one column of that name), before a join shuffles them.

    A bit map of the ids' hashes has a fixed size: with very many ids it lets more rows pass, never fewer than it must.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(MAP_BITS))
    bits = ids.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("map"))
    filled = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in bits.collect():  # 2048 rows of 4 KB at most; an iterator would run a job for each partition
        filled[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.map, dtype=np.uint8)
    packed = df.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            keep = (packed.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(keep.astype(bool))).select(list(range(batch.num_columns - 1)))

    return df.withColumn("_bit", bit).mapInArrow(run, df.schema)


#: Parts that one task adds up.
FAN_IN = 32


def in_levels(parts: DataFrame, keys: list[str], add: Callable[[tuple, pa.Table], pa.Table], schema: str) -> DataFrame:
    """One row for each of ``keys``: the tasks' rows added up by ``add``, ``FAN_IN`` at a time until one is left."""
    tasks = parts.rdd.getNumPartitions()
    parts = parts.withColumn("_piece", F.spark_partition_id())
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        level = parts.withColumn("_piece", F.col("_piece") % tasks)
        parts = level.groupBy("_piece", *keys).applyInArrow(_kept_piece(add), f"_piece int, {schema}")
    return parts.groupBy(*keys).applyInArrow(lambda key, rows: add(key, rows.drop_columns(["_piece"])), schema)


def _kept_piece(add: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        out = add(key[1:], rows.drop_columns(["_piece"]))
        return out.add_column(0, "_piece", pa.array([key[0].as_py()] * len(out), pa.int32()))

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_strings(values: pa.StringArray) -> np.ndarray:
    """A 64-bit polynomial hash of each string, the same on every machine."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    if not len(values):
        return np.zeros(0, dtype=np.uint64)
    first = offsets[0]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[first : offsets[-1]]
    offsets = offsets - first
    powers = np.full(len(data) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.add.accumulate(_BYTE_VALUE[data] * powers[:-1], out=sums[1:])
    # dividing by the power of the first place makes the hash independent of where the string stands
    inverse = np.full(len(data) + 1, _BASE_INVERSE, dtype=np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    spans = (sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]]
    return mixed(spans + np.diff(offsets).astype(np.uint64) * _SHINGLE[-1])


def split_words(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """A-Z lower-cased words between ASCII white space, of all texts in one array, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words = lists.flatten()
    kept = pc.greater(pc.binary_length(words), 0)
    at = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    at = at - at[0]
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    return words.filter(kept), before[at]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, at = split_words(texts)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), at
    coded = words.dictionary_encode()
    return hash_strings(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)], at


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles; of all its words where there are fewer than ``k``."""
    hashes, at = word_hashes(texts)
    rolled = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
    for i in range(k):
        rolled += hashes[i : i + len(rolled)] * _SHINGLE[i]
    rolled = mixed(rolled + np.uint64(k))
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= k:
            x = np.sort(rolled[s : e - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif e > s:
            whole = (hashes[s:e] * _SHINGLE[: e - s]).sum(dtype=np.uint64)
            out.append(mixed(np.array([whole + np.uint64(e - s)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
