"""Row numbers inside groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearwell.session import ensure_checkpoint_dir


def number_rows(
    df: DataFrame, group: list[str], order: list[Column], name: str = "rank", partitions: int | None = None
) -> DataFrame:
    """``row_number() over (partition by group order by order)`` without one task per group.

    A window sorts a whole group in one task. Here the rows are range-partitioned by group and order together, so a
    group with a third of all rows spreads over a third of the tasks. Each task numbers its own runs; only groups that
    cross a partition border need an offset, and there are fewer of those than partitions. The numbered rows are
    checkpointed, so the borders the offsets were computed for are the borders of the rows they are added to.
    ``order`` should be unique inside a group.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType(
        [*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType())]
    )
    local = ranged.withColumn("_part", F.spark_partition_id()).mapInArrow(
        lambda batches: _number_runs(batches, group), schema
    ).checkpoint()
    offsets = _offsets(local, group)
    on = local["_part"] == offsets["_p"]
    for i, g in enumerate(group):
        on = on & local[g].eqNullSafe(offsets[f"_g{i}"])
    joined = local.join(F.broadcast(offsets), on, "left")  # at most two rows per partition
    rank = F.col("_run") + F.coalesce("_offset", F.lit(0))
    return joined.select(*[local[c] for c in df.columns], rank.alias(name))


def _number_runs(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """Number consecutive rows of equal group keys, carrying the count over from batch to batch."""
    last: pd.DataFrame | None = None
    carried = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = pa.Table.from_batches([batch.select(group)]).to_pandas(integer_object_nulls=True)
        before = pd.concat([keys.iloc[:1] if last is None else last, keys.iloc[:-1]], ignore_index=True)
        same = ((keys == before) | (keys.isna() & before.isna())).all(axis=1).to_numpy(copy=True)
        if last is None:
            same[0] = False
        position = np.arange(len(keys))
        starts = np.maximum.accumulate(np.where(same, -1, position))
        run = np.where(starts >= 0, position - starts + 1, position + 1 + carried).astype("int64")
        last, carried = keys.iloc[-1:], int(run[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run)], [*batch.schema.names, "_run"])


def _offsets(local: DataFrame, group: list[str]) -> DataFrame:
    """Rows of a group in the partitions before, for the first and last group of every partition."""
    edges = local.groupBy("_part").agg(
        F.min(F.struct(*group)).alias("_first"), F.max(F.struct(*group)).alias("_last")
    )
    ends = edges.select(
        F.col("_part").alias("_p"), F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_g")
    ).select("_p", *[F.col(f"_g.{g}").alias(f"_g{i}") for i, g in enumerate(group)])
    on = local["_part"] == ends["_p"]
    for i, g in enumerate(group):
        on = on & local[g].eqNullSafe(ends[f"_g{i}"])
    names = [f"_g{i}" for i in range(len(group))]
    sizes = local.join(F.broadcast(ends), on).groupBy("_p", *names).agg(F.max("_run").alias("_n"))
    earlier = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_offset", F.sum("_n").over(earlier)).where("_offset is not null").drop("_n")
