"""Joins on nearness: the last valid row at a time, and values within a distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearwell.session import ensure_checkpoint_dir


def as_of_join(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str],
    partitions: int | None = None,
) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the row of ``right`` that was valid at its time: the latest one of the same keys at or
    before ``left_time``; nulls where there is none.

    Rows of both sides are range-partitioned by keys and time together, so the history of one key, however long, spreads over many
    tasks. Each partition carries values forward within itself; what a partition hands on to the next is one row for its last
    key, and these few rows are carried forward in turn. No key is ever gathered in one task and no pair of rows is made. Of
    several rows of ``right`` at one time the greatest by ``columns`` counts. Null keys have no match; rows of ``left`` without a time
    have none either; rows of ``right`` without one are never valid.
    """
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = lambda df: [F.col(k).alias(a) for k, a in zip(keys, names)]
    valid = right.where(F.col(right_time).isNotNull()).dropna(subset=keys)
    value = F.struct(*columns)
    kind = valid.select(value.alias("v")).schema["v"].dataType
    row_kind = left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType
    # values at a time stand before the rows that ask at that time
    both = valid.select(*keyed(valid), F.col(right_time).alias("_t"), F.lit(0).alias("_asks"), value.alias("_v"), F.lit(None).cast(row_kind).alias("_row")).union(
        left.select(*keyed(left), F.col(left_time), F.lit(1), F.lit(None).cast(kind), F.struct(*left.columns)))
    order = ["_t", "_asks", "_v"]
    parts = both.repartitionByRange(n, *names, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_part", *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = parts.withColumn("_last", F.last("_v", ignorenulls=True).over(inside)).where("_asks = 1").drop("_v")
    # the keys at the borders of each partition, and the last value of each of them in it: two rows a partition at most
    edges = parts.groupBy("_part").agg(F.min(F.struct(*names)).alias("a"), F.max(F.struct(*names)).alias("b"))
    marks = [f"_g{i}" for i in range(len(keys))]
    border = edges.select(F.col("_part").alias("_p"), F.explode(F.array_distinct(F.array("a", "b"))).alias("k")).select("_p", *[F.col(f"k.{x}").alias(g) for x, g in zip(names, marks)])
    same = lambda: _all([F.col("_part") == F.col("_p"), *[F.col(x).eqNullSafe(F.col(g)) for x, g in zip(names, marks)]])
    held = parts.join(F.broadcast(border), same()).groupBy("_p", *marks).agg(
        F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_end"))
    before = Window.partitionBy(*marks).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.withColumn("_carried", F.last("_end._v", ignorenulls=True).over(before)).where("_carried is not null").drop("_end")
    out = filled.join(F.broadcast(carried), same(), "left")
    usable = _all([F.col("_t").isNotNull(), *[F.col(x).isNotNull() for x in names]])
    found = out.select("_row", F.when(usable, F.coalesce("_last", "_carried")).alias("_found"))
    return found.select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, width: float, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of rows whose values differ by ``width`` or less (and whose ``keys`` are equal): all columns of both, whose names must differ.

    Values are dealt to buckets of the width; a row of ``left`` meets the rows of its own bucket and of the two beside it in a join on the
    bucket, so no nested loop is planned, and a hot bucket is a skewed key that adaptive execution splits. Null and NaN values pair
    with nothing. Times go in as numbers, for instance as seconds.
    """
    if not width > 0:
        raise ValueError("width must be above 0")
    # a little wider, so that rounding never puts two values of a pair more than a bucket apart
    bucket = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(width) * (1 + 1e-9)))
    fine = lambda df, c: df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    a = fine(left, left_value).withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: bucket(left_value) + d)))
    b = fine(right, right_value).withColumn("_near", bucket(right_value))
    on = _all([a["_bucket"] == b["_near"], F.abs(a[left_value] - b[right_value]) <= width, *[a[x] == b[y] for x, y in keys]])
    return a.join(b, on).drop("_bucket", "_near")
