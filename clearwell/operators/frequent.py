"""Most frequent values of many columns: counters in one pass, and an exact recount of the few values that can win.

Each task keeps ``COUNTERS`` counters a column (Misra and Gries): when there are more values, all counters are lowered alike until
few are left, so a value's counter is too low by at most rows / (COUNTERS + 1). Counters of all tasks add up to counters of the
table with the same bound. Values whose counter may still reach the best one are counted exactly in a second pass. A column
where no value is frequent enough for the bound to decide, such as one of distinct values, is counted by key in a third.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.functions.types import quoted
from clearwell.session import ensure_checkpoint_dir

COUNTERS = 512
#: Types whose text form tells values apart and has their order.
COUNTED_TYPES = ("string", "boolean", "date")


class _Counters:
    def __init__(self, limit: int) -> None:
        self.limit, self.rows = limit, 0
        self.parts: list[pa.Table] = []
        self.entries = 0

    def add(self, values: pa.Array) -> None:
        values = values.drop_null()
        self.rows += len(values)
        found = pc.value_counts(values)
        self.parts.append(pa.table([found.field("values"), found.field("counts")], names=["value", "count"]))
        self.entries += len(found)
        if self.entries > 64 * self.limit:
            self.lower()

    def lower(self) -> pa.Table:
        merged = pa.concat_tables(self.parts).group_by("value").aggregate([("count", "sum")]) if self.parts else None
        if merged is None:
            return pa.table({"value": pa.array([], pa.string()), "count": pa.array([], pa.int64())})
        values, counts = merged.column("value").combine_chunks(), merged.column("count_sum").to_numpy()
        if len(counts) > self.limit:
            counts = counts - np.partition(counts, -self.limit - 1)[-self.limit - 1]
            values, counts = values.filter(pa.array(counts > 0)), counts[counts > 0]
        out = pa.table([values, pa.array(counts, pa.int64())], names=["value", "count"])
        self.parts, self.entries = [out], len(counts)
        return out


def _cells(df: DataFrame, columns: dict[int, str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.col(quoted(c)).cast("string").alias("value")) for i, c in columns.items()]))).where("value is not null")


def counters(df: DataFrame, columns: list[str], limit: int = COUNTERS) -> DataFrame:
    """(ordinal, value, low, error) of columns by their place in ``columns``: the counters of the whole table, and by how much they
    may be too low. A column without a value has no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_Counters(limit) for _ in columns]
        for batch in batches:
            for i, own in enumerate(held):
                own.add(batch.column(i))
        for i, own in enumerate(held):
            last = own.lower()
            yield pa.record_batch(
                [pa.array([i] * (len(last) + 1), pa.int32()), pa.concat_arrays([pa.nulls(1, pa.string()), *last.column("value").chunks]),
                 pa.array([own.rows, *last.column("count").to_pylist()], pa.int64())], names=["ordinal", "value", "low"])

    texts = df.select(*[F.col(quoted(c)).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    summed = texts.mapInArrow(run, "ordinal int, value string, low long").groupBy("ordinal", "value").agg(F.sum("low").alias("low"))
    rows = summed.where("value is null").select("ordinal", F.expr(f"low div {limit + 1}").alias("error"))
    return summed.where("value is not null").join(F.broadcast(rows), "ordinal")  # one row a column


def most_frequent(df: DataFrame, columns: list[str], limit: int = COUNTERS) -> dict[str, tuple[str, int] | None]:
    """The most frequent non-null value of each column as text, with its exact count; the smallest text on ties.

    ``df`` is read twice, once more where a column's best counter is below twice its error, and once more where a column's best value
    occurs in less than about one of ``limit`` rows. One row a column reaches the driver.
    """
    if not columns:
        return {}
    ensure_checkpoint_dir(df.sparkSession)
    kept = counters(df, columns, limit).checkpoint()
    best = kept.groupBy("ordinal").agg(F.max("low").alias("best"))
    can_win = kept.join(F.broadcast(best), "ordinal").where("low + error >= best").select("ordinal", "value", "error")
    clear = {r.ordinal for r in kept.groupBy("ordinal").agg(F.max("low").alias("best"), F.max("error").alias("error")).where("best >= 2 * error").collect()}

    def winners(counted: DataFrame) -> DataFrame:
        return counted.groupBy("ordinal").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top"), F.max("error").alias("error"))

    def recounted(which: dict[int, str], asked: DataFrame) -> dict[int, tuple[str, int, int]]:
        if not which:
            return {}
        exact = _cells(df, which).join(asked, ["ordinal", "value"]).groupBy("ordinal", "value").agg(F.count("*").alias("n"), F.max("error").alias("error"))
        return {r.ordinal: (r.top.value, -r.top.n, r.error) for r in winners(exact).collect()}

    # where the best counter is twice the error, at most about ``limit`` values reach the error, so they go to the cells: by key, all
    # cells of a frequent value would be sorted in one task. Elsewhere no value fills more than three of ``limit`` rows.
    out: dict[str, tuple[str, int] | None] = dict.fromkeys(columns)
    few, many = ({i: c for i, c in enumerate(columns) if (i in clear) == told} for told in (True, False))
    found = recounted(few, F.broadcast(can_win.where(F.col("ordinal").isin(*few)))) | recounted(many, can_win.where(F.col("ordinal").isin(*many)).hint("merge"))
    # a value without a counter may occur as often as the error; lowering may have left no counter at all
    open_ = [i for i in range(len(columns)) if i not in found or found[i][1] <= found[i][2]]
    out.update({columns[i]: (v, n) for i, (v, n, _) in found.items()})
    if open_:
        names = {i: columns[i] for i in open_}
        counted = _cells(df, names).groupBy("ordinal", "value").agg(F.count("*").alias("n")).withColumn("error", F.lit(0))
        out.update({names[r.ordinal]: (r.top.value, -r.top.n) for r in winners(counted).collect()})
    return out
