"""Profiles that merge: what a batch adds to a table's profile is kept as one small row a column, and history is never read again.

A state holds counts, extremes, mean and squared deviations, which merge exactly, and two sketches, which merge within their error: one of
distinct values (standard error 0.8 %) and one of quantiles (rank error about 0.4 % in 99 of 100 cases). States are kept per
table and batch; a baseline, a micro-batch or a month is the merge of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearwell.functions.numeric import present
from clearwell.functions.types import logical_type, quoted
from clearwell.operators.profile import PROFILE_SCHEMA, column_statistics

#: Power of two of the distinct sketch's registers, one byte each, and the size parameter of the quantile sketch.
REGISTERS, SPREAD = 14, 800
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _sketches(df: DataFrame) -> DataFrame:
    """(ordinal, distinct_state, quantile_state); columns that are no numbers have no quantiles."""
    aggs: list[Column] = []
    for i, f in enumerate(df.schema.fields):
        v = present(F.col(quoted(f.name)), f.dataType.simpleString())
        if isinstance(f.dataType, (T.MapType, T.VariantType)):
            v = v.cast("string")
        aggs.append(F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), REGISTERS).alias(f"d{i}"))
        if logical_type(f.dataType) in ("integer", "float"):
            aggs.append(F.kll_sketch_agg_double(v.cast("double"), SPREAD).alias(f"q{i}"))
    one_row = df.agg(*aggs)
    none = F.lit(None).cast("binary")
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ordinal"), F.col(f"d{i}").alias("distinct_state"),
                 (F.col(f"q{i}") if f"q{i}" in one_row.columns else none).alias("quantile_state"))
        for i in range(len(df.columns))])))


def profile_state(df: DataFrame, probe_dates: bool = True) -> DataFrame:
    """One row per column of a batch: ordinal, column_name, data_type, row_count, null_count, min, max, mean, squares (the sum of squared
    deviations), distinct_state, quantile_state. An empty batch has states that add nothing."""
    found = column_statistics(df, probe_dates).join(_sketches(df), "ordinal")
    n = F.col("row_count") - F.col("null_count")
    return found.withColumn("squares", F.coalesce(F.col("stddev") * F.col("stddev") * (n - 1), F.when(n > 0, 0.0))).select(
        "ordinal", "column_name", "data_type", "row_count", "null_count", "min", "max", "mean", "squares", "distinct_state", "quantile_state")


def merge_states(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """States of any batches to one row per column (and ``by``). The order of batches makes no difference but for the last digits of
    means and deviations. A column whose batches differ in type is ``float`` for numbers and ``string`` for all else; batches
    without a value have no say. A column missing from a batch counts the batch's rows as not there, not as null."""
    keys = [*by, "column_name"]
    n = (F.col("row_count") - F.col("null_count")).cast("double")
    whole = Window.partitionBy(*keys)
    # deviations are taken around the common mean, so that nothing large cancels out
    centred = states.withColumn("_n", n).withColumn("_mean", F.sum(F.col("_n") * F.col("mean")).over(whole) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), F.col("_n"))).over(whole), F.lit(0.0)))
    kinds = F.array_sort(F.collect_set(F.when(F.col("_n") > 0, F.col("data_type"))))
    kind = (F.when(F.size(kinds) == 0, F.max("data_type")).when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))
            .when(kinds == F.array(F.lit("float"), F.lit("integer")), F.lit("float")).otherwise(F.lit("string")))
    merged = centred.groupBy(*keys).agg(
        F.min("ordinal").alias("ordinal"), kind.alias("data_type"), F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.max("_mean").alias("mean"),
        F.sum(F.col("squares") + F.col("_n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))).alias("squares"),
        F.hll_union_agg("distinct_state").alias("distinct_state"), F.kll_merge_agg_double("quantile_state").alias("quantile_state"))
    numeric = F.col("data_type").isin("integer", "float")
    blank = {c: F.when(numeric, F.col(c)) for c in ("min", "max", "mean", "squares", "quantile_state")}
    return merged.withColumns(blank).select(*by, *[c for c in states.columns if c not in by and c in merged.columns])


def state_profile(states: DataFrame) -> DataFrame:
    """Merged states as a profile, with the quartiles of numeric columns (q1, median, q3): the sketch form."""
    n = F.col("row_count") - F.col("null_count")
    quartiles = {name: F.when(F.col("quantile_state").isNotNull() & (n > 0), F.kll_sketch_get_quantile_double("quantile_state", F.lit(p)))
                 for name, p in QUARTILES.items()}
    shown = states.withColumns({
        "nullable": F.col("null_count") > 0, "distinct_values": F.hll_sketch_estimate("distinct_state"),
        "stddev": F.when(n > 1, F.sqrt(F.col("squares") / (n - 1))), **quartiles})
    return shown.select(*[c.split()[0] for c in PROFILE_SCHEMA.split(", ")], *QUARTILES)


def _folder(root: str, table: str) -> str:
    return f"{root}/profile_states/{table}"


def store_state(df: DataFrame, root: str, table: str, batch_id: int, probe_dates: bool = True) -> None:
    """Keep a batch's state in its own ``batch_id`` folder; a batch that comes again replaces its state."""
    profile_state(df, probe_dates).write.mode("overwrite").parquet(f"{_folder(root, table)}/batch_id={batch_id}")


def stored_states(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All kept states of a table with their ``batch_id``; a filter on it prunes folders."""
    return spark.read.parquet(_folder(root, table))
