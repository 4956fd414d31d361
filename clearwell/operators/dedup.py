"""Duplicate removal by aggregation, so copies of one row meet on the map side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.functions.types import quoted

KEEP = ("first", "last", False)


def drop_duplicates(
    df: DataFrame,
    subset: list[str] | None = None,
    keep: str | bool = "first",
    order_by: list[str] | None = None,
) -> DataFrame:
    """Keep the first, the last or none of the rows that agree on ``subset`` (all columns by default).

    Nulls equal each other. ``order_by`` says what first and last mean; without it rows are taken in file order,
    which repeats only for the same file layout. Ties on it are broken by the remaining columns.
    """
    if keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP}")
    if subset is None and keep is not False:
        return df.dropDuplicates()
    keys = subset or df.columns
    if keep is False:
        # one row per key and a count; the row is the only one where the count is 1
        payload = [F.first(F.struct(*[F.col(quoted(c)) for c in df.columns])).alias("_row")]
        counted = df.groupBy(*[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
            F.count(F.lit(1)).alias("_n"), *payload
        )
        return counted.where("_n = 1").select("_row.*")
    if order_by:
        source, order = df, [F.col(quoted(c)) for c in order_by]
    else:
        source, order = df.withColumn("_arrival", F.monotonically_increasing_id()), [F.col("_arrival")]
    row = _ordered_row(order, df.columns)
    pick = F.min(row) if keep == "first" else F.max(row)
    return (
        source.groupBy(*[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(pick.alias("_pick"))
        .select("_pick._row.*")
    )


def _ordered_row(order: list[Column], columns: list[str]) -> Column:
    return F.struct(
        *[o.alias(f"_o{i}") for i, o in enumerate(order)],
        F.struct(*[F.col(quoted(c)) for c in columns]).alias("_row"),
    )
