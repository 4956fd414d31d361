"""Column profiles, logical types and semantic tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearwell.functions.fixed_values import DATE_LAYOUTS, DEFAULT_TAG, SEMANTIC_RULES
from clearwell.functions.numeric import missing, present
from clearwell.functions.text import parse_timestamp
from clearwell.functions.types import logical_type, quoted, string_columns

PROFILE_SCHEMA = (
    "ordinal int, column_name string, data_type string, nullable boolean, row_count bigint, null_count bigint, "
    "distinct_values bigint, min double, max double, mean double, stddev double"
)


def matching_rules(name: Column) -> Column:
    """Positions of all rules whose pattern is found in a column name, in rule order."""
    return F.array_compact(
        F.array(*[F.when(name.rlike(p), F.lit(i)) for i, (p, _, _) in enumerate(SEMANTIC_RULES)]))


def semantic_tags(rules: Column) -> Column:
    """Tags of the matching rules, or the default tag."""
    tags = F.array(*[F.lit(tag) for _, tag, _ in SEMANTIC_RULES])
    return F.when(F.size(rules) > 0, F.transform(rules, lambda i: F.get(tags, i))).otherwise(F.array(F.lit(DEFAULT_TAG)))


def semantic_description(rules: Column, name: Column) -> Column:
    """Description by the last matching rule."""
    texts = F.array(*[F.lit(text) for _, _, text in SEMANTIC_RULES])
    last = F.get(texts, F.try_element_at(rules, F.lit(-1)))
    return F.coalesce(
        F.concat(last, F.lit(" derived from column name '"), name, F.lit("'")),
        F.concat(F.lit("Generic raw input data column: "), name))


def tag_columns(names: DataFrame, column: str = "column_name", enrichment: DataFrame | None = None) -> DataFrame:
    """Add ``description`` and ``tags`` to a table of column names.

    ``enrichment(column_name, description, tags)`` wins over the rules where it has a row. It names each column once,
    so the join adds no rows.
    """
    # every pattern runs once per name; tags and description both read its result
    tagged = (
        names.withColumn("_rules", matching_rules(F.col(column)))
        .withColumns({"description": semantic_description(F.col("_rules"), F.col(column)),
                      "tags": semantic_tags(F.col("_rules"))})
        .drop("_rules")
    )
    if enrichment is None:
        return tagged
    extra = enrichment.select(
        F.col("column_name").alias(column),
        F.coalesce("description", F.concat(F.lit("Data field "), "column_name")).alias("_description"),
        F.coalesce("tags", F.array(F.lit(DEFAULT_TAG))).alias("_tags"),
    )
    return (
        tagged.join(extra, column, "left")
        .withColumns(
            {"description": F.coalesce("_description", "description"), "tags": F.coalesce("_tags", "tags")}
        )
        .drop("_description", "_tags")
    )


def _comparable(f: T.StructField) -> tuple[str, Column]:
    """A cell in the widest type of its family, so that cells of many columns fit one column."""
    c = present(F.col(quoted(f.name)), f.dataType.simpleString())
    if logical_type(f.dataType) == "integer":
        return "bigint", c.cast("bigint")
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return "double", c.cast("double")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return "bigint", F.unix_micros(c.cast("timestamp"))
    return "string", c.cast("string")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct non-null values of many columns: ``(ordinal, distinct_values)``.

    One (column, value) row per cell, made distinct on the map side before the shuffle and then counted. A column
    with one hot value sends one row per task, not the third of the table it fills. Numbers, times and texts are
    counted apart, each in its own type and from a scan of its own columns.
    """
    families: dict[str, list[Column]] = {}
    for i, f in enumerate(df.schema.fields):
        if columns is None or f.name in columns:
            family, value = _comparable(f)
            families.setdefault(family, []).append(F.struct(F.lit(i).alias("ordinal"), value.alias("value")))
    counted = [
        df.select(F.inline(F.array(*cells)))
        .where("value is not null")
        .distinct()
        .groupBy("ordinal")
        .agg(F.count(F.lit(1)).alias("distinct_values"))
        for cells in families.values()
    ]
    return reduce(DataFrame.unionAll, counted)


def date_columns(df: DataFrame, layouts: tuple = DATE_LAYOUTS) -> DataFrame:
    """String columns whose values all are timestamps: ``(ordinal, dates)``."""
    found = [(i, f.name) for i, f in enumerate(df.schema.fields) if f.name in string_columns(df)]
    one_row = df.agg(*[_all_dates(F.col(quoted(c)), layouts).alias(f"d{i}") for i, c in found])
    return one_row.select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.col(f"d{i}").alias("dates")) for i, _ in found])))


def sketched_counts(df: DataFrame) -> DataFrame:
    """Distinct non-null values of all columns by sketch (5 % error): ``(ordinal, distinct_values)``."""
    aggs, entries = [], []
    for i, f in enumerate(df.schema.fields):
        v = present(F.col(quoted(f.name)), f.dataType.simpleString())
        nested = isinstance(f.dataType, (T.MapType, T.VariantType))
        aggs.append(F.approx_count_distinct(v.cast("string") if nested else v).alias(f"d{i}"))
        entries.append(F.struct(F.lit(i).alias("ordinal"), F.col(f"d{i}").alias("distinct_values")))
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def profile(
    df: DataFrame,
    exact: bool = False,
    probe_dates: bool = True,
    date_layouts: tuple = DATE_LAYOUTS,
) -> DataFrame:
    """One row per column: logical type, nulls, distinct values, min, max, mean, sample deviation.

    Three aggregations, each over the columns it needs: statistics, distinct counts (by sketch or with ``exact`` by
    value) and the date probe. Sketches have no generated code and date parsing has too much of it; either one would
    slow down the statistics if they shared an aggregation.
    String columns whose values all parse as timestamps are ``datetime``.
    """
    counts = distinct_counts(df) if exact else sketched_counts(df)
    long = column_statistics(df, probe_dates, date_layouts).join(counts, "ordinal", "left")
    long = long.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    return long.select([c.split()[0] for c in PROFILE_SCHEMA.split(", ")])


def column_statistics(df: DataFrame, probe_dates: bool = True, date_layouts: tuple = DATE_LAYOUTS) -> DataFrame:
    """A profile without distinct values, one row per column."""
    fields = df.schema.fields
    strings = string_columns(df)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c, dtype = F.col(quoted(f.name)), f.dataType.simpleString()
        v = present(c, dtype)
        aggs.append(F.count_if(missing(c, dtype)).alias(f"nulls{i}"))
        if logical_type(f.dataType) in ("integer", "float"):
            d = v.cast("double")
            aggs += [F.min(d).alias(f"min{i}"), F.max(d).alias(f"max{i}"), F.avg(d).alias(f"mean{i}"),
                     F.stddev_samp(d).alias(f"std{i}")]
    one_row = df.agg(*aggs)
    def entry(i: int, f: T.StructField) -> Column:
        numeric = logical_type(f.dataType) in ("integer", "float")
        null_double = F.lit(None).cast("double")
        return F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(logical_type(f.dataType)).alias("data_type"),
            (F.col(f"nulls{i}") > 0).alias("nullable"),
            F.col("n").alias("row_count"),
            F.col(f"nulls{i}").alias("null_count"),
            *[(F.col(f"{k}{i}") if numeric else null_double).alias(a)
              for k, a in (("min", "min"), ("max", "max"), ("mean", "mean"), ("std", "stddev"))],
        )

    long = one_row.select(F.inline(F.array(*[entry(i, f) for i, f in enumerate(fields)])))
    if probe_dates and strings:
        dated = date_columns(df, date_layouts)
        long = long.join(dated, "ordinal", "left").withColumn(
            "data_type", F.when(F.col("dates"), F.lit("datetime")).otherwise(F.col("data_type"))
        )
    return long


def _all_dates(c: Column, layouts: tuple) -> Column:
    """True if every non-null value parses and at least one exists. A text without a digit is no date and is not parsed."""
    parsed = F.when(c.rlike("[0-9]"), parse_timestamp(c, layouts).isNotNull()).otherwise(F.lit(False))
    return F.coalesce(F.bool_and(F.when(c.isNotNull(), parsed)), F.lit(False))


def schema_document(df: DataFrame, table_name: str, enrichment: DataFrame | None = None, **options) -> DataFrame:
    """The nested schema document of a table as one row; the column list is as long as the table is wide."""
    columns = tag_columns(profile(df, **options), enrichment=enrichment)
    entry = F.struct(
        "ordinal",
        F.col("column_name").alias("name"),
        "data_type",
        "nullable",
        F.struct("null_count", "distinct_values", "min", "max", "mean").alias("statistics"),
        "description",
        "tags",
    )
    return columns.agg(
        F.lit(table_name).alias("table_name"),
        F.max("row_count").alias("row_count"),
        F.sort_array(F.collect_list(entry)).alias("columns"),
    )


def baseline_of(document: DataFrame, column: str = "columns") -> DataFrame:
    """Schema documents to one row per table and column, the form drift checks compare with."""
    return document.select(
        *[c for c in ("table_name", "row_count") if c in document.columns], F.inline(column)
    ).select(
        *[c for c in ("table_name",) if c in document.columns],
        F.col("name").alias("column_name"),
        F.col("data_type"),
        F.col("statistics.distinct_values").alias("distinct_values"),
    )


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
