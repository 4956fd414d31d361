"""CSV and JSON scans, raw landing and schema artifacts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clearwell.functions.types import quoted
from clearwell.operators.clean import sentinels_to_null

INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")
FORMATS = ("csv", "json")
#: A line whose last cell opens with a quote and never closes it. Quotes inside a cell that begins otherwise are text.
TORN = r'^(?:(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]|"")*+$'


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header. Without a schema every cell is read as text, null sentinels become null and the types are
    inferred from what is left; ``inferSchema`` would take a numeric column with one ``NA`` for text.

    ``multi_line`` keeps line breaks inside quoted cells; each file is then read by one task. Without it a file is split
    by lines, and an input with a line that ends inside a quoted cell is refused rather than torn apart; a lone quote inside a
    cell is text.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if not multi_line:
        torn = spark.read.text(path).where(F.contains("value", F.lit('"')) & F.col("value").rlike(TORN))
        if not torn.isEmpty():
            raise ValueError("a quoted cell goes over a line break; read this input with multi_line=True")
    if schema is not None:
        return reader.schema(schema).csv(path)
    return infer_column_types(sentinels_to_null(reader.option("inferSchema", False).csv(path)))


def infer_column_types(df: DataFrame) -> DataFrame:
    """Cast text columns to bigint, double or boolean where every non-null cell has that form: one aggregation."""
    names = df.columns
    if not names:
        return df
    aggs = []
    for i, c in enumerate(names):
        col = F.col(quoted(c))
        whole = col.rlike(INTEGER) & col.try_cast("bigint").isNotNull()
        aggs += [
            F.count(col).alias(f"n{i}"),
            F.count_if(whole).alias(f"int{i}"),
            F.count_if(col.rlike(NUMBER)).alias(f"num{i}"),
            F.count_if(col.isin(*BOOLEANS)).alias(f"bool{i}"),
        ]
    row = df.agg(*aggs).first()

    def typed(i: int, c: str) -> Column:
        col, n = F.col(quoted(c)), row[f"n{i}"]
        for kind, target in (("int", "bigint"), ("num", "double"), ("bool", "boolean")):
            if n and row[f"{kind}{i}"] == n:
                return col.cast(target).alias(c)
        return col.alias(c)

    return df.select(*[typed(i, c) for i, c in enumerate(names)])


def read_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """An array of records per file, or one record per line (``lines``), the form Spark can split.

    A file that is no array is refused in the first form: of several records, Spark would read one. What stands before a
    file's first comma shows its form, so files are looked at in small pieces of any split.
    """
    if not lines:
        opening = F.substring(F.ltrim(F.regexp_replace("value", "^[\ufeff\\s]+", "")), 1, 1)
        pieces = spark.read.option("lineSep", ",").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), opening.alias("opening"),
            F.monotonically_increasing_id().alias("at"))
        first = pieces.where("block = 0 and opening <> ''").groupBy("file").agg(F.min_by("opening", "at").alias("opening"))
        if not first.where("opening <> '['").isEmpty():
            raise ValueError("not an array of records; read one record per line with lines=True")
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_batch(spark: SparkSession, path: str | list[str], file_format: str, schema=None, **options) -> DataFrame:
    if file_format.lower() not in FORMATS:
        raise ValueError(f"unsupported file format {file_format!r}, expected one of {FORMATS}")
    return (read_csv if file_format.lower() == "csv" else read_json)(spark, path, schema, **options)


def land_raw(spark: SparkSession, path: str | list[str], file_format: str, root: str, table: str, at: datetime) -> str:
    """Keep a batch as it came: its lines as text (``value``), their source file and order, under ``raw/{table}/ingest_ts=…``.

    CSV and JSON are landed alike, in any layout; nothing is parsed, so no number or space changes. ``_line`` rises with
    the place in a file. Reruns for the same time replace their own folder only. Returns the folder.
    """
    if file_format.lower() not in FORMATS:
        raise ValueError(f"unsupported file format {file_format!r}, expected one of {FORMATS}")
    raw = spark.read.text(path).withColumns({"_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    target = f"{root}/raw/{table}/ingest_ts={at:%Y%m%d_%H%M%S}"
    raw.withColumn("_source_file", F.col("_metadata.file_path")).write.mode("overwrite").parquet(target)
    return target


def read_raw(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All landed batches of a table; a filter on ``ingest_ts`` prunes folders."""
    return spark.read.option("mergeSchema", True).parquet(f"{root}/raw/{table}")


def write_table(df: DataFrame, root: str, zone: str, table: str, mode: str = "overwrite") -> str:
    target = f"{root}/{zone}/{table}"
    df.write.mode(mode).parquet(target)
    return target


def publish_schema(document: DataFrame, root: str, table: str) -> str:
    """The confirmed schema document as JSON under ``schemas/{table}``; one row."""
    target = f"{root}/schemas/{table}"
    document.write.mode("overwrite").json(target)
    return target
