"""Logical types of the schema document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

LOGICAL_TYPES = ("integer", "float", "boolean", "datetime", "string")


def logical_type(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    return "string"


def physical_type(logical: str) -> str:
    """Spark type used when a column has to be created or cast."""
    return {"integer": "bigint", "float": "double", "boolean": "boolean", "datetime": "timestamp"}.get(logical, "string")


def columns_of(df: DataFrame, *logical: str) -> list[str]:
    """Columns of the given logical types; only true string columns count as ``string``."""
    return [
        f.name
        for f in df.schema.fields
        if logical_type(f.dataType) in logical
        and (logical_type(f.dataType) != "string" or isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType)))
    ]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "integer", "float")


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "string")


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "datetime")


def quoted(name: str) -> str:
    """Column reference that survives dots and backticks in a name."""
    return "`" + name.replace("`", "``") + "`"
