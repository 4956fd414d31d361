"""Scaling, letter case, UTC and units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.functions.numeric import UNIT_FORMULAS, present
from clearwell.functions.text import title_case
from clearwell.functions.types import datetime_columns, numeric_columns, quoted, string_columns

SCALINGS = ("minmax", "zscore")
CASES = {"lower": F.lower, "upper": F.upper, "title": title_case}


def scale(df: DataFrame, method: str, columns: list[str] | None = None) -> DataFrame:
    """Min-max or z-score (sample deviation) scaling; a column without spread stays unchanged.

    One aggregate over all columns gives one row of statistics; they become literals in one projection, so the
    scaled table is a plain scan for whatever follows.
    """
    if method not in SCALINGS:
        raise ValueError(f"unknown scaling {method!r}, expected one of {SCALINGS}")
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return df
    types = dict(df.dtypes)
    value = {c: present(F.col(quoted(c)), types[c]).cast("double") for c in columns}
    functions = (F.min, F.max) if method == "minmax" else (F.avg, F.stddev_samp)
    stats = df.agg(*[f(value[c]).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in zip("ab", functions)]).first()
    scaled = {}
    for i, c in enumerate(columns):
        a, b = stats[f"a{i}"], stats[f"b{i}"]
        if method == "minmax" and a is not None and b != a:
            scaled[c] = (value[c] - F.lit(a)) / F.lit(b - a)
        elif method == "zscore" and b is not None and b > 0:
            scaled[c] = (value[c] - F.lit(a)) / F.lit(b)
    return df.withColumns(scaled) if scaled else df


def convert_case(df: DataFrame, case: str) -> DataFrame:
    if case not in CASES:
        raise ValueError(f"unknown case {case!r}, expected one of {sorted(CASES)}")
    return df.withColumns({c: CASES[case](F.col(quoted(c))) for c in string_columns(df)})


def to_utc(df: DataFrame, source_zone: str = "UTC") -> DataFrame:
    """Zone-less timestamps become instants, read as wall-clock time of ``source_zone``; instants stay as they are."""
    types = dict(df.dtypes)
    naive = [c for c in datetime_columns(df) if types[c] in ("timestamp_ntz", "date")]
    return df.withColumns(
        {c: F.to_utc_timestamp(F.col(quoted(c)).cast("timestamp"), source_zone) if source_zone != "UTC"
         else F.col(quoted(c)).cast("timestamp") for c in naive}
    )


def convert_units(df: DataFrame, conversions: dict[str, dict[str, str]]) -> DataFrame:
    """``{"temp_f": {"to": "temp_c", "formula": "fahrenheit_to_celsius"}}``: replaces the column under its new name."""
    for c, rule in conversions.items():
        if rule["formula"] not in UNIT_FORMULAS:
            raise ValueError(f"unknown unit formula {rule['formula']!r}")
        if c not in df.columns:
            raise ValueError(f"no column {c!r} to convert")
    converted = []
    for c in df.columns:
        col = F.col(quoted(c))
        if c in conversions:
            col = UNIT_FORMULAS[conversions[c]["formula"]](col.cast("double")).alias(conversions[c]["to"])
        converted.append(col)
    return df.select(*converted)


def normalize(
    df: DataFrame,
    scaling: str | None = None,
    case: str | None = "lower",
    utc: bool = True,
    units: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    if units:
        df = convert_units(df, units)
    if scaling:
        df = scale(df, scaling)
    if case:
        df = convert_case(df, case)
    return to_utc(df) if utc else df
