"""Headers, trimming and null filling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.functions.numeric import missing, present
from clearwell.functions.text import null_sentinels, strip
from clearwell.functions.types import datetime_columns, logical_type, numeric_columns, quoted, string_columns
from clearwell.operators.profile import all_of
from clearwell.operators.quantiles import exact_medians

NUMERIC_FILLS = ("median", "mean", "zero", "drop")
DATETIME_FILLS = ("drop", "keep")


@dataclass(frozen=True)
class CleanResult:
    df: DataFrame
    rows_input: int
    null_cells_filled: int
    rows_cleaned: int  # rows dropped for a null, as the name is used in the run ledger


def normalized_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def normalize_headers(df: DataFrame) -> DataFrame:
    names = [normalized_name(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"headers collide after normalization: {clashes}")
    return df.toDF(*names)


def strip_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: strip(F.col(quoted(c))) for c in string_columns(df)})


def sentinels_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: null_sentinels(F.col(quoted(c))) for c in string_columns(df)})


def fill_nulls(
    df: DataFrame, numeric: str = "median", string: str = "UNKNOWN", datetime: str = "drop"
) -> CleanResult:
    """Fill or drop nulls column by column, left to right.

    A row dropped for one column does not count for the columns right of it. That order is kept in one pass: every
    statistic of a column only looks at rows that are complete in all drop-columns left of it. The driver reads one
    row of counts and means (and the medians of the columns that do have nulls), and the fills become literals in one
    projection. Booleans and nested columns are left as they are.
    """
    if numeric not in NUMERIC_FILLS:
        raise ValueError(f"unknown numeric fill {numeric!r}, expected one of {NUMERIC_FILLS}")
    if datetime not in DATETIME_FILLS:
        raise ValueError(f"unknown datetime fill {datetime!r}, expected one of {DATETIME_FILLS}")

    types = dict(df.dtypes)
    numbers, texts, dates = numeric_columns(df), string_columns(df), datetime_columns(df)
    drops = {c for c in df.columns if (c in numbers and numeric == "drop") or (c in dates and datetime == "drop")}
    keeps: dict[str, list] = {}
    earlier: list = []
    for c in df.columns:
        keeps[c] = list(earlier)
        if c in drops:
            earlier.append(~missing(F.col(quoted(c)), types[c]))
    touched = [c for c in df.columns if c in drops or c in numbers or c in texts]

    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(touched):
        col = F.col(quoted(c))
        aggs.append(F.count_if(all_of(keeps[c]) & missing(col, types[c])).alias(f"nulls{i}"))
        if c in numbers and numeric == "mean":
            aggs.append(F.avg(F.when(all_of(keeps[c]), present(col, types[c]).cast("double"))).alias(f"mean{i}"))
    stats = df.agg(*aggs).first().asDict()
    nulls = {c: stats[f"nulls{i}"] for i, c in enumerate(touched)}

    to_fill = [c for c in numbers if c not in drops and nulls[c] > 0]
    fills: dict[str, object] = {}
    if numeric == "median" and to_fill:
        kept = df.select(*[F.when(all_of(keeps[c]), F.col(quoted(c))).alias(c) for c in to_fill])
        fills = exact_medians(kept, to_fill)
    elif numeric == "mean":
        fills = {c: stats[f"mean{touched.index(c)}"] for c in to_fill}
    elif numeric == "zero":
        fills = {c: 0 for c in to_fill}
    fills = {c: v for c, v in fills.items() if v is not None}

    replaced = {}
    for c, value in fills.items():
        col = present(F.col(quoted(c)), types[c])
        whole = logical_type(df.schema[c].dataType) == "integer" and float(value).is_integer()
        # an integer column takes a fractional fill as double, as it would be read with nulls in it
        replaced[c] = F.coalesce(col, F.lit(int(value)).cast(types[c]) if whole else F.lit(float(value)))
    for c in texts:
        if nulls[c] > 0:
            replaced[c] = F.coalesce(F.col(quoted(c)), F.lit(string))

    out = df.where(all_of(earlier)) if any(nulls[c] for c in drops) else df
    filled = sum(nulls[c] for c in replaced)
    return CleanResult(
        out.withColumns(replaced) if replaced else out, stats["n"], filled, sum(nulls[c] for c in drops)
    )


def clean(
    df: DataFrame,
    headers: bool = True,
    trim: bool = True,
    numeric: str = "median",
    string: str = "UNKNOWN",
    datetime: str = "drop",
) -> CleanResult:
    if headers:
        df = normalize_headers(df)
    if trim:
        df = strip_strings(df)
    return fill_nulls(df, numeric, string, datetime)
