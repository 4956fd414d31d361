"""Personal data, freshness, masking and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.functions.fixed_values import PII_PATTERNS, TRUST_STALE_PENALTY
from clearwell.functions.numeric import laplace_noise, uniform
from clearwell.functions.types import numeric_columns, quoted, string_columns


def _pattern(text: str, mode: str) -> str:
    if mode == "anchored":
        return text
    if mode == "contains":
        # digits around a hit would make it part of a longer number
        body = text.removeprefix("^").removesuffix("$")
        return rf"(?<![0-9]){body}(?![0-9])" if "@" not in body else body
    raise ValueError(f"unknown scan mode {mode!r}")


# A character every match of a pattern has; looking for it is much cheaper than the pattern.
NEEDED = {"email": "@", "ssn": "-"}


def _guarded(c: Column, name: str, pattern: str, mode: str) -> Column:
    search = c.rlike(_pattern(pattern, mode))
    return F.contains(c, F.lit(NEEDED[name])) & search if name in NEEDED else search


def scan_pii(df: DataFrame, mode: str = "anchored", order_by: list[str] | None = None) -> DataFrame:
    """One row per string column with personal data: type of the first hit, and the cells hit by each pattern.

    One aggregation over the table. The first hit is the one in the earliest row of ``order_by`` (file order without
    it), patterns in their listed order. ``mode="contains"`` searches inside longer text.
    """
    columns = string_columns(df)
    source = df if order_by else df.withColumn("_arrival", F.monotonically_increasing_id())
    order = F.struct(*[F.col(quoted(c)) for c in (order_by or ["_arrival"])])
    names = [n for n, _ in PII_PATTERNS]
    spark = df.sparkSession
    schema = "column_name string, type string, risk string, description string, " + ", ".join(
        f"{n}_cells bigint" for n in names)
    if not columns:
        return spark.createDataFrame([], schema)
    # the searches run once per cell, in a projection below the aggregation
    hits = source.select(order.alias("_at"), *[
        F.coalesce(_guarded(F.col(quoted(c)), name, pattern, mode), F.lit(False)).alias(f"h{i}_{j}")
        for i, c in enumerate(columns) for j, (name, pattern) in enumerate(PII_PATTERNS)
    ])
    aggs, entries = [], []
    for i, c in enumerate(columns):
        rank: Column | None = None
        for j in range(len(PII_PATTERNS)):
            hit = F.col(f"h{i}_{j}")
            aggs.append(F.count_if(hit).alias(f"n{i}_{j}"))
            rank = F.when(hit, j) if rank is None else rank.when(hit, j)
        aggs.append(F.min(F.when(rank.isNotNull(), F.struct("_at", rank.alias("rank")))).alias(f"first{i}"))
        kind = F.element_at(F.array(*map(F.lit, names)), F.col(f"first{i}.rank") + 1)
        entries.append(F.when(F.col(f"first{i}").isNotNull(), F.struct(
            F.lit(c).alias("column_name"), kind.alias("type"), F.lit("high").alias("risk"),
            F.concat(F.lit("Found potential "), kind, F.lit(f" in column '{c}'.")).alias("description"),
            *[F.col(f"n{i}_{j}").alias(f"{n}_cells") for j, n in enumerate(names)],
        )))
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return hits.agg(*aggs).select(F.inline(found))


def stale_tables(catalog: DataFrame, now: Column, hours: float = 24.0) -> DataFrame:
    """Catalog tables strictly older than ``hours`` at ``now``."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("freshness_timestamp").cast("timestamp"))) / 3.6e9
    return catalog.withColumn("hours_stale", age).where(F.col("hours_stale") > hours).select(
        "table_name", F.col("freshness_timestamp").alias("last_updated"), "hours_stale"
    )


def governance_scan(
    df: DataFrame, table_name: str, catalog: DataFrame, now: Column, mode: str = "anchored",
    order_by: list[str] | None = None, hours: float = 24.0, agent_name: str = "steward",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan one table: a one-row report, at most one masking request, and the catalog after the stale penalty.

    The report counts all stale tables, the penalty only meets the scanned one.
    """
    findings = scan_pii(df, mode, order_by).agg(
        F.count(F.lit(1)).alias("pii_issues_found"), F.sort_array(F.collect_list("column_name")).alias("columns")
    )  # one entry per column of the table
    stale = stale_tables(catalog, now, hours)
    stale_count = stale.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    report = findings.select(
        F.lit(table_name).alias("table_name"), F.lit("scan_complete").alias("status"), "pii_issues_found",
        stale_count.alias("stale_tables_found"), (F.col("pii_issues_found") > 0).cast("int").alias("actions_queued"),
    )
    listed = F.array_join("columns", ", ")
    requests = findings.where("pii_issues_found > 0").select(
        F.lit(agent_name).alias("agent_name"), F.lit("mask_pii_columns").alias("action_type"),
        F.to_json(F.struct(F.lit(table_name).alias("table"), F.col("columns").alias("columns_to_mask"))).alias(
            "proposed_payload"),
        F.concat(F.lit("Detected PII in columns: "), listed,
                 F.lit(". Recommend applying dynamic data masking.")).alias("reasoning"),
        now.cast("timestamp").alias("created_at"),
    )
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("freshness_timestamp").cast("timestamp"))) / 3.6e9
    hit = (F.col("table_name") == table_name) & (age > hours)
    penalized = catalog.withColumn(
        "trust_score",
        F.when(hit, F.greatest(F.lit(0.0), F.col("trust_score") - TRUST_STALE_PENALTY)).otherwise(F.col("trust_score")),
    )
    return report, requests, penalized


def mask_columns(df: DataFrame, columns: list[str], method: str = "hash", salt: str = "") -> DataFrame:
    """Replace flagged cells: ``hash`` by a salted digest (equal cells stay joinable), ``redact`` by keeping the shape
    of the text with letters and digits blotted out."""
    if method not in ("hash", "redact"):
        raise ValueError(f"unknown masking method {method!r}")

    def mask(c: Column) -> Column:
        if method == "hash":
            return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"\p{L}", "x"), r"\p{N}", "0")

    return df.withColumns({c: mask(F.col(quoted(c))) for c in columns})


def noise_mask(
    df: DataFrame, epsilon: float = 0.5, seed: int = 0, sensitivity: float = 1.0,
    keys: tuple[str, ...] = ("id",), row_key: list[str] | None = None,
) -> DataFrame:
    """Laplace noise of scale ``sensitivity / epsilon`` on all numeric columns but the keys, rounded to 2 digits.

    With ``row_key`` the draw is a hash of seed, key and column, so a recomputed task gives the same noise.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    key = [F.col(quoted(c)) for c in row_key or []]
    noisy = {}
    for i, c in enumerate(c for c in numeric_columns(df) if c not in keys and c not in (row_key or [])):
        u = uniform(seed, F.lit(c), *key) if key else uniform(seed + i)
        noisy[c] = F.bround(F.col(quoted(c)).cast("double") + laplace_noise(sensitivity / epsilon, u), 2)
    return df.withColumns(noisy) if noisy else df
