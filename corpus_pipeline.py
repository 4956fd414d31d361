"""The corpus pipeline: documents in five stages to the plan of a training mixture.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before has kept; between stages the rows are written as
Parquet and read again. All stages but the last return the columns of ``documents``; the last returns the mixture's plan.

Nulls and empty texts: language identification rejects texts without a letter, so later stages see none. Near duplicates are
told by their rows, not by doc_ids: of rows that repeat each other one stays, with or without a doc_id, and different texts
under one doc_id all stay. Rows without a doc_id pass the leak and secret stages as they are, and are mixed. Ties go to the smaller doc_id, then to
the first in file order. Empty tables pass through all stages, other columns stay up to the last.

Texts go to Python in small Arrow batches: stages set the session's batch size, so that a task's buffers don't grow with the
length of texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwell.llm.blocks import small_batches, stored, table
from clearwell.llm.language_spans import fit, held_out, keep_identified
from clearwell.llm.latent_leaks import without_leaks
from clearwell.llm.mixing import mix_sources
from clearwell.llm.ngram_join import ngram_join
from clearwell.llm.secret_scan import redact_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter, or no language for half of their letters. The model is learned from ``docs``."""
    small_batches(spark)
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return keep_identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of texts that share 0.8 of their five-word shingles."""
    small_batches(spark)
    row = "row_of_" + "_".join(docs.columns)  # no column of the table has this name
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = ngram_join(rows.select(F.col(row).alias("doc_id"), "text"), k=5, num=4, den=5)
    parts = rows.select(row, "doc_id").join(found.select(F.col("doc_id").alias(row), "component_id"), row)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row)).alias("first")
    kept = parts.groupBy("component_id").agg(first).select(F.col(f"first.{row}").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of ``benchmark``."""
    small_batches(spark)
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in ``text`` replaced by its kind and ``n_chars`` brought up to date."""
    small_batches(spark)
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan: which documents are read in which pass over their source, at which place, at tempered weights."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: Learned language models and latent retrieval have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
