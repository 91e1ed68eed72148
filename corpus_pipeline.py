"""A corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows to the shared scratch folder and reads them
again, so that a lost executor repeats at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm import decontaminate, jaccard, line_quality, packing, personal
from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import ship_package
from sparkmeter.session import settle


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text that a stage may have changed."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines; documents that fail the base rules or lose too much text go."""
    return _counted(line_quality.keep_clean(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays."""
    ship_package(spark)
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    ship_package(spark)
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    hit = leaks.select("doc_id").distinct()
    same = F.col("own.doc_id").eqNullSafe(F.col("hit.doc_id"))
    return docs.alias("own").join(hit.alias("hit"), same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return _counted(personal.redact(docs, personal.train(spark)), docs.columns)


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", token_packing),
]

#: Components, the latent search, boosted trees and best fit are beyond SQL; a test compares the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = settle(stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return rows
