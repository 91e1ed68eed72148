"""Bring a tree of logs up to date with another one, file by file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators.stores import merge_log_trees
from sparkmeter.session import scratch, settle
from sparkmeter.sources.logs import json_rows, positioned
from sparkmeter.store.journal import Files

_FILE = "_file"


@dataclass(frozen=True)
class Merged:
    """What a merge did."""

    files: int = 0
    records: int = 0
    skipped_lines: int = 0
    skipped_files: int = 0


def read_tree(spark: SparkSession, root: str, glob: str = "*.jsonl") -> DataFrame:
    """All lines of a tree by their paths below its root; empty when there is none."""
    schema = "file_path string, chunk bigint, pos bigint, value string"
    if not Files(spark, root).names("*"):
        return spark.createDataFrame([], schema)
    base = Files(spark, root).absolute()
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    return positioned(text, keep_blank=True).withColumn("file_path", below(F.col("file_path"), base))


def below(path: Column, root: str) -> Column:
    """A path without its root; scheme and slashes of both may be written differently."""
    plain = F.regexp_replace(path, r"^[a-z]+:/*", "/")
    return F.substr(plain, F.lit(len(root.rstrip("/")) + 2))


def merge_trees(
    spark: SparkSession, host: str, incoming: str, glob: str = "*.jsonl"
) -> Merged:
    """Write the host tree: known files gain the incoming lines they lack, others come whole.

    Each changed file is written beside the tree and renamed over the old one, so a reader sees
    either version, and a merge that is repeated adds nothing. Incoming lines are parsed once; the
    counts are taken by the same pass (``observe``): lines that are no JSON object, blank ones aside,
    and files without a valid line.
    """
    files = Files(spark, host)
    with scratch(spark):
        counted = Observation()
        arriving = read_tree(spark, incoming, glob).filter(F.col("value") != "")
        valid = json_rows(arriving, "struct<uuid string>", keep_value=True).select(
            *arriving.columns, F.col("j").isNotNull().alias("valid")
        )
        lines = settle(
            valid.observe(counted, F.count_if(~F.col("valid")).alias("skipped")), "incoming"
        )
        held = read_tree(spark, host, glob)
        merged = settle(merge_log_trees(held.filter(F.col("value") != ""), lines.drop("valid")), "merged")
        changed = merged.select("file_path", "action").distinct()
        whole = held.join(changed, "file_path", "left_semi").withColumn("_new", F.lit(False))
        rows = merged.select("file_path", "chunk", "pos", "value", F.lit(True).alias("_new"))
        write_files(files, whole.unionByName(rows), ["_new", "chunk", "pos"])
        # One row: counts over files.
        per_file = lines.groupBy("file_path").agg(F.bool_or("valid").alias("good"))
        totals = per_file.agg(
            F.count_if("good").alias("files"), F.count_if(~F.col("good")).alias("bad")
        ).collect()[0]
        records = merged.filter("valid").count()
        skipped = counted.get["skipped"] if lines.count() else 0
    return Merged(totals["files"], records, skipped, totals["bad"])


def write_files(files: Files, lines: DataFrame, order: list[str]) -> None:
    """Write each file of some lines (file_path, value) and rename it over the old one.

    A file is one object, so one task writes it; different files go to different tasks.
    """
    draft = ".draft"
    files.delete(draft)
    named = lines.withColumn(_FILE, F.sha2("file_path", 256))
    ordered = named.repartition(_FILE).sortWithinPartitions(_FILE, *order)
    ordered.select(_FILE, "value").write.partitionBy(_FILE).text(f"{files.root}/{draft}")
    for row in named.select(_FILE, "file_path").distinct().toLocalIterator():
        (written,) = files.names(f"{draft}/{_FILE}={row[_FILE]}/part-*")
        files.replace(written, row["file_path"])
    files.delete(draft)
