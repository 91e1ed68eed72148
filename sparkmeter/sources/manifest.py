"""The manifest of parsed files: what is stale, what was parsed, what is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.operators.upsert import upsert
from sparkmeter.schemas import MANIFEST, conform


def stale_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """The current files, and those the manifest knows beside them, with their ``status``.

    new, modified (time or size differs), unchanged or deleted (then only the path is known).
    """
    now, then = current.alias("now"), manifest.alias("then")
    changed = (F.col("now.mtime_ns") != F.col("then.mtime_ns")) | (
        F.col("now.size_bytes") != F.col("then.size_bytes")
    )
    return now.join(then, F.col("now.file_path") == F.col("then.file_path"), "full_outer").select(
        F.coalesce("now.file_path", "then.file_path").alias("file_path"),
        *[F.col(f"now.{c}").alias(c) for c in current.columns if c != "file_path"],
        F.when(F.col("then.file_path").isNull(), "new")
        .when(F.col("now.file_path").isNull(), "deleted")
        .when(changed, "modified")
        .otherwise("unchanged")
        .alias("status"),
    )


def needs_parsing(stale: DataFrame) -> DataFrame:
    """New and modified files."""
    return stale.filter(F.col("status").isin("new", "modified"))


def update_manifest(
    manifest: DataFrame, parsed: DataFrame, stats: DataFrame, now: Column
) -> DataFrame:
    """Record parsed files with the stats taken before parsing.

    Bytes appended while a file was parsed therefore leave it stale for the next run. ``parsed``
    may carry a ``record_count``.
    """
    rows = parsed.join(stats, "file_path").withColumn("last_parsed", now)
    return upsert(
        conform(manifest, MANIFEST),
        conform(rows, MANIFEST, {"record_count": 0}),
        ["file_path"],
        update_matched=True,
    )


def prune_manifest(manifest: DataFrame, deleted: DataFrame) -> DataFrame:
    """The manifest without deleted paths."""
    return manifest.join(deleted.select("file_path"), "file_path", "left_anti")


def tracked_files(manifest: DataFrame) -> DataFrame:
    """Number of files in the manifest."""
    return manifest.agg(F.count("*").alias("files"))
