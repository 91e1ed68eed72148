"""Merging log trees and copying, checking and repairing stores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.operators.skew import spread_join
from sparkmeter.operators.upsert import upsert, without_keys
from sparkmeter.schemas import (
    DAILY,
    DEVICE_COLUMNS,
    LIMITS,
    MANIFEST,
    USAGE,
    conform,
)
from sparkmeter.sources.logs import json_rows
from sparkmeter.sources.registry import union_all

_KEY = "struct<uuid string, timestamp string, sessionId string>"
_KEYS = ["file_path", "k1", "k2", "k3"]


def _keyed(lines: DataFrame) -> DataFrame:
    """Lines with their identity: (uuid, time, session), or (time, session) without uuid."""

    def text(field: str) -> Column:
        return F.coalesce(F.col(f"j.{field}"), F.lit(""))

    uuid, ts, session = text("uuid"), text("timestamp"), text("sessionId")
    named = uuid != ""
    return json_rows(lines, _KEY, keep_value=True).select(
        "file_path",
        "chunk",
        "pos",
        "value",
        F.col("j").isNotNull().alias("valid"),
        F.when(named, uuid).otherwise(ts).alias("k1"),
        F.when(named, ts).otherwise(session).alias("k2"),
        F.when(named, session).otherwise(F.lit("")).alias("k3"),
    )


def merge_log_trees(host: DataFrame, incoming: DataFrame) -> DataFrame:
    """Lines that bring the host tree up to date, by relative ``file_path``.

    A file with a host copy gains the lines whose identity is new, each once; lines without
    identity are passed over. A file without one is taken whole, unless no line of it is valid.
    ``action`` is append or copy.
    """
    lines = _keyed(incoming)
    files = (
        lines.groupBy("file_path")
        .agg(F.count_if("valid").alias("_valid"))
        .filter(F.col("_valid") > 0)
        .join(
            host.select("file_path").distinct().withColumn("_held", F.lit(True)), "file_path", "left"
        )
        .select("file_path", F.when(F.col("_held"), "append").otherwise("copy").alias("action"))
    )
    placed = spread_join(lines, files, ["file_path"], ["pos", "value"])
    whole = placed.filter(F.col("action") == "copy")
    first = Window.partitionBy(*_KEYS).orderBy("chunk", "pos")
    identified = F.col("valid") & (F.concat("k1", "k2", "k3") != "")
    news = placed.filter((F.col("action") == "append") & identified)
    known = _keyed(host).filter("valid").select(*_KEYS).distinct()
    added = (
        news.withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
        .join(known, _KEYS, "left_anti")
    )
    columns = ["file_path", "chunk", "pos", "value", "valid", "action"]
    return whole.select(*columns).unionByName(added.select(*columns))


def merge_summary(merged: DataFrame) -> DataFrame:
    """Files and valid lines of a merge, by action."""
    return merged.groupBy("action").agg(
        F.count_distinct("file_path").alias("files"), F.count_if("valid").alias("records")
    )


def fill_device(df: DataFrame, device: tuple[str | None, str | None, str | None]) -> DataFrame:
    """Device columns completed from ``device`` where they are null."""
    return df.withColumns(
        {
            c: F.coalesce(F.col(c), F.lit(v).cast("string"))
            for c, v in zip(DEVICE_COLUMNS, device, strict=True)
        }
    )


#: Tables of a store copy: schema, key, and whether a copied row replaces the one held.
COPIED = {
    "daily": (DAILY, ["date"], True),
    "usage": (USAGE, ["session_id", "message_uuid"], False),
    "limits": (LIMITS, ["ts"], True),
    "manifest": (MANIFEST, ["file_path"], True),
}


def copy_store(
    source: Mapping[str, DataFrame],
    target: Mapping[str, DataFrame],
    device: tuple[str | None, str | None, str | None] = (None, None, None),
) -> dict[str, DataFrame]:
    """The target tables after copying the source tables, every column included."""
    result = {}
    for name, (schema, keys, replace) in COPIED.items():
        if name not in source:
            continue
        rows = conform(source[name], schema)
        if "device_id" in schema.names:
            rows = fill_device(rows, device)
        held = conform(target[name], schema) if name in target else rows.limit(0)
        result[name] = upsert(held, rows, keys, update_matched=replace)
    return result


def copied_counts(
    source: Mapping[str, DataFrame], target: Mapping[str, DataFrame]
) -> DataFrame:
    """Rows a copy writes per table."""
    counts = []
    for name, (schema, keys, replace) in COPIED.items():
        if name not in source:
            continue
        rows = conform(source[name], schema)
        if not replace and name in target:
            rows = without_keys(rows, conform(target[name], schema), keys)
        counts.append(rows.agg(F.lit(name).alias("table"), F.count("*").alias("rows")))
    return union_all(counts)


def store_status(stores: Mapping[str, DataFrame | None]) -> DataFrame:
    """Per store: whether it exists, has all device columns, and its number of rows."""
    rows = []
    for name, df in stores.items():
        if df is None:
            continue
        rows.append(
            df.agg(F.count("*").alias("records")).select(
                F.lit(name).alias("store"),
                F.lit(True).alias("exists"),
                F.lit(all(c in df.columns for c in DEVICE_COLUMNS)).alias("has_device_columns"),
                "records",
            )
        )
    status = union_all(rows)
    for name in (n for n, df in stores.items() if df is None):
        status = status.unionByName(
            status.sparkSession.range(1).select(
                F.lit(name).alias("store"),
                F.lit(False).alias("exists"),
                F.lit(False).alias("has_device_columns"),
                F.lit(0).cast("bigint").alias("records"),
            )
        )
    return status
