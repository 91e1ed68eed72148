"""Row selections shared by the views and the push."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.functions.predicates import usage_present
from sparkmeter.schemas import COUNTERS
from sparkmeter.sources.transcripts import SYNTHETIC_MODEL


def date_range_filter(
    df: DataFrame, start: str | date | None = None, end: str | date | None = None
) -> DataFrame:
    """Rows between two days, both included; a missing bound is open."""
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df


def device_filter(df: DataFrame, devices: list[str] | None) -> DataFrame:
    """Rows of the listed devices; all rows without a list."""
    return df.filter(F.col("device_id").isin(devices)) if devices else df


def year_filter(df: DataFrame, year: int) -> DataFrame:
    """Rows of one calendar year, as a range so that day partitions can be pruned."""
    return date_range_filter(df, date(year, 1, 1), date(year, 12, 31))


def exclude_synthetic(df: DataFrame) -> DataFrame:
    """Rows with usage and a real model."""
    return df.filter((F.col("model") != SYNTHETIC_MODEL) & (F.col("model") != "") & usage_present(df))


def load_history(
    usage: DataFrame,
    start: str | date | None = None,
    end: str | date | None = None,
    legacy_null_rule: bool = True,
    ordered: bool = True,
) -> DataFrame:
    """Facts of a date range by day and time.

    Under the legacy rule a row without input and output has no usage at all, whatever its cache
    counters say, and the one-hour counter is not restored. ``ordered=False`` leaves out the sort
    when the result is aggregated anyway.
    """
    rows = date_range_filter(usage, start, end)
    if legacy_null_rule:
        used = (F.col("input_tokens") > 0) | (F.col("output_tokens") > 0)
        rows = rows.withColumns(
            {
                "has_usage": used,
                **{c: F.when(used, F.col(c)) for c in [*COUNTERS, "total_tokens"]},
                "cache_creation_1h_tokens": F.when(used, F.lit(0).cast("bigint")),
            }
        )
    return rows.orderBy("date", "ts") if ordered else rows


def history_or_daily(
    usage: DataFrame,
    daily: DataFrame,
    start: str | date | None = None,
    end: str | date | None = None,
) -> DataFrame:
    """Facts of a date range, or one stand-in row per rollup day when there are none."""
    facts = load_history(usage, start, end, ordered=False)
    none_found: Column = facts.limit(1).agg(F.count("*")).scalar() == 0
    day = F.col("date").cast("string")
    stand_ins = date_range_filter(daily, start, end).filter(none_found)
    rows = stand_ins.select(
        "date",
        (F.col("date").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("ts"),
        F.concat(F.lit("daily-"), day).alias("session_id"),
        F.concat(F.lit("aggregate-"), day).alias("message_uuid"),
        F.lit("assistant").alias("message_type"),
        F.lit("aggregate").alias("model"),
        F.lit("aggregate").alias("folder"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS if c in daily.columns],
        "total_tokens",
        F.lit(True).alias("has_usage"),
    )
    return facts.unionByName(rows, allowMissingColumns=True)
