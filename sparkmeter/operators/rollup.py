"""The daily rollup: build, refresh, gap fill, additive saves and the per-file ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.functions.predicates import is_prompt, is_response
from sparkmeter.operators.upsert import upsert, with_keys, without_keys
from sparkmeter.schemas import DAILY, DAILY_MEASURES, LEDGER, TOTAL_PARTS, conform


def measures_by(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts, responses, distinct sessions and token sums per key."""
    return usage.groupBy(*keys).agg(
        F.count_if(is_prompt()).alias("prompts"),
        F.count_if(is_response()).alias("responses"),
        F.count_distinct("session_id").alias("sessions"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in [*TOTAL_PARTS, "total_tokens"]
        ],
    )


def daily_rollup(usage: DataFrame, now: Column) -> DataFrame:
    """One rollup row per day of the facts."""
    return conform(measures_by(usage, ["date"]).withColumn("snapshot_ts", now), DAILY)


def refresh_daily(
    usage: DataFrame, daily: DataFrame, dates: DataFrame, now: Column
) -> DataFrame:
    """The rollup with the listed days recomputed; days without facts keep their row."""
    fresh = daily_rollup(with_keys(usage, dates, ["date"]), now)
    return upsert(conform(daily, DAILY), fresh, ["date"], update_matched=True)


def recompute_daily(
    usage: DataFrame, daily: DataFrame, dates: DataFrame, now: Column
) -> DataFrame:
    """As ``refresh_daily``, but listed days that have no facts left lose their row."""
    fresh = daily_rollup(with_keys(usage, dates, ["date"]), now)
    return without_keys(conform(daily, DAILY), dates, ["date"]).unionByName(fresh)


def save_additive(batch: DataFrame, daily: DataFrame, now: Column) -> DataFrame:
    """The rollup with the sums of a batch added to its days."""
    return add_to_daily(conform(daily, DAILY), daily_rollup(batch, now))


def add_to_daily(daily: DataFrame, added: DataFrame) -> DataFrame:
    """Sum two rollups by day; the device and time of the second win."""
    both = daily.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)))
    rest = [c for c in DAILY.names if c not in ["date", *DAILY_MEASURES]]
    return conform(
        both.groupBy("date").agg(
            *[F.sum(c).alias(c) for c in DAILY_MEASURES],
            F.max_by(F.struct(*rest), "_new").alias("_rest"),
        ).select("date", *DAILY_MEASURES, "_rest.*"),
        DAILY,
    )


def file_contribution(df: DataFrame) -> DataFrame:
    """What each file holds per day: counts, distinct sessions and token sums."""
    return conform(measures_by(df, ["file_path", "date"]), LEDGER)


def ledger_changes(fresh: DataFrame, contrib: DataFrame, manifest: DataFrame) -> DataFrame:
    """Fresh minus previous contribution per file and day of the fresh files.

    A file the manifest knows but the ledger does not was counted before there was a ledger: it
    changes nothing the first time. A day a file no longer holds is not subtracted.
    """
    booked = contrib.select("file_path").distinct().withColumn("_booked", F.lit(True))
    tracked = manifest.select("file_path").distinct().withColumn("_tracked", F.lit(True))
    previous = contrib.select(
        "file_path", "date", *[F.col(c).alias(f"_old_{c}") for c in DAILY_MEASURES]
    )
    known = F.col("_booked").isNull() & F.col("_tracked").isNotNull()
    return (
        fresh.join(previous, ["file_path", "date"], "left")
        .join(booked, "file_path", "left")
        .join(tracked, "file_path", "left")
        .select(
            "file_path",
            "date",
            *[
                F.when(known, 0)
                .otherwise(F.col(c) - F.coalesce(F.col(f"_old_{c}"), F.lit(0)))
                .cast("bigint")
                .alias(c)
                for c in DAILY_MEASURES
            ],
        )
    )


def apply_ledger_delta(changes: DataFrame, daily: DataFrame, now: Column) -> DataFrame:
    """The rollup after the changes of all files, not below zero.

    The total is the sum of the four merged counters. All files are summed first and the clamp
    comes once per day; clamping after each file differs only where a running sum is negative.
    Days whose changes are all zero keep their row.
    """
    moved = changes.groupBy("date").agg(
        *[F.sum(c).alias(f"_d_{c}") for c in DAILY_MEASURES],
        F.bool_or(
            F.greatest(*[F.abs(F.col(c)) for c in DAILY_MEASURES]) > 0
        ).alias("_moved"),
    ).filter("_moved")
    plain = [c for c in DAILY_MEASURES if c != "total_tokens"]
    merged = moved.join(conform(daily, DAILY), "date", "left").select(
        "date",
        *[
            F.greatest(F.coalesce(F.col(c), F.lit(0)) + F.col(f"_d_{c}"), F.lit(0)).alias(c)
            for c in plain
        ],
        *[c for c in DAILY.names if c not in ["date", *DAILY_MEASURES, "snapshot_ts"]],
    )
    total = sum((F.col(c) for c in TOTAL_PARTS[1:]), F.col(TOTAL_PARTS[0]))
    merged = conform(merged.withColumns({"total_tokens": total, "snapshot_ts": now}), DAILY)
    return upsert(conform(daily, DAILY), merged, ["date"], update_matched=True)


def newly_counted(changes: DataFrame) -> DataFrame:
    """Responses newly accounted for: the sum of the positive changes."""
    return changes.agg(
        F.coalesce(F.sum(F.greatest("responses", F.lit(0))), F.lit(0)).alias("new_responses")
    )


def replace_ledger(fresh: DataFrame, contrib: DataFrame) -> DataFrame:
    """The ledger with all rows of the fresh files replaced."""
    return without_keys(conform(contrib, LEDGER), fresh, ["file_path"]).unionByName(
        conform(fresh, LEDGER)
    )
