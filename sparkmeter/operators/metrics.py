"""Statistics, breakdowns and shares over facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.functions.labels import (
    bar_fill,
    model_label,
    narrow_model_label,
    narrow_project_label,
    project_label,
)
from sparkmeter.functions.predicates import is_prompt, is_response, usage_present
from sparkmeter.operators.filters import exclude_synthetic
from sparkmeter.schemas import COUNTERS, USAGE_DAILY, DEVICES, conform

_SUMS = [*COUNTERS, "total_tokens"]


def _condensed(df: DataFrame) -> DataFrame:
    """Facts summed per day, session, model and folder.

    Several distinct counts expand every row once per counted column; condensed input makes that
    expansion small.
    """
    return df.groupBy("date", "session_id", "model", "folder").agg(
        F.count_if(is_prompt()).alias("prompts"),
        F.count_if(is_response()).alias("responses"),
        *[F.sum(c).alias(c) for c in _SUMS],
    )


def _stat_columns() -> list[Column]:
    return [
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in ["prompts", "responses", *_SUMS]
        ],
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("model").alias("models"),
        F.count_distinct("folder").alias("folders"),
    ]


def daily_stats(df: DataFrame) -> DataFrame:
    """Per day: prompts, responses, token sums, and numbers of sessions, models and folders.

    The models and folders themselves are rows of ``daily_members``.
    """
    return _condensed(df).groupBy("date").agg(*_stat_columns())


def overall_stats(df: DataFrame) -> DataFrame:
    """``daily_stats`` over everything, as one row with key ``all``; zeros without rows."""
    return _condensed(df).agg(*_stat_columns()).withColumn("date_key", F.lit("all"))


def daily_and_overall(df: DataFrame) -> DataFrame:
    """Daily and overall statistics in one pass."""
    return (
        _condensed(df)
        .groupingSets([[F.col("date")], []], F.col("date"))
        .agg(
            *_stat_columns(),
            F.when(F.grouping("date") == 1, F.lit("all"))
            .otherwise(F.col("date").cast("string"))
            .alias("date_key"),
        )
        .drop("date")
    )


def daily_members(df: DataFrame) -> DataFrame:
    """Models (known ones) and folders of each day, one row per member.

    Rows instead of arrays: a day may have any number of folders, and no task has to hold them.
    """
    return (
        df.select("date", "model", "folder")
        .distinct()
        .select(
            "date",
            F.explode(
                F.array(
                    F.struct(F.lit("model").alias("kind"), F.col("model").alias("member")),
                    F.struct(F.lit("folder").alias("kind"), F.col("folder").alias("member")),
                )
            ).alias("m"),
        )
        .select("date", "m.kind", "m.member")
        .filter(F.col("member").isNotNull())
        .distinct()
    )


def coverage(usage: DataFrame) -> DataFrame:
    """Number of records, first and last day."""
    return usage.agg(
        F.count("*").alias("total_records"),
        F.min("date").alias("oldest_date"),
        F.max("date").alias("newest_date"),
    )


def store_stats(usage: DataFrame, daily: DataFrame) -> DataFrame:
    """Fact counts and bounds beside the sums of the rollup, as one row.

    Sessions are the sum of the daily distinct counts.
    """
    facts = usage.agg(
        F.count("*").alias("total_records"),
        F.count_distinct("date").alias("total_days"),
        F.min("date").alias("oldest_date"),
        F.max("date").alias("newest_date"),
    )
    rollup = daily.agg(
        F.max("snapshot_ts").alias("newest_timestamp"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(name)
            for c, name in [
                ("total_tokens", "total_tokens"),
                ("prompts", "total_prompts"),
                ("responses", "total_responses"),
                ("sessions", "sessions_daily_sum"),
            ]
        ],
    )
    both = facts.unionByName(rollup, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def store_stats_distinct(usage: DataFrame) -> DataFrame:
    """``store_stats`` from facts alone; sessions are counted once over all days."""
    return usage.agg(
        F.count("*").alias("total_records"),
        F.count_distinct("date").alias("total_days"),
        F.min("date").alias("oldest_date"),
        F.max("date").alias("newest_date"),
        F.max("ts").alias("newest_timestamp"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count_if(is_prompt()).alias("total_prompts"),
        F.count_if(is_response()).alias("total_responses"),
        F.count_distinct("session_id").alias("sessions_distinct"),
    )


def file_sessions(contrib: DataFrame) -> DataFrame:
    """Sessions as the sum of the per-file distinct counts, by day."""
    return contrib.groupBy("date").agg(F.sum("sessions").alias("sessions_file_sum"))


def tokens_by_model(usage: DataFrame) -> DataFrame:
    """Tokens per known model, most first."""
    return (
        usage.filter(F.col("model") != "")
        .groupBy("model")
        .agg(F.sum("total_tokens").alias("tokens"))
        .orderBy(F.desc("tokens"), "model")
    )


def tokens_by_folder(usage: DataFrame) -> DataFrame:
    """Tokens per folder of the rows with usage."""
    return (
        usage.filter(usage_present(usage))
        .groupBy("folder")
        .agg(F.sum("total_tokens").alias("tokens"))
    )


def share(df: DataFrame, value: str, denominator: Column | None = None) -> DataFrame:
    """Add ``share``, the percentage of ``denominator`` (default: the sum of all rows), 0 of 0.

    The sum is a scalar subquery, so no window gathers the rows in one task.
    """
    total = df.agg(F.sum(value)).scalar() if denominator is None else denominator
    ratio = F.try_divide(F.col(value).cast("double"), total.cast("double"))
    return df.withColumn("share", F.coalesce(ratio * 100, F.lit(0.0)))


def model_share(usage: DataFrame, denominator: Column | None = None) -> DataFrame:
    """Tokens, label, share and bar per model; the share is of the shown models by default."""
    tokens = tokens_by_model(exclude_synthetic(usage))
    top = tokens.agg(F.max("tokens")).scalar()
    return share(tokens, "tokens", denominator).withColumns(
        {"label": model_label(F.col("model")), "filled": bar_fill(F.col("tokens"), top)}
    )


def project_breakdown(usage: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest projects with their share of all projects and a bar among the shown."""
    tokens = tokens_by_folder(usage)
    total = tokens.agg(F.sum("tokens")).scalar()
    shown = tokens.orderBy(F.desc("tokens"), "folder").limit(n)
    # At most n rows reach this window without partitions.
    top = F.max("tokens").over(Window.partitionBy())
    return share(shown, "tokens", total).withColumns(
        {"label": project_label(F.col("folder")), "filled": bar_fill(F.col("tokens"), top)}
    )


def top_models(usage: DataFrame, n: int = 5) -> DataFrame:
    """Narrow view: the ``n`` largest models with their share of all models."""
    tokens = tokens_by_model(exclude_synthetic(usage))
    total = tokens.agg(F.sum("tokens")).scalar()
    shown = tokens.orderBy(F.desc("tokens"), "model").limit(n)
    return share(shown, "tokens", total).withColumn("label", narrow_model_label(F.col("model")))


def top_projects(usage: DataFrame, n: int = 5) -> DataFrame:
    """Narrow view: the ``n`` largest projects with their share of all projects."""
    return project_breakdown(usage, n).select(
        "folder", "tokens", "share", narrow_project_label(F.col("folder")).alias("label")
    )


def kpis(usage: DataFrame) -> DataFrame:
    """Tokens, prompts, sessions and active days."""
    return usage.agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.count_if(is_prompt()).alias("prompts"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("date").alias("active_days"),
    )


def rollup_kpis(daily: DataFrame) -> DataFrame:
    """Key figures from the rollup alone; sessions are the sum of the daily distinct counts."""
    active = (F.col("prompts") > 0) | (F.col("responses") > 0)
    return daily.agg(
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("prompts"), F.lit(0)).alias("prompts"),
        F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions_daily_sum"),
        F.count_if(active).alias("active_days"),
    )


def date_bounds(usage: DataFrame) -> DataFrame:
    """First and last active day."""
    return usage.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def usage_daily(usage: DataFrame, now: Column) -> DataFrame:
    """Facts per day, device, model, folder and branch; missing dimensions get a fixed text."""
    dims = usage.withColumns(
        {
            "model": F.coalesce("model", F.lit("<none>")),
            "folder": F.coalesce("folder", F.lit("")),
            "git_branch": F.coalesce("git_branch", F.lit("")),
        }
    )
    return conform(
        dims.groupBy("date", "device_id", "model", "folder", "git_branch")
        .agg(
            F.count("*").alias("records"),
            F.count_distinct("session_id").alias("sessions"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS],
        )
        .withColumn("last_updated", now),
        USAGE_DAILY,
    )


def devices_dim(usage: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """Devices of the facts with the account each is registered to.

    ``accounts`` has one row per ``device_id`` with email, organization and subscription.
    """
    devices = usage.select("device_id", "device_name", "device_type").distinct()
    return conform(
        devices.join(accounts, "device_id", "left")
        .withColumnRenamed("email", "user_upn")
        .withColumn("last_push_at", now),
        DEVICES,
    )


def device_counts(usage: DataFrame) -> DataFrame:
    """Rows per device; rows without device count under ``<null>``."""
    return usage.groupBy(F.coalesce("device_id", F.lit("<null>")).alias("device_id")).agg(
        F.count("*").alias("records")
    )


def device_total(usage: DataFrame) -> DataFrame:
    """Number of distinct known devices."""
    return usage.agg(F.count_distinct("device_id").alias("devices"))
