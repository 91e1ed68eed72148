"""Day spines, the year grid of the heatmap, week strips and limit values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.operators.upsert import without_keys
from sparkmeter.schemas import DAILY, DAILY_MEASURES, conform

# Colours of the grid and characters of the strip.
NONE_COLOUR = "#3C3C3A"
FUTURE_COLOUR = "#6B6B68"
NONE_RGB = (60, 60, 58)
FULL_RGB = (203, 123, 93)
LEVELS = ".:*#@"


def days_between(spark: SparkSession, start: Column, end: Column) -> DataFrame:
    """One row per day from ``start`` to ``end``; none when the range is empty."""
    ordered = F.when(start <= end, F.sequence(start, end))
    return spark.range(1).select(F.explode(ordered).alias("date"))


def date_spine(daily: DataFrame, end: date, days: int = 365) -> DataFrame:
    """The ``days`` days up to ``end``; empty when there is no daily data at all."""
    last = F.lit(end).cast("date")
    spine = days_between(daily.sparkSession, F.date_sub(last, days - 1), last)
    return spine.filter(daily.limit(1).agg(F.count("*")).scalar() > 0)


def missing_days(daily: DataFrame, start: date | Column, end: date | Column) -> DataFrame:
    """Days of a range that have no rollup row."""
    first, last = (_day(d) for d in (start, end))
    return without_keys(days_between(daily.sparkSession, first, last), daily, ["date"])


def fill_gaps(
    daily: DataFrame, start: date | Column, end: date | Column, now: Column
) -> DataFrame:
    """The rollup with a zero row for every missing day of a range."""
    zeros = missing_days(daily, start, end).withColumn("snapshot_ts", now)
    return conform(daily, DAILY).unionByName(
        conform(zeros, DAILY, dict.fromkeys(DAILY_MEASURES, 0))
    )


def _day(value: date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def calendar_cells(daily: DataFrame, year: int, today: date) -> DataFrame:
    """One cell per day of a year: week column, weekday row (Sunday first), state and counts.

    ``max_tokens`` is over all days of the rollup, not only those of the year.
    """
    first = date(year, 1, 1)
    lead = (first.weekday() + 1) % 7
    spine = days_between(daily.sparkSession, _day(first), _day(date(year, 12, 31)))
    top = daily.agg(F.max("total_tokens")).scalar()
    cells = spine.join(daily.select("date", "prompts", "total_tokens"), "date", "left")
    tokens = F.coalesce("total_tokens", F.lit(0))
    return cells.select(
        "date",
        F.floor((F.dayofyear("date") - 1 + lead) / 7).cast("bigint").alias("week"),
        (F.dayofweek("date") - 1).cast("bigint").alias("weekday"),
        F.when(F.col("date") > _day(today), "future")
        .when(tokens == 0, "none")
        .otherwise("active")
        .alias("state"),
        F.coalesce("prompts", F.lit(0)).alias("prompts"),
        tokens.alias("tokens"),
        F.coalesce(top, F.lit(1)).alias("max_tokens"),
    )


def heat_intensity(cells: DataFrame) -> DataFrame:
    """Add ``colour``: between two colours by the root of the share of the maximum."""
    ratio = F.sqrt(
        F.coalesce(
            F.try_divide(F.col("tokens").cast("double"), F.col("max_tokens").cast("double")),
            F.lit(0.0),
        )
    )
    parts = [F.floor(lo + (hi - lo) * ratio) for lo, hi in zip(NONE_RGB, FULL_RGB, strict=True)]
    return cells.withColumn(
        "colour",
        F.when(F.col("state") == "future", FUTURE_COLOUR)
        .when(F.col("state") == "none", NONE_COLOUR)
        .otherwise(F.format_string("rgb(%d,%d,%d)", *parts)),
    )


def cell_tooltip(cells: DataFrame) -> DataFrame:
    """Add ``tooltip``: the day and its counts, or why there are none."""
    counts = F.format_string(
        "%s: %d prompts, %s tokens",
        F.col("date").cast("string"),
        "prompts",
        F.format_number("tokens", 0),
    )
    day = F.col("date").cast("string")
    return cells.withColumn(
        "tooltip",
        F.when(F.col("tokens") > 0, counts)
        .when(F.col("state") == "future", F.concat(day, F.lit(": Future")))
        .otherwise(F.concat(day, F.lit(": No activity"))),
    )


def month_labels(cells: DataFrame) -> DataFrame:
    """Week columns in which the month of the first day changes, with the month's short name."""
    weeks = cells.groupBy("week").agg(F.min("date").alias("date"))
    # One row per week of a year, so this window without partitions is bounded.
    before = F.lag(F.month("date")).over(Window.orderBy("week"))
    return (
        weeks.withColumn("_before", before)
        .filter(F.col("_before").isNull() | (F.month("date") != F.col("_before")))
        .select("week", F.date_format("date", "MMM").alias("label"))
    )


def week_strip(daily: DataFrame, today: date, weeks: int = 12) -> DataFrame:
    """The current and the ``weeks`` earlier weeks from Monday, seven level characters each."""
    start = F.date_sub(F.trunc(_day(today), "week"), 7 * weeks)
    spine = days_between(daily.sparkSession, start, F.date_add(start, 7 * (weeks + 1) - 1))
    top = daily.agg(F.max("total_tokens")).scalar()
    tokens = F.coalesce("total_tokens", F.lit(0))
    ratio = F.sqrt(F.try_divide(tokens.cast("double"), top.cast("double")))
    level = F.least(F.lit(4), F.floor(ratio * 5)).cast("int")
    cells = spine.join(daily.select("date", "total_tokens"), "date", "left").select(
        F.trunc("date", "week").alias("week_start"),
        "date",
        F.when(tokens == 0, LEVELS[0])
        .otherwise(F.substring(F.lit(LEVELS), level + 1, F.lit(1)))
        .alias("char"),
    )
    # Seven days per week, so the list is bounded.
    days = F.array_sort(F.collect_list(F.struct("date", "char")))
    return cells.groupBy("week_start").agg(
        F.array_join(F.transform(days, lambda d: d["char"]), "").alias("strip")
    )


def fill_limits(limits: DataFrame, end: date | None = None) -> DataFrame:
    """Daily limit percentages per device; missing days take the last known values.

    A day with several readings counts with its largest. ``end`` extends the days beyond the last
    reading of a device.
    """
    values = ["session_pct", "week_pct", "opus_pct"]
    known = limits.groupBy("device_id", "date").agg(*[F.max(c).alias(c) for c in values])
    last = F.greatest(F.max("date"), _day(end)) if end else F.max("date")
    spine = known.groupBy("device_id").agg(
        F.explode(F.sequence(F.min("date"), last)).alias("date")
    )
    so_far = Window.partitionBy("device_id").orderBy("date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return spine.join(known, ["device_id", "date"], "left").select(
        "device_id",
        "date",
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in values],
    )
