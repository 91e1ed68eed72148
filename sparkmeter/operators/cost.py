"""Cost from token counts and model prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.schemas import COUNTERS
from sparkmeter.sources.pricing import MISSING_1H_RATE

MILLION = 1_000_000
#: The monthly fee a plan is compared at.
PLAN_FEE = 200.0

_FACT_DIMS = ["date", "device_id", "model", "folder", "git_branch"]


def _priced(tokens: Column, price: Column) -> Column:
    return tokens / MILLION * F.coalesce(price, F.lit(0.0))


def token_cost(write_1h_price: Column) -> Column:
    """Price formula in five parts; one-hour writes are part of the cache writes."""
    hour = F.coalesce("cache_creation_1h_tokens", F.lit(0))
    return (
        _priced(F.col("input_tokens"), F.col("input_price"))
        + _priced(F.col("output_tokens"), F.col("output_price"))
        + _priced(F.col("cache_creation_tokens") - hour, F.col("cache_write_price"))
        + _priced(hour, write_1h_price)
        + _priced(F.col("cache_read_tokens"), F.col("cache_read_price"))
    )


def cost_by_model(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Token sums and cost per model; a model without price costs 0 and is not ``priced``.

    Facts are summed per model before the join, so prices meet one row per model.
    """
    sums = (
        usage.filter(F.col("model").isNotNull())
        .groupBy("model")
        .agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTERS])
    )
    prices = pricing.withColumnRenamed("model_name", "model")
    hour_price = F.coalesce(
        F.col("cache_write_1h_price"), F.col("cache_write_price") * MISSING_1H_RATE
    )
    return sums.join(prices, "model", "left").select(
        "model",
        *COUNTERS,
        token_cost(hour_price).alias("cost"),
        F.col("input_price").isNotNull().alias("priced"),
    )


def total_cost(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Cost over all models."""
    return cost_by_model(usage, pricing).agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost")
    )


def usage_averages(totals: DataFrame) -> DataFrame:
    """Tokens and cost per session and response, 0 where nothing is counted.

    ``totals`` has total_tokens, total_cost, sessions and responses.
    """

    def average(value: str, count: str, digits: int) -> Column:
        ratio = F.try_divide(F.col(value).cast("double"), F.col(count).cast("double"))
        return F.bround(F.coalesce(ratio, F.lit(0.0)), digits)

    return totals.select(
        average("total_tokens", "sessions", 0).cast("bigint").alias("avg_tokens_per_session"),
        average("total_tokens", "responses", 0).cast("bigint").alias("avg_tokens_per_response"),
        average("total_cost", "sessions", 2).alias("avg_cost_per_session"),
        average("total_cost", "responses", 4).alias("avg_cost_per_response"),
    )


def months_covered(oldest: Column, newest: Column) -> Column:
    """Number of calendar months from one day to another, both touched."""
    return (F.months_between(F.trunc(newest, "MM"), F.trunc(oldest, "MM")) + 1).cast("bigint")


def plan_vs_api(totals: DataFrame, fee: float = PLAN_FEE) -> DataFrame:
    """Plan cost beside the cost by token prices.

    ``totals`` has total_cost, oldest_date and newest_date. ``saved`` and ``overpaid`` exclude
    each other.
    """
    months = months_covered(F.col("oldest_date"), F.col("newest_date"))
    difference = F.col("total_cost") - F.col("plan_cost")
    return totals.select("total_cost", months.alias("months")).withColumn(
        "plan_cost", F.col("months") * F.lit(fee)
    ).withColumns(
        {
            "saved": F.when(difference > 0, difference),
            "overpaid": F.when(difference <= 0, F.abs(difference)),
        }
    )


#: Measures by name, over usage_daily joined to prices; add an entry for another measure.
MEASURES: dict[str, Column] = {}


def measure_columns() -> dict[str, Column]:
    """The named measures. Ratios are null where the divisor is 0."""
    return {
        "total_tokens": F.sum("total_tokens"),
        "uncached_input_tokens": F.sum("input_tokens"),
        "output_tokens": F.sum("output_tokens"),
        "cache_write_tokens": F.sum("cache_creation_tokens"),
        "cache_read_tokens": F.sum("cache_read_tokens"),
        "cache_read_ratio": F.try_divide(
            F.sum("cache_read_tokens").cast("double"), F.sum("total_tokens").cast("double")
        ),
        "est_api_cost": F.sum("_cost"),
        "total_sessions": F.sum("sessions"),
        "active_devices": F.count_distinct("device_id"),
        **MEASURES,
    }


def measures(
    usage_daily: DataFrame,
    pricing: DataFrame,
    devices: DataFrame,
    by: list[str],
    names: list[str] | None = None,
) -> DataFrame:
    """Named measures sliced by columns of the daily facts, the prices or the devices.

    The cost is linear in the counters, so facts are summed to the slice, device and model before
    they meet prices and devices. Here a missing one-hour price counts as 0.
    """
    facts = list(dict.fromkeys([*[c for c in by if c in _FACT_DIMS], "device_id", "model"]))
    sums = usage_daily.groupBy(*facts).agg(
        *[F.sum(c).alias(c) for c in [*COUNTERS, "total_tokens", "sessions"]]
    )
    star = sums.join(pricing.withColumnRenamed("model_name", "model"), "model", "left").withColumn(
        "_cost",
        F.when(F.col("input_price").isNotNull(), token_cost(F.col("cache_write_1h_price"))),
    )
    if any(c in devices.columns for c in by if c not in _FACT_DIMS):
        star = star.join(devices, "device_id", "left")
    known = measure_columns()
    chosen = {n: known[n] for n in names} if names else known
    return star.groupBy(*by).agg(*[column.alias(name) for name, column in chosen.items()])
