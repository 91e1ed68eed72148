"""Incremental pushes: the decision, the batches, the state, the repair of a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.operators.filters import device_filter
from sparkmeter.operators.metrics import device_counts, usage_daily
from sparkmeter.operators.skew import spread_join
from sparkmeter.operators.upsert import upsert, with_keys, without_keys
from sparkmeter.schemas import STATE, USAGE, conform
from sparkmeter.sources.registry import union_all

#: State keys of a sink, each stored as ``<sink>.<key>``.
WATERMARK, LIMITS_WATERMARK = "usage_watermark", "limits_watermark"
LAST_PUSH, PUSH_COUNT, GUARD = "last_push_at", "push_count", "rebuild_guard"
_STATE_KEYS = [WATERMARK, LIMITS_WATERMARK, LAST_PUSH, PUSH_COUNT, GUARD]
# Seconds between throttled pushes, and pushes between two compactions.
MIN_INTERVAL = 900
COMPACT_EVERY = 50
KEYS_LAKE = ["date", "device_id", "model", "folder", "git_branch"]
KEYS_SERVER = ["session_id", "message_uuid"]


def sequence(by_update: bool) -> Column:
    """What a usage watermark counts: ids, or update numbers so that upgrades are sent again."""
    return F.coalesce("updated_seq", "id") if by_update else F.col("id")


def sink_state(state: DataFrame, sink: str) -> DataFrame:
    """State of one sink as one row with a text column per key."""
    return state.agg(
        *[F.max(F.when(F.col("key") == f"{sink}.{k}", F.col("value"))).alias(k) for k in _STATE_KEYS]
    )


def plan_push(
    usage: DataFrame,
    limits: DataFrame,
    state: DataFrame,
    sink: str,
    now: float,
    devices: list[str] | None = None,
    full: bool = False,
    respect_interval: bool = False,
    min_interval: int = MIN_INTERVAL,
    by_update: bool = False,
) -> DataFrame:
    """What a push would do, as one row.

    Only rows of ``devices`` count as new. A watermark above the largest id means the store was
    rebuilt, and is dropped. ``blocked`` holds while the guard of a rebuild is set, ``throttled``
    within the interval after the last push; ``skip`` says there is nothing to do.
    """
    facts = device_filter(conform(usage, USAGE), devices).agg(
        F.max(sequence(by_update)).alias("max_id")
    )
    readings = device_filter(limits, devices).agg(F.max("ts").alias("max_limits_ts"))
    parts = union_all([facts, readings, sink_state(state, sink)])
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])

    stored = F.col(WATERMARK).cast("bigint")
    rebuilt = F.coalesce("max_id", F.lit(0)) < stored
    watermark = F.when(~F.lit(full) & ~F.coalesce(rebuilt, F.lit(False)), stored)
    limits_seen = F.col(LIMITS_WATERMARK).cast("timestamp")
    since = F.lit(float(now)) - F.col(LAST_PUSH).cast("double")
    return (
        row.withColumns(
            {
                "wm_id": watermark,
                "new_usage": F.col("max_id").isNotNull()
                & F.coalesce(F.col("max_id") > watermark, F.lit(True)),
                "new_limits": F.col("max_limits_ts").isNotNull()
                & (F.lit(full) | F.coalesce(F.col("max_limits_ts") > limits_seen, F.lit(True))),
                "blocked": F.coalesce(F.col(GUARD) == "1", F.lit(False)),
                "throttled": F.lit(respect_interval)
                & F.coalesce(since < min_interval, F.lit(False)),
            }
        )
        .withColumn(
            "skip",
            F.col("throttled") | ~(F.col("new_usage") | F.col("new_limits") | F.lit(full)),
        )
        .select(
            "max_id",
            "max_limits_ts",
            "wm_id",
            F.col(LIMITS_WATERMARK).alias("wm_limits_ts"),
            F.col(PUSH_COUNT).cast("bigint").alias("push_count"),
            "new_usage",
            "new_limits",
            "blocked",
            "throttled",
            "skip",
        )
    )


def source_rows(
    usage: DataFrame, wm: int | None, devices: list[str] | None = None, by_update: bool = False
) -> DataFrame:
    """Rows above the watermark under the device filter; all rows without a watermark."""
    rows = device_filter(conform(usage, USAGE), devices)
    return rows if wm is None else rows.filter(sequence(by_update) > wm)


def as_numbers(touched: DataFrame) -> DataFrame:
    """A change log in place of the facts, for ``plan_push``: its largest numbers are theirs."""
    return touched.select("device_id", F.col("last_id").alias("id"), F.col("seq").alias("updated_seq"))


def changed_days(
    touched: DataFrame,
    wm: int | None,
    devices: list[str] | None = None,
    by_update: bool = False,
) -> DataFrame:
    """Days and devices of a change log above the watermark, and whether they lost rows since."""
    rows = device_filter(touched, devices)
    if wm is not None:
        rows = rows.filter(F.col("seq" if by_update else "last_id") > wm)
    return rows.groupBy("date", "device_id").agg(F.bool_or("shrunk").alias("shrunk"))


def without_shrunk(target: DataFrame, changed: DataFrame) -> DataFrame:
    """Target rows without those of a day and device that lost local rows; these are sent whole."""
    return without_keys(target, changed.filter("shrunk"), ["date", "device_id"])


def affected_day_batch(
    usage: DataFrame,
    wm: int | None,
    now: Column,
    devices: list[str] | None = None,
    by_update: bool = False,
) -> DataFrame:
    """Daily facts of every day that gained rows, from all rows of the day.

    The values are absolute, so the target rows can be replaced and a repeat changes nothing.
    """
    rows = device_filter(conform(usage, USAGE), devices)
    if wm is not None:
        days = source_rows(usage, wm, devices, by_update).select("date").distinct()
        rows = with_keys(rows, days, ["date"])
    return usage_daily(rows, now)


def push_daily(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The lake table after a batch of whole days."""
    return upsert(target, batch, KEYS_LAKE, update_matched=True)


def full_rows(usage: DataFrame, remote: DataFrame) -> DataFrame:
    """Local rows whose session and id the target lacks."""
    return without_keys(usage, remote, KEYS_SERVER)


def push_full(usage: DataFrame, remote: DataFrame) -> DataFrame:
    """The target after adding every row it lacks."""
    return remote.unionByName(full_rows(usage, remote), allowMissingColumns=True)


def incremental_rows(usage: DataFrame, remote: DataFrame, wm: int) -> DataFrame:
    """Rows above the watermark that the target lacks.

    Only target rows of the sessions of those rows are looked at. How many sessions make that
    worthwhile is left to the planner; the rows are the same either way.
    """
    fresh = usage.filter(F.col("id") > wm)
    sessions = fresh.select("session_id").distinct()
    held = spread_join(
        remote.select(*KEYS_SERVER), sessions, ["session_id"], ["message_uuid"], "left_semi"
    )
    return without_keys(fresh, held, KEYS_SERVER)


def push_incremental(usage: DataFrame, remote: DataFrame, wm: int) -> DataFrame:
    """The target after adding the rows above the watermark that it lacks."""
    return remote.unionByName(incremental_rows(usage, remote, wm), allowMissingColumns=True)


def push_limits(limits: DataFrame, remote: DataFrame, by_device: bool = False) -> DataFrame:
    """The target's readings with new ones added, by time (and device)."""
    return upsert(remote, limits, ["ts", "device_id"] if by_device else ["ts"])


def push_pricing(pricing: DataFrame, remote: DataFrame, replace: bool) -> DataFrame:
    """The target's prices: replaced by model, or only added to."""
    return upsert(remote, pricing, ["model_name"], update_matched=replace)


def push_devices(dim: DataFrame, remote: DataFrame) -> DataFrame:
    """The target's devices, replaced by device id."""
    return upsert(remote, dim, ["device_id"], update_matched=True)


def set_state(state: DataFrame, values: dict[str, str | None]) -> DataFrame:
    """The state with keys set; a value that is null is not written."""
    written = [(k, v) for k, v in values.items() if v is not None]
    if not written:
        return conform(state, STATE)
    rows = state.sparkSession.createDataFrame(written, "key string, value string")
    return upsert(conform(state, STATE), rows, ["key"], update_matched=True)


def repair_conflict(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows without device on both sides, and whether a repair must stop because of them."""
    unknown = F.col("device_id").isNull()
    sides = union_all(
        [
            local.agg(F.count_if(unknown).alias("local_nulls")),
            remote.agg(F.count_if(unknown).alias("remote_nulls")),
        ]
    )
    return sides.agg(
        F.max("local_nulls").alias("local_nulls"), F.max("remote_nulls").alias("remote_nulls")
    ).withColumn("abort", (F.col("local_nulls") > 0) & (F.col("remote_nulls") > 0))


def foreign_rows(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Target rows of devices the local store has no rows of."""
    own = local.filter(F.col("device_id").isNotNull()).select("device_id").distinct()
    return spread_join(remote, own, ["device_id"], KEYS_SERVER, "left_anti")


def repair_target(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The target with rows of local devices replaced by the local rows, foreign rows kept."""
    return conform(local, USAGE).unionByName(conform(foreign_rows(local, remote), USAGE))


def repair_differences(local: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Devices whose row count after a repair is not the expected one; none when all is well."""
    own = device_counts(local)
    expected = upsert(device_counts(before), own, ["device_id"], update_matched=True)
    found = device_counts(after)
    return expected.exceptAll(found).withColumn("side", F.lit("expected")).unionByName(
        found.exceptAll(expected).withColumn("side", F.lit("found"))
    )


def sink_status(state: DataFrame, sinks: DataFrame) -> DataFrame:
    """Watermark and last push of each sink beside its settings.

    ``sinks`` has sink, min_interval and device_filter; a sink that never pushed has nulls.
    """
    parts = state.select(
        F.substring_index("key", ".", 1).alias("sink"),
        F.substring_index("key", ".", -1).alias("field"),
        "value",
    )
    wide = parts.groupBy("sink").agg(
        *[F.max(F.when(F.col("field") == k, F.col("value"))).alias(k) for k in _STATE_KEYS]
    )
    return sinks.join(wide, "sink", "left").select(
        "sink",
        F.col(WATERMARK).cast("bigint").alias("watermark"),
        F.timestamp_seconds(F.col(LAST_PUSH).cast("double")).alias("last_push"),
        F.coalesce("min_interval", F.lit(MIN_INTERVAL)).alias("min_interval"),
        "device_filter",
    )


def cross_device_view(stores: list[DataFrame]) -> DataFrame:
    """Facts of several stores as one table; a row held by two stores counts once.

    Rows are told apart by session and id; the copy with most tokens, then the latest, stays.
    """
    order = Window.partitionBy(*KEYS_SERVER).orderBy(
        F.desc("total_tokens"), F.desc("ts"), "device_id", "id"
    )
    return (
        union_all([conform(s, USAGE) for s in stores])
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
