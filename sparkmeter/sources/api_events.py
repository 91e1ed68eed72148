"""Dialect C: one event per billed API call, without any content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.functions.predicates import date_key
from sparkmeter.schemas import with_total
from sparkmeter.sources.logs import json_rows
from sparkmeter.sources.transcripts import UNKNOWN, iso_timestamp

# Field names of the dialect, its event type and its default texts.
EVENT_TYPE = "hermes_usage"
PREFIX = "hermes:"
DEFAULT_MODEL = "hermes-unknown"
_EVENT = (
    "struct<type string, session_id string, api_request_id string, message_uuid string,"
    " ended_at variant, timestamp variant, provider string, platform string, model string,"
    " response_model string, cwd string, git_branch string, usage struct<input_tokens variant,"
    " output_tokens variant, cache_read_tokens variant, cache_write_tokens variant>>"
)
_LAST_SECOND = 253402300799


def clamped_counter(value: Column) -> Column:
    """A counter of any JSON type as a number that is not negative; 0 when it is not numeric."""
    return F.greatest(
        F.coalesce(F.try_variant_get(value, "$", "bigint"), F.lit(0)), F.lit(0)
    ).cast("bigint")


def flexible_timestamp(value: Column) -> Column:
    """Epoch seconds or ISO text."""
    textual = F.schema_of_variant(value) == "STRING"
    seconds = F.try_variant_get(value, "$", "double")
    return F.when(textual, iso_timestamp(F.try_variant_get(value, "$", "string"))).when(
        F.abs(seconds) <= _LAST_SECOND,
        F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint")),
    )


def parse_api_events(lines: DataFrame, now: Column, tz: str = "UTC") -> DataFrame:
    """Fact rows of usage events that name session and request and have usage.

    The time is the end of the call, else the event's time, else ``now``.
    """

    def text(*fields: str) -> Column:
        trimmed = [F.trim(F.col(f"j.{f}")) for f in fields]
        return F.coalesce(*[F.when(t != "", t) for t in trimmed])

    def filled(*fields: str) -> Column:
        return F.coalesce(*[F.when(F.col(f"j.{f}") != "", F.col(f"j.{f}")) for f in fields])

    ts = F.coalesce(
        flexible_timestamp(F.col("j.ended_at")), flexible_timestamp(F.col("j.timestamp")), now
    )
    events = json_rows(lines, _EVENT).filter(
        (F.col("j.type") == EVENT_TYPE) & F.col("j.usage").isNotNull()
    )
    facts = with_total(
        events.select(
            *[c for c in lines.columns if c != "value"],
            ts.alias("ts"),
            text("session_id").alias("session_id"),
            text("api_request_id", "message_uuid").alias("message_uuid"),
            F.lit("assistant").alias("message_type"),
            F.coalesce(filled("response_model", "model"), F.lit(DEFAULT_MODEL)).alias("model"),
            F.coalesce(
                filled("cwd"),
                F.concat(F.lit(PREFIX), F.coalesce(text("platform"), F.lit(UNKNOWN))),
            ).alias("folder"),
            filled("git_branch").alias("git_branch"),
            F.concat(F.lit(PREFIX), F.coalesce(text("provider"), F.lit(UNKNOWN))).alias("version"),
            clamped_counter(F.col("j.usage.input_tokens")).alias("input_tokens"),
            clamped_counter(F.col("j.usage.output_tokens")).alias("output_tokens"),
            clamped_counter(F.col("j.usage.cache_write_tokens")).alias("cache_creation_tokens"),
            F.lit(0).cast("bigint").alias("cache_creation_1h_tokens"),
            clamped_counter(F.col("j.usage.cache_read_tokens")).alias("cache_read_tokens"),
            F.lit(True).alias("has_usage"),
        )
    )
    return facts.filter(
        F.col("session_id").isNotNull()
        & F.col("message_uuid").isNotNull()
        & (F.col("total_tokens") > 0)
    ).withColumn("date", date_key(F.col("ts"), tz))
