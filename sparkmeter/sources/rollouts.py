"""Dialect B: rollout files, one per session, whose lines set the context of later lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.functions.predicates import date_key
from sparkmeter.operators.carry import carry_forward
from sparkmeter.schemas import with_total
from sparkmeter.sources.logs import json_rows
from sparkmeter.sources.transcripts import UNKNOWN, iso_timestamp, whole_number

# Field names and line types of the dialect, and its default texts.
DEFAULT_MODEL = "codex-unknown"
DEFAULT_VERSION = "codex"
META, CONTEXT, EVENT, TOKENS = "session_meta", "turn_context", "event_msg", "token_count"
_LINE = (
    "struct<type string, timestamp string, payload struct<type string, cwd string,"
    " cli_version string, model string, info struct<last_token_usage struct<"
    "input_tokens string, cached_input_tokens string, output_tokens string>>>>"
)


def file_stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


#: What a line sets for the lines after it.
CARRIED = ["model", "folder", "version"]


def rollout_events(lines: DataFrame) -> DataFrame:
    """What each line sets (``CARRIED``) and whether it is a token count with usage (``billed``)."""
    kind, usage = F.col("j.type"), "j.payload.info.last_token_usage."

    def number(field: str) -> Column:
        return whole_number(F.col(usage + field))

    cached = number("cached_input_tokens")
    fresh = F.greatest(number("input_tokens") - cached, F.lit(0)).cast("bigint")
    counted = (kind == EVENT) & (F.col("j.payload.type") == TOKENS)
    billed = counted & ((fresh != 0) | (cached != 0) | (number("output_tokens") != 0))
    return json_rows(lines, _LINE).select(
        *[c for c in lines.columns if c != "value"],
        iso_timestamp(F.col("j.timestamp")).alias("ts"),
        F.when((kind == CONTEXT) & (F.col("j.payload.model") != ""), F.col("j.payload.model")).alias(
            "model"
        ),
        F.when(kind.isin(META, CONTEXT), F.col("j.payload.cwd")).alias("folder"),
        F.when(kind == META, F.col("j.payload.cli_version")).alias("version"),
        F.coalesce(billed, F.lit(False)).alias("billed"),
        fresh.alias("input_tokens"),
        number("output_tokens").alias("output_tokens"),
        cached.alias("cache_read_tokens"),
    )


def parse_rollouts(lines: DataFrame, now: Column, tz: str = "UTC") -> DataFrame:
    """One fact row per token count with usage.

    Model, folder and version hold from the line that sets them until the next one. Only turns
    with usage are numbered. Input is what was not read from cache. ``now`` stands in for a
    missing time.
    """
    turns = carry_forward(
        rollout_events(lines),
        ["file_path"],
        ["pos"],
        CARRIED,
        chunk="chunk",
        count=("turn", F.col("billed")),
    ).filter("billed")
    return rollout_facts(turns, now, tz)


def rollout_facts(turns: DataFrame, now: Column, tz: str = "UTC") -> DataFrame:
    """Facts of numbered turns that know their context."""
    ts = F.coalesce(F.col("ts"), now)
    session = file_stem(F.col("file_path"))
    return with_total(
        turns.select(
            "file_path",
            "chunk",
            "pos",
            date_key(ts, tz).alias("date"),
            ts.alias("ts"),
            session.alias("session_id"),
            F.concat(session, F.lit(":t"), F.col("turn").cast("string")).alias("message_uuid"),
            F.lit("assistant").alias("message_type"),
            F.coalesce("model", F.lit(DEFAULT_MODEL)).alias("model"),
            F.coalesce("folder", F.lit(UNKNOWN)).alias("folder"),
            F.lit(None).cast("string").alias("git_branch"),
            F.coalesce("version", F.lit(DEFAULT_VERSION)).alias("version"),
            "input_tokens",
            "output_tokens",
            F.lit(0).cast("bigint").alias("cache_creation_tokens"),
            F.lit(0).cast("bigint").alias("cache_creation_1h_tokens"),
            "cache_read_tokens",
            F.lit(True).alias("has_usage"),
        )
    )
