"""Dialect A: session transcripts of prompts and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.functions.predicates import date_key
from sparkmeter.schemas import with_total
from sparkmeter.sources.logs import json_rows

# Field names of the dialect, its kept types, the skipped model, the default text.
KEPT_TYPES = ["user", "assistant"]
SYNTHETIC_MODEL = "<synthetic>"
UNKNOWN = "unknown"
_USAGE = (
    "struct<input_tokens string, output_tokens string, cache_read_input_tokens string,"
    " cache_creation struct<cache_creation_input_tokens string,"
    " ephemeral_5m_input_tokens string, ephemeral_1h_input_tokens string>>"
)
_ENTRY = (
    "struct<type string, timestamp string, sessionId string, uuid string, requestId string,"
    " cwd string, gitBranch string, version string,"
    " message struct<id string, model string, {content}usage " + _USAGE + ">>"
)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 instant, null when the text does not start with a full date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def whole_number(text: Column) -> Column:
    """A counter in any number form (``12``, ``12.0``, ``1e3``), cut to a whole number; else 0."""
    return F.coalesce(F.trim(text).try_cast("decimal(38,6)").try_cast("bigint"), F.lit(0))


def response_identity(
    message_type: Column, api_id: Column, request_id: Column, uuid: Column
) -> Column:
    """Identity of a billed response: API id and request id, else the entry's own id."""
    billed = (message_type == "assistant") & (F.coalesce(api_id, F.lit("")) != "")
    return F.when(
        billed, F.concat_ws(":", api_id, F.when(request_id != "", request_id))
    ).otherwise(F.coalesce(uuid, F.lit(UNKNOWN)))


def message_text(content: Column) -> Column:
    """Text of a message whose content is a string or a list of blocks; null without text."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        F.filter(
            blocks, lambda b: F.try_variant_get(b, "$.type", "string") == F.lit("text")
        ),
        lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")),
    )
    plain = F.schema_of_variant(content) == "STRING"
    return F.when(plain, F.try_variant_get(content, "$", "string")).when(
        F.size(texts) > 0, F.array_join(texts, "\n")
    )


def parse_transcripts(lines: DataFrame, tz: str = "UTC", content: bool = False) -> DataFrame:
    """Fact rows of user prompts and assistant responses.

    ``content`` adds the message text and its length; without it the text is not even read.
    Rows that cannot be read are dropped one by one and never take their file with them.
    """
    entries = json_rows(lines, _ENTRY.format(content="content variant, " if content else ""))
    kept = entries.withColumn("ts", iso_timestamp(F.col("j.timestamp"))).filter(
        F.col("j.type").isin(KEPT_TYPES)
        & F.col("ts").isNotNull()
        & (F.coalesce(F.col("j.message.model"), F.lit("")) != SYNTHETIC_MODEL)
    )
    billed = F.col("j.type") == "assistant"
    cache = "j.message.usage.cache_creation."

    def counter(*fields: str) -> Column:
        parts = [whole_number(F.col(f)) for f in fields]
        return F.when(billed, sum(parts[1:], parts[0])).otherwise(0).cast("bigint")

    def default(field: str) -> Column:
        return F.coalesce(F.col(field), F.lit(UNKNOWN))

    text = [message_text(F.col("j.message.content")).alias("content")] if content else []
    facts = kept.select(
        *[c for c in lines.columns if c != "value"],
        date_key(F.col("ts"), tz).alias("date"),
        "ts",
        default("j.sessionId").alias("session_id"),
        response_identity(
            F.col("j.type"), F.col("j.message.id"), F.col("j.requestId"), F.col("j.uuid")
        ).alias("message_uuid"),
        F.col("j.type").alias("message_type"),
        F.col("j.message.model").alias("model"),
        default("j.cwd").alias("folder"),
        F.col("j.gitBranch").alias("git_branch"),
        default("j.version").alias("version"),
        counter("j.message.usage.input_tokens").alias("input_tokens"),
        counter("j.message.usage.output_tokens").alias("output_tokens"),
        counter(
            cache + "cache_creation_input_tokens",
            cache + "ephemeral_5m_input_tokens",
            cache + "ephemeral_1h_input_tokens",
        ).alias("cache_creation_tokens"),
        counter(cache + "ephemeral_1h_input_tokens").alias("cache_creation_1h_tokens"),
        counter("j.message.usage.cache_read_input_tokens").alias("cache_read_tokens"),
        (billed & F.col("j.message.usage").isNotNull()).alias("has_usage"),
        *text,
    )
    facts = with_total(facts)
    if content:
        facts = facts.withColumn("char_count", F.coalesce(F.length("content"), F.lit(0)).cast("bigint"))
    return facts
