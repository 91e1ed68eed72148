"""Row predicates and date keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_key(ts: Column, tz: str = "UTC") -> Column:
    """Calendar day of an instant in ``tz``; the session time zone must be UTC."""
    if tz == "UTC":
        return F.to_date(ts)
    return F.to_date(F.from_utc_timestamp(ts, tz))


def is_prompt(message_type: str | Column = "message_type") -> Column:
    return _col(message_type) == "user"


def is_response(message_type: str | Column = "message_type") -> Column:
    return _col(message_type) == "assistant"


def usage_present(df: DataFrame) -> Column:
    """Whether a row carries billed usage.

    Parsers and history reads set ``has_usage``; a plain fact table has only assistant rows
    that are billed.
    """
    return F.col("has_usage") if "has_usage" in df.columns else is_response()


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
