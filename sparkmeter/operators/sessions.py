"""Distinct sessions that can be added up: bitmaps of numbered sessions.

A distinct count cannot be summed over days or models. Here every session has a number, and each slice of
the facts keeps the bits of its sessions in blocks of 32,768 numbers. The union of any slices is the
bitwise or of their blocks, so exact distinct counts for any days, devices, models or folders come
from the slices alone. Numbers follow the first day of a session, so a slice touches few blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.operators.ranking import global_row_number
from sparkmeter.operators.skew import spread_join

SLICE = ["date", "device_id", "model", "folder"]


def first_days(usage: DataFrame) -> DataFrame:
    """Each session and its first day."""
    return usage.filter("session_id IS NOT NULL").groupBy("session_id").agg(
        F.min("date").alias("first_date")
    )


def number_sessions(sessions: DataFrame, start: int = 0) -> DataFrame:
    """(session_id, session_no): numbers start, start + 1, … by first day, then by id."""
    order = [F.col("first_date"), F.col("session_id")]
    numbered = global_row_number(sessions, order, "session_no")
    return numbered.select(
        "session_id", (F.col("session_no") + F.lit(start - 1)).cast("bigint").alias("session_no")
    )


def session_bits(usage: DataFrame, numbers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The blocks of each slice: ``by``, block, bits.

    Equal rows collapse before the join, and a session with most rows is split by what it is
    sliced by.
    """
    by = by or SLICE
    slices = usage.filter("session_id IS NOT NULL").select("session_id", *by).distinct()
    placed = spread_join(slices, numbers, ["session_id"], by)
    number = F.col("session_no")
    return placed.groupBy(*by, F.bitmap_bucket_number(number).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def distinct_sessions(bits: DataFrame, by: list[str | Column] | None = None) -> DataFrame:
    """Distinct sessions of the union of slices, for each value of ``by`` or as one row."""
    by = by or []
    blocks = bits.groupBy(*by, "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    names = [c for c in blocks.columns if c not in ("block", "bits")]
    return blocks.groupBy(*names).agg(
        F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("sessions")
    )
