"""One row per billed response: largest usage wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.functions.predicates import is_response


def _best_first(tiebreak: list[str]) -> list[Column]:
    return [F.desc("total_tokens"), F.desc("ts"), *[F.col(c) for c in tiebreak]]


def dedupe_responses(df: DataFrame, tiebreak: list[str]) -> DataFrame:
    """Responses reduced to the one with most tokens per ``message_uuid``; prompts pass through.

    Ties go to the latest time, then to the first by ``tiebreak``. The rank-one filter is applied
    before the shuffle as well, so a repeated id sends one row per task, however often it occurs.
    """
    billed = is_response()
    order = Window.partitionBy("message_uuid").orderBy(*_best_first(tiebreak))
    best = (
        df.filter(billed)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )
    return df.filter(~billed | billed.isNull()).unionByName(best)


def scope() -> Column:
    """What makes a ``message_uuid`` unique: nothing more for responses, the session for prompts."""
    return F.when(is_response(), F.lit("r")).otherwise(
        F.concat(F.lit("s"), F.coalesce("session_id", F.lit("")))
    )


def batch_gate(staging: DataFrame, tiebreak: list[str]) -> DataFrame:
    """One row per response id, and per session and id of prompts; largest usage wins."""
    order = Window.partitionBy("message_uuid", "_scope").orderBy(*_best_first(tiebreak))
    return (
        staging.withColumn("_scope", scope())
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == 1)
        .drop("_rank", "_scope")
    )
