"""Text statistics over messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.functions.predicates import is_prompt, is_response
from sparkmeter.functions.text import (
    char_count,
    count_absolutely_right,
    count_perfect,
    count_please,
    count_profanity,
    count_thanks,
)


def text_stats(messages: DataFrame) -> DataFrame:
    """Counters over messages with content, as one row; zeros without messages.

    ``messages`` has message_type and content and holds each response once. Every counter only
    reads the texts of its own side.
    """
    text = F.col("content")

    def total(side: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(side, value)), F.lit(0)).cast("bigint")

    user, assistant = is_prompt(), is_response()
    return (
        messages.filter(text != "")
        .agg(
            total(user, count_profanity(text)).alias("user_profanity"),
            total(user, count_thanks(text)).alias("user_thanks"),
            total(user, count_please(text)).alias("user_please"),
            total(user, char_count(text)).alias("user_chars"),
            F.count_if(user).alias("user_prompts"),
            total(assistant, count_profanity(text)).alias("assistant_profanity"),
            total(assistant, count_perfect(text)).alias("perfect"),
            total(assistant, count_absolutely_right(text)).alias("absolutely_right"),
        )
        .withColumn(
            "avg_prompt_chars",
            F.bround(
                F.coalesce(
                    F.try_divide(F.col("user_chars").cast("double"), F.col("user_prompts")),
                    F.lit(0.0),
                ),
                0,
            ).cast("bigint"),
        )
    )
