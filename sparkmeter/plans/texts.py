"""Queries over message texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.functions import text
from sparkmeter.operators.messages import text_stats
from sparkmeter.plans.inputs import table
from sparkmeter.plans.registry import query

_SEEDED = (
    "concat(text, CASE turn % 4 WHEN 0 THEN ' Please help, pls! thanks'"
    " WHEN 1 THEN ' Perfect! You are absolutely right.' WHEN 2 THEN ' thx ty damn' ELSE '' END)"
)
_WHO = "CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END"


def _ascii(column: str) -> str:
    """Word characters outside ASCII as ``x``: the SQL engine's classes are ASCII only."""
    return f"regexp_replace(lower({column}), '[^\\x00-\\x7F]', 'x', 'g')"


def _count_sql(patterns: list[str], column: str = "plain") -> str:
    parts = [
        "len(regexp_extract_all({}, '{}'))".format(column, p.replace("'", "''")) for p in patterns
    ]
    return f"CAST({' + '.join(parts)} AS BIGINT)"


_MESSAGES = (
    f"(SELECT conv_id, turn, {_WHO} AS message_type, {_SEEDED} AS content,"
    f" {_ascii(_SEEDED)} AS plain FROM conversations)"
)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", f"{_WHO} AS message_type", f"{_SEEDED} AS content"
    )


def _counter(name: str, count, patterns: list[str]) -> None:
    sql = f"SELECT conv_id, turn, {_count_sql(patterns)} AS n FROM {_MESSAGES}"

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _messages(spark, sf).select("conv_id", "turn", count(F.col("content")).alias("n"))


_counter("count_profanity", text.count_profanity, text.PROFANITY)
_counter("count_perfect", text.count_perfect, text.PERFECT)
_counter("count_absolutely_right", text.count_absolutely_right, text.ABSOLUTELY_RIGHT)
_counter("count_thanks", text.count_thanks, text.THANKS)
_counter("count_please", text.count_please, text.PLEASE)


@query(
    "char_count",
    "SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN 0 ELSE length(text) END AS n"
    " FROM conversations",
)
def char_counts(spark: SparkSession, sf: str) -> DataFrame:
    content = F.when(F.col("turn") % 7 != 0, F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.char_count(content).alias("n")
    )


def _side(kind: str, value: str, name: str) -> str:
    return f"CAST(coalesce(sum({value}) FILTER (message_type = '{kind}'), 0) AS BIGINT) AS {name}"


@query(
    "text_stats",
    "SELECT "
    + ", ".join(
        [
            _side("user", _count_sql(text.PROFANITY), "user_profanity"),
            _side("user", _count_sql(text.THANKS), "user_thanks"),
            _side("user", _count_sql(text.PLEASE), "user_please"),
            _side("user", "length(content)", "user_chars"),
            "count(*) FILTER (message_type = 'user') AS user_prompts",
            _side("assistant", _count_sql(text.PROFANITY), "assistant_profanity"),
            _side("assistant", _count_sql(text.PERFECT), "perfect"),
            _side("assistant", _count_sql(text.ABSOLUTELY_RIGHT), "absolutely_right"),
            "CAST(round_even(avg(length(content)) FILTER (message_type = 'user'), 0) AS BIGINT)"
            " AS avg_prompt_chars",
        ]
    )
    + f" FROM {_MESSAGES} WHERE content <> ''",
)
def stats(spark: SparkSession, sf: str) -> DataFrame:
    return text_stats(_messages(spark, sf))
