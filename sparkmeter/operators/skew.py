"""Joins of many rows with few keys, spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
    salts: int = 32,
) -> DataFrame:
    """Join ``rows`` with a ``lookup`` that is unique on ``keys``, when one key may hold most rows.

    Rows of one key are split by the hash of ``spread``; the lookup is repeated once per split.
    It is never broadcast: the planner's size check sees the lookup before it is repeated, and the
    copies of one that passes can still be more than the driver holds.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not a join that keeps rows of the left side once: {how}")
    split = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    every_salt = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    copies = lookup.withColumn("_salt", F.explode(every_salt))
    return split.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
