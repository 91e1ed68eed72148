"""Keyed merge of a batch into a table, and dense row ids."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two aliased frames, usable as an equi-join."""
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def without_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys do not occur in ``other``."""
    return df.alias("l").join(other.select(*keys).alias("r"), same_keys("l", "r", keys), "left_anti")


def with_keys(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys occur in ``other``; null keys do not."""
    return df.join(other.select(*keys), keys, "left_semi")


def upsert(
    target: DataFrame, batch: DataFrame, keys: list[str], update_matched: bool = False
) -> DataFrame:
    """The table after merging a batch that is unique on ``keys``.

    Matched rows are replaced when ``update_matched`` is set and kept otherwise; unmatched batch
    rows are added.
    """
    if update_matched:
        kept, added = without_keys(target, batch, keys), batch
    else:
        kept, added = target, without_keys(batch, target, keys)
    return kept.unionByName(added, allowMissingColumns=True)


def inserted_rows(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch rows a merge would add."""
    return without_keys(batch, target, keys)


def assign_ids(
    df: DataFrame, keys: list[str], start: Column, name: str = "id", buckets: int = 1024
) -> DataFrame:
    """Number the rows start + 1, start + 2, … without one task seeing them all.

    Rows fall into buckets by the hash of ``keys`` (unique, so buckets are even); each bucket is
    numbered on its own and starts after the rows of the buckets before it. The same rows always
    get the same numbers.
    """
    placed = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    # One row per bucket: bounded for this window without partitions and for the broadcast.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    numbered = placed.withColumn("_row", F.row_number().over(inside)).join(
        F.broadcast(starts), "_bucket"
    )
    return numbered.withColumn(
        name, (F.coalesce(start, F.lit(0)) + F.col("_start") + F.col("_row")).cast("bigint")
    ).drop("_bucket", "_row", "_start")
