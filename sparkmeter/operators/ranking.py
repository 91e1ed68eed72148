"""Ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.session import settle

_ROW_BITS = (1 << 33) - 1
_PLACE = ["_part", "_place"]


def with_places(df: DataFrame) -> DataFrame:
    """Add the partition of each row and its place inside; to be written before it is used."""
    return df.withColumns(
        {
            "_part": F.spark_partition_id(),
            "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)),
        }
    )


def number_places(rows: DataFrame, placed: DataFrame, start: Column, name: str) -> DataFrame:
    """Number ``rows`` by their places in ``placed``, a written table they are taken from.

    Nothing is shuffled: a partition starts after the row counts of the ones before it. Rows of
    ``placed`` that are not in ``rows`` leave gaps.
    """
    # One row per partition of a written table: bounded for this window and for the broadcast.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn(name, (start + F.col("_start") + F.col("_place") + 1).cast("bigint"))
        .drop(*_PLACE, "_start")
    )


def global_row_number(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row number over all rows by ``order`` (which must be unique), as a parallel sort.

    A window without partitions would sort the table in one task. Here the rows are range
    partitioned, sorted and written with their places. The written copy keeps the sampled ranges
    fixed for both uses.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    fixed = settle(with_places(ranged), "ranked")
    return number_places(fixed, fixed, F.lit(0), name)
