"""State carried along ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carry_forward(
    df: DataFrame,
    group: list[str],
    order: list[str],
    cols: list[str],
    chunk: str | None = None,
    count: tuple[str, Column] | None = None,
) -> DataFrame:
    """Replace each of ``cols`` by its last non-null value in order within ``group``.

    ``count`` = (name, condition) also adds a running count of the rows that meet a condition.

    With ``chunk`` (a column that never falls along the order) the rows of one group are split
    over tasks: each chunk carries locally, and the state at its start comes from a prefix over
    one summary row per chunk. Without it a group is ordered by one task.
    """
    if chunk is None:
        whole = _running(Window.partitionBy(*group).orderBy(*order))
        out = df.withColumns({c: F.last(c, ignorenulls=True).over(whole) for c in cols})
        if count:
            out = out.withColumn(count[0], F.count_if(count[1]).over(whole))
        return out

    keys = [*group, chunk]
    local = _running(Window.partitionBy(*keys).orderBy(*order))
    step = {c: F.last(c, ignorenulls=True).over(local) for c in cols}
    if count:
        step[count[0]] = F.count_if(count[1]).over(local)

    place = F.struct(*order)
    ends = [
        F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_end_{c}") for c in cols
    ]
    if count:
        ends.append(F.count_if(count[1]).alias("_end_n"))
    before = (
        Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        df.groupBy(*keys)
        .agg(*ends)
        .select(
            *keys,
            *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_start_{c}") for c in cols],
            *([F.sum("_end_n").over(before).alias("_start_n")] if count else []),
        )
    )
    out = df.withColumns(step).join(starts, keys, "left")
    fixed = {c: F.coalesce(F.col(c), F.col(f"_start_{c}")) for c in cols}
    if count:
        fixed[count[0]] = F.col(count[0]) + F.coalesce(F.col("_start_n"), F.lit(0))
    return out.withColumns(fixed).drop(*[f"_start_{c}" for c in cols], "_start_n")


def _running(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
