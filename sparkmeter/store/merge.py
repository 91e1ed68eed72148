"""Merges into catalog tables whose format supports MERGE."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from operator import and_
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Result = TypeVar("Result")
# Tries per commit; the waits between them are 1, 2, … seconds.
ATTEMPTS = 3


def retry_commit(
    commit: Callable[[], Result],
    conflict: type[Exception] | tuple[type[Exception], ...],
    attempts: int = ATTEMPTS,
    wait: Callable[[float], object] = time.sleep,
) -> Result:
    """Run a commit again while it loses to a concurrent one; other errors pass through."""
    for attempt in range(attempts - 1):
        try:
            return commit()
        except conflict:
            wait(2**attempt)
    return commit()


def merge_into(
    batch: DataFrame, table: str, keys: list[str], update_matched: bool = False
) -> None:
    """Merge a batch that is unique on ``keys`` into a catalog table.

    Parquet tables do not support this; there ``operators.upsert`` gives the merged rows.
    """
    target = table.rsplit(".", 1)[-1]
    same = reduce(
        and_, [F.col(f"{target}.{k}").eqNullSafe(F.col(f"batch_rows.{k}")) for k in keys]
    )
    merge = batch.alias("batch_rows").mergeInto(table, same)
    if update_matched:
        merge = merge.whenMatched().updateAll()
    merge.whenNotMatched().insertAll().merge()
