"""Ad-hoc SQL over a store."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from sparkmeter.session import SETTINGS
from sparkmeter.store.tables import SCHEMAS, Store

#: Tables that a reader of a store may ask for; the others are its bookkeeping.
SHOWN = ["usage", "daily", "limits", "manifest", "pricing", "sync_state", "usage_daily", "devices"]


def query_store(
    store: Store, text: str, params: Mapping[str, Any] | None = None, limit: int | None = None
) -> DataFrame:
    """The rows of a query over the tables of a store, by their names.

    ``params`` fill ``:name`` markers as values, never as text. The query runs in a session of its
    own, so its views meet no other ones, and as a subquery, so it can only read. ``limit`` bounds
    the rows that come back. Every table is as of one commit.
    """
    session = store.spark.newSession()
    for key, value in SETTINGS.items():
        session.conf.set(key, value)
    snapshot = Store(session, store.path).at(store.pointer())
    for name in SHOWN:
        snapshot.read(name).createOrReplaceTempView(name)
    bounded = f"SELECT * FROM (\n{text.rstrip().rstrip(';')}\n)"
    rows = session.sql(bounded, args=dict(params or {}))
    return rows if limit is None else rows.limit(limit)


def describe_store(store: Store) -> DataFrame:
    """Tables and columns that ``query_store`` knows, one row per column."""
    rows = [
        (name, f.name, f.dataType.simpleString()) for name in SHOWN for f in SCHEMAS[name].fields
    ]
    return store.spark.createDataFrame(rows, "table string, column string, type string")
