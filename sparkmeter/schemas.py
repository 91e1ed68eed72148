"""Table schemas and the helper that fits a DataFrame to one of them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def _table(columns: str) -> T.StructType:
    fields = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


#: Counters that add up to ``total_tokens``; the one-hour counter is part of cache_creation.
TOTAL_PARTS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]
COUNTERS = [
    "input_tokens",
    "output_tokens",
    "cache_creation_tokens",
    "cache_creation_1h_tokens",
    "cache_read_tokens",
]
DEVICE_COLUMNS = ["device_id", "device_name", "device_type"]
DAILY_MEASURES = ["prompts", "responses", "sessions", *TOTAL_PARTS, "total_tokens"]

USAGE = _table(
    "id bigint, date date, ts timestamp, session_id string, message_uuid string,"
    "message_type string, model string, folder string, git_branch string, version string,"
    "input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint,"
    "cache_creation_1h_tokens bigint, cache_read_tokens bigint, total_tokens bigint,"
    "device_id string, device_name string, device_type string, updated_seq bigint"
)
DAILY = _table(
    "date date, prompts bigint, responses bigint, sessions bigint, input_tokens bigint,"
    "output_tokens bigint, cache_creation_tokens bigint, cache_read_tokens bigint,"
    "total_tokens bigint, snapshot_ts timestamp,"
    "device_id string, device_name string, device_type string"
)
LIMITS = _table(
    "ts timestamp, date date, session_pct bigint, week_pct bigint, opus_pct bigint,"
    "session_reset string, week_reset string, opus_reset string,"
    "device_id string, device_name string, device_type string"
)
MANIFEST = _table(
    "file_path string, mtime_ns bigint, size_bytes bigint, record_count bigint, last_parsed timestamp"
)
LEDGER = _table(
    "file_path string, date date, prompts bigint, responses bigint, sessions bigint,"
    "input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint,"
    "cache_read_tokens bigint, total_tokens bigint"
)
PRICING = _table(
    "model_name string, input_price double, output_price double, cache_write_price double,"
    "cache_read_price double, cache_write_1h_price double, last_updated timestamp, notes string"
)
STATE = _table("key string, value string")
USAGE_DAILY = _table(
    "date date, device_id string, model string, folder string, git_branch string,"
    "records bigint, sessions bigint, input_tokens bigint, output_tokens bigint,"
    "cache_creation_tokens bigint, cache_creation_1h_tokens bigint, cache_read_tokens bigint,"
    "total_tokens bigint, last_updated timestamp"
)
DEVICES = _table(
    "device_id string, device_name string, device_type string, user_upn string,"
    "organization string, subscription string, last_push_at timestamp"
)
#: Days on which the facts may hold an id; a hint that the facts themselves confirm.
KEYS = _table("message_uuid string, date date, bucket bigint")
#: Largest id and number given on a day of a device; ``shrunk`` where rows were removed.
TOUCHED = _table("date date, device_id string, last_id bigint, seq bigint, shrunk boolean")
#: Number of each session, and the sessions of a slice of the facts as blocks of bits.
SESSIONS = _table("session_id string, session_no bigint")
SESSION_BITS = _table(
    "date date, device_id string, model string, folder string, block bigint, bits binary"
)
#: Names of batches that were applied.
BATCHES = _table("batch string")


def conform(
    df: DataFrame, schema: T.StructType, defaults: Mapping[str, Any] | None = None
) -> DataFrame:
    """Select exactly the columns of ``schema``: cast what exists, fill what is missing.

    Missing columns take their value from ``defaults`` and are null otherwise, which is how
    older tables without device columns or the one-hour counter are read.
    """
    defaults = defaults or {}
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(defaults.get(f.name)))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def with_total(df: DataFrame) -> DataFrame:
    """Add ``total_tokens``: input + output + cache creation + cache read."""
    total = sum((F.col(c) for c in TOTAL_PARTS[1:]), F.col(TOTAL_PARTS[0]))
    return df.withColumn("total_tokens", total)
