"""Facts derived from the given tables, once as DataFrames and once as SQL.

Both sides share one list of expressions, in which ``{S}`` is the text type and ``{K}`` the number
in the JSON column ``props``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators.rollup import daily_rollup
from sparkmeter.schemas import DAILY, DAILY_MEASURES, LIMITS, PRICING, USAGE, conform, with_total

NOW = dt.datetime(2024, 3, 1, 12, 0, 0)
TODAY = dt.date(2024, 1, 25)
TOTAL = "input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens"

_SPARK = {
    "S": "STRING",
    "K": "CAST(get_json_object(props, '$.k') AS BIGINT)",
}
_DUCKDB = {
    "S": "VARCHAR",
    "K": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
}

_BILLED = "CASE WHEN event_type = 'view' THEN 0 ELSE {} END"
EVENT_FACTS = {
    "id": "event_id",
    "date": "CAST(ts AS DATE)",
    "ts": "CAST(ts AS TIMESTAMP)",
    "session_id": "concat('s', CAST(user_id AS {S}), '-', CAST(extract(day FROM ts) % 10 AS {S}))",
    "message_uuid": "concat('m', CAST(event_id % 7500 AS {S}))",
    "message_type": "CASE WHEN event_type = 'view' THEN 'user' ELSE 'assistant' END",
    "model": "CASE event_type WHEN 'click' THEN 'model-a' WHEN 'purchase' THEN 'model-b'"
    " WHEN 'signup' THEN 'model-c' WHEN 'error' THEN 'model-unpriced' END",
    "folder": "concat('/work/team', CAST(user_id % 3 AS {S}), '/p', CAST(user_id % 25 AS {S}))",
    "git_branch": "CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('b', CAST(user_id % 5 AS {S})) END",
    "version": "'v1'",
    "input_tokens": _BILLED.format("CAST(floor(value * 10) AS BIGINT)"),
    "output_tokens": _BILLED.format("CAST(floor(value) AS BIGINT)"),
    "cache_creation_tokens": _BILLED.format("{K} * 3"),
    "cache_creation_1h_tokens": _BILLED.format("{K}"),
    "cache_read_tokens": _BILLED.format("{K} * 100"),
    "device_id": "concat('d', CAST(user_id % 4 AS {S}))",
    "device_name": "concat('Device ', CAST(user_id % 4 AS {S}))",
    "device_type": "CASE user_id % 4 WHEN 0 THEN 'macos' WHEN 1 THEN 'windows' ELSE 'linux' END",
}
LINE_FACTS = {
    "id": "l_orderkey * 10 + l_linenumber",
    "date": "CAST(l_shipdate AS DATE)",
    "ts": "CAST(l_shipdate AS TIMESTAMP)",
    "session_id": "CAST(l_orderkey AS {S})",
    "message_uuid": "concat(CAST(l_orderkey AS {S}), '-', CAST(l_linenumber AS {S}))",
    "message_type": "'assistant'",
    "model": "concat(l_returnflag, l_linestatus)",
    "folder": "concat('/lines/', CAST(l_partkey % 500 AS {S}))",
    "git_branch": "CAST(NULL AS {S})",
    "version": "'v2'",
    "input_tokens": "CAST(floor(l_extendedprice) AS BIGINT)",
    "output_tokens": "CAST(l_quantity AS BIGINT)",
    "cache_creation_tokens": "CAST(0 AS BIGINT)",
    "cache_creation_1h_tokens": "CAST(0 AS BIGINT)",
    "cache_read_tokens": "CAST(floor(l_extendedprice / 7) AS BIGINT)",
    "device_id": "concat('d', CAST(l_suppkey % 4 AS {S}))",
    "device_name": "concat('Device ', CAST(l_suppkey % 4 AS {S}))",
    "device_type": "'linux'",
}
PRICES = [
    ("model-a", 3.0, 15.0, 3.75, 0.3, 6.0),
    ("model-b", 15.0, 75.0, 18.75, 1.5, None),
    ("model-c", 1.0, 5.0, 1.25, 0.1, 2.0),
]


def fill(text: str, names: dict[str, str]) -> str:
    return text.replace("{S}", names["S"]).replace("{K}", names["K"])


def spark_columns(columns: dict[str, str]) -> list[str]:
    return [f"{fill(expr, _SPARK)} AS {name}" for name, expr in columns.items()]


def duckdb_columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{fill(expr, _DUCKDB)} AS {name}" for name, expr in columns.items())


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Facts from the events; ids repeat when there are more than 7,500 events."""
    events = table(spark, sf, "events").selectExpr(*spark_columns(EVENT_FACTS))
    return conform(with_total(events), USAGE)


def line_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Facts from the line items: seven years, with repeated ids."""
    lines = table(spark, sf, "lineitem").selectExpr(*spark_columns(LINE_FACTS))
    return conform(with_total(lines), USAGE)


def batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two batches of event facts; the second repeats some ids with doubled counters."""
    facts = usage(spark, sf)
    doubled = {
        c: F.col(c) * 2 for c in USAGE.names if c.endswith("_tokens")
    }
    return facts.filter("id % 10 < 6"), facts.filter("id % 10 >= 6").withColumns(doubled)


def pricing(spark: SparkSession) -> DataFrame:
    names = "model_name string, input_price double, output_price double, cache_write_price double,"
    rows = spark.createDataFrame(
        PRICES, names + "cache_read_price double, cache_write_1h_price double"
    )
    return conform(rows.withColumn("last_updated", now()), PRICING)


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_rollup(usage(spark, sf), now())


def line_daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_rollup(line_usage(spark, sf), now())


def limits(spark: SparkSession, sf: str) -> DataFrame:
    """Limit readings: the events of every 40th id on even days."""
    rows = table(spark, sf, "events").filter("event_id % 40 = 0 AND extract(day FROM ts) % 2 = 0")
    return conform(
        rows.selectExpr(
            "CAST(ts AS TIMESTAMP) AS ts",
            "CAST(ts AS DATE) AS date",
            "CAST(floor(value) AS BIGINT) % 101 AS session_pct",
            "event_id % 101 AS week_pct",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 51 END AS opus_pct",
            "concat('d', CAST(user_id % 4 AS STRING)) AS device_id",
        ),
        LIMITS,
    )


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts of the devices, from the first suppliers; d3 has none."""
    return table(spark, sf, "supplier").filter("s_suppkey <= 3").selectExpr(
        "concat('d', CAST(s_suppkey - 1 AS STRING)) AS device_id",
        "concat(lower(s_name), '@example.org') AS email",
        "concat('org', CAST(s_nationkey AS STRING)) AS organization",
        "CASE WHEN s_acctbal > 0 THEN 'max' ELSE 'pro' END AS subscription",
    )


def day(column: str = "date"):
    return F.col(column).cast("string").alias(column)


def moment(column: str = "ts"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


# --- the same as SQL -------------------------------------------------------------------------

def moment_sql(column: str = "ts", source: str | None = None) -> str:
    return f"strftime({source or column}, '%Y-%m-%d %H:%M:%S.%f') AS {column}"


def day_sql(column: str = "date", source: str | None = None) -> str:
    return f"CAST({source or column} AS VARCHAR) AS {column}"


_COUNTERS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_creation_1h_tokens",
             "cache_read_tokens", "total_tokens"]
SUMS_SQL = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in _COUNTERS)
MEASURES_SQL = (
    "CAST(count(*) FILTER (message_type = 'user') AS BIGINT) AS prompts,"
    " CAST(count(*) FILTER (message_type = 'assistant') AS BIGINT) AS responses,"
    " CAST(count(DISTINCT session_id) AS BIGINT) AS sessions, "
    + ", ".join(
        f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}"
        for c in _COUNTERS
        if c != "cache_creation_1h_tokens"
    )
)
_DOUBLED = ", ".join(f"{c} * 2 AS {c}" for c in _COUNTERS)
_BEST = "ORDER BY total_tokens DESC, ts DESC, id"
_SCOPE = "CASE WHEN message_type = 'assistant' THEN 'r' ELSE concat('s', session_id) END"
_PRICE_ROWS = ", ".join(
    "(" + ", ".join("CAST(NULL AS DOUBLE)" if v is None else repr(v) for v in row) + ")"
    for row in PRICES
)
_UPGRADED = ["ts", *_COUNTERS]

CTES = {
    "usage": f"SELECT *, {TOTAL} AS total_tokens FROM"
    f" (SELECT {duckdb_columns(EVENT_FACTS)} FROM events)",
    "line_usage": f"SELECT *, {TOTAL} AS total_tokens FROM"
    f" (SELECT {duckdb_columns(LINE_FACTS)} FROM lineitem)",
    "price": f"SELECT * FROM (VALUES {_PRICE_ROWS}) AS v(model_name, input_price, output_price,"
    " cache_write_price, cache_read_price, cache_write_1h_price)",
    "daily": f"SELECT date, {MEASURES_SQL} FROM usage GROUP BY date",
    "line_daily": f"SELECT date, {MEASURES_SQL} FROM line_usage GROUP BY date",
    "limits": "SELECT CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS date,"
    " CAST(floor(value) AS BIGINT) % 101 AS session_pct, event_id % 101 AS week_pct,"
    " CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 51 END AS opus_pct,"
    " concat('d', CAST(user_id % 4 AS VARCHAR)) AS device_id"
    " FROM events WHERE event_id % 40 = 0 AND extract(day FROM ts) % 2 = 0",
    "accounts": "SELECT concat('d', CAST(s_suppkey - 1 AS VARCHAR)) AS device_id,"
    " concat(lower(s_name), '@example.org') AS email,"
    " concat('org', CAST(s_nationkey AS VARCHAR)) AS organization,"
    " CASE WHEN s_acctbal > 0 THEN 'max' ELSE 'pro' END AS subscription"
    " FROM supplier WHERE s_suppkey <= 3",
    "batch1": "SELECT * FROM usage WHERE id % 10 < 6",
    "batch2": f"SELECT * REPLACE ({_DOUBLED}) FROM usage WHERE id % 10 >= 6",
    "gated1": f"SELECT * FROM batch1 QUALIFY row_number() OVER"
    f" (PARTITION BY message_uuid, {_SCOPE} {_BEST}) = 1",
    "gated2": f"SELECT * FROM batch2 QUALIFY row_number() OVER"
    f" (PARTITION BY message_uuid, {_SCOPE} {_BEST}) = 1",
    "upgraded": "SELECT u.* REPLACE ("
    + ", ".join(
        f"CASE WHEN b.total_tokens > u.total_tokens THEN b.{c} ELSE u.{c} END AS {c}"
        for c in _UPGRADED
    )
    + ") FROM gated1 u LEFT JOIN gated2 b ON u.message_type = 'assistant'"
    " AND b.message_type = 'assistant' AND u.message_uuid = b.message_uuid",
    "added": "SELECT s.* FROM gated2 s WHERE NOT EXISTS (SELECT 1 FROM gated1 u WHERE"
    " u.message_uuid = s.message_uuid AND (s.message_type = 'assistant'"
    " OR u.session_id = s.session_id))",
    "saved": "SELECT * FROM upgraded UNION ALL SELECT * FROM added",
    "deduped": f"SELECT * FROM usage WHERE message_type = 'user' UNION ALL"
    f" (SELECT * FROM usage WHERE message_type = 'assistant' QUALIFY row_number() OVER"
    f" (PARTITION BY message_uuid {_BEST}) = 1)",
}
_NEEDS = {
    "daily": ["usage"],
    "line_daily": ["line_usage"],
    "batch1": ["usage"],
    "batch2": ["usage"],
    "gated1": ["batch1"],
    "gated2": ["batch2"],
    "upgraded": ["gated1", "gated2"],
    "added": ["gated1", "gated2"],
    "saved": ["upgraded", "added"],
    "deduped": ["usage"],
}


def with_ctes(names: str, body: str, **more: str) -> str:
    """A statement over the named derived tables; ``more`` adds tables of its own, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


__all__ = [
    "CTES", "DAILY", "DAILY_MEASURES", "MEASURES_SQL", "NOW", "SUMS_SQL", "TODAY", "accounts",
    "batches", "daily", "day", "day_sql", "limits", "line_daily", "line_usage", "moment",
    "moment_sql", "now", "pricing", "table", "usage", "with_ctes",
]
