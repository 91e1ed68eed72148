"""Queries over day spines, the year grid and project aliases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators import calendar
from sparkmeter.operators.anonymise import anonymise_projects, project_aliases
from sparkmeter.operators.carry import carry_forward
from sparkmeter.plans.inputs import (
    TODAY,
    daily,
    day,
    day_sql,
    limits,
    line_daily,
    line_usage,
    now,
    table,
    usage,
    with_ctes,
)
from sparkmeter.plans.registry import query
from sparkmeter.schemas import DAILY_MEASURES

YEAR = 1998
YEAR_TODAY = dt.date(1998, 9, 10)

_SPINE = (
    "SELECT CAST(unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY)) AS DATE) AS date"
)
_ZEROS = ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in DAILY_MEASURES)


@query(
    "fill_gaps",
    with_ctes(
        "usage daily",
        f"SELECT {day_sql()}, {_ZEROS} FROM spine LEFT JOIN"
        " (SELECT * FROM daily WHERE day(date) % 4 <> 0) USING (date) UNION ALL"
        f" SELECT {day_sql()}, {_ZEROS} FROM daily WHERE day(date) % 4 <> 0 AND date NOT IN"
        " (SELECT date FROM spine)",
        spine=_SPINE.format(a="2023-12-25", b="2024-01-25"),
    ),
)
def fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    # Days without a row come from leaving every fourth day out of the facts.
    gappy = daily(spark, sf).filter("day(date) % 4 <> 0")
    filled = calendar.fill_gaps(gappy, dt.date(2023, 12, 25), TODAY, now())
    return filled.select(day(), *DAILY_MEASURES)


@query(
    "date_spine",
    with_ctes(
        "usage daily",
        f"SELECT {day_sql()}, CAST(coalesce(total_tokens, 0) AS BIGINT) AS tokens"
        " FROM spine LEFT JOIN daily USING (date)",
        spine=_SPINE.format(a="2023-01-26", b="2024-01-25"),
    ),
)
def date_spine(spark: SparkSession, sf: str) -> DataFrame:
    days = daily(spark, sf)
    spine = calendar.date_spine(days, TODAY)
    return spine.join(days, "date", "left").select(
        day(), F.coalesce("total_tokens", F.lit(0)).alias("tokens")
    )


_RANKED = (
    "SELECT folder, row_number() OVER (ORDER BY sum(total_tokens) DESC, folder) AS rank"
    " FROM line_usage GROUP BY folder"
)


@query(
    "anonymise_projects",
    with_ctes(
        "line_usage",
        "SELECT concat('project-', lpad(CAST(rank AS VARCHAR), 3, '0')) AS folder,"
        f" count(*) AS records, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM line_usage"
        f" JOIN ({_RANKED}) r USING (folder) GROUP BY rank",
    ),
)
def anonymised(spark: SparkSession, sf: str) -> DataFrame:
    return anonymise_projects(line_usage(spark, sf)).groupBy("folder").agg(
        F.count("*").alias("records"), F.sum("total_tokens").alias("tokens")
    )


@query(
    "project_aliases",
    with_ctes(
        "usage",
        "SELECT folder, row_number() OVER (ORDER BY sum(total_tokens) DESC, folder) AS rank,"
        " printf('project-%03d', row_number() OVER (ORDER BY sum(total_tokens) DESC, folder))"
        " AS alias FROM usage WHERE message_type = 'assistant' GROUP BY folder",
    ),
)
def aliases(spark: SparkSession, sf: str) -> DataFrame:
    return project_aliases(usage(spark, sf))


_CELLS = (
    "SELECT date, CAST((dayofyear(date) - 1 + dayofweek(DATE '1998-01-01')) // 7 AS BIGINT) AS week,"
    " CAST(dayofweek(date) AS BIGINT) AS weekday, CASE WHEN date > DATE '1998-09-10' THEN 'future'"
    " WHEN coalesce(total_tokens, 0) = 0 THEN 'none' ELSE 'active' END AS state,"
    " CAST(coalesce(prompts, 0) AS BIGINT) AS prompts,"
    " CAST(coalesce(total_tokens, 0) AS BIGINT) AS tokens,"
    " (SELECT CAST(max(total_tokens) AS BIGINT) FROM gappy) AS max_tokens FROM ("
    + _SPINE.format(a="1998-01-01", b="1998-12-31")
    + ") LEFT JOIN gappy USING (date)"
)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    # Every sixth day of the year shown has no row; the largest day is over all years.
    gappy = line_daily(spark, sf).filter("day(date) % 6 <> 0 OR year(date) <> 1998")
    return calendar.calendar_cells(gappy, YEAR, YEAR_TODAY)


_GAPPY = "SELECT * FROM line_daily WHERE day(date) % 6 <> 0 OR year(date) <> 1998"


def _cell_sql(body: str) -> str:
    return with_ctes("line_daily", body, gappy=_GAPPY, cells=_CELLS)


@query("calendar_cells", _cell_sql("SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM cells"))
def calendar_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).withColumn("date", day())


@query(
    "heat_intensity",
    _cell_sql(
        f"SELECT {day_sql()}, CASE state WHEN 'future' THEN '#6B6B68' WHEN 'none' THEN '#3C3C3A'"
        " ELSE printf('rgb(%d,%d,%d)', CAST(floor(60 + 143 * r) AS BIGINT),"
        " CAST(floor(60 + 63 * r) AS BIGINT), CAST(floor(58 + 35 * r) AS BIGINT)) END AS colour"
        " FROM (SELECT *, sqrt(CAST(tokens AS DOUBLE) / max_tokens) AS r FROM cells)"
    ),
)
def heat_intensity(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.heat_intensity(_cells(spark, sf)).select(day(), "colour")


@query(
    "cell_tooltip",
    _cell_sql(
        f"SELECT {day_sql()}, CASE WHEN tokens > 0 THEN format('{{}}: {{}} prompts, {{:,}} tokens',"
        " CAST(date AS VARCHAR), prompts, tokens) WHEN state = 'future' THEN"
        " concat(CAST(date AS VARCHAR), ': Future') ELSE concat(CAST(date AS VARCHAR),"
        " ': No activity') END AS tooltip FROM cells"
    ),
)
def cell_tooltip(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.cell_tooltip(_cells(spark, sf)).select(day(), "tooltip")


@query(
    "month_labels",
    _cell_sql(
        "SELECT week, strftime(date, '%b') AS label FROM (SELECT *, lag(month(date)) OVER"
        " (ORDER BY week) AS before FROM (SELECT week, min(date) AS date FROM cells GROUP BY week))"
        " WHERE before IS NULL OR before <> month(date)"
    ),
)
def month_labels(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.month_labels(_cells(spark, sf))


@query(
    "week_strip",
    with_ctes(
        "usage daily",
        "SELECT CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS week_start,"
        " string_agg(CASE WHEN coalesce(total_tokens, 0) = 0 THEN '.' ELSE"
        " substr('.:*#@', CAST(least(4, floor(sqrt(CAST(total_tokens AS DOUBLE) / m) * 5)) AS INT)"
        " + 1, 1) END, '' ORDER BY date) AS strip FROM spine LEFT JOIN daily USING (date),"
        " (SELECT CAST(max(total_tokens) AS DOUBLE) AS m FROM daily) GROUP BY 1",
        spine=_SPINE.format(a="2023-10-30", b="2024-01-28"),
    ),
)
def week_strip(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.week_strip(daily(spark, sf), TODAY).withColumn("week_start", day("week_start"))


@query(
    "carry_forward",
    "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS)"
    " OVER w AS known, CAST(count(*) FILTER (event_type = 'click') OVER w AS BIGINT) AS clicks"
    " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id"
    " ROWS UNBOUNDED PRECEDING)",
)
def carried(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.expr("event_id DIV 700").alias("chunk"),
        F.expr("CASE WHEN event_type = 'signup' THEN value END").alias("known"),
        (F.col("event_type") == "click").alias("click"),
    )
    out = carry_forward(
        rows, ["user_id"], ["event_id"], ["known"], chunk="chunk", count=("clicks", F.col("click"))
    )
    return out.select("event_id", "known", "clicks")


_PCTS = ["session_pct", "week_pct", "opus_pct"]


@query(
    "fill_limits",
    with_ctes(
        "limits",
        f"SELECT device_id, {day_sql()}, "
        + ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in _PCTS)
        + " FROM spine LEFT JOIN known USING (device_id, date)"
        " WINDOW w AS (PARTITION BY device_id ORDER BY date ROWS UNBOUNDED PRECEDING)",
        known="SELECT device_id, date, "
        + ", ".join(f"max({c}) AS {c}" for c in _PCTS)
        + " FROM limits GROUP BY ALL",
        spine="SELECT device_id, CAST(unnest(generate_series(min(date), greatest(max(date),"
        " DATE '2024-02-10'), INTERVAL 1 DAY)) AS DATE) AS date FROM known GROUP BY device_id",
    ),
)
def fill_limits(spark: SparkSession, sf: str) -> DataFrame:
    return calendar.fill_limits(limits(spark, sf), dt.date(2024, 2, 10)).withColumn("date", day())
