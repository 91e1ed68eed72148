"""Queries over statistics, shares and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators import cost, metrics
from sparkmeter.operators.dedupe import dedupe_responses
from sparkmeter.operators.rollup import (
    daily_rollup,
    file_contribution,
    recompute_daily,
    refresh_daily,
)
from sparkmeter.plans.inputs import (
    MEASURES_SQL,
    SUMS_SQL,
    accounts,
    daily,
    day,
    day_sql,
    line_daily,
    line_usage,
    moment,
    now,
    pricing,
    usage,
    with_ctes,
)
from sparkmeter.plans.registry import query
from sparkmeter.schemas import DAILY_MEASURES

_COUNTS_SQL = (
    "CAST(count(*) FILTER (message_type = 'user') AS BIGINT) AS prompts,"
    " CAST(count(*) FILTER (message_type = 'assistant') AS BIGINT) AS responses,"
    f" {SUMS_SQL}, count(DISTINCT session_id) AS sessions, count(DISTINCT model) AS models,"
    " count(DISTINCT folder) AS folders"
)


@query("daily_stats", with_ctes("usage", f"SELECT {day_sql()}, {_COUNTS_SQL} FROM usage GROUP BY date"))
def daily_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.daily_stats(usage(spark, sf)).withColumn("date", day())


@query("overall_stats", with_ctes("usage", f"SELECT 'all' AS date_key, {_COUNTS_SQL} FROM usage"))
def overall_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.overall_stats(usage(spark, sf))


@query(
    "daily_and_overall",
    with_ctes(
        "line_usage",
        f"SELECT coalesce(CAST(date AS VARCHAR), 'all') AS date_key, {_COUNTS_SQL} FROM line_usage"
        " GROUP BY GROUPING SETS ((date), ())",
    ),
)
def daily_and_overall(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.daily_and_overall(line_usage(spark, sf))


@query(
    "daily_members",
    with_ctes(
        "usage",
        f"SELECT DISTINCT {day_sql()}, 'model' AS kind, model AS member FROM usage"
        " WHERE model IS NOT NULL UNION ALL"
        f" SELECT DISTINCT {day_sql()}, 'folder', folder FROM usage",
    ),
)
def daily_members(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.daily_members(usage(spark, sf)).withColumn("date", day())


@query(
    "refresh_daily",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, {MEASURES_SQL} FROM usage WHERE day(date) % 3 = 0 GROUP BY date"
        f" UNION ALL SELECT {day_sql()}, {MEASURES_SQL} FROM usage"
        " WHERE id % 2 = 0 AND day(date) % 3 <> 0 GROUP BY date",
    ),
)
def refreshed(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    old = daily_rollup(facts.filter("id % 2 = 0"), now())
    touched = facts.filter("day(date) % 3 = 0").select("date").distinct()
    return refresh_daily(facts, old, touched, now()).select(day(), *DAILY_MEASURES)


@query(
    "recompute_daily",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, {MEASURES_SQL} FROM usage WHERE day(date) % 5 <> 0 GROUP BY date",
    ),
)
def recomputed(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    old = daily_rollup(facts, now())
    touched = facts.filter("day(date) % 5 = 0 OR day(date) % 3 = 0").select("date").distinct()
    left = facts.filter("day(date) % 5 <> 0")
    return recompute_daily(left, old, touched, now()).select(day(), *DAILY_MEASURES)


@query(
    "coverage",
    with_ctes(
        "line_usage",
        "SELECT count(*) AS total_records, CAST(min(date) AS VARCHAR) AS oldest_date,"
        " CAST(max(date) AS VARCHAR) AS newest_date FROM line_usage",
    ),
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.coverage(line_usage(spark, sf)).withColumns(
        {c: day(c) for c in ("oldest_date", "newest_date")}
    )


@query(
    "store_stats",
    with_ctes(
        "usage daily",
        "SELECT (SELECT count(*) FROM usage) AS total_records,"
        " (SELECT count(DISTINCT date) FROM usage) AS total_days,"
        " (SELECT CAST(min(date) AS VARCHAR) FROM usage) AS oldest_date,"
        " (SELECT CAST(max(date) AS VARCHAR) FROM usage) AS newest_date,"
        " '2024-03-01 12:00:00.000000' AS newest_timestamp,"
        " CAST(sum(total_tokens) AS BIGINT) AS total_tokens,"
        " CAST(sum(prompts) AS BIGINT) AS total_prompts,"
        " CAST(sum(responses) AS BIGINT) AS total_responses,"
        " CAST(sum(sessions) AS BIGINT) AS sessions_daily_sum FROM daily",
    ),
)
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.store_stats(usage(spark, sf), daily(spark, sf)).withColumns(
        {
            "oldest_date": day("oldest_date"),
            "newest_date": day("newest_date"),
            "newest_timestamp": moment("newest_timestamp"),
        }
    )


@query(
    "store_stats_distinct",
    with_ctes(
        "usage",
        "SELECT count(*) AS total_records, count(DISTINCT date) AS total_days,"
        " CAST(min(date) AS VARCHAR) AS oldest_date, CAST(max(date) AS VARCHAR) AS newest_date,"
        " strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS newest_timestamp,"
        " CAST(sum(total_tokens) AS BIGINT) AS total_tokens,"
        " CAST(count(*) FILTER (message_type = 'user') AS BIGINT) AS total_prompts,"
        " CAST(count(*) FILTER (message_type = 'assistant') AS BIGINT) AS total_responses,"
        " count(DISTINCT session_id) AS sessions_distinct FROM usage",
    ),
)
def store_stats_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.store_stats_distinct(usage(spark, sf)).withColumns(
        {
            "oldest_date": day("oldest_date"),
            "newest_date": day("newest_date"),
            "newest_timestamp": moment("newest_timestamp"),
        }
    )


@query(
    "session_counts",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, CAST(sum(n) AS BIGINT) AS sessions_file_sum FROM (SELECT date,"
        " id % 20 AS f, count(DISTINCT session_id) AS n FROM usage GROUP BY ALL) GROUP BY date",
    ),
)
def session_counts(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf).withColumn("file_path", F.expr("concat('f', id % 20)"))
    return metrics.file_sessions(file_contribution(facts)).withColumn("date", day())


@query(
    "tokens_by_model",
    with_ctes(
        "usage",
        "SELECT model, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage"
        " WHERE model IS NOT NULL GROUP BY model",
    ),
)
def tokens_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.tokens_by_model(usage(spark, sf))


_COST = (
    "i / 1000000 * coalesce(input_price, 0) + o / 1000000 * coalesce(output_price, 0)"
    " + (w - h) / 1000000 * coalesce(cache_write_price, 0)"
    " + h / 1000000 * coalesce(cache_write_1h_price, cache_write_price * 1.6, 0)"
    " + r / 1000000 * coalesce(cache_read_price, 0)"
)
_COST_ROWS = (
    "SELECT model, i AS input_tokens, o AS output_tokens, w AS cache_creation_tokens,"
    " h AS cache_creation_1h_tokens, r AS cache_read_tokens,"
    f" {_COST} AS cost, input_price IS NOT NULL AS priced FROM ("
    " SELECT model, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o,"
    " CAST(sum(cache_creation_tokens) AS BIGINT) AS w,"
    " CAST(sum(cache_creation_1h_tokens) AS BIGINT) AS h,"
    " CAST(sum(cache_read_tokens) AS BIGINT) AS r FROM deduped WHERE model IS NOT NULL"
    " GROUP BY model) LEFT JOIN price ON model = model_name"
)


def _deduped(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe_responses(usage(spark, sf), ["id"])


@query(
    "cost_by_model",
    with_ctes("deduped price", f"SELECT * REPLACE (round(cost, 8) AS cost) FROM ({_COST_ROWS})"),
)
def cost_by_model(spark: SparkSession, sf: str) -> DataFrame:
    rows = cost.cost_by_model(_deduped(spark, sf), pricing(spark))
    return rows.withColumn("cost", F.round("cost", 8))


@query(
    "total_cost",
    with_ctes("deduped price", f"SELECT round(sum(cost), 8) AS total_cost FROM ({_COST_ROWS})"),
)
def total_cost(spark: SparkSession, sf: str) -> DataFrame:
    return cost.total_cost(_deduped(spark, sf), pricing(spark)).select(
        F.round("total_cost", 8).alias("total_cost")
    )


@query(
    "usage_averages",
    with_ctes(
        "deduped price",
        "SELECT CAST(round_even(t / s, 0) AS BIGINT) AS avg_tokens_per_session,"
        " CAST(round_even(t / r, 0) AS BIGINT) AS avg_tokens_per_response,"
        " round_even(c / s, 2) AS avg_cost_per_session, round_even(c / r, 4) AS"
        " avg_cost_per_response FROM (SELECT CAST(sum(total_tokens) AS DOUBLE) AS t,"
        " count(DISTINCT session_id) AS s, count(*) FILTER (message_type = 'assistant') AS r"
        f" FROM deduped), (SELECT sum(cost) AS c FROM ({_COST_ROWS}))",
    ),
)
def usage_averages(spark: SparkSession, sf: str) -> DataFrame:
    facts = _deduped(spark, sf)
    money = cost.total_cost(facts, pricing(spark)).scalar()
    totals = metrics.store_stats_distinct(facts).select(
        "total_tokens",
        F.col("sessions_distinct").alias("sessions"),
        F.col("total_responses").alias("responses"),
        money.alias("total_cost"),
    )
    return cost.usage_averages(totals)


@query(
    "months_covered",
    with_ctes(
        "line_usage",
        "SELECT folder, CAST((year(b) - year(a)) * 12 + month(b) - month(a) + 1 AS BIGINT)"
        " AS months FROM (SELECT folder, min(date) AS a, max(date) AS b FROM line_usage"
        " GROUP BY folder)",
    ),
)
def months_covered(spark: SparkSession, sf: str) -> DataFrame:
    bounds = line_usage(spark, sf).groupBy("folder").agg(
        F.min("date").alias("a"), F.max("date").alias("b")
    )
    return bounds.select("folder", cost.months_covered(F.col("a"), F.col("b")).alias("months"))


_PLAN = (
    "SELECT round(c, 8) AS total_cost, m AS months, m * {fee} AS plan_cost,"
    " CASE WHEN c > m * {fee} THEN round(c - m * {fee}, 8) END AS saved,"
    " CASE WHEN c <= m * {fee} THEN round(abs(c - m * {fee}), 8) END AS overpaid FROM (SELECT"
    " (year(max(date)) - year(min(date))) * 12 + month(max(date)) - month(min(date)) + 1 AS m"
    " FROM deduped), (SELECT sum(cost) AS c FROM (" + _COST_ROWS + "))"
)


@query(
    "plan_vs_api",
    with_ctes("deduped price", f"{_PLAN.format(fee='200.0')} UNION ALL {_PLAN.format(fee='0.5')}"),
)
def plan_vs_api(spark: SparkSession, sf: str) -> DataFrame:
    facts = _deduped(spark, sf)
    money = cost.total_cost(facts, pricing(spark)).scalar()
    totals = metrics.coverage(facts).withColumn("total_cost", money)
    both = cost.plan_vs_api(totals).unionByName(cost.plan_vs_api(totals, fee=0.5))
    return both.withColumns({c: F.round(c, 8) for c in ("total_cost", "saved", "overpaid")})


@query(
    "model_share",
    with_ctes(
        "usage",
        "SELECT model, tokens, round(tokens / sum(tokens) OVER () * 100, 6) AS share,"
        " CAST(floor(tokens / max(tokens) OVER () * 20) AS BIGINT) AS filled, model AS label"
        " FROM (SELECT model, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage"
        " WHERE model IS NOT NULL GROUP BY model)",
    ),
)
def model_share(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.model_share(usage(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    "model_share_of_daily",
    with_ctes(
        "usage daily",
        "SELECT model, tokens, round(CAST(tokens AS DOUBLE) / (SELECT sum(total_tokens) FROM daily)"
        " * 100, 6) AS share FROM (SELECT model, CAST(sum(total_tokens) AS BIGINT) AS tokens"
        " FROM usage WHERE model IS NOT NULL AND id % 2 = 0 GROUP BY model)",
    ),
)
def model_share_of_daily(spark: SparkSession, sf: str) -> DataFrame:
    total = daily(spark, sf).agg(F.sum("total_tokens")).scalar()
    shares = metrics.model_share(usage(spark, sf).filter("id % 2 = 0"), total)
    return shares.select("model", "tokens", F.round("share", 6).alias("share"))


_BY_FOLDER = (
    "SELECT folder, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM {facts}"
    " WHERE message_type = 'assistant' GROUP BY folder"
)
_TOP_FOLDERS = (
    "SELECT folder, tokens, round(CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM f) * 100, 6)"
    " AS share{more} FROM (SELECT * FROM f ORDER BY tokens DESC, folder LIMIT {n})"
)


@query(
    "project_breakdown",
    with_ctes(
        "line_usage",
        _TOP_FOLDERS.format(
            n=10,
            more=", CAST(floor(tokens / max(tokens) OVER () * 20) AS BIGINT) AS filled,"
            " concat(string_split(folder, '/')[-2], '/', string_split(folder, '/')[-1]) AS label",
        ),
        f=_BY_FOLDER.format(facts="line_usage"),
    ),
)
def project_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.project_breakdown(line_usage(spark, sf))
    return rows.withColumn("share", F.round("share", 6))


@query(
    "top_models",
    with_ctes(
        "line_usage",
        "SELECT model, tokens, round(CAST(tokens AS DOUBLE) / (SELECT sum(tokens) FROM f) * 100, 6)"
        " AS share, model AS label FROM (SELECT * FROM f ORDER BY tokens DESC, model LIMIT 5)",
        f="SELECT model, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM line_usage GROUP BY model",
    ),
)
def top_models(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_models(line_usage(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    "top_projects",
    with_ctes(
        "usage",
        _TOP_FOLDERS.format(
            n=5,
            more=", concat(string_split(folder, '/')[-2], '/', string_split(folder, '/')[-1])"
            " AS label",
        ),
        f=_BY_FOLDER.format(facts="usage"),
    ),
)
def top_projects(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_projects(usage(spark, sf)).withColumn("share", F.round("share", 6))


@query(
    "kpis",
    with_ctes(
        "usage",
        "SELECT CAST(sum(total_tokens) AS BIGINT) AS tokens,"
        " CAST(count(*) FILTER (message_type = 'user') AS BIGINT) AS prompts,"
        " count(DISTINCT session_id) AS sessions, count(DISTINCT date) AS active_days FROM usage",
    ),
)
def kpis(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.kpis(usage(spark, sf))


@query(
    "rollup_kpis",
    with_ctes(
        "line_daily",
        "SELECT CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(sum(prompts) AS BIGINT) AS prompts,"
        " CAST(sum(sessions) AS BIGINT) AS sessions_daily_sum, count(*) AS active_days"
        " FROM line_daily",
    ),
)
def rollup_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rollup_kpis(line_daily(spark, sf))


@query(
    "date_bounds",
    with_ctes(
        "line_usage",
        "SELECT CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date"
        " FROM line_usage",
    ),
)
def date_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.date_bounds(line_usage(spark, sf)).withColumns(
        {c: day(c) for c in ("first_date", "last_date")}
    )


LAKE_SQL = (
    "SELECT date, device_id, coalesce(model, '<none>') AS model, coalesce(folder, '') AS folder,"
    " coalesce(git_branch, '') AS git_branch, count(*) AS records,"
    " count(DISTINCT session_id) AS sessions, " + SUMS_SQL + " FROM usage GROUP BY 1, 2, 3, 4, 5"
)


@query(
    "usage_daily",
    with_ctes("usage", f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({LAKE_SQL})"),
)
def usage_daily(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.usage_daily(usage(spark, sf), now()).withColumn("date", day()).drop(
        "last_updated"
    )


@query(
    "devices_dim",
    with_ctes(
        "usage accounts",
        "SELECT u.*, a.email AS user_upn, a.organization, a.subscription FROM (SELECT DISTINCT"
        " device_id, device_name, device_type FROM usage) u LEFT JOIN accounts a USING (device_id)",
    ),
)
def devices_dim(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.devices_dim(usage(spark, sf), accounts(spark, sf), now()).drop("last_push_at")


_MEASURES = (
    "CAST(sum(total_tokens) AS BIGINT) AS total_tokens,"
    " CAST(sum(input_tokens) AS BIGINT) AS uncached_input_tokens,"
    " CAST(sum(output_tokens) AS BIGINT) AS output_tokens,"
    " CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_write_tokens,"
    " CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,"
    " round(sum(cache_read_tokens) / nullif(sum(total_tokens), 0), 6) AS cache_read_ratio,"
    " round(sum(CASE WHEN input_price IS NOT NULL THEN input_tokens / 1000000 * input_price"
    " + output_tokens / 1000000 * output_price"
    " + (cache_creation_tokens - cache_creation_1h_tokens) / 1000000 * cache_write_price"
    " + cache_creation_1h_tokens / 1000000 * coalesce(cache_write_1h_price, 0)"
    " + cache_read_tokens / 1000000 * cache_read_price END), 8) AS est_api_cost,"
    " CAST(sum(sessions) AS BIGINT) AS total_sessions,"
    " count(DISTINCT device_id) AS active_devices"
)


def _measures(spark: SparkSession, sf: str, by: list[str]) -> DataFrame:
    facts = metrics.usage_daily(usage(spark, sf), now())
    dim = metrics.devices_dim(usage(spark, sf), accounts(spark, sf), now())
    return cost.measures(facts, pricing(spark), dim, by).withColumns(
        {
            "cache_read_ratio": F.round("cache_read_ratio", 6),
            # Token prices give multiples of 1e-8, so the order of the sums does not show.
            "est_api_cost": F.round("est_api_cost", 8),
        }
    )


@query(
    "measures",
    with_ctes(
        "usage price",
        f"SELECT model, git_branch, {_MEASURES} FROM lake LEFT JOIN price ON model = model_name"
        " GROUP BY model, git_branch",
        lake=LAKE_SQL,
    ),
)
def measures(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, ["model", "git_branch"])


@query(
    "measures_by_account",
    with_ctes(
        "usage price accounts",
        f"SELECT a.subscription, CAST(date AS VARCHAR) AS date, {_MEASURES} FROM lake"
        " LEFT JOIN price ON model = model_name LEFT JOIN accounts a USING (device_id)"
        " GROUP BY a.subscription, date",
        lake=LAKE_SQL,
    ),
)
def measures_by_account(spark: SparkSession, sf: str) -> DataFrame:
    return _measures(spark, sf, ["subscription", "date"]).withColumn("date", day())


@query(
    "device_counts",
    with_ctes(
        "usage",
        "SELECT coalesce(CASE WHEN device_id <> 'd3' THEN device_id END, '<null>') AS device_id,"
        " count(*) AS records, (SELECT count(DISTINCT device_id) FROM usage"
        " WHERE device_id <> 'd3') AS devices FROM usage GROUP BY 1",
    ),
)
def device_counts(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf).withColumn(
        "device_id", F.when(F.col("device_id") != "d3", F.col("device_id"))
    )
    return metrics.device_counts(facts).withColumn("devices", metrics.device_total(facts).scalar())
