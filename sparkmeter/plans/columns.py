"""Queries over column expressions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.functions import labels
from sparkmeter.functions.predicates import date_key, is_prompt, is_response
from sparkmeter.operators.filters import (
    date_range_filter,
    device_filter,
    exclude_synthetic,
    year_filter,
)
from sparkmeter.plans.inputs import (
    day,
    day_sql,
    line_usage,
    table,
    usage,
    with_ctes,
)
from sparkmeter.plans.registry import query
from sparkmeter.schemas import with_total


@query(
    "date_key",
    with_ctes(
        "usage",
        "SELECT CAST(CAST(timezone('Europe/Berlin', timezone('UTC', ts)) AS DATE) AS VARCHAR)"
        " AS berlin, CAST(CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS"
        " VARCHAR) AS new_york, count(*) AS n FROM usage GROUP BY ALL",
    ),
)
def date_keys(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    return usage(spark, sf).groupBy(
        date_key(ts, "Europe/Berlin").cast("string").alias("berlin"),
        date_key(ts, "America/New_York").cast("string").alias("new_york"),
    ).agg(F.count("*").alias("n"))


@query("total_tokens", with_ctes("usage", "SELECT id, total_tokens FROM usage"))
def total_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return with_total(usage(spark, sf).drop("total_tokens")).select("id", "total_tokens")


@query(
    "message_types",
    with_ctes(
        "usage",
        "SELECT folder, CAST(count(*) FILTER (message_type = 'user') AS BIGINT) AS prompts,"
        " CAST(count(*) FILTER (message_type = 'assistant') AS BIGINT) AS responses"
        " FROM usage GROUP BY folder",
    ),
)
def message_types(spark: SparkSession, sf: str) -> DataFrame:
    return usage(spark, sf).groupBy("folder").agg(
        F.count_if(is_prompt()).alias("prompts"), F.count_if(is_response()).alias("responses")
    )


@query(
    "date_range_filter",
    with_ctes(
        "line_usage",
        f"SELECT {day_sql()}, count(*) AS n FROM line_usage"
        " WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' GROUP BY date",
    ),
)
def date_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = date_range_filter(line_usage(spark, sf), "1997-01-01", "1997-03-31")
    return rows.groupBy("date").agg(F.count("*").alias("n")).withColumn("date", day())


@query(
    "device_filter",
    with_ctes(
        "usage",
        "SELECT device_id, count(*) AS n, max(id) AS max_id FROM usage"
        " WHERE device_id IN ('d0', 'd2') GROUP BY device_id",
    ),
)
def devices(spark: SparkSession, sf: str) -> DataFrame:
    return device_filter(usage(spark, sf), ["d0", "d2"]).groupBy("device_id").agg(
        F.count("*").alias("n"), F.max("id").alias("max_id")
    )


@query(
    "year_filter",
    with_ctes(
        "line_daily",
        f"SELECT {day_sql()}, total_tokens FROM line_daily WHERE year(date) = 1998",
    ),
)
def one_year(spark: SparkSession, sf: str) -> DataFrame:
    # The filter comes before the aggregation, so that the scan sees it.
    rows = year_filter(line_usage(spark, sf), 1998)
    return rows.groupBy("date").agg(F.sum("total_tokens").alias("total_tokens")).withColumn(
        "date", day()
    )


@query(
    "exclude_synthetic",
    with_ctes(
        "usage",
        "SELECT model, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM ("
        " SELECT * REPLACE (CASE WHEN id % 9 = 0 THEN '<synthetic>' ELSE model END AS model)"
        " FROM usage) WHERE model <> '<synthetic>' AND message_type = 'assistant' GROUP BY model",
    ),
)
def without_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    marked = usage(spark, sf).withColumn(
        "model", F.when(F.col("id") % 9 == 0, "<synthetic>").otherwise(F.col("model"))
    )
    return exclude_synthetic(marked).groupBy("model").agg(
        F.count("*").alias("n"), F.sum("total_tokens").alias("tokens")
    )


_MODEL = (
    "CASE p_partkey % 4 WHEN 0 THEN concat('vendor/claude-', lower(p_brand), '-20250101')"
    " WHEN 1 THEN concat('claude-', lower(p_brand)) WHEN 2 THEN concat('a/b/', p_brand, '-20')"
    " ELSE p_type END"
)


@query(
    "model_label",
    "SELECT p_partkey, CASE WHEN contains(lower(tail), 'claude') THEN replace(tail, 'claude-', '')"
    " ELSE tail END AS label, replace(model, 'claude-', '')[1:25] AS narrow,"
    " string_split(replace(model, 'claude-', ''), '-20')[1] AS undated FROM"
    f" (SELECT *, string_split(model, '/')[-1] AS tail FROM (SELECT p_partkey, {_MODEL} AS model"
    " FROM part))",
)
def model_labels(spark: SparkSession, sf: str) -> DataFrame:
    model = F.expr(_MODEL)
    return table(spark, sf, "part").select(
        "p_partkey",
        labels.model_label(model).alias("label"),
        labels.narrow_model_label(model).alias("narrow"),
        labels.dated_model_label(model).alias("undated"),
    )


_FOLDER = (
    "CASE c_custkey % 5 WHEN 0 THEN concat('/work/', lower(c_mktsegment), '/', c_name)"
    " WHEN 1 THEN concat(lower(c_mktsegment), '/', c_name) WHEN 2 THEN c_name"
    " WHEN 3 THEN concat('/', c_name)"
    " ELSE concat('a/', c_mktsegment, c_mktsegment, c_mktsegment, '/', c_name, c_name) END"
)


@query(
    "project_label",
    "SELECT c_custkey, (CASE WHEN len(p) > 3 THEN concat('.../', p[-2], '/', p[-1])"
    " WHEN len(p) = 3 THEN concat(p[-2], '/', p[-1]) ELSE folder END)[1:35] AS label,"
    " (CASE WHEN len(p) > 2 THEN concat(p[-2], '/', p[-1]) ELSE folder END)[1:25] AS narrow FROM"
    f" (SELECT *, string_split(folder, '/') AS p FROM (SELECT c_custkey, {_FOLDER} AS folder"
    " FROM customer))",
)
def project_labels(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.expr(_FOLDER)
    return table(spark, sf, "customer").select(
        "c_custkey",
        labels.project_label(folder).alias("label"),
        labels.narrow_project_label(folder).alias("narrow"),
    )


_NUMBER = "l_orderkey * CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN 50 WHEN 2 THEN 1250 WHEN 3 THEN 70001 ELSE 400050 END"


@query(
    "human_number",
    "SELECT n, CASE WHEN n >= 1000000000 THEN printf('%.1fbn', n / 1000000000)"
    " WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000)"
    " WHEN n >= 1000 THEN printf('%.1fK', n / 1000) ELSE CAST(n AS VARCHAR) END AS text"
    f" FROM (SELECT DISTINCT {_NUMBER} AS n FROM lineitem)",
)
def human_numbers(spark: SparkSession, sf: str) -> DataFrame:
    numbers = table(spark, sf, "lineitem").select(F.expr(_NUMBER).alias("n")).distinct()
    return numbers.select("n", labels.human_number(F.col("n")).alias("text"))


@query(
    "bar_fill",
    with_ctes(
        "line_daily",
        f"SELECT {day_sql()}, filled, concat(repeat('█', filled), repeat('░', 20 - filled)) AS bar"
        " FROM (SELECT date, CAST(floor(CAST(total_tokens AS DOUBLE) / m * 20) AS BIGINT) AS filled"
        " FROM line_daily, (SELECT CAST(max(total_tokens) AS DOUBLE) AS m FROM line_daily))",
    ),
)
def bars(spark: SparkSession, sf: str) -> DataFrame:
    days = line_usage(spark, sf).groupBy("date").agg(F.sum("total_tokens").alias("tokens"))
    top = days.agg(F.max("tokens")).scalar()
    filled = days.withColumn("filled", labels.bar_fill(F.col("tokens"), top))
    return filled.select(day(), "filled", labels.text_bar(F.col("filled")).alias("bar"))
