"""Queries over pushes: facts of devices d0 to d2 form the remote side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators import metrics, push
from sparkmeter.plans.inputs import (
    NOW,
    accounts,
    day,
    day_sql,
    limits,
    moment,
    moment_sql,
    now,
    pricing,
    table,
    usage,
    with_ctes,
)
from sparkmeter.plans.registry import query
from sparkmeter.plans.statistics import LAKE_SQL
from sparkmeter.schemas import DEVICES, LIMITS, PRICING, conform
from sparkmeter.session import scratch_path
from sparkmeter.store.sinks import push_all, push_lake, push_server
from sparkmeter.store.tables import Store

WATERMARK = 6000
_SECONDS = NOW.replace(tzinfo=dt.timezone.utc).timestamp()


def _state(spark: SparkSession, sf: str) -> DataFrame:
    """State of three sinks, derived from the events: watermarks of some, times of some."""
    top = table(spark, sf, "events").agg(F.max("event_id").alias("n"))
    values = F.create_map(
        F.lit("a.usage_watermark"), (F.col("n") - 100).cast("string"),
        F.lit("a.last_push_at"), F.lit(str(int(_SECONDS) - 600)),
        F.lit("a.limits_watermark"), F.lit("2024-01-15 00:00:00"),
        F.lit("b.usage_watermark"), (F.col("n") + 5).cast("string"),
        F.lit("b.rebuild_guard"), F.lit("1"),
        F.lit("c.usage_watermark"), F.col("n").cast("string"),
        F.lit("c.limits_watermark"), F.lit("2030-01-01 00:00:00"),
        F.lit("c.last_push_at"), F.lit(str(int(_SECONDS) - 5000)),
    )
    return top.select(F.explode(values).alias("key", "value"))


_TOP = "(SELECT max(event_id) FROM events)"


@query(
    "plan_push",
    with_ctes(
        "usage limits",
        f"SELECT case_, (SELECT max(id) FROM usage WHERE NOT only_d1 OR device_id = 'd1') AS max_id,"
        " (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') FROM limits WHERE NOT only_d1 OR"
        " device_id = 'd1') AS max_limits_ts, wm_id, new_usage, new_limits, blocked, throttled, skip"
        f" FROM (VALUES ('a', false, {_TOP} - 100, true, true, false, false, false),"
        f" ('a throttled', false, {_TOP} - 100, true, true, false, true, true),"
        " ('b', false, NULL, true, true, true, false, false),"
        f" ('c', false, {_TOP}, false, false, false, false, true),"
        " ('c full', false, NULL, true, true, false, false, false),"
        " ('new', true, NULL, true, true, false, false, false))"
        " AS v(case_, only_d1, wm_id, new_usage, new_limits, blocked, throttled, skip)",
    ),
)
def plans(spark: SparkSession, sf: str) -> DataFrame:
    facts, readings, state = usage(spark, sf), limits(spark, sf), _state(spark, sf)
    rows = {
        "a": push.plan_push(facts, readings, state, "a", _SECONDS),
        "a throttled": push.plan_push(facts, readings, state, "a", _SECONDS, respect_interval=True),
        "b": push.plan_push(facts, readings, state, "b", _SECONDS),
        "c": push.plan_push(facts, readings, state, "c", _SECONDS, respect_interval=True),
        "c full": push.plan_push(facts, readings, state, "c", _SECONDS, full=True),
        "new": push.plan_push(facts, readings, state, "new", _SECONDS, ["d1"]),
    }
    parts = [df.withColumn("case_", F.lit(name)) for name, df in rows.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.withColumn("max_limits_ts", moment("max_limits_ts")).select(
        "case_", "max_id", "max_limits_ts", "wm_id", "new_usage", "new_limits", "blocked",
        "throttled", "skip",
    )


_LAKE_DAYS = LAKE_SQL.replace(
    "FROM usage GROUP BY",
    f"FROM usage WHERE date IN (SELECT date FROM usage WHERE id > {WATERMARK}) GROUP BY",
)


@query(
    "affected_day_batch",
    with_ctes(
        "usage",
        f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date), (SELECT count(*) FROM usage"
        f" WHERE id > {WATERMARK}) AS source_rows FROM ({_LAKE_DAYS})",
    ),
)
def day_batch(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    rows = push.source_rows(facts, WATERMARK).agg(F.count("*")).scalar()
    batch = push.affected_day_batch(facts, WATERMARK, now()).drop("last_updated")
    return batch.withColumns({"date": day(), "source_rows": rows})


@query(
    "push_daily",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, CAST(sum(records) AS BIGINT) AS records, CAST(sum(total_tokens) AS"
        f" BIGINT) AS total_tokens, count(*) AS n FROM ({LAKE_SQL}) GROUP BY date",
    ),
)
def daily_pushed(spark: SparkSession, sf: str) -> DataFrame:
    # What was pushed up to the watermark, then the days that gained rows: equals a full push.
    facts = usage(spark, sf)
    earlier = metrics.usage_daily(facts.filter(F.col("id") <= WATERMARK), now())
    after = push.push_daily(earlier, push.affected_day_batch(facts, WATERMARK, now()))
    return after.groupBy("date").agg(
        F.sum("records").alias("records"),
        F.sum("total_tokens").alias("total_tokens"),
        F.count("*").alias("n"),
    ).withColumn("date", day())


def _remote(facts: DataFrame) -> DataFrame:
    """The target: rows of three devices up to the watermark, and some rows beyond it."""
    return facts.filter(
        f"device_id <> 'd3' AND (id <= {WATERMARK} OR id % 9 = 0)"
    )


_REMOTE = f"SELECT * FROM usage WHERE device_id <> 'd3' AND (id <= {WATERMARK} OR id % 9 = 0)"
_LACKING = (
    "SELECT * FROM usage u WHERE {more} NOT EXISTS (SELECT 1 FROM remote r WHERE"
    " r.session_id = u.session_id AND r.message_uuid = u.message_uuid)"
)
_BY_DEVICE = (
    "SELECT device_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM {} GROUP BY device_id"
)


def _by_device(df: DataFrame) -> DataFrame:
    return df.groupBy("device_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(
    "push_full",
    with_ctes(
        "usage",
        _BY_DEVICE.format("(SELECT * FROM remote UNION ALL SELECT * FROM lacking)"),
        remote=_REMOTE,
        lacking=_LACKING.format(more=""),
    ),
)
def full(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    return _by_device(push.push_full(facts, _remote(facts)))


@query(
    "push_incremental",
    with_ctes(
        "usage",
        _BY_DEVICE.format("(SELECT * FROM remote UNION ALL SELECT * FROM lacking)"),
        remote=_REMOTE,
        lacking=_LACKING.format(more=f"u.id > {WATERMARK} AND"),
    ),
)
def incremental(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    return _by_device(push.push_incremental(facts, _remote(facts), WATERMARK))


@query(
    "push_limits",
    with_ctes(
        "limits",
        f"SELECT {moment_sql()}, device_id, CASE WHEN week_pct % 2 = 0 THEN -1 ELSE week_pct END AS"
        " week_pct FROM limits",
    ),
)
def limits_pushed(spark: SparkSession, sf: str) -> DataFrame:
    readings = limits(spark, sf)
    held = readings.filter("week_pct % 2 = 0").withColumn("week_pct", F.lit(-1).cast("bigint"))
    return push.push_limits(readings, held).select(moment(), "device_id", "week_pct")


@query(
    "push_pricing",
    "SELECT concat('p', p_partkey) AS model_name, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE"
    " 0 END AS kept, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice END AS replaced FROM part"
    " WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0",
)
def pricing_pushed(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    name, price = F.concat(F.lit("p"), "p_partkey").alias("model_name"), F.col("p_retailprice")
    held = conform(
        part.filter("p_partkey % 2 = 0").select(name, price.alias("input_price")), PRICING
    )
    mine = conform(
        part.filter("p_partkey % 3 = 0").select(name, F.lit(0.0).alias("input_price")), PRICING
    )
    kept = push.push_pricing(mine, held, replace=False)
    replaced = push.push_pricing(mine, held, replace=True)
    return kept.select("model_name", F.col("input_price").alias("kept")).join(
        replaced.select("model_name", F.col("input_price").alias("replaced")), "model_name"
    )


@query(
    "push_devices",
    "SELECT concat('d', c_custkey) AS device_id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old'"
    " END AS device_name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
)
def devices_pushed(spark: SparkSession, sf: str) -> DataFrame:
    def dim(condition: str, name: str) -> DataFrame:
        rows = table(spark, sf, "customer").filter(condition).select(
            F.concat(F.lit("d"), "c_custkey").alias("device_id"), F.lit(name).alias("device_name")
        )
        return conform(rows, DEVICES)

    after = push.push_devices(dim("c_custkey % 2 = 0", "new"), dim("c_custkey % 3 = 0", "old"))
    return after.select("device_id", "device_name")


_REPAIR = {
    "remote": "SELECT * REPLACE (id + 1 AS id) FROM usage WHERE device_id IN ('d1', 'd2', 'd3')"
    " AND id % 3 <> 0",
    "local": "SELECT * FROM usage WHERE device_id IN ('d0', 'd1')",
    "repaired": "SELECT * FROM local UNION ALL SELECT * FROM remote"
    " WHERE device_id NOT IN ('d0', 'd1')",
}


@query(
    "repair_target",
    with_ctes(
        "usage",
        "SELECT *, CAST(0 AS BIGINT) AS differences, false AS abort FROM ("
        + _BY_DEVICE.format("repaired")
        + ")",
        **_REPAIR,
    ),
)
def repaired(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    local = facts.filter("device_id IN ('d0', 'd1')")
    remote = facts.filter("device_id IN ('d1', 'd2', 'd3') AND id % 3 <> 0").withColumn(
        "id", F.col("id") + 1
    )
    after = push.repair_target(local, remote)
    wrong = push.repair_differences(local, remote, after).agg(F.count("*")).scalar()
    conflict = push.repair_conflict(local, remote).select("abort").scalar()
    return _by_device(after).withColumns({"differences": wrong, "abort": conflict})


@query(
    "sink_status",
    f"SELECT * FROM (VALUES ('a', {_TOP} - 100, '2024-03-01 11:50:00.000000', 900, NULL),"
    f" ('b', {_TOP} + 5, NULL, 60, 'd1,d2'), ('c', {_TOP}, '2024-03-01 10:36:40.000000', 900, NULL),"
    " ('idle', NULL, NULL, 900, NULL))"
    " AS v(sink, watermark, last_push, min_interval, device_filter)",
)
def sinks(spark: SparkSession, sf: str) -> DataFrame:
    settings = spark.createDataFrame(
        [("a", None, None), ("b", 60, "d1,d2"), ("c", None, None), ("idle", None, None)],
        "sink string, min_interval int, device_filter string",
    )
    return push.sink_status(_state(spark, sf), settings).withColumn(
        "last_push", moment("last_push")
    )


def _local(spark: SparkSession, facts: DataFrame, readings: DataFrame) -> Store:
    local = Store(spark, scratch_path(spark, "local"))
    local.append("usage", facts.withColumn("updated_seq", F.col("id")))
    local.append("limits", conform(readings, LIMITS))
    local.append("pricing", pricing(spark))
    return local


@query(
    "push_all",
    with_ctes(
        "usage limits accounts",
        f"SELECT 'lake' AS sink, {day_sql()}, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS"
        f" tokens FROM ({LAKE_SQL}) GROUP BY date UNION ALL SELECT 'server', CAST(date AS VARCHAR),"
        " count(*), CAST(sum(total_tokens) AS BIGINT) FROM usage GROUP BY date UNION ALL"
        " SELECT 'limits', CAST(date AS VARCHAR), count(*), CAST(sum(week_pct) AS BIGINT)"
        " FROM limits GROUP BY date UNION ALL SELECT 'devices', subscription, count(*),"
        " 0 FROM (SELECT DISTINCT device_id FROM usage) LEFT JOIN accounts USING (device_id)"
        " GROUP BY subscription UNION ALL SELECT 'failed', NULL, 1, 0",
    ),
)
def pushed(spark: SparkSession, sf: str) -> DataFrame:
    # Rows up to the watermark are pushed first, the rest with a second push that resends whole
    # days; one sink fails and does not stop the others.
    facts, readings = usage(spark, sf), limits(spark, sf)
    local = _local(spark, facts.filter(F.col("id") <= WATERMARK), readings)
    lake, server = (Store(spark, scratch_path(spark, n)) for n in ("lake", "server"))
    people = accounts(spark, sf)

    def fail():
        raise RuntimeError("unreachable")

    moments = [NOW.replace(tzinfo=dt.timezone.utc) + dt.timedelta(hours=h) for h in range(2)]
    failures: dict[str, str] = {}
    for i, when in enumerate(moments):
        if i:
            rest = facts.filter(F.col("id") > WATERMARK)
            local.append("usage", rest.withColumn("updated_seq", F.col("id")))
        _, failures = push_all(
            {
                "lake": lambda when=when: push_lake(local, lake, when, people),
                "broken": fail,
                "server": lambda when=when: push_server(local, server, when),
            }
        )

    def part(df: DataFrame, name: str, key, tokens) -> DataFrame:
        return df.groupBy(key.alias("date")).agg(
            F.count("*").alias("n"), F.sum(tokens).alias("tokens")
        ).withColumn("sink", F.lit(name))

    key, tokens = F.col("date").cast("string"), F.col("total_tokens")
    result = part(lake.read("usage_daily"), "lake", key, tokens)
    result = result.unionByName(part(server.read("usage"), "server", key, tokens))
    result = result.unionByName(part(lake.read("limits"), "limits", key, F.col("week_pct")))
    result = result.unionByName(
        part(lake.read("devices"), "devices", F.col("subscription"), F.lit(0))
    )
    failed = table(spark, sf, "events").agg(
        F.lit(None).cast("string").alias("date"),
        F.lit(len(failures)).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("tokens"),
    )
    return result.unionByName(failed.withColumn("sink", F.lit("failed")))


@query(
    "compact",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens,"
        " true AS fewer_files FROM usage GROUP BY date",
    ),
)
def compacted(spark: SparkSession, sf: str) -> DataFrame:
    store = Store(spark, scratch_path(spark, "compact"))
    for i in range(3):
        store.append("usage", usage(spark, sf).filter(F.col("id") % 3 == i))

    before = store.file_sizes("usage").count()
    store.compact("usage")
    fewer = store.file_sizes("usage").count() < before
    return (
        store.read("usage")
        .groupBy("date")
        .agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))
        .select(day(), "n", "tokens", F.lit(fewer).alias("fewer_files"))
    )


@query(
    "cross_device_view",
    with_ctes(
        "usage",
        "SELECT device_id, count(*) AS records, CAST(sum(total_tokens) AS BIGINT) AS tokens,"
        " count(DISTINCT session_id) AS sessions FROM (SELECT * FROM usage QUALIFY row_number() OVER"
        " (PARTITION BY session_id, message_uuid ORDER BY total_tokens DESC, ts DESC, device_id, id)"
        " = 1) GROUP BY device_id",
    ),
)
def cross_device(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    stores = [
        facts.filter("device_id IN ('d0', 'd1')"),
        facts.filter("device_id IN ('d1', 'd2')"),
        facts.filter("device_id = 'd3'"),
    ]
    return push.cross_device_view(stores).groupBy("device_id").agg(
        F.count("*").alias("records"),
        F.sum("total_tokens").alias("tokens"),
        F.count_distinct("session_id").alias("sessions"),
    )
