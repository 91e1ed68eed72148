"""Queries over streams of log files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators.dedupe import dedupe_responses
from sparkmeter.plans.inputs import (
    MEASURES_SQL,
    NOW,
    accounts,
    day,
    day_sql,
    now,
    usage,
    with_ctes,
)
from sparkmeter.plans.registry import query
from sparkmeter.plans.saving import transcript_tree
from sparkmeter.plans.statistics import LAKE_SQL
from sparkmeter.schemas import DAILY_MEASURES
from sparkmeter.session import scratch_path
from sparkmeter.sources.registry import Source
from sparkmeter.store.sinks import push_lake
from sparkmeter.store.tables import Store
from sparkmeter.streaming.ingest import daily_totals_stream, dashboard_stream, ingest_stream

# What one store holds after all events were ingested from transcripts, in whatever order.
_HELD = (
    "SELECT * FROM deduped QUALIFY row_number() OVER (PARTITION BY message_uuid, CASE WHEN"
    " message_type = 'user' THEN session_id END ORDER BY ts DESC, id) = 1"
)


def _source(spark: SparkSession, facts: DataFrame) -> Source:
    return Source(transcript_tree(spark, facts), "claude", "d0", "Device 0", "macos")


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch_path(spark, "stream"))


@query(
    "stream_ingest",
    with_ctes(
        "deduped",
        f"SELECT {day_sql()}, {MEASURES_SQL} FROM held GROUP BY date",
        held=_HELD,
    ),
)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    stream = ingest_stream(
        store, _source(spark, usage(spark, sf)), scratch_path(spark, "cp"), now(), glob="*.txt"
    )
    stream.awaitTermination()
    return store.read("daily").select(day(), *DAILY_MEASURES)


@query(
    "stream_dashboard",
    with_ctes(
        "deduped",
        "SELECT CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) FILTER (message_type = 'user')"
        " AS prompts, count(DISTINCT session_id) AS sessions, count(DISTINCT date) AS active_days"
        " FROM held",
        held=_HELD,
    ),
)
def stream_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    shown: list[DataFrame] = []
    stream = dashboard_stream(
        _store(spark),
        _source(spark, usage(spark, sf)),
        scratch_path(spark, "cp"),
        now(),
        shown.append,
        interval=None,
        glob="*.txt",
    )
    stream.awaitTermination()
    return shown[-1]


@query(
    "stream_totals",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, model, count(*) AS records, CAST(sum(total_tokens) AS BIGINT) AS"
        " total_tokens FROM usage GROUP BY date, model",
    ),
)
def stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    path = scratch_path(spark, "facts")
    facts.write.parquet(path)
    totals: list[DataFrame] = []
    stream = (
        daily_totals_stream(spark.readStream.schema(facts.schema).parquet(path))
        .writeStream.outputMode("complete")
        .foreachBatch(lambda batch, _: _keep(batch, path, totals))
        .option("checkpointLocation", scratch_path(spark, "cp"))
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return totals[-1].withColumn("date", day())


def _keep(batch: DataFrame, path: str, totals: list[DataFrame]) -> None:
    """Write the latest complete result, so that it outlives the batch."""
    target = f"{path}-totals-{len(totals)}"
    batch.write.parquet(target)
    totals.append(batch.sparkSession.read.parquet(target))


@query(
    "stream_ingest_and_push",
    with_ctes(
        "deduped",
        f"SELECT {day_sql()}, model, CAST(sum(records) AS BIGINT) AS records,"
        " CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM ("
        + LAKE_SQL.replace("FROM usage", "FROM held")
        + ") GROUP BY date, model",
        held=_HELD,
    ),
)
def stream_and_push(spark: SparkSession, sf: str) -> DataFrame:
    # Every saved batch is pushed; days that later batches touch are sent again.
    lake, people = Store(spark, scratch_path(spark, "lake")), accounts(spark, sf)
    when = NOW.replace(tzinfo=dt.timezone.utc)
    stream = ingest_stream(
        _store(spark),
        _source(spark, usage(spark, sf)),
        scratch_path(spark, "cp"),
        now(),
        then=lambda store: push_lake(store, lake, when, people),
        glob="*.txt",
    )
    stream.awaitTermination()
    return (
        lake.read("usage_daily")
        .groupBy("date", "model")
        .agg(F.sum("records").alias("records"), F.sum("total_tokens").alias("total_tokens"))
        .withColumn("date", day())
    )


@query(
    "stream_replays",
    with_ctes(
        "deduped",
        "SELECT message_uuid, message_type, total_tokens FROM held",
        held=_HELD,
    ),
)
def stream_replays(spark: SparkSession, sf: str) -> DataFrame:
    # Two streams bring the same files; the second, with its own checkpoint, changes nothing.
    store, source = _store(spark), _source(spark, dedupe_responses(usage(spark, sf), ["id"]))
    for _ in range(2):
        ingest_stream(
            store, source, scratch_path(spark, "cp"), now(), glob="*.txt"
        ).awaitTermination()
    return store.read("usage").select("message_uuid", "message_type", "total_tokens")
