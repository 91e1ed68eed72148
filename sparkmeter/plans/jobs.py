"""Queries over jobs of a store: retries, rebuilds, growing logs, merges, upkeep, ad-hoc SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators.sessions import distinct_sessions
from sparkmeter.plans.inputs import (
    MEASURES_SQL,
    NOW,
    accounts,
    batches,
    day,
    day_sql,
    now,
    table,
    usage,
    with_ctes,
)
from sparkmeter.plans.parsing import rollout_lines
from sparkmeter.plans.registry import ORACLES, query
from sparkmeter.plans.saving import TREE_COUNTS_SQL, log_tree, transcript_lines, transcript_tree
from sparkmeter.schemas import DAILY_MEASURES
from sparkmeter.session import scratch_path
from sparkmeter.sources.registry import Source
from sparkmeter.store.index import refresh_sessions
from sparkmeter.store.ingest import ingest_registry, rebuild, save_files, save_full
from sparkmeter.store.journal import Files
from sparkmeter.store.merging import merge_trees, read_tree, write_files
from sparkmeter.store.sinks import push_lake
from sparkmeter.store.tables import Store
from sparkmeter.store.views import query_store
from sparkmeter.streaming.ingest import follow_logs
from sparkmeter.streaming.state import largest_usage_stream, rollout_pieces_stream, start_available

_FILE = "concat('f', CAST(id % 20 AS {S}))"
_HELD = (
    "SELECT * FROM deduped QUALIFY row_number() OVER (PARTITION BY message_uuid, CASE WHEN"
    " message_type = 'user' THEN session_id END ORDER BY ts DESC, id) = 1"
)


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch_path(spark, "job"))


# --- commits ---------------------------------------------------------------------------------


class Lost(RuntimeError):
    """Stands for a driver that is lost."""


class FailingStore(Store):
    """A store whose writer is lost right after a given write, before it is committed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path)
        self.fail_after: int | None = None

    def _write(self, name: str, rows: DataFrame) -> int:
        part = super()._write(name, rows)
        if self.fail_after is not None:
            self.fail_after -= 1
            if self.fail_after == 0:
                self.fail_after = None
                raise Lost(name)
        return part


def repeated(store: FailingStore, job, steps: list[int]) -> None:
    """Run a job that is lost after each of some writes, then run it to its end."""
    for step in steps:
        store.fail_after = step
        try:
            job()
        except Lost:
            continue
        break
    store.fail_after = None
    job()


@query(
    "save_full_retried",
    with_ctes(
        "saved",
        f"SELECT {day_sql()}, {MEASURES_SQL}, CAST(sum(total_tokens) AS BIGINT) AS fact_tokens"
        " FROM saved GROUP BY date",
    ),
)
def saved_after_losses(spark: SparkSession, sf: str) -> DataFrame:
    # Each batch is lost after its first write, then after the last before the rollup.
    store = FailingStore(spark, scratch_path(spark, "job"))
    for batch in batches(spark, sf):
        repeated(store, lambda batch=batch: save_full(store, batch, now(), ["id"]), [1, 3])
    facts = store.read("usage").groupBy("date").agg(F.sum("total_tokens").alias("fact_tokens"))
    return store.read("daily").join(facts, "date").select(day(), *DAILY_MEASURES, "fact_tokens")


@query(
    "ledger_retried",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, "
        + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in DAILY_MEASURES)
        + f" FROM (SELECT {_FILE.format(S='VARCHAR')} AS file_path, date, {MEASURES_SQL} FROM usage"
        " GROUP BY 1, 2) GROUP BY date",
    ),
)
def ledger_after_losses(spark: SparkSession, sf: str) -> DataFrame:
    # The rollup is written, the ledger is not; then both are but the commit is lost.
    store = FailingStore(spark, scratch_path(spark, "job"))
    facts = usage(spark, sf).withColumn("file_path", F.expr(_FILE.format(S="STRING")))
    repeated(store, lambda: save_files(store, facts, now()), [1, 2])
    save_files(store, facts, now())
    return store.read("daily").select(day(), *DAILY_MEASURES)


# --- rebuild and push ------------------------------------------------------------------------

_OWN_IDS = "concat('n', CAST(id AS {S}))"
# Logs of each device after the first push: other counters, fewer rows, the same rows, more rows.
_LOGGED = (
    "message_type = 'assistant' AND model = 'model-b' AND (device_id <> 'd1' OR id % 2 = 0)"
)


def _own_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.expr(_OWN_IDS.format(S="STRING"))
    return usage(spark, sf).withColumn("message_uuid", ids)


@query(
    "rebuild_and_push",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, device_id, count(*) AS records, CAST(sum(total_tokens) AS BIGINT) AS"
        " tokens FROM (SELECT date, device_id, total_tokens FROM kept UNION ALL SELECT date,"
        " device_id, total_tokens + CASE WHEN device_id = 'd0' THEN 1 ELSE 0 END FROM logs UNION ALL"
        " SELECT date, device_id, total_tokens FROM logs WHERE device_id = 'd3')"
        " GROUP BY date, device_id",
        logs=f"SELECT * FROM usage WHERE {_LOGGED}",
        kept="SELECT * FROM usage WHERE session_id NOT IN (SELECT session_id FROM logs)",
    ),
)
def rebuilt_and_pushed(spark: SparkSession, sf: str) -> DataFrame:
    local, lake, people = _store(spark), _store(spark), accounts(spark, sf)
    facts = _own_ids(spark, sf)
    save_full(local, facts, now(), ["id"])
    when = NOW.replace(tzinfo=dt.timezone.utc)
    push_lake(local, lake, when, people)
    sources = []
    for device in ("d0", "d1", "d2", "d3"):
        logs = facts.filter(_LOGGED).filter(F.col("device_id") == device)
        if device == "d0":
            logs = logs.withColumn("input_tokens", F.col("input_tokens") + 1)
        if device == "d3":
            twice = F.concat("message_uuid", F.lit("-again"))
            logs = logs.unionByName(logs.withColumn("message_uuid", twice))
        sources.append(Source(transcript_tree(spark, logs), "claude", device, device, "linux"))
    rebuild(local, sources, now(), "before", glob="*.txt")
    push_lake(local, lake, when + dt.timedelta(hours=1), people)
    return lake.read("usage_daily").groupBy("date", "device_id").agg(
        F.sum("records").alias("records"), F.sum("total_tokens").alias("tokens")
    ).withColumn("date", day())


# --- growing logs ----------------------------------------------------------------------------


def _grow(spark: SparkSession, root: str, facts: DataFrame) -> None:
    """Write facts as twenty transcripts; a file that is there is replaced by its longer version."""
    lines = transcript_lines(facts, "id").withColumn(
        "file_path", F.expr("concat('a/f', CAST(id % 20 AS STRING), '.jsonl')")
    )
    write_files(Files(spark, root), lines, ["id"])


@query(
    "stream_grown_files",
    with_ctes(
        "deduped",
        f"SELECT {day_sql()}, {MEASURES_SQL} FROM held GROUP BY date",
        held=_HELD,
    ),
)
def grown(spark: SparkSession, sf: str) -> DataFrame:
    # Every file is followed when it holds half of its ids, and again when it holds all.
    facts, store = usage(spark, sf), _store(spark)
    root, checkpoint = scratch_path(spark, "logs"), scratch_path(spark, "cp")
    source = Source(root, "claude", "d0", "Device 0", "macos")
    half = F.pmod(F.crc32("message_uuid"), F.lit(2)) == 0
    for part in (facts.filter(half), facts):
        _grow(spark, root, part)
        follow_logs(store, [source], checkpoint, now()).awaitTermination()
    return store.read("daily").select(day(), *DAILY_MEASURES)


#: Files of a piece of a stream's input, which are written and read by as many tasks.
PIECE_FILES = 32


def _stream_pieces(spark: SparkSession, rows: DataFrame, piece: Column, *by: str) -> DataFrame:
    """A stream over four pieces of some rows, written one after the other, a micro-batch for each.

    Rows that are equal in ``by`` share a file of their piece, so they come in the order of the pieces
    also when a piece has fewer files and a micro-batch goes on with the next one's.
    """
    path = scratch_path(spark, "pieces")
    for k in range(4):
        part = rows.filter(piece == k).repartition(PIECE_FILES, *by)
        part.write.mode("append").parquet(path)
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", PIECE_FILES)
    return reader.parquet(path)


def _write_stream(spark: SparkSession, rows: DataFrame, target: str, mode: str) -> None:
    """Write what passes a stream with state, a micro-batch at a time."""
    writer = rows.writeStream.foreachBatch(
        lambda batch, _: batch.write.mode("append").parquet(target)
    ).outputMode(mode)
    writer = writer.option("checkpointLocation", scratch_path(spark, "cp"))
    start_available(writer, spark).awaitTermination()


@query(
    "stream_replays_stateful",
    with_ctes(
        "usage",
        "SELECT message_uuid, message_type, total_tokens FROM usage QUALIFY row_number() OVER"
        " (PARTITION BY message_uuid, CASE WHEN message_type = 'user' THEN concat('s', session_id)"
        " ELSE 'r' END ORDER BY total_tokens DESC, ts DESC, id) = 1",
    ),
)
def stateful_replays(spark: SparkSession, sf: str) -> DataFrame:
    # Four pieces of facts, one per micro-batch; what passes is written, and the last of a key counts.
    facts, target = usage(spark, sf), scratch_path(spark, "passed")
    stream = _stream_pieces(spark, facts, F.col("id") % 4)
    _write_stream(spark, largest_usage_stream(stream, ["id"]), target, "update")
    passed = spark.read.schema(facts.schema).parquet(target)
    keys = ["message_uuid", "message_type", F.when(F.col("message_type") == "user", F.col("session_id")).alias("s")]
    return passed.groupBy(*keys).agg(F.max("total_tokens").alias("total_tokens")).drop("s")


@query("stream_rollout_pieces", ORACLES["parse_rollouts"])
def rollout_pieces(spark: SparkSession, sf: str) -> DataFrame:
    # The lines of each rollout come in four pieces, one per micro-batch.
    target = scratch_path(spark, "turns")
    lines = rollout_lines(table(spark, sf, "events"))
    top = lines.agg(F.max("pos") + 1).scalar()
    pieces = lines.withColumn("piece", F.floor(F.col("pos") * 4 / top).cast("bigint"))
    stream = _stream_pieces(spark, pieces, F.col("piece"), "file_path")
    _write_stream(spark, rollout_pieces_stream(stream, now()), target, "append")
    return spark.read.parquet(target).select(
        F.col("pos").alias("id"), "session_id", "message_uuid", "model", "folder", "version",
        "input_tokens", "output_tokens", "cache_read_tokens", "total_tokens",
    )


# --- sessions, merges, upkeep ----------------------------------------------------------------

_WEEK = "date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"


@query(
    "sessions_by_any_slice",
    with_ctes(
        "usage",
        "SELECT 'all' AS slice, '' AS key, count(DISTINCT session_id) AS sessions FROM usage"
        f" UNION ALL SELECT 'week', '', count(DISTINCT session_id) FROM usage WHERE {_WEEK}"
        " UNION ALL SELECT 'device', device_id, count(DISTINCT session_id) FROM usage GROUP BY 2"
        " UNION ALL SELECT 'model', coalesce(model, '-'), count(DISTINCT session_id) FROM usage"
        " GROUP BY 2 UNION ALL SELECT 'folder and day', concat(folder, ' ', CAST(date AS VARCHAR)),"
        " count(DISTINCT session_id) FROM usage GROUP BY 2",
    ),
)
def any_slice(spark: SparkSession, sf: str) -> DataFrame:
    # The store is filled in two parts; the second adds sessions and days to the bitmaps.
    store, facts = _store(spark), usage(spark, sf)
    for part in ("day(date) <= 12", "day(date) > 12"):
        store.append("usage", facts.filter(part))
        refresh_sessions(store)
    bits = store.read("session_bits")
    keys = {
        "device": F.col("device_id"),
        "model": F.coalesce("model", F.lit("-")),
        "folder and day": F.concat_ws(" ", "folder", day()),
    }
    parts = [
        distinct_sessions(bits).withColumns({"slice": F.lit("all"), "key": F.lit("")}),
        distinct_sessions(bits.filter(_WEEK)).withColumns(
            {"slice": F.lit("week"), "key": F.lit("")}
        ),
        *[
            distinct_sessions(bits, [key.alias("key")]).withColumn("slice", F.lit(name))
            for name, key in keys.items()
        ],
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select("slice", "key", "sessions")


@query("merge_log_trees_job", TREE_COUNTS_SQL)
def merged_trees(spark: SparkSession, sf: str) -> DataFrame:
    host, incoming = scratch_path(spark, "host"), scratch_path(spark, "incoming")
    name = F.concat("file_path", F.lit(".jsonl"))
    for root, lines in (
        (host, log_tree(spark, sf, "event_id DIV 20 % 10 < 6 AND event_id % 20 < 15", 1)),
        (incoming, log_tree(spark, sf, "event_id DIV 20 % 10 >= 3", 2)),
    ):
        write_files(Files(spark, root), lines.withColumn("file_path", name), ["chunk", "pos"])
    first = merge_trees(spark, host, incoming)
    # Whole copies are known by now, and nothing is added by a second merge.
    second = merge_trees(spark, host, incoming)
    return read_tree(spark, host).groupBy("file_path").agg(F.count("*").alias("lines")).withColumns(
        {
            "files": F.lit(first.files).cast("bigint"),
            "records": F.lit(first.records).cast("bigint"),
            "skipped_lines": F.lit(first.skipped_lines).cast("bigint"),
            "skipped_files": F.lit(first.skipped_files).cast("bigint"),
            "added_again": F.lit(second.records).cast("bigint"),
        }
    )


@query(
    "compact_by_need",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens,"
        " day(date) <= 5 AS rewritten, CAST(0 AS BIGINT) AS replaced_left FROM usage GROUP BY date",
    ),
)
def compacted_by_need(spark: SparkSession, sf: str) -> DataFrame:
    # Only the first five days are in many files; replaced files are kept until they are due.
    store, facts = _store(spark), usage(spark, sf)
    store.append("usage", facts.filter("day(date) > 5"))
    for k in range(4):
        store.append("usage", facts.filter("day(date) <= 5").filter(F.col("id") % 4 == k))
    days = store.compact("usage", files=3)
    store.vacuum(keep=0)
    left = len(store.files.names("usage/*/*/*.parquet")) - store.file_sizes("usage").count()
    return store.read("usage").groupBy("date").agg(
        F.count("*").alias("n"), F.sum("total_tokens").alias("tokens")
    ).select(
        day(), "n", "tokens", day().isin(days).alias("rewritten"),
        F.lit(left).cast("bigint").alias("replaced_left"),
    )


@query(
    "sql_over_store",
    with_ctes(
        "usage",
        "SELECT u.model, count(*) AS n, CAST(sum(u.total_tokens) AS BIGINT) AS tokens, max(p.rate)"
        " AS rate FROM usage u LEFT JOIN (VALUES ('model-a', 3.0::DOUBLE), ('model-b', 15.0::DOUBLE))"
        " AS p(model, rate) ON p.model = u.model WHERE u.date >= DATE '2024-01-10' AND u.device_id ="
        " 'd1' GROUP BY u.model ORDER BY n DESC, u.model LIMIT 3",
    ),
)
def ad_hoc(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    store.append("usage", usage(spark, sf))
    prices = [("model-a", 3.0), ("model-b", 15.0)]
    rows = spark.createDataFrame(prices, "model_name string, input_price double")
    store.append("pricing", rows)
    return query_store(
        store,
        "SELECT u.model, count(*) AS n, sum(u.total_tokens) AS tokens, max(p.input_price) AS rate"
        " FROM usage u LEFT JOIN pricing p ON p.model_name = u.model WHERE u.date >= :start AND"
        " u.device_id = :device GROUP BY u.model ORDER BY n DESC, u.model",
        {"start": dt.date(2024, 1, 10), "device": "d1"},
        limit=3,
    )


@query(
    "ingest_registry",
    with_ctes(
        "deduped",
        "SELECT device_id, concat('Device ', device_id) AS device_name, count(*) AS n,"
        " CAST(sum(total_tokens) AS BIGINT) AS tokens, CAST(30 AS BIGINT) AS days FROM held"
        " WHERE device_id <> 'd3' GROUP BY device_id",
        held=_HELD,
    ),
)
def registry_ingested(spark: SparkSession, sf: str) -> DataFrame:
    # One entry is not valid and is left out; the rollup is filled up to the last day.
    facts, store = usage(spark, sf), _store(spark)
    entries = []
    for device in ("d0", "d1", "d2", "d3"):
        path = transcript_tree(spark, facts.filter(F.col("device_id") == device))
        name = "-not valid-" if device == "d3" else device
        entries.append((path, "claude", name, f"Device {device}", "linux"))
    registry = spark.createDataFrame(
        entries, "path string, format string, device_id string, device_name string, device_type string"
    )
    ingest_registry(store, registry, now(), glob="*.txt", today=dt.date(2024, 1, 30))
    days = store.read("daily").agg(F.count("*")).scalar()
    return store.read("usage").groupBy("device_id", "device_name").agg(
        F.count("*").alias("n"), F.sum("total_tokens").alias("tokens")
    ).withColumn("days", days)
