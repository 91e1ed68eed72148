"""Queries over dedupe, saves, the ledger, merges and store repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators import facts as fact_ops
from sparkmeter.operators.dedupe import batch_gate, dedupe_responses
from sparkmeter.operators.rollup import (
    apply_ledger_delta,
    daily_rollup,
    file_contribution,
    ledger_changes,
    newly_counted,
    replace_ledger,
    save_additive,
)
from sparkmeter.operators.stores import (
    copied_counts,
    copy_store,
    merge_log_trees,
    merge_summary,
    store_status,
)
from sparkmeter.operators.upsert import inserted_rows, upsert
from sparkmeter.plans.inputs import (
    MEASURES_SQL,
    batches,
    daily,
    day,
    day_sql,
    limits,
    line_usage,
    moment,
    moment_sql,
    now,
    table,
    usage,
    with_ctes,
)
from sparkmeter.plans.registry import query
from sparkmeter.schemas import DAILY_MEASURES
from sparkmeter.session import scratch_path
from sparkmeter.sources.registry import Source
from sparkmeter.store.ingest import ingest, rebuild, save_full, snapshot_table
from sparkmeter.store.tables import Store

_SHOWN = (
    "session_id message_uuid message_type model folder git_branch input_tokens output_tokens"
    " cache_creation_tokens cache_creation_1h_tokens cache_read_tokens total_tokens device_id"
).split()
_SHOWN_SQL = ", ".join(_SHOWN)


def _facts_sql(name: str, more: str = "") -> str:
    return f"SELECT {day_sql()}, {moment_sql()}, {_SHOWN_SQL}{more} FROM {name}"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(day(), moment(), *_SHOWN)


@query("dedupe_responses", with_ctes("deduped", "SELECT id, message_uuid, total_tokens FROM deduped"))
def deduped(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe_responses(usage(spark, sf), ["id"]).select("id", "message_uuid", "total_tokens")


@query(
    "dedupe_lines",
    with_ctes(
        "line_usage",
        "SELECT message_uuid, total_tokens, CAST(date AS VARCHAR) AS date FROM line_usage QUALIFY"
        " row_number() OVER (PARTITION BY message_uuid ORDER BY total_tokens DESC, ts DESC,"
        " folder, device_id) = 1",
    ),
)
def deduped_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedupe_responses(line_usage(spark, sf), ["folder", "device_id"])
    return rows.select("message_uuid", "total_tokens", day())


@query("batch_gate", with_ctes("gated2", "SELECT id, message_type, total_tokens FROM gated2"))
def gated(spark: SparkSession, sf: str) -> DataFrame:
    return batch_gate(batches(spark, sf)[1], ["id"]).select("id", "message_type", "total_tokens")


def _first_saved(spark: SparkSession, sf: str) -> DataFrame:
    return batch_gate(batches(spark, sf)[0], ["id"])


@query(
    "insert_new",
    with_ctes(
        "added gated1",
        _facts_sql("added", ", true AS numbered, (SELECT count(*) FROM added) AS inserted"),
    ),
)
def inserted(spark: SparkSession, sf: str) -> DataFrame:
    stored = _first_saved(spark, sf)
    rows = fact_ops.insert_new(batches(spark, sf)[1], stored, ["id"])
    # New ids are dense and follow the stored ones.
    bounds = rows.agg(
        F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"),
        F.count_distinct("id").alias("ids"),
    )
    start = fact_ops.last_sequence(stored).scalar()
    dense = bounds.select(
        (F.col("n") == F.col("ids"))
        & (F.col("lo") == start + 1)
        & (F.col("hi") == start + F.col("n"))
    ).scalar()
    return _shown(rows).withColumns(
        {"numbered": dense, "inserted": bounds.select("n").scalar()}
    )


@query("upgrade_existing", with_ctes("upgraded", _facts_sql("upgraded", ", id")))
def upgraded(spark: SparkSession, sf: str) -> DataFrame:
    rows = fact_ops.upgrade_existing(batches(spark, sf)[1], _first_saved(spark, sf), ["id"])
    return rows.select(day(), moment(), *_SHOWN, "id")


def _store(spark: SparkSession) -> Store:
    return Store(spark, scratch_path(spark, "store"))


def _saved_store(spark: SparkSession, sf: str) -> Store:
    store = _store(spark)
    for batch in batches(spark, sf):
        save_full(store, batch, now(), ["id"])
    return store


@query("save_full", with_ctes("saved", _facts_sql("saved")))
def saved(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_saved_store(spark, sf).read("usage"))


@query(
    "save_full_daily",
    with_ctes("saved", f"SELECT {day_sql()}, {MEASURES_SQL} FROM saved GROUP BY date"),
)
def saved_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _saved_store(spark, sf).read("daily").select(day(), *DAILY_MEASURES)


@query(
    "save_additive",
    with_ctes(
        "batch1 batch2",
        f"SELECT {day_sql()}, "
        + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in DAILY_MEASURES)
        + f" FROM (SELECT date, {MEASURES_SQL} FROM batch1 GROUP BY date UNION ALL"
        f" SELECT date, {MEASURES_SQL} FROM batch2 GROUP BY date) GROUP BY date",
    ),
)
def added(spark: SparkSession, sf: str) -> DataFrame:
    first, second = batches(spark, sf)
    return save_additive(second, daily_rollup(first, now()), now()).select(day(), *DAILY_MEASURES)


_FILE = "concat('f', CAST(id % 20 AS {S}))"


def _filed(df: DataFrame) -> DataFrame:
    return df.withColumn("file_path", F.expr(_FILE.format(S="STRING")))


@query(
    "file_contribution",
    with_ctes(
        "usage",
        f"SELECT {_FILE.format(S='VARCHAR')} AS file_path, {day_sql()}, {MEASURES_SQL} FROM usage"
        " GROUP BY 1, date",
    ),
)
def contributions(spark: SparkSession, sf: str) -> DataFrame:
    return file_contribution(_filed(usage(spark, sf))).withColumn("date", day())


# Files f0..f4 are tracked without a ledger, f5..f14 are in it with half of their rows, the
# others are new; f15..f19 are not parsed again.
_CONTRIB = f"SELECT {_FILE.format(S='VARCHAR')} AS file_path, date, {MEASURES_SQL} FROM usage"
_LEDGER_CTES = {
    "fresh": _CONTRIB + " WHERE id % 20 < 15 GROUP BY 1, 2",
    "old": _CONTRIB + " WHERE id % 20 >= 5 AND id % 40 < 20 AND id % 20 <> 7 GROUP BY 1, 2",
    "changes": "SELECT f.file_path, f.date, "
    + ", ".join(
        f"CASE WHEN f.file_path IN ('f0', 'f1', 'f2', 'f3', 'f4') THEN 0"
        f" ELSE f.{c} - coalesce(o.{c}, 0) END AS {c}"
        for c in DAILY_MEASURES
    )
    + " FROM fresh f LEFT JOIN old o ON f.file_path = o.file_path AND f.date = o.date",
}


def _ledger(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    facts = _filed(usage(spark, sf))
    fresh = file_contribution(facts.filter("id % 20 < 15"))
    old = file_contribution(facts.filter("id % 20 >= 5 AND id % 40 < 20 AND id % 20 <> 7"))
    tracked = facts.filter("id % 20 < 5").select("file_path").distinct()
    return fresh, old, ledger_changes(fresh, old, tracked)


@query(
    "apply_ledger_delta",
    with_ctes(
        "daily usage",
        f"SELECT {day_sql()}, "
        + ", ".join(f"CAST(d.{c} + coalesce(x.{c}, 0) AS BIGINT) AS {c}" for c in DAILY_MEASURES)
        + ", (SELECT CAST(sum(greatest(responses, 0)) AS BIGINT) FROM changes) AS new_responses"
        " FROM daily d LEFT JOIN (SELECT date, "
        + ", ".join(f"sum({c}) AS {c}" for c in DAILY_MEASURES)
        + " FROM changes GROUP BY date) x USING (date)",
        **_LEDGER_CTES,
    ),
)
def ledger_applied(spark: SparkSession, sf: str) -> DataFrame:
    _, _, changes = _ledger(spark, sf)
    rows = apply_ledger_delta(changes, daily(spark, sf), now())
    return rows.select(
        day(), *DAILY_MEASURES, newly_counted(changes).scalar().alias("new_responses")
    )


@query(
    "replace_ledger",
    with_ctes(
        "usage",
        "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM (SELECT * FROM fresh UNION ALL"
        " SELECT * FROM old WHERE file_path NOT IN (SELECT file_path FROM fresh))",
        **_LEDGER_CTES,
    ),
)
def ledger_replaced(spark: SparkSession, sf: str) -> DataFrame:
    fresh, old, _ = _ledger(spark, sf)
    return replace_ledger(fresh, old).withColumn("date", day())


@query(
    "delete_sessions",
    with_ctes(
        "usage",
        f"SELECT {day_sql()}, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens,"
        " (SELECT count(DISTINCT date) FROM usage WHERE device_id = 'd1' AND session_id IN"
        " (SELECT session_id FROM usage WHERE model = 'model-c')) AS dates FROM usage"
        " WHERE NOT (device_id = 'd1' AND session_id IN (SELECT session_id FROM usage"
        " WHERE model = 'model-c')) GROUP BY date",
    ),
)
def sessions_deleted(spark: SparkSession, sf: str) -> DataFrame:
    rows = usage(spark, sf)
    sessions = rows.filter("model = 'model-c'").select("session_id")
    left = fact_ops.delete_sessions(rows, sessions, "d1")
    dates = fact_ops.deleted_dates(rows, sessions, "d1").agg(F.count("*")).scalar()
    return (
        left.groupBy("date")
        .agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))
        .select(day(), "n", "tokens", dates.alias("dates"))
    )


def transcript_lines(facts: DataFrame, *others: str) -> DataFrame:
    """Facts as lines of transcripts (value) that restore them, beside other columns."""
    line = F.to_json(
        F.struct(
            F.col("message_type").alias("type"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            F.col("session_id").alias("sessionId"),
            F.col("message_uuid").alias("uuid"),
            F.col("folder").alias("cwd"),
            F.col("git_branch").alias("gitBranch"),
            "version",
            F.struct(
                F.when(F.col("message_type") == "assistant", F.col("message_uuid")).alias("id"),
                "model",
                F.struct(
                    "input_tokens",
                    "output_tokens",
                    F.col("cache_read_tokens").alias("cache_read_input_tokens"),
                    F.struct(
                        (F.col("cache_creation_tokens") - F.col("cache_creation_1h_tokens")).alias(
                            "ephemeral_5m_input_tokens"
                        ),
                        F.col("cache_creation_1h_tokens").alias("ephemeral_1h_input_tokens"),
                    ).alias("cache_creation"),
                ).alias("usage"),
            ).alias("message"),
        )
    )
    return facts.select(*others, line.alias("value"))


def transcript_tree(spark: SparkSession, facts: DataFrame) -> str:
    """Facts as a tree of transcripts that restore them."""
    path = scratch_path(spark, "tree")
    transcript_lines(facts).write.text(path)
    return path


# A store with all facts whose logs now hold sessions of d1 with other counters.
_REBUILD = {
    "stored": "SELECT * FROM deduped QUALIFY row_number() OVER"
    " (PARTITION BY message_uuid, CASE WHEN message_type = 'user' THEN session_id END"
    " ORDER BY ts DESC, id) = 1",
    "logs": "SELECT * REPLACE (input_tokens + 1 AS input_tokens, total_tokens + 1 AS total_tokens)"
    " FROM stored WHERE device_id = 'd1' AND message_type = 'assistant' AND model = 'model-b'",
    "kept": "SELECT * FROM stored WHERE NOT (device_id = 'd1' AND session_id IN"
    " (SELECT session_id FROM logs))",
    "added": "SELECT * FROM logs WHERE message_uuid NOT IN (SELECT message_uuid FROM kept)",
}


def _rebuilt(spark: SparkSession, sf: str) -> Store:
    facts = dedupe_responses(usage(spark, sf), ["id"])
    store = _store(spark)
    save_full(store, facts, now(), ["id"])
    logs = facts.filter(
        "device_id = 'd1' AND message_type = 'assistant' AND model = 'model-b'"
    ).withColumn("input_tokens", F.col("input_tokens") + 1)
    source = Source(transcript_tree(spark, logs), "claude", "d1", "Device 1", "windows")
    rebuild(store, [source], now(), "before-rebuild", glob="*.txt")
    return store


@query(
    "rebuild",
    with_ctes(
        "deduped",
        _facts_sql("(SELECT * FROM kept UNION ALL SELECT * FROM added)"),
        **_REBUILD,
    ),
)
def rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_rebuilt(spark, sf).read("usage"))


@query(
    "rebuild_daily",
    with_ctes(
        "deduped",
        f"SELECT {day_sql()}, {MEASURES_SQL} FROM (SELECT * FROM kept UNION ALL"
        " SELECT * FROM added) GROUP BY date",
        **_REBUILD,
    ),
)
def rebuilt_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _rebuilt(spark, sf).read("daily").select(day(), *DAILY_MEASURES)


@query(
    "snapshot_table",
    with_ctes(
        "gated1",
        "SELECT count(*) AS total_records, CAST(min(date) AS VARCHAR) AS oldest_date,"
        " CAST(max(date) AS VARCHAR) AS newest_date FROM gated1",
    ),
)
def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    save_full(store, batches(spark, sf)[0], now(), ["id"])
    return snapshot_table(store, "usage", "backup").withColumns(
        {c: day(c) for c in ("oldest_date", "newest_date")}
    )


@query(
    "upsert",
    with_ctes(
        "usage",
        "SELECT key, CAST(sum(n) AS BIGINT) AS n, mode FROM (SELECT 'update' AS mode, o_custkey % 97"
        " AS key, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM orders WHERE"
        " o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 UNION ALL SELECT 'insert', o_custkey % 97,"
        " CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END FROM orders WHERE o_orderkey % 3 = 0 OR"
        " o_orderkey % 2 = 0 UNION ALL SELECT 'inserted', o_custkey % 97, 1 FROM orders WHERE"
        " o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0) GROUP BY mode, key",
    ),
)
def upserted(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("key"))
    target = orders.filter("o_orderkey % 2 = 0").withColumn("n", F.lit(1))
    batch = orders.filter("o_orderkey % 3 = 0").withColumn("n", F.lit(2))
    keys = ["o_orderkey"]
    results = {
        "update": upsert(target, batch, keys, update_matched=True),
        "insert": upsert(target, batch, keys),
        "inserted": inserted_rows(target, batch, keys).withColumn("n", F.lit(1)),
    }
    frames = [df.withColumn("mode", F.lit(mode)) for mode, df in results.items()]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return rows.groupBy("mode", "key").agg(F.sum("n").alias("n"))


# --- merging trees ---------------------------------------------------------------------------

_TREE_LINE = (
    "CASE WHEN event_id % 97 = 0 THEN '{broken' WHEN event_id % 50 = 7 THEN '{\"type\":\"x\"}'"
    " WHEN event_id % 4 = 1 THEN concat('{\"timestamp\":\"t', event_id % 800, '\",\"sessionId\":\"s',"
    " user_id, '\"}') ELSE concat('{\"uuid\":\"u', event_id % 900, '\",\"timestamp\":\"t',"
    " event_id % 900, '\",\"sessionId\":\"s\"}') END"
)


def log_tree(spark: SparkSession, sf: str, condition: str, copies: int) -> DataFrame:
    return (
        table(spark, sf, "events")
        .filter(condition)
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .select(
            F.expr("concat('f', event_id % 20)").alias("file_path"),
            F.expr("event_id DIV 400").alias("chunk"),
            (F.col("event_id") * 2 + F.col("copy")).alias("pos"),
            F.expr(_TREE_LINE).alias("value"),
        )
    )


@query(
    "merge_log_trees",
    "WITH l AS (SELECT event_id % 20 AS f, event_id // 20 % 10 AS d, " + _TREE_LINE + " AS value,"
    " event_id % 97 <> 0 AS valid, event_id % 97 <> 0 AND event_id % 50 <> 7 AS named FROM events),"
    " host AS (SELECT * FROM l WHERE d < 6 AND f < 15), inc AS (SELECT * FROM l WHERE d >= 3)"
    " SELECT 'append' AS action, count(DISTINCT f) AS files, count(*) AS records FROM (SELECT"
    " DISTINCT f, value FROM inc WHERE named AND f IN (SELECT f FROM host) AND (f, value) NOT IN"
    " (SELECT (f, value) FROM host WHERE named)) UNION ALL SELECT 'copy', count(DISTINCT f),"
    " 2 * count(*) FILTER (valid) FROM inc WHERE f NOT IN (SELECT f FROM host)",
)
def merged(spark: SparkSession, sf: str) -> DataFrame:
    host = log_tree(spark, sf, "event_id DIV 20 % 10 < 6 AND event_id % 20 < 15", 1)
    incoming = log_tree(spark, sf, "event_id DIV 20 % 10 >= 3", 2)
    return merge_summary(merge_log_trees(host, incoming))


#: Lines of each file of the host tree after a merge, with the counts of the merge.
TREE_COUNTS_SQL = (
    "WITH l AS (SELECT event_id % 20 AS f, event_id // 20 % 10 AS d, " + _TREE_LINE + " AS value,"
    " event_id % 97 <> 0 AS valid, event_id % 97 <> 0 AND event_id % 50 <> 7 AS named FROM events),"
    " host AS (SELECT * FROM l WHERE d < 6 AND f < 15), inc AS (SELECT * FROM l WHERE d >= 3),"
    " added AS (SELECT DISTINCT f, value FROM inc WHERE named AND f IN (SELECT f FROM host)"
    " AND (f, value) NOT IN (SELECT (f, value) FROM host WHERE named)),"
    " whole AS (SELECT f, valid FROM inc, range(2) WHERE f NOT IN (SELECT f FROM host)),"
    " after AS (SELECT f FROM host UNION ALL SELECT f FROM added UNION ALL SELECT f FROM whole)"
    " SELECT concat('f', f, '.jsonl') AS file_path, count(*) AS lines,"
    " (SELECT count(DISTINCT f) FROM inc WHERE valid) AS files,"
    " (SELECT count(*) FROM added) + (SELECT count(*) FILTER (valid) FROM whole) AS records,"
    " (SELECT 2 * count(*) FILTER (NOT valid) FROM inc) AS skipped_lines,"
    " CAST(0 AS BIGINT) AS skipped_files, CAST(0 AS BIGINT) AS added_again FROM after GROUP BY f"
)


# --- copying and checking stores -------------------------------------------------------------

_DEVICE = ("d9", "Device 9", "linux")


def _halves(spark: SparkSession, sf: str) -> tuple[dict, dict]:
    facts, readings = usage(spark, sf), limits(spark, sf)
    # The source store predates device columns on every third row.
    old = {
        c: F.when(F.col("id") % 3 != 0, F.col(c)) for c in ("device_id", "device_name", "device_type")
    }
    mine = facts.filter("id % 10 < 7").dropDuplicates(["session_id", "message_uuid"])
    source = {
        "usage": mine.withColumns(old),
        "daily": daily_rollup(facts.filter("id % 10 < 7"), now()),
        "limits": readings.filter("week_pct < 60"),
    }
    theirs = facts.filter("id % 10 >= 5").dropDuplicates(["session_id", "message_uuid"])
    target = {
        "usage": theirs,
        "daily": daily_rollup(facts.filter("day(date) > 20"), now()),
        "limits": readings.filter("week_pct >= 40"),
    }
    return source, target


_PAIRS = "(SELECT DISTINCT session_id, message_uuid FROM usage WHERE {})"


@query(
    "copy_store",
    with_ctes(
        "usage daily limits",
        "SELECT 'usage' AS table, (SELECT count(*) FROM (SELECT * FROM"
        f" {_PAIRS.format('id % 10 < 7')} EXCEPT SELECT * FROM {_PAIRS.format('id % 10 >= 5')}))"
        " AS copied, (SELECT count(*) FROM (SELECT DISTINCT session_id, message_uuid FROM usage))"
        " AS total UNION ALL SELECT 'daily', (SELECT count(DISTINCT date) FROM usage WHERE"
        " id % 10 < 7), (SELECT count(DISTINCT date) FROM usage WHERE id % 10 < 7 OR day(date) > 20)"
        " UNION ALL SELECT 'limits', (SELECT count(*) FROM limits WHERE week_pct < 60),"
        " (SELECT count(*) FROM limits)",
    ),
)
def copied(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _halves(spark, sf)
    after = copy_store(source, target, _DEVICE)
    totals = None
    for name, df in after.items():
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("total"))
        totals = row if totals is None else totals.unionByName(row)
    counts = copied_counts(source, target).withColumnRenamed("rows", "copied")
    return counts.join(totals, "table")


@query(
    "backfill_device",
    with_ctes(
        "usage",
        "SELECT CASE WHEN id % 3 = 0 THEN 'd9' ELSE device_id END AS device_id, CASE WHEN id % 3 = 0"
        " THEN 'Device 9' ELSE device_name END AS device_name, count(*) AS n, (SELECT count(*) FROM"
        " usage WHERE id % 3 = 0) AS updated FROM usage GROUP BY 1, 2",
    ),
)
def backfilled(spark: SparkSession, sf: str) -> DataFrame:
    facts = usage(spark, sf)
    unknown = facts.withColumns(
        {c: F.when(F.col("id") % 3 != 0, F.col(c)) for c in ("device_id", "device_name")}
    )
    updated = fact_ops.unattributed(unknown).scalar()
    return (
        fact_ops.backfill_device(unknown, *_DEVICE)
        .groupBy("device_id", "device_name")
        .agg(F.count("*").alias("n"))
        .withColumn("updated", updated)
    )


@query(
    "store_status",
    "SELECT 'events' AS store, true AS exists, false AS has_device_columns, count(*) AS records"
    " FROM events UNION ALL SELECT 'facts', true, true, count(*) FROM events UNION ALL"
    " SELECT 'missing', false, false, 0",
)
def status(spark: SparkSession, sf: str) -> DataFrame:
    return store_status(
        {"events": table(spark, sf, "events"), "facts": usage(spark, sf), "missing": None}
    )


@query(
    "ingest",
    with_ctes(
        "deduped",
        f"SELECT {day_sql()}, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS tokens,"
        " CAST(0 AS BIGINT) AS second_run FROM (SELECT * FROM deduped QUALIFY row_number() OVER"
        " (PARTITION BY message_uuid, CASE WHEN message_type = 'user' THEN session_id END"
        " ORDER BY ts DESC) = 1) GROUP BY date",
    ),
)
def ingest_twice(spark: SparkSession, sf: str) -> DataFrame:
    # The second run finds no stale file and saves nothing.
    facts = usage(spark, sf)
    store, source = _store(spark), Source(transcript_tree(spark, facts), "claude", "d", "D", "linux")
    ingest(store, [source], now(), glob="*.txt")
    again, _ = ingest(store, [source], now(), glob="*.txt")
    return (
        store.read("usage")
        .groupBy("date")
        .agg(F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"))
        .select(day(), "n", "tokens", F.lit(again).cast("bigint").alias("second_run"))
    )
