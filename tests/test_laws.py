"""Idempotence, order independence, and jobs over log trees that change."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import functions as F

from sparkmeter.operators import push
from sparkmeter.operators.dedupe import dedupe_responses
from sparkmeter.operators.metrics import usage_daily
from sparkmeter.operators.upsert import upsert
from sparkmeter.plans.inputs import accounts, batches, limits, now, pricing, usage
from sparkmeter.schemas import LIMITS
from sparkmeter.session import scratch_path
from sparkmeter.sources.registry import Source
from sparkmeter.store.ingest import (
    close_gaps,
    ingest,
    rebuild,
    save_daily,
    save_full,
    save_pricing,
)
from sparkmeter.store.sinks import (
    PushBlocked,
    clear_guard,
    push_lake,
    push_server,
    repair_server,
)
from sparkmeter.store.merge import merge_into, retry_commit
from sparkmeter.store.tables import Store, on_days
from sparkmeter.streaming.ingest import dashboard_stream, ingest_stream

WHEN = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SHOWN = ["date", "session_id", "message_uuid", "message_type", "total_tokens", "model"]


def store(spark) -> Store:
    return Store(spark, scratch_path(spark, "test"))


def rows(df, *columns):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


def colliding(spark, sf):
    """Two batches whose ids overlap, the second with larger counters on some."""
    first, second = batches(spark, sf)
    uuid = F.concat(F.lit("m"), F.col("id") % 150)
    return first.withColumn("message_uuid", uuid), second.withColumn("message_uuid", uuid)


def test_dedupe_does_not_depend_on_order(spark, sf):
    facts = usage(spark, sf).withColumn("message_uuid", F.concat(F.lit("m"), F.col("id") % 50))
    shuffled = facts.repartition(7, F.rand(1)).sortWithinPartitions(F.rand(2))
    assert rows(dedupe_responses(facts, ["id"])) == rows(dedupe_responses(shuffled, ["id"]))


def test_saving_twice_is_saving_once(spark, sf):
    s = store(spark)
    first, second = colliding(spark, sf)
    assert save_full(s, first, now(), ["id"]) > 0
    save_full(s, second, now(), ["id"])
    facts, daily = rows(s.read("usage")), rows(s.read("daily"))
    for batch in (second, first):
        assert save_full(s, batch, now(), ["id"]) == 0
    assert rows(s.read("usage")) == facts and rows(s.read("daily")) == daily


def test_upgrade_keeps_first_seen_fields_and_never_shrinks(spark, sf):
    s = store(spark)
    base = usage(spark, sf).filter("message_type = 'assistant'").limit(1)
    save_full(s, base, now(), ["id"])
    (old,) = s.read("usage").collect()
    later = base.withColumns(
        {
            "date": F.date_add("date", 3),
            "ts": F.col("ts") + F.expr("INTERVAL 3 DAYS"),
            "session_id": F.lit("other"),
            "model": F.lit("other"),
        }
    )
    save_full(s, later.withColumn("total_tokens", F.col("total_tokens") + 7), now(), ["id"])
    save_full(s, later.withColumn("total_tokens", F.lit(1).cast("bigint")), now(), ["id"])
    (new,) = s.read("usage").collect()
    assert (new.id, new.date, new.session_id, new.model) == (
        old.id, old.date, old.session_id, old.model,
    )
    assert new.total_tokens == old.total_tokens + 7 and new.ts == old.ts + dt.timedelta(days=3)
    assert new.updated_seq > old.updated_seq


def test_ids_are_dense_over_batches(spark, sf):
    s = store(spark)
    for batch in batches(spark, sf):
        save_full(s, batch, now(), ["id"])
    top = s.read("usage").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    assert top.collect()[0].top == top.collect()[0].n


def test_ids_are_unique_and_follow_earlier_batches(spark, sf):
    s, tops = store(spark), [0]
    for batch in colliding(spark, sf):
        known = {r.id for r in s.read("usage").select("id").collect()}
        save_full(s, batch, now(), ["id"])
        ids = [r.id for r in s.read("usage").select("id").collect()]
        assert len(ids) == len(set(ids)) and known <= set(ids)
        assert all(i > tops[-1] for i in set(ids) - known)
        tops.append(max(ids))


def test_upsert_twice_is_once(spark, sf):
    facts = usage(spark, sf).select("id", "total_tokens")
    batch = facts.filter("id % 3 = 0").withColumn("total_tokens", F.lit(0).cast("bigint"))
    once = upsert(facts, batch, ["id"], update_matched=True)
    assert rows(upsert(once, batch, ["id"], update_matched=True)) == rows(once)
    assert rows(upsert(facts, batch, ["id"])) == rows(facts)


def test_upsert_matches_null_keys(spark):
    table = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    batch = spark.createDataFrame([(None, 9), ("b", 3)], "k string, v int")
    assert rows(upsert(table, batch, ["k"], True)) == rows(
        spark.createDataFrame([(None, 9), ("a", 2), ("b", 3)], "k string, v int")
    )


def local_store(spark, sf, condition="true") -> Store:
    s = store(spark)
    facts = usage(spark, sf).filter(condition)
    s.append("usage", facts.withColumn("updated_seq", F.col("id")))
    s.append("limits", limits(spark, sf).select(*LIMITS.names))
    save_pricing(s, pricing(spark))
    return s


def test_push_twice_is_push_once_and_incremental_is_full(spark, sf):
    local, lake, server = local_store(spark, sf, "id < 600"), store(spark), store(spark)
    people = accounts(spark, sf)
    assert push_lake(local, lake, WHEN, people).new_records == 600
    assert push_lake(local, lake, WHEN, people).skipped
    assert push_server(local, server, WHEN).new_records == 600
    assert push_server(local, server, WHEN).skipped

    rest = usage(spark, sf).filter("id >= 600").withColumn("updated_seq", F.col("id"))
    local.append("usage", rest)
    assert push_lake(local, lake, WHEN, people, respect_interval=True).skipped
    push_lake(local, lake, WHEN, people)
    push_server(local, server, WHEN)
    drop = ["last_updated"]
    assert rows(lake.read("usage_daily").drop(*drop)) == rows(
        usage_daily(local.read("usage"), now()).drop(*drop)
    )
    assert rows(server.read("usage")) == rows(local.read("usage"))
    assert rows(lake.read("limits"), "ts") == rows(local.read("limits"), "ts")
    assert rows(server.read("pricing")) == rows(local.read("pricing"))
    assert push_server(local, server, WHEN, full=True).new_records == 0


def test_upgraded_rows_are_pushed_again(spark, sf):
    s, lake = store(spark), store(spark)
    first, second = colliding(spark, sf)
    for batch in (first, second):
        save_full(s, batch, now(), ["id"])
        push_lake(s, lake, WHEN, accounts(spark, sf))
    assert rows(lake.read("usage_daily").drop("last_updated")) == rows(
        usage_daily(s.read("usage"), now()).drop("last_updated")
    )


def test_device_filter_scopes_the_push(spark, sf):
    local, lake = local_store(spark, sf), store(spark)
    push_lake(local, lake, WHEN, accounts(spark, sf), devices=["d1"])
    assert {r.device_id for r in lake.read("usage_daily").collect()} == {"d1"}
    assert {r.device_id for r in lake.read("devices").collect()} == {"d1"}
    assert {r.device_id for r in lake.read("limits").collect()} == {"d1"}


def test_rebuilt_store_drops_the_watermark(spark, sf):
    state = push.set_state(store(spark).read("sync_state"), {"x.usage_watermark": "999999"})
    plan = push.plan_push(usage(spark, sf), limits(spark, sf), state, "x", 0.0).collect()[0]
    assert plan.wm_id is None and plan.new_usage


def test_compaction_every_so_many_pushes(spark, sf):
    local, lake = local_store(spark, sf, "id < 100"), store(spark)
    push_lake(local, lake, WHEN, accounts(spark, sf), compact_every=1)
    assert lake.read("usage_daily").agg(F.sum("records")).collect()[0][0] == 100


def line(i, tokens=10, uuid=None, session="s", day=1, kind="assistant"):
    return json.dumps(
        {
            "type": kind,
            "timestamp": f"2025-05-{day:02}T10:00:{i % 60:02}Z",
            "sessionId": session,
            "uuid": f"u{i}",
            "cwd": "/w",
            "version": "1",
            "message": {"id": uuid or f"m{i}", "model": "x", "usage": {"input_tokens": tokens}},
        }
    )


def add(path, *lines):
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(text + "\n" for text in lines)


def total(s: Store, table="usage"):
    return s.read(table).agg(F.sum("total_tokens")).collect()[0][0]


def test_ingest_follows_grown_new_and_deleted_files(spark, tmp_path):
    s, source = store(spark), Source(str(tmp_path), "claude", "d", "D", "linux")
    add(tmp_path / "a [1].jsonl", line(1), line(2))
    add(tmp_path / "b.jsonl", line(3))
    assert ingest(s, [source], now()) == (3, {})
    assert ingest(s, [source], now()) == (0, {})
    add(tmp_path / "a [1].jsonl", line(4), line(2, tokens=50))
    add(tmp_path / "c.jsonl", line(3), line(5))
    (tmp_path / "b.jsonl").unlink()
    assert ingest(s, [source], now()) == (2, {})
    assert total(s) == 4 * 10 + 50
    assert {r.file_path.rsplit("/", 1)[1] for r in s.read("manifest").collect()} == {
        "a [1].jsonl", "c.jsonl",
    }
    assert ingest(s, [source], now(), force=True) == (0, {})


def test_failed_source_stays_stale_and_others_are_saved(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    for folder in (good, bad):
        folder.mkdir()
        add(folder / "x.jsonl", line(1, session=folder.name, uuid=folder.name))
    sources = [Source(str(bad), "nonsense"), Source(str(good), "claude")]
    s = store(spark)
    saved, failures = ingest(s, sources, now())
    assert saved == 1 and list(failures) == [str(bad)]
    assert s.read("manifest").count() == 1
    saved, failures = ingest(s, [Source(str(bad)), sources[1]], now())
    assert (saved, failures) == (1, {})


def test_aggregate_mode_books_differences(spark, tmp_path):
    s, source = store(spark), Source(str(tmp_path), "claude")
    add(tmp_path / "a.jsonl", line(1), line(2, day=2), line(9, kind="user"))
    assert ingest(s, [source], now(), aggregate=True) == (2, {})
    add(tmp_path / "a.jsonl", line(3, day=2))
    assert ingest(s, [source], now(), aggregate=True) == (1, {})
    daily = {str(r.date): r for r in s.read("daily").collect()}
    assert (daily["2025-05-01"].prompts, daily["2025-05-01"].total_tokens) == (1, 10)
    assert (daily["2025-05-02"].responses, daily["2025-05-02"].total_tokens) == (2, 20)
    assert s.read("ledger").count() == 2


def test_tracked_file_without_ledger_changes_nothing_at_first(spark, tmp_path):
    s, source = store(spark), Source(str(tmp_path), "claude")
    add(tmp_path / "a.jsonl", line(1))
    ingest(s, [source], now())
    before = rows(s.read("daily"))
    add(tmp_path / "a.jsonl", line(2))
    assert ingest(s, [source], now(), aggregate=True) == (0, {})
    assert rows(s.read("daily")) == before
    add(tmp_path / "a.jsonl", line(3))
    assert ingest(s, [source], now(), aggregate=True) == (1, {})


def test_additive_days_and_gap_fill(spark, sf, tmp_path):
    s = store(spark)
    assert save_daily(s, usage(spark, sf), now()) == 30
    assert save_daily(s, usage(spark, sf), now()) == 30
    assert total(s, "daily") == 2 * usage(spark, sf).agg(F.sum("total_tokens")).collect()[0][0]
    source = Source(str(tmp_path), "claude")
    add(tmp_path / "a.jsonl", line(1, day=1), line(2, day=5))
    s = store(spark)
    ingest(s, [source], now())
    assert close_gaps(s, dt.date(2025, 5, 8), now()) == 6
    assert close_gaps(s, dt.date(2025, 5, 8), now()) == 0
    assert s.read("daily").count() == 8


def test_rebuild_guard_and_repair(spark, tmp_path):
    s, server = store(spark), store(spark)
    source = Source(str(tmp_path), "claude", "d", "D", "linux")
    add(tmp_path / "a.jsonl", line(1, day=1), line(2, day=2, session="gone"), line(3, day=3))
    ingest(s, [source], now())
    push_server(s, server, WHEN)
    foreign = s.read("usage").limit(1).withColumns(
        {"device_id": F.lit("other"), "message_uuid": F.lit("foreign")}
    )
    server.append("usage", foreign)
    # The day-3 line moves to day 4 and the file of the other session ages out.
    (tmp_path / "a.jsonl").write_text(line(1, day=1) + "\n" + line(3, day=4) + "\n")
    assert rebuild(s, [source], now(), "t1") == 2
    assert sorted(str(r.date) for r in s.read("usage").collect()) == [
        "2025-05-01", "2025-05-02", "2025-05-04",
    ]
    assert sorted(str(r.date) for r in s.read("daily").collect()) == [
        "2025-05-01", "2025-05-02", "2025-05-04",
    ]
    with pytest.raises(PushBlocked):
        push_server(s, server, WHEN)
    repair_server(s, server, "t1")
    assert server.read("usage").filter("device_id = 'other'").count() == 1
    assert server.read("usage").count() == 4
    assert push_server(s, server, WHEN).new_records == 0
    clear_guard(s)


def test_repair_stops_when_rows_cannot_be_told_apart(spark, sf):
    local, server = local_store(spark, sf), store(spark)
    unknown = usage(spark, sf).withColumn("device_id", F.lit(None).cast("string"))
    local.append("usage", unknown.limit(1))
    server.append("usage", unknown.limit(1))
    with pytest.raises(RuntimeError):
        repair_server(local, server, "t")


def test_stream_takes_new_files_once(spark, tmp_path):
    s, source = store(spark), Source(str(tmp_path), "claude")
    checkpoint = scratch_path(spark, "cp")
    add(tmp_path / "a.jsonl", line(1), line(2))
    add(tmp_path / "b.jsonl", line(2, tokens=70))
    for extra in ("c", "d"):
        ingest_stream(s, source, checkpoint, now(), files_per_trigger=1).awaitTermination()
        add(tmp_path / f"{extra}.jsonl", line(1), line(10 + ord(extra)))
    ingest_stream(s, source, checkpoint, now()).awaitTermination()
    assert total(s) == 10 + 70 + 10 + 10


def test_dashboard_from_the_rollup(spark, tmp_path):
    add(tmp_path / "a.jsonl", line(1), line(2, day=2), line(9, kind="user", session="t"))
    shown = []
    dashboard_stream(
        store(spark), Source(str(tmp_path), "claude"), scratch_path(spark, "cp"), now(),
        lambda df: shown.append(df.collect()[0].asDict()), interval=None, distinct_sessions=False,
    ).awaitTermination()
    assert shown == [{"tokens": 20, "prompts": 1, "sessions_daily_sum": 3, "active_days": 2}]


def test_commit_conflicts_are_tried_again():
    waits, calls = [], []

    class Conflict(Exception):
        pass

    def commit():
        calls.append(1)
        if len(calls) < 3:
            raise Conflict
        return "done"

    assert retry_commit(commit, Conflict, wait=waits.append) == "done"
    assert waits == [1, 2] and len(calls) == 3
    calls.clear()
    with pytest.raises(Conflict):
        retry_commit(lambda: (_ for _ in ()).throw(Conflict()), Conflict, wait=waits.append)
    with pytest.raises(ValueError):
        retry_commit(lambda: int("x"), Conflict, wait=waits.append)


def test_merge_needs_a_table_format_that_supports_it(spark):
    spark.sql("CREATE OR REPLACE TEMP VIEW held AS SELECT 1 AS k")
    with pytest.raises(UnsupportedOperationException):
        merge_into(spark.range(1).withColumnRenamed("id", "k"), "held", ["k"], True)


def test_days_are_read_by_their_partitions(spark, sf):
    facts = usage(spark, sf)
    days = facts.filter("day(date) < 5").select("date").distinct()
    assert rows(on_days(facts, days)) == rows(facts.filter("day(date) < 5"))
    assert rows(on_days(facts, days.limit(0))) == []
