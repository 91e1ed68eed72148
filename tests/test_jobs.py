"""Commits, indexes, growing logs, keyed state, merges and upkeep of a store."""

from __future__ import annotations

import datetime as dt
import os
import random
import re
import time

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F
from test_laws import SHOWN, WHEN, add, line, rows, total
from test_scale import plan_of

from sparkmeter.operators.metrics import usage_daily
from sparkmeter.operators.sessions import distinct_sessions, first_days, number_sessions, session_bits
from sparkmeter.plans.inputs import accounts, batches, limits, now, usage
from sparkmeter.plans.jobs import FailingStore, Lost, repeated
from sparkmeter.schemas import DAILY_MEASURES, LIMITS
from sparkmeter.session import scratch, scratch_path, scratch_root, settle
from sparkmeter.sources.registry import Source
from sparkmeter.store import ingest as jobs
from sparkmeter.store.index import catch_up, held_rows, last_number, refresh_sessions
from sparkmeter.store.ingest import ingest, ingest_registry, rebuild, save_daily, save_files, save_full
from sparkmeter.store.merging import merge_trees
from sparkmeter.store.sinks import push_lake, push_server
from sparkmeter.store.tables import Store, on_values
from sparkmeter.store.views import describe_store, query_store
from sparkmeter.streaming.ingest import follow_logs, store_kpis
from sparkmeter.streaming.state import largest_usage_stream, rollout_pieces_stream, start_available


def new_store(spark, kind=Store):
    return kind(spark, scratch_path(spark, "test"))


def colliding(spark, sf):
    first, second = batches(spark, sf)
    uuid = F.concat(F.lit("m"), F.col("id") % 150)
    return first.withColumn("message_uuid", uuid), second.withColumn("message_uuid", uuid)


def state_of(store):
    return {
        "usage": rows(store.read("usage").drop("id", "updated_seq"), *SHOWN),
        "daily": rows(store.read("daily"), "date", *DAILY_MEASURES),
        "ledger": rows(store.read("ledger")),
        "manifest": rows(store.read("manifest"), "file_path", "size_bytes"),
    }


# --- commits ---------------------------------------------------------------------------------


def test_a_save_lost_at_any_write_changes_nothing_until_repeated(spark, sf):
    plain, broken = new_store(spark), new_store(spark, FailingStore)
    first, second = (b.filter("day(date) < 4") for b in colliding(spark, sf))
    for store in (plain, broken):
        save_full(store, first, now(), ["id"])
    save_full(plain, second, now(), ["id"])
    before = state_of(broken)
    for step in range(1, 9):
        broken.fail_after = step
        try:
            save_full(broken, second, now(), ["id"])
            break
        except Lost:
            assert state_of(broken) == before
    assert 3 < step < 8
    assert state_of(broken) == state_of(plain)
    assert broken.files.names("*/*/written=*") and not broken.files.exists("_commits/open")


def test_a_larger_replay_on_another_day_is_right_after_a_loss(spark, tmp_path):
    store = new_store(spark, FailingStore)
    source = Source(str(tmp_path), "claude")
    add(tmp_path / "a.jsonl", line(1, tokens=10, day=2))
    ingest(store, [source], now())
    add(tmp_path / "b.jsonl", line(1, tokens=50, day=4))
    store.fail_after = 2
    _, failures = ingest(store, [source], now())
    assert failures and total(store) == 10
    assert ingest(store, [source], now()) == (0, {})
    assert total(store) == 50 and total(store, "daily") == 50


def test_a_ledger_save_lost_at_any_write_counts_once(spark, sf):
    facts = usage(spark, sf).filter("day(date) < 4").withColumn(
        "file_path", F.concat(F.lit("f"), F.col("id") % 5)
    )
    expected = new_store(spark)
    save_files(expected, facts, now())
    for step in (1, 2):
        store = new_store(spark, FailingStore)
        repeated(store, lambda store=store: save_files(store, facts, now()), [step])
        assert state_of(store) == state_of(expected)


def test_a_rebuild_lost_at_any_write_is_made_good(spark, tmp_path):
    source = Source(str(tmp_path), "claude", "d", "D", "linux")
    add(tmp_path / "a.jsonl", line(1, day=1), line(2, day=2), line(3, day=3, session="t"))
    done = None
    for step in (2, 5):
        store = new_store(spark, FailingStore)
        save_full_of = ingest(store, [source], now(), force=True)
        assert save_full_of[1] == {}
        with open(tmp_path / "a.jsonl", encoding="utf-8") as f:
            text = f.read()
        (tmp_path / "a.jsonl").write_text(line(1, tokens=99, day=1) + "\n")
        before, failures = state_of(store), {}
        store.fail_after = step + 1  # the state of the guard is written first
        rebuild(store, [source], now(), "t", failures=failures)
        if failures:
            assert state_of(store) == before
        store.fail_after = None
        rebuild(store, [source], now(), "t2")
        done = done or state_of(store)
        assert state_of(store) == done and total(store) == 99 + 10
        (tmp_path / "a.jsonl").write_text(text)


def test_what_a_lost_writer_left_is_removed(spark, sf):
    store = new_store(spark)
    store.append("daily", store.read("daily").limit(0))
    save_daily(store, usage(spark, sf), now())
    number, pointer, _ = store._journal.begin()
    store._open = pointer
    store._write("daily", store.read("daily"))  # the driver is lost here
    store._open = None
    again = Store(spark, store.path)
    assert again.read("daily").count() == 30
    assert len(again.files.names("daily/written=*")) == 2
    again.append("daily", again.read("daily").limit(1))
    assert again.read("daily").count() == 31


def test_a_named_batch_is_applied_once(spark, sf):
    store = new_store(spark)
    facts = usage(spark, sf)
    assert save_daily(store, facts, now(), "monday") == 30
    assert save_daily(store, facts, now(), "monday") == 0
    assert save_daily(store, facts, now(), "tuesday") == 30
    assert total(store, "daily") == 2 * facts.agg(F.sum("total_tokens")).collect()[0][0]
    assert save_full(store, facts, now(), ["id"], "monday") == 0
    assert store.read("usage").count() == 0


def test_the_writer_that_began_last_owns_the_store(spark, sf):
    store, other = new_store(spark), None
    readings = limits(spark, sf).select(*LIMITS.names)
    with pytest.raises(RuntimeError, match="another writer"), store.commit():
        store.append("limits", readings)
        other = Store(spark, store.path)
        other.append("limits", readings.limit(1))
    assert store.read("limits").count() == 1
    with pytest.raises(RuntimeError, match="another writer"), store.commit():
        store.append("limits", readings)
        with other.commit():
            other.append("limits", readings.limit(2))
            with pytest.raises(RuntimeError, match="another writer"):
                store._journal.commit(store._journal.latest()[0] + 1, store.pointer())
    assert store.read("limits").count() == 3


def test_rows_stay_readable_while_their_table_is_replaced(spark, sf):
    store = new_store(spark)
    store.append("usage", usage(spark, sf))
    held = store.read("usage")
    store.replace("usage", held.filter("id < 10"))
    store.replace_partitions("usage", held.limit(0), [dt.date(2024, 1, 1)])
    assert held.count() == usage(spark, sf).count()
    assert store.read("usage").filter("date = '2024-01-01'").isEmpty()


def test_a_failed_part_of_a_commit_is_taken_back_alone(spark, sf):
    store = new_store(spark)
    readings = limits(spark, sf).select(*LIMITS.names)
    with store.commit():
        store.append("limits", readings.limit(2))
        with pytest.raises(Exception), store.commit():  # noqa: B017
            store.append("limits", readings.limit(3))
            raise ValueError
    assert store.read("limits").count() == 2


def test_null_days_are_replaced_like_others(spark, sf):
    store = new_store(spark)
    facts = usage(spark, sf).limit(4).withColumn("date", F.lit(None).cast("date"))
    store.append("usage", facts)
    store.replace_partitions("usage", facts.limit(1))
    assert store.read("usage").count() == 1
    store.replace_partitions("usage", facts.limit(0), [None])
    assert store.read("usage").count() == 0


# --- indexes ---------------------------------------------------------------------------------


def test_a_save_reads_the_folders_and_days_of_its_ids(spark, sf):
    store = new_store(spark)
    save_full(store, usage(spark, sf), now(), ["id"])
    wanted = usage(spark, sf).filter("id = 17").select("message_uuid")
    held = held_rows(store, wanted)
    plan = plan_of(held)
    (day,) = {str(r.date) for r in held.select("date").collect()}
    (filters,) = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    assert set(re.findall(r"2024-\d\d-\d\d", filters)) == {day}
    keys = plan_of(on_values(store.read("keys"), "bucket", [3]))
    assert re.search(r"PartitionFilters: \[.*bucket#\d+L? = 3", keys)
    assert len(store.files.names("keys/bucket=*")) == store.pointer().buckets


def test_index_follows_facts_written_without_it(spark, sf):
    store = new_store(spark)
    first, second = colliding(spark, sf)
    store.append("usage", first.withColumn("updated_seq", F.col("id")).limit(40))
    catch_up(store)
    parts = store.pointer().last
    catch_up(store)
    assert store.pointer().last == parts  # nothing left to do
    top = store.read("usage").agg(F.max("id")).collect()[0][0]
    assert last_number(store) == top
    held = {r.message_uuid for r in held_rows(store, second).collect()}
    both = store.read("usage").join(second, "message_uuid", "left_semi")
    assert held == {r.message_uuid for r in both.collect()}


def test_numbers_never_come_back(spark, sf, tmp_path):
    store, lake = new_store(spark), new_store(spark)
    source = Source(str(tmp_path), "claude", "d", "D", "linux")
    add(tmp_path / "a.jsonl", *[line(i, day=1 + i % 3) for i in range(9)])
    ingest(store, [source], now())
    people, tag = accounts(spark, sf), 0
    push_lake(store, lake, WHEN, people)
    for texts in ([line(1, tokens=1000)], [line(i, day=1 + i % 5) for i in range(20)],
                  [line(2, day=9)]):
        seen = last_number(store)
        (tmp_path / "a.jsonl").write_text("\n".join(texts) + "\n")
        tag += 1
        assert rebuild(store, [source], now(), f"t{tag}") == len(texts)
        assert store.read("usage").agg(F.min("id")).collect()[0][0] > seen
        assert not push_lake(store, lake, WHEN, people).skipped
        drop = ["last_updated"]
        assert rows(lake.read("usage_daily").drop(*drop)) == rows(
            usage_daily(store.read("usage"), now()).drop(*drop)
        )


def test_rebuild_skips_a_failing_source_and_notes_files(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    for folder in (good, bad):
        folder.mkdir()
        add(folder / "x.jsonl", line(1, session=folder.name, uuid=folder.name))
    sources = [Source(str(bad), "claude", "b"), Source(str(good), "claude", "g")]
    store, failures = new_store(spark), {}
    ingest(store, sources, now())
    add(good / "x.jsonl", line(2, session="good", uuid="more"))
    broken = [Source(str(bad), "nonsense", "b"), sources[1]]
    assert rebuild(store, broken, now(), "t", failures=failures) == 2
    assert list(failures) == [str(bad)] and store.read("usage").count() == 3
    assert ingest(store, sources, now()) == (0, {})
    with pytest.raises(RuntimeError, match="not rebuilt"):
        rebuild(store, broken, now(), "u")


class CountingStore(FailingStore):
    """A store that notes which tables are written."""

    def _write(self, name, rows):
        self.written = [*getattr(self, "written", []), name]
        return super()._write(name, rows)


def random_logs(root, sources, seed, sessions):
    """Logs of some devices with common sessions and ids; no id is a response's and a prompt's."""
    pick = random.Random(seed)
    for source in sources:
        os.makedirs(source.path, exist_ok=True)
        lines = [
            line(
                pick.randrange(60), tokens=pick.randrange(1, 40), uuid=f"m{pick.randrange(60)}",
                session=f"s{pick.choice(sessions)}", day=pick.randrange(1, 5),
                kind=pick.choice(["assistant", "assistant", "user"]),
            )
            for _ in range(80)
        ]
        with open(f"{source.path}/x.jsonl", "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")


def test_sources_rebuilt_together_are_as_one_after_the_other(spark, tmp_path, monkeypatch):
    sources = [Source(str(tmp_path / d), "claude", d, d, "linux") for d in ("a", "b", "c")]
    random_logs(tmp_path, sources, 1, range(9))
    both = [new_store(spark, CountingStore) for _ in range(2)]
    for store in both:
        ingest(store, sources, now())
    random_logs(tmp_path, sources, 2, range(5))
    found = []
    for store, together in zip(both, (32, 1), strict=True):
        monkeypatch.setattr(jobs, "REBUILT_TOGETHER", together)
        store.written = []
        count = rebuild(store, sources, now(), "t")
        catch_up(store)
        assert store.written.count("usage") == (1 if together > 1 else 3)
        lost = store.read("touched").filter("shrunk").select("date", "device_id").distinct()
        facts = store.read("usage").drop("id", "updated_seq")
        found.append((count, rows(facts), rows(lost), state_of(store)))
        assert store.read("usage").select("id").distinct().count() == facts.count()
    assert found[0] == found[1] and found[0][0] > 60


@pytest.mark.parametrize("device", ["a", "b"])
def test_sources_whose_order_matters_are_rebuilt_one_by_one(spark, tmp_path, device):
    # The same session of one device, or an id of a response and of a prompt.
    sources = [Source(str(tmp_path / n), "claude", d) for n, d in (("x", "a"), ("y", device))]
    store = new_store(spark, CountingStore)
    for source, kind in zip(sources, ("assistant", "user"), strict=True):
        os.mkdir(source.path)
        add(tmp_path / source.path / "x.jsonl", line(1, uuid="u1", kind=kind))
    assert rebuild(store, sources, now(), "t") == 2 - (device == "b")
    assert store.written.count("usage") == 2
    # Of one device the later source's session stays; of two the earlier response is known.
    kept = "user" if device == "a" else "assistant"
    assert [r.message_type for r in store.read("usage").collect()] == [kept]


def test_a_failed_commit_of_several_sources_is_made_for_each(spark, tmp_path):
    sources = [Source(str(tmp_path / d), "claude", d) for d in ("a", "b")]
    store, failures = new_store(spark, CountingStore), {}
    for source in sources:
        os.mkdir(source.path)
        add(tmp_path / source.path / "x.jsonl", line(1, uuid=source.device_id))
    store.fail_after = 3  # after the guard, the facts of both, and their keys
    assert rebuild(store, sources, now(), "t", failures=failures) == 2
    assert failures == {} and store.written.count("usage") == 3
    assert store.read("usage").count() == 2 and store.read("manifest").count() == 2


def test_jobs_leave_no_scratch_behind(spark, sf, tmp_path):
    store, lake, server = (new_store(spark) for _ in range(3))
    source = Source(str(tmp_path), "claude")
    add(tmp_path / "a.jsonl", line(1), line(2, day=2))
    for name in ("usage", "x"):
        with scratch(spark):
            settle(usage(spark, sf), name)

    def left():
        root = scratch_root(spark).removeprefix("file:")
        stores = {s.path.rsplit("/", 1)[1] for s in (store, lake, server)}
        return set(os.listdir(root)) - stores

    before = left()
    ingest(store, [source], now(), today=dt.date(2025, 5, 4))
    save_full(store, usage(spark, sf), now(), ["id"])
    push_lake(store, lake, WHEN, accounts(spark, sf))
    push_server(store, server, WHEN)
    rebuild(store, [source], now(), "t")
    refresh_sessions(store)
    assert {name for name in left() - before if not name.startswith("ranked-")} == set()
    assert store.read("daily").filter("date = '2025-05-04'").count() == 1


def test_registry_entries_become_sources(spark, tmp_path):
    add(tmp_path / "a.jsonl", line(1))
    entries = [
        (str(tmp_path), "other", "dev-1", "One", "linux"),
        ("", "claude", "dev-2", "Two", "linux"),
        (str(tmp_path), "claude", "bad id", "Three", "linux"),
    ]
    schema = "path string, format string, device_id string, device_name string, device_type string"
    store = new_store(spark)
    assert ingest_registry(store, spark.createDataFrame(entries, schema), now()) == (1, {})
    assert [r.device_id for r in store.read("usage").collect()] == ["dev-1"]


# --- sessions --------------------------------------------------------------------------------


def test_bitmaps_count_any_slice_exactly(spark, sf):
    facts = usage(spark, sf).withColumn(
        "session_id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 199))
    )
    facts = facts.withColumn("session_id", F.when(F.col("id") % 50 != 1, F.col("session_id")))
    numbers = number_sessions(first_days(facts))
    assert sorted(r.session_no for r in numbers.collect()) == list(range(numbers.count()))
    bits = session_bits(facts, numbers)
    for by in (["model"], ["device_id", "folder"], ["date"]):
        expected = facts.groupBy(*by).agg(F.count_distinct("session_id").alias("sessions"))
        assert rows(distinct_sessions(bits, by)) == rows(expected.filter("sessions > 0"), *by, "sessions")
    union = distinct_sessions(bits.filter("model = 'model-a' OR device_id = 'd2'"))
    expected = facts.filter("model = 'model-a' OR device_id = 'd2'").agg(F.count_distinct("session_id"))
    assert union.collect()[0][0] == expected.collect()[0][0]
    assert "Expand" not in plan_of(distinct_sessions(bits, ["model"]))
    assert distinct_sessions(bits.limit(0)).collect()[0][0] == 0


def test_session_figures_follow_the_store(spark, tmp_path):
    store, source = new_store(spark), Source(str(tmp_path), "claude")
    add(tmp_path / "a.jsonl", line(1), line(2, day=2), line(9, kind="user", session="t"))
    ingest(store, [source], now())
    expected = {"tokens": 20, "prompts": 1, "sessions": 2, "active_days": 2}
    assert store_kpis(store).collect()[0].asDict() == expected
    add(tmp_path / "b.jsonl", line(5, day=2, session="u"))
    ingest(store, [source], now())
    assert store_kpis(store).collect()[0].asDict() == expected | {"tokens": 30, "sessions": 3}


# --- streams ---------------------------------------------------------------------------------


def test_ticks_follow_appended_new_and_deleted_files(spark, tmp_path):
    logs, bad = tmp_path / "logs", tmp_path / "bad"
    logs.mkdir()
    bad.mkdir()
    store, checkpoint = new_store(spark), scratch_path(spark, "cp")
    sources = [Source(str(logs), "claude"), Source(str(bad), "nonsense")]
    shown, failed = [], []

    def tick():
        follow_logs(
            store, sources, checkpoint, now, then=lambda s: shown.append(total(s)), failed=failed.append
        ).awaitTermination()

    add(logs / "a.jsonl", line(1), line(2))
    add(bad / "x.jsonl", line(3, uuid="late"))
    tick()
    assert shown == [20] and len(failed) == 1
    tick()
    assert shown == [20]  # nothing changed
    add(logs / "a.jsonl", line(4), line(2, tokens=30))
    add(logs / "b.jsonl", line(5))
    sources[1] = Source(str(bad), "claude")
    follow_logs(
        store, sources, checkpoint, now, then=lambda s: shown.append(total(s))
    ).awaitTermination()
    assert shown == [20, 10 + 30 + 10 + 10 + 10]
    (logs / "b.jsonl").unlink()
    tick()
    assert store.read("manifest").count() == 2 and total(store) == 70


def test_a_running_stream_sees_an_appended_line(spark, tmp_path):
    store = new_store(spark)
    add(tmp_path / "a.jsonl", line(1))
    query = follow_logs(
        store, [Source(str(tmp_path), "claude")], scratch_path(spark, "cp"), now, interval="1 second"
    )
    try:
        for expected in (10, 20):
            end = time.time() + 60
            while total(store) != expected and time.time() < end:
                time.sleep(0.5)
            assert total(store) == expected
            add(tmp_path / "a.jsonl", line(2))
    finally:
        query.stop()


def run_stream(df, target, checkpoint, mode):
    writer = df.writeStream.foreachBatch(
        lambda batch, _: batch.write.mode("append").parquet(target)
    ).outputMode(mode).option("checkpointLocation", checkpoint)
    query = start_available(writer, df.sparkSession)
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_state_of_replays_is_bounded_by_its_time_to_live(spark, sf):
    facts = usage(spark, sf).filter("message_type = 'assistant'").limit(40)
    path, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    facts.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(facts.schema).parquet(path)
    days = 2 / 24 / 3600  # two seconds
    held = run_stream(largest_usage_stream(stream, ["id"], days), target, checkpoint, "update")
    passed = spark.read.parquet(target).count()
    assert held == passed == facts.select("message_uuid").distinct().count()
    time.sleep(3)
    other = facts.limit(3).withColumn("message_uuid", F.concat(F.lit("new"), F.col("id")))
    other.coalesce(1).write.mode("append").parquet(path)
    held = run_stream(largest_usage_stream(stream, ["id"], days), target, checkpoint, "update")
    assert held == 3 and spark.read.parquet(target).count() == passed + 3


def test_replays_pass_only_when_they_are_larger(spark, sf):
    base = usage(spark, sf).filter("message_type = 'assistant'").limit(1)
    path, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    base.limit(0).write.parquet(path)
    stream = spark.readStream.schema(base.schema).parquet(path)
    for tokens in (10, 10, 7, 30):
        rows_ = base.withColumn("total_tokens", F.lit(tokens).cast("bigint"))
        rows_.unionByName(rows_).coalesce(1).write.mode("append").parquet(path)
        run_stream(largest_usage_stream(stream, ["id"]), target, checkpoint, "update")
    passed = spark.read.parquet(target)
    assert sorted(r.total_tokens for r in passed.collect()) == [10, 30]


def test_replays_of_many_keys_share_a_group(spark, sf):
    # Ids, a prompt's session and no id are kept apart inside the only bucket.
    base = usage(spark, sf).limit(1)
    path, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    base.limit(0).write.parquet(path)
    stream = spark.readStream.schema(base.schema).parquet(path)
    schema = "message_uuid string, message_type string, session_id string, total_tokens bigint, id bigint"
    first = [
        ("a", "assistant", "s", 5, 1), ("a", "assistant", "t", 5, 0), ("b", "assistant", "s", 7, 2),
        ("a", "user", "s", 0, 3), ("a", "user", "t", 0, 4), (None, "assistant", "s", 1, 5),
    ]
    later = [("a", "assistant", "s", 5, 6), ("b", "assistant", "s", 9, 7), ("a", "user", "s", 0, 8)]
    for given in (first, later):
        new = spark.createDataFrame(given, schema)
        others = base.drop(*new.columns)
        new.join(others).select(base.columns).coalesce(1).write.mode("append").parquet(path)
        held = run_stream(largest_usage_stream(stream, ["id"], buckets=1), target, checkpoint, "update")
        assert held == 1
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 2, 3, 4, 5, 7]


def test_a_key_of_a_bucket_goes_when_it_is_due(spark, sf):
    base = usage(spark, sf).filter("message_type = 'assistant'").limit(1)
    path, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    base.limit(0).write.parquet(path)
    stream = spark.readStream.schema(base.schema).parquet(path)
    days = 2 / 24 / 3600  # two seconds
    for ids in (("a",), ("b",), ("a", "b")):
        new = base.drop("message_uuid").withColumn("message_uuid", F.explode(F.array(*map(F.lit, ids))))
        new.select(base.columns).coalesce(1).write.mode("append").parquet(path)
        run_stream(
            largest_usage_stream(stream, ["id"], days, buckets=1), target, checkpoint, "update"
        )
        time.sleep(3 if ids == ("a",) else 0)
    passed = [r.message_uuid for r in spark.read.parquet(target).collect()]
    assert sorted(passed)[:2] == ["a", "a"] and "b" in passed


def test_rollouts_of_one_group_keep_their_own_context(spark):
    import json

    def context(model):
        return json.dumps({"type": "turn_context", "payload": {"model": model, "cwd": "/w"}})

    usage_ = {"input_tokens": 1, "cached_input_tokens": 0, "output_tokens": 1}
    info = {"type": "token_count", "info": {"last_token_usage": usage_}}
    turn = json.dumps({"type": "event_msg", "timestamp": "2025-05-01T10:00:00Z", "payload": info})
    path, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    schema = "file_path string, piece bigint, chunk bigint, pos bigint, value string"
    spark.createDataFrame([], schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    for k, texts in enumerate(([context("{}"), turn], [turn, turn])):
        own = [
            (f"/l/{f}.jsonl", k, 0, 2 * p + n, t.replace("{}", f))
            for p, t in enumerate(texts)
            for n, f in enumerate("xy")
        ]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(path)
        held = run_stream(
            rollout_pieces_stream(stream, now(), buckets=1), target, checkpoint, "append"
        )
        assert held == 1
    got = sorted((r.message_uuid, r.model) for r in spark.read.parquet(target).collect())
    assert got == [(f"{f}:t{n}", f) for f in "xy" for n in (1, 2, 3)]


def test_rollout_context_goes_on_over_batches(spark):
    import json

    def context(model):
        return json.dumps({"type": "turn_context", "payload": {"model": model, "cwd": "/w"}})

    def turn(n):
        usage_ = {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": 1}
        info = {"type": "token_count", "info": {"last_token_usage": usage_}}
        return json.dumps({"type": "event_msg", "timestamp": "2025-05-01T10:00:00Z", "payload": info})

    path, target, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    schema = "file_path string, piece bigint, chunk bigint, pos bigint, value string"
    spark.createDataFrame([], schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    pieces = [[turn(1), context("a"), turn(2)], [turn(3)], ["{broken", context("b"), turn(0), turn(4)]]
    for k, texts in enumerate(pieces):
        own = [("/l/s.jsonl", k, 0, p, t) for p, t in enumerate(texts)]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(path)
        run_stream(rollout_pieces_stream(stream, now()), target, checkpoint, "append")
    got = sorted((r.message_uuid, r.model, r.input_tokens) for r in spark.read.parquet(target).collect())
    assert got == [("s:t1", "codex-unknown", 1), ("s:t2", "a", 2), ("s:t3", "a", 3),
                   ("s:t4", "b", 0), ("s:t5", "b", 4)]


# --- merges and upkeep -----------------------------------------------------------------------


def test_merged_trees(spark, tmp_path):
    host, incoming = tmp_path / "host", tmp_path / "incoming"
    (host / "p").mkdir(parents=True)
    (incoming / "p" / "q").mkdir(parents=True)
    add(host / "p" / "a.jsonl", line(1), "{broken", line(2))
    add(host / "only.jsonl", line(7))
    add(incoming / "p" / "a.jsonl", line(2), line(3), line(3), "", "nonsense", '{"type": "x"}')
    add(incoming / "p" / "q" / "new [1].jsonl", line(4), "{", '{"type": "x"}')
    add(incoming / "bad.jsonl", "{", "[1]")
    merged = merge_trees(spark, str(host), str(incoming))
    assert (merged.files, merged.records, merged.skipped_lines, merged.skipped_files) == (2, 3, 4, 1)
    after = (host / "p" / "a.jsonl").read_text().splitlines()
    assert after == [line(1), "{broken", line(2), line(3)]
    assert (host / "p" / "q" / "new [1].jsonl").read_text().splitlines()[0] == line(4)
    assert not (host / "bad.jsonl").exists() and (host / "only.jsonl").read_text() == line(7) + "\n"
    assert merge_trees(spark, str(host), str(incoming)).records == 0
    assert (host / "p" / "a.jsonl").read_text().splitlines() == after
    assert merge_trees(spark, str(host), str(tmp_path / "none")).files == 0
    fresh = merge_trees(spark, str(tmp_path / "fresh"), str(incoming))
    assert fresh.files == 2 and (tmp_path / "fresh" / "p" / "a.jsonl").exists()


def test_only_crowded_days_are_compacted_and_old_files_kept(spark, sf):
    store = new_store(spark)
    facts = usage(spark, sf)
    store.append("usage", facts.filter("day(date) > 2"))
    for k in range(4):
        store.append("usage", facts.filter("day(date) <= 2").filter(F.col("id") % 4 == k))
    catch_up(store)
    quiet = rows(store.file_sizes("usage").filter("day > '2024-01-02'"), "path")
    held = store.read("usage")
    assert store.compact("usage", files=3) == ["2024-01-01", "2024-01-02"]
    assert store.is_covered("keys") and store.is_covered("touched")
    assert rows(store.file_sizes("usage").filter("day > '2024-01-02'"), "path") == quiet
    assert store.compact("usage", files=3) == []
    assert held.count() == facts.count()  # replaced files are still there
    assert store.vacuum(keep=3600) == 0
    assert store.vacuum(keep=3600, now=time.time() + 7200) == 8
    assert rows(store.read("usage")) == rows(facts)
    for _ in range(4):
        store.append("devices", store.read("devices").limit(0))
        save_daily(store, facts, now())
    assert store.compact("daily", files=0, size=1 << 30) in ([], [""])


def test_ad_hoc_queries_only_read(spark, sf):
    store = new_store(spark)
    store.append("usage", usage(spark, sf))
    n = usage(spark, sf).count()
    assert query_store(store, "SELECT count(*) AS n FROM usage;").collect()[0].n == n
    assert query_store(store, "SELECT id FROM usage", limit=5).count() == 5
    quoted = query_store(store, "SELECT count(*) AS n FROM usage WHERE model = :m", {"m": "x' OR '1'='1"})
    assert quoted.collect()[0].n == 0
    for text in ("DROP VIEW usage", "INSERT INTO usage SELECT * FROM usage", "SET a = b",
                 "SELECT 1) UNION (SELECT 2; DROP VIEW daily"):
        with pytest.raises((ParseException, AnalysisException)):
            query_store(store, text).collect()
    with pytest.raises(AnalysisException):
        spark.table("usage")  # views stay in their own session
    assert query_store(store, "SELECT * FROM limits").count() == 0
    assert {"usage", "daily"} <= {r.table for r in describe_store(store).collect()}
