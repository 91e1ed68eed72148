"""Ingest jobs: save facts, keep the rollup, ledger and manifest, rebuild sessions.

Each job makes one commit per batch (``Store.commit``): facts, rollup, ledger, manifest and indexes
change together, and a batch that failed anywhere left nothing behind when it is repeated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.operators.calendar import fill_gaps, missing_days
from sparkmeter.operators.dedupe import batch_gate
from sparkmeter.operators.facts import (
    apply_upgrades,
    delete_sessions,
    deleted_dates,
    largest_of,
    mark_sessions,
    new_rows,
    order_matters,
    shared_ids,
    upgrades,
)
from sparkmeter.operators.metrics import coverage
from sparkmeter.operators.push import GUARD, set_state
from sparkmeter.operators.ranking import number_places, with_places
from sparkmeter.operators.rollup import (
    apply_ledger_delta,
    file_contribution,
    ledger_changes,
    newly_counted,
    recompute_daily,
    refresh_daily,
    replace_ledger,
    save_additive,
)
from sparkmeter.schemas import PRICING, USAGE, conform
from sparkmeter.session import scratch, settle
from sparkmeter.sources.logs import list_files, scan_logs
from sparkmeter.sources.manifest import (
    needs_parsing,
    prune_manifest,
    stale_files,
    update_manifest,
)
from sparkmeter.sources.pricing import upsert_pricing
from sparkmeter.sources.registry import Source, parse_source, registered_sources, union_all
from sparkmeter.store.index import catch_up, held_rows, key_rows, last_number, shrink_rows
from sparkmeter.store.journal import GLOB_CHARS
from sparkmeter.store.tables import Store, day_list, on_values

POSITION = ["file_path", "chunk", "pos"]
#: Stale files are read, saved and noted in the manifest together up to this many bytes and paths.
BATCH_BYTES = 256 << 30
BATCH_FILES = 100_000
#: Sources that a rebuild takes into one commit.
REBUILT_TOGETHER = 32


def save_full(
    store: Store,
    staging: DataFrame,
    now: Column,
    tiebreak: list[str] | None = None,
    batch: str | None = None,
) -> int:
    """Save a batch of facts: upgrade larger repeats, add unknown rows, refresh their days.

    New rows are appended; only days with an upgraded row are rewritten, and only days that may hold
    an id of the batch are read. Saving a batch again changes nothing; one whose name (``batch``) was
    saved before is not even read. Returns the number of rows added.
    """
    with store.commit(batch) as fresh, scratch(store.spark):
        if not fresh:
            return 0
        catch_up(store)
        first = last_number(store)
        gated = _gated(staging, tiebreak)
        changes, placed = _against_held(gated, held_rows(store, gated))
        count = _append(store, placed, first)
        days = [] if changes is None else day_list(changes)
        if days:
            rows = on_values(store.read("usage"), "date", days)
            rewritten = apply_upgrades(rows, changes, F.lit(first + 1))
            store.replace_partitions("usage", rewritten, covered=["keys"])
        touched = gated.select("date").distinct()
        if changes is not None:
            touched = touched.union(changes.select("date")).distinct()
        facts = on_values(store.read("usage"), "date", day_list(touched))
        store.replace("daily", refresh_daily(facts, store.read("daily"), touched, now))
    return count


def _gated(staging: DataFrame, tiebreak: list[str] | None) -> DataFrame:
    """The gated batch, written aside, so that its logs are parsed once."""
    return settle(conform(batch_gate(staging, tiebreak or POSITION), USAGE), "gated")


def _against_held(gated: DataFrame, held: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Upgrades of stored facts (none when no id is stored) and the new rows, both written aside."""
    stored = settle(held, "held")
    if stored.isEmpty():
        return None, settle(with_places(gated.drop("id")), "added")
    changes = settle(upgrades(stored, gated), "upgrades")
    return changes, settle(with_places(new_rows(gated, stored).drop("id")), "added")


def _numbered(placed: DataFrame, first: int) -> DataFrame:
    """New facts with ids first + 1, first + 2, …, by their places in a written copy."""
    rows = number_places(placed, placed, F.lit(first), "id")
    return conform(rows.withColumn("updated_seq", F.col("id")), USAGE)


def _append(store: Store, placed: DataFrame, first: int) -> int:
    """Append new facts and their keys; returns their number."""
    count = placed.count()
    if count:
        store.append("usage", _numbered(placed, first))
        store.cover("keys", key_rows(store, placed))
    return count


def save_daily(store: Store, batch: DataFrame, now: Column, name: str | None = None) -> int:
    """Aggregate mode: add the sums of a batch to the rollup. Returns the days touched.

    A batch with a ``name`` is added once, however often the call is repeated.
    """
    with store.commit(name) as fresh:
        if not fresh:
            return 0
        store.replace("daily", save_additive(batch, store.read("daily"), now))
    return batch.select("date").distinct().count()


def save_files(store: Store, facts: DataFrame, now: Column) -> int:
    """Aggregate mode by file: book what each file adds to its earlier contribution.

    Rollup and ledger change in one commit, so a save that is repeated counts nothing twice. Returns
    the number of responses newly accounted for.
    """
    with store.commit(), scratch(store.spark):
        fresh = settle(file_contribution(facts), "fresh")
        ledger, manifest = store.read("ledger"), store.read("manifest")
        changes = settle(ledger_changes(fresh, ledger, manifest), "changes")
        store.replace("daily", apply_ledger_delta(changes, store.read("daily"), now))
        store.replace("ledger", replace_ledger(fresh, ledger))
        return newly_counted(changes).collect()[0]["new_responses"]


def ingest(
    store: Store,
    sources: Iterable[Source],
    now: Column,
    tz: str = "UTC",
    aggregate: bool = False,
    force: bool = False,
    glob: str = "*.jsonl",
    today: date | None = None,
) -> tuple[int, dict[str, str]]:
    """Parse the stale files of all sources and save them; returns rows saved and failures.

    Stale and deleted files come from one comparison over all sources. A source that fails is
    reported and stays stale; the others are saved. File stats are taken before parsing, and
    are noted in the commit that saves the facts. With ``today`` the rollup gets a row for every day up
    to it.
    """
    sources, spark = list(sources), store.spark
    with scratch(spark):
        listed = [
            list_files(spark, s.path, glob).withColumn("_source", F.lit(i))
            for i, s in enumerate(sources)
        ]
        status = settle(stale_files(union_all(listed), store.read("manifest")), "stale")
        present = F.col("status") != "deleted"
        stale = status.filter(present) if force else needs_parsing(status)
        saved, failures = 0, {}
        # One row per source: the sources that have anything to read.
        pending = {r["_source"] for r in stale.select("_source").distinct().collect()}
        for i in sorted(pending):
            mine = stale.filter(F.col("_source") == i)
            try:
                for names in _batches(mine):
                    saved += _ingest_files(store, sources[i], names, mine, now, tz, aggregate, glob)
            except Exception as error:
                failures[sources[i].path] = str(error)
        gone = status.filter(~present)
        if not force and not gone.isEmpty():
            store.replace("manifest", prune_manifest(store.read("manifest"), gone))
    if today is not None:
        close_gaps(store, today, now)
    return saved, failures


def _ingest_files(
    store: Store,
    source: Source,
    names: list[str],
    stats: DataFrame,
    now: Column,
    tz: str,
    aggregate: bool,
    glob: str,
) -> int:
    """Save some files of a source and note them, in one commit."""
    with store.commit():
        lines = scan_logs(store.spark, [GLOB_CHARS.sub(r"\\\1", n) for n in names], glob)
        facts = parse_source(lines, source, now, tz)
        saved = save_files(store, facts, now) if aggregate else save_full(store, facts, now)
        read = stats.filter(F.col("file_path").isin(names))
        manifest = update_manifest(store.read("manifest"), read.select("file_path"), read, now)
        store.replace("manifest", manifest)
    return saved


def ingest_registry(
    store: Store, registry: DataFrame, now: Column, **options: object
) -> tuple[int, dict[str, str]]:
    """``ingest`` for the valid entries of a registry table."""
    return ingest(store, registered_sources(registry), now, **options)


def _batches(files: DataFrame) -> Iterator[list[str]]:
    """Paths of the stale files of one source, a batch at a time, always by their paths."""
    names: list[str] = []
    size = 0
    rows = files.select("file_path", "size_bytes").orderBy("file_path")
    for row in rows.toLocalIterator():
        names.append(row["file_path"])
        size += row["size_bytes"] or 0
        if size >= BATCH_BYTES or len(names) == BATCH_FILES:
            yield names
            names, size = [], 0
    if names:
        yield names


def rebuild(
    store: Store,
    sources: Iterable[Source],
    now: Column,
    tag: str,
    tz: str = "UTC",
    glob: str = "*.jsonl",
    failures: dict[str, str] | None = None,
) -> int:
    """Replace the rows of every session still in the logs by a fresh ingest.

    Sessions whose logs are gone keep their rows. The facts are copied aside first, and pushes
    to the server sink are blocked until its target is repaired. Sources share a commit, so that a day
    is rewritten once for all of them; where that fails or their order matters, each gets its own. One
    that fails keeps its rows and is put into ``failures`` (or raised when the others are
    done). New rows get numbers that were never given, so the next push sends their days.
    """
    failed: dict[str, str] = {}
    saved, sources = 0, list(sources)
    with store.commit():
        snapshot_table(store, "usage", tag)
        state = set_state(store.read("sync_state"), {f"server.{GUARD}": "1"})
        store.replace("sync_state", state)
    for start in range(0, len(sources), REBUILT_TOGETHER):
        with scratch(store.spark):
            parsed = []
            for source in sources[start : start + REBUILT_TOGETHER]:
                try:
                    parsed.append(_parsed(store, source, now, tz, glob))
                except Exception as error:
                    failed[source.path] = str(error)
            saved += _rebuild_parsed(store, parsed, now, failed)
    if failures is not None:
        failures.update(failed)
    elif failed:
        raise RuntimeError(f"not rebuilt: {failed}")
    return saved


@dataclass(frozen=True)
class _Parsed:
    """Logs of a source: their files, as they were before they were read, and their gated facts."""

    source: Source
    stats: DataFrame
    gated: DataFrame


def _parsed(store: Store, source: Source, now: Column, tz: str, glob: str) -> _Parsed:
    stats = settle(list_files(store.spark, source.path, glob), "files")
    facts = parse_source(scan_logs(store.spark, source.path, glob), source, now, tz)
    return _Parsed(source, stats, _gated(facts, None))


def _rebuild_parsed(
    store: Store, logs: list[_Parsed], now: Column, failed: dict[str, str]
) -> int:
    """Rebuild sources in one commit, or each in its own; puts those that fail into ``failed``."""
    if len(logs) > 1:
        devices = [one.source.device_id for one in logs]
        try:
            gated = _in_order(one.gated for one in logs)
            shared = settle(shared_ids(gated, _ORDER), "shared")
            if not order_matters(gated, shared, _ORDER, devices):
                return _rebuild_commit(store, logs, now, None if shared.isEmpty() else shared)
        except Exception:
            # Nothing was committed; which of them fails shows when each has its own commit.
            pass
    saved = 0
    for one in logs:
        try:
            saved += _rebuild_commit(store, [one], now)
        except Exception as error:
            failed[one.source.path] = str(error)
    return saved


_ORDER = "_source"


def _in_order(frames: Iterable[DataFrame]) -> DataFrame:
    return union_all(rows.withColumn(_ORDER, F.lit(i)) for i, rows in enumerate(frames))


def _rebuild_commit(
    store: Store, logs: list[_Parsed], now: Column, shared: DataFrame | None = None
) -> int:
    with store.commit(), scratch(store.spark):
        return _rebuild_sources(store, logs, now, shared)


def _rebuild_sources(
    store: Store, logs: list[_Parsed], now: Column, shared: DataFrame | None
) -> int:
    """Rebuild sources as if one after the other; ``shared`` has the ids that several of them hold."""
    catch_up(store)
    first = last_number(store)
    gated = _in_order(one.gated for one in logs)
    listed = gated.filter("session_id IS NOT NULL").select("device_id", "session_id", _ORDER)
    sessions = settle(listed.distinct(), "sessions")
    usage = store.read("usage")
    shrunk = settle(deleted_dates(usage, sessions, by_device=True), "shrunk")
    held = held_rows(store, gated).select(
        "date", "message_uuid", "message_type", "session_id", "device_id", "total_tokens"
    )
    held = settle(mark_sessions(held, sessions, _ORDER), "held")
    stays = held.filter(F.col(_ORDER).isNull())
    best = gated if shared is None else largest_of(gated, _ORDER)
    changes = settle(upgrades(stays, best), "upgrades")
    added = settle(with_places(new_rows(gated, held, _ORDER, shared).drop("id")), "added")
    count = added.count()
    days = shrunk.select("date").union(changes.select("date")).union(gated.select("date"))
    days = settle(days.distinct(), "days")
    names = day_list(days)
    rewritten = delete_sessions(on_values(usage, "date", names), sessions, by_device=True)
    if not changes.isEmpty():
        rewritten = apply_upgrades(rewritten, changes, F.lit(first + 1))
    # A listed day that lost all its rows disappears with its folder.
    store.replace_partitions(
        "usage", rewritten.unionByName(_numbered(added, first)), names, covered=["keys"]
    )
    store.cover("keys", key_rows(store, added))
    store.append("touched", shrink_rows(shrunk, first + max(count, 1)))
    facts = on_values(store.read("usage"), "date", names)
    store.replace("daily", recompute_daily(facts, store.read("daily"), days, now))
    stats = _latest(one.stats for one in logs)
    manifest = update_manifest(store.read("manifest"), stats.select("file_path"), stats, now)
    store.replace("manifest", manifest)
    return count


def _latest(stats: Iterable[DataFrame]) -> DataFrame:
    """One row per file of several listings, the last one's."""
    rest = F.max_by(F.struct("mtime_ns", "size_bytes"), _ORDER).alias("_rest")
    return _in_order(stats).groupBy("file_path").agg(rest).select("file_path", "_rest.*")


def snapshot_table(store: Store, table: str, tag: str) -> DataFrame:
    """Copy a table beside itself before a destructive step; its count and range of days."""
    rows = store.read(table)
    rows.write.mode("errorifexists").parquet(f"{store.location(table)}@{tag}")
    return coverage(store.spark.read.schema(rows.schema).parquet(f"{store.location(table)}@{tag}"))


def close_gaps(store: Store, today: date, now: Column) -> int:
    """Give every day from the first fact to ``today`` a rollup row; returns the rows added."""
    first = coverage(store.read("usage")).collect()[0]["oldest_date"]
    if first is None:
        return 0
    daily = store.read("daily")
    added = missing_days(daily, first, today).count()
    store.replace("daily", fill_gaps(daily, first, today, now))
    return added


def save_pricing(store: Store, prices: DataFrame) -> None:
    """Insert or replace prices by model."""
    store.replace("pricing", upsert_pricing(conform(prices, PRICING), store.read("pricing")))
