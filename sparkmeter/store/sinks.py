"""Push jobs to the two kinds of sinks.

The *lake* sink keeps daily facts that are replaced by key; the *server* sink keeps facts that
are only added to. Which days changed is read from the change log, not from the facts; the tables
of a target change in one commit, and a watermark moves only after that.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sparkmeter.operators import push
from sparkmeter.operators.filters import device_filter
from sparkmeter.operators.metrics import devices_dim, usage_daily
from sparkmeter.schemas import LIMITS, conform
from sparkmeter.session import scratch, settle
from sparkmeter.store.index import catch_up, last_number
from sparkmeter.store.tables import Store, day_list, on_values


@dataclass(frozen=True)
class Pushed:
    """What a push did."""

    new_records: int = 0
    skipped: bool = True
    failed_tables: list[str] = field(default_factory=list)


class PushBlocked(RuntimeError):
    """The target still holds rows from before a rebuild; repair it first."""


def push_lake(
    local: Store,
    target: Store,
    now: datetime,
    accounts: DataFrame,
    devices: list[str] | None = None,
    full: bool = False,
    respect_interval: bool = False,
    compact_every: int = push.COMPACT_EVERY,
    by_update: bool = True,
    sink: str = "lake",
) -> Pushed:
    """Replace every day that changed in the target's daily facts, then its side tables.

    ``by_update`` lets the watermark follow upgrades too, so a day whose rows only grew is sent
    again; without it only new ids count.
    """
    catch_up(local)
    usage, limits, touched = (local.read(t) for t in ("usage", "limits", "touched"))
    plan = push.plan_push(
        push.as_numbers(touched),
        limits,
        local.read("sync_state"),
        sink,
        now.timestamp(),
        devices,
        full,
        respect_interval,
        by_update=by_update,
    ).collect()[0]
    if plan["skip"]:
        return Pushed()

    stamp, new_records = F.lit(now).cast("timestamp"), 0
    with target.commit(), scratch(local.spark):
        if plan["new_usage"] or full:
            changed = push.changed_days(touched, plan["wm_id"], devices, by_update)
            days = day_list(changed)
            rows = on_values(device_filter(usage, devices), "date", days)
            batch = settle(usage_daily(rows, stamp), "batch")
            held = on_values(target.read("usage_daily"), "date", days)
            held = push.without_shrunk(held, changed)
            target.replace_partitions("usage_daily", push.push_daily(held, batch), days)
            new_records = push.source_rows(rows, plan["wm_id"], by_update=by_update).count()
        done, failed = _push_lake_side(local, target, plan, devices, accounts, stamp)
    count = (plan["push_count"] or 0) + 1
    done |= {push.LAST_PUSH: str(int(now.timestamp())), push.PUSH_COUNT: str(count)}
    _save_state(local, sink, done)
    if compact_every > 0 and count % compact_every == 0:
        for table in ("usage_daily", "devices"):
            target.compact(table)
    return Pushed(new_records, False, failed)


def _push_lake_side(
    local: Store,
    target: Store,
    plan: Row,
    devices: list[str] | None,
    accounts: DataFrame,
    stamp: Column,
) -> tuple[dict[str, str | None], list[str]]:
    """Push prices, devices and readings; the watermarks that may move, and the failed tables."""
    usage, limits = local.read("usage"), local.read("limits")
    done = {push.WATERMARK: _text(plan["max_id"])}

    side: dict[str, Callable[[], None]] = {
        "pricing": lambda: target.replace(
            "pricing", push.push_pricing(local.read("pricing"), target.read("pricing"), True)
        ),
        "devices": lambda: target.replace(
            "devices",
            push.push_devices(
                devices_dim(device_filter(usage, devices), accounts, stamp),
                target.read("devices"),
            ),
        ),
    }
    if plan["new_limits"]:
        side["limits"] = lambda: target.replace(
            "limits",
            push.push_limits(device_filter(limits, devices), target.read("limits"), True),
        )
    failed = _run_side_tables(side)
    if "limits" not in failed:
        done[push.LIMITS_WATERMARK] = _text(plan["max_limits_ts"])
    return done, failed


def push_server(
    local: Store, target: Store, now: datetime, full: bool = False, sink: str = "server"
) -> Pushed:
    """Add the local rows the target lacks, then its side tables."""
    catch_up(local)
    usage, limits, touched = (local.read(t) for t in ("usage", "limits", "touched"))
    plan = push.plan_push(
        push.as_numbers(touched), limits, local.read("sync_state"), sink, now.timestamp(), full=full
    ).collect()[0]
    if plan["blocked"]:
        raise PushBlocked(f"{sink}: repair the target after the rebuild")
    if plan["skip"]:
        return Pushed()

    new_records = 0
    with target.commit(), scratch(local.spark):
        if plan["new_usage"] or full:
            remote = target.read("usage")
            if plan["wm_id"] is None or remote.isEmpty():
                rows = push.full_rows(usage, remote)
            else:
                days = day_list(push.changed_days(touched, plan["wm_id"]))
                fresh = on_values(usage, "date", days)
                rows = push.incremental_rows(fresh, remote, plan["wm_id"])
            rows = settle(rows, "pushed")
            target.append("usage", rows)
            new_records = rows.count()
        failed = _push_server_side(local, target, plan, limits)
    done = {push.WATERMARK: _text(plan["max_id"])}
    if "limits" not in failed:
        done[push.LIMITS_WATERMARK] = _text(plan["max_limits_ts"])
    _save_state(local, sink, done)
    return Pushed(new_records, False, failed)


def _push_server_side(local: Store, target: Store, plan: Row, limits: DataFrame) -> list[str]:
    """Push prices and readings; the tables that failed."""
    side: dict[str, Callable[[], None]] = {}
    if plan["wm_id"] is None:
        side["pricing"] = lambda: target.replace(
            "pricing", push.push_pricing(local.read("pricing"), target.read("pricing"), False)
        )
    if plan["new_limits"]:
        side["limits"] = lambda: target.replace(
            "limits", push.push_limits(conform(limits, LIMITS), target.read("limits"))
        )
    return _run_side_tables(side)


def repair_server(local: Store, target: Store, tag: str, sink: str = "server") -> None:
    """Rebuild the target's facts from local rows and the rows of other devices.

    The new table is checked per device before it replaces the old one, and the old one is kept
    beside it. The guard of the rebuild is cleared last.
    """
    catch_up(local)
    usage, remote = local.read("usage"), target.read("usage")
    if push.repair_conflict(usage, remote).collect()[0]["abort"]:
        raise RuntimeError("rows without device on both sides cannot be told apart")
    remote.write.mode("errorifexists").parquet(f"{target.location('usage')}@{tag}")
    with target.commit():
        target.replace("usage", push.repair_target(usage, remote))
        # The files of ``remote`` are still there; a mismatch takes the new ones back.
        if not push.repair_differences(usage, remote, target.read("usage")).isEmpty():
            raise RuntimeError("repair verification failed; the target is unchanged")
        target.replace("pricing", local.read("pricing"))
    _save_state(local, sink, {push.WATERMARK: _text(last_number(local)), push.GUARD: "0"})


def clear_guard(local: Store, sink: str = "server") -> None:
    """Confirm that a target was emptied after a rebuild, so pushes may go on."""
    _save_state(local, sink, {push.GUARD: "0"})


def push_all(sinks: Mapping[str, Callable[[], Pushed]]) -> tuple[dict[str, Pushed], dict[str, str]]:
    """Run every sink; one that fails does not stop the others. Returns results and failures."""
    results, failures = {}, {}
    for name, run in sinks.items():
        try:
            results[name] = run()
        except Exception as error:
            failures[name] = str(error)
    return results, failures


def _run_side_tables(side: Mapping[str, Callable[[], None]]) -> list[str]:
    """Side tables never block the facts or their watermark."""
    failed = []
    for name, run in side.items():
        try:
            run()
        except Exception:
            failed.append(name)
    return failed


def _save_state(local: Store, sink: str, values: Mapping[str, str | None]) -> None:
    keyed = {f"{sink}.{k}": v for k, v in values.items()}
    local.replace("sync_state", push.set_state(local.read("sync_state"), keyed))


def _text(value: object) -> str | None:
    return None if value is None else str(value)


def utc(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, tz=timezone.utc)
