"""What a store derives from its facts: where an id may be, and which days changed last.

Both tables only grow, and are brought up to date by reading the parts of the facts that were
written since. The key index tells the days on which an id may be stored, in folders by a hash of the
id; a save reads the folders of its ids and then the facts of those days, never all facts. The
change log has the largest number given per day and device. It keeps its rows when facts are removed,
so a number is never given twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmeter.operators.sessions import first_days, number_sessions, session_bits
from sparkmeter.operators.upsert import without_keys
from sparkmeter.schemas import KEYS, SESSION_BITS, TOUCHED, conform
from sparkmeter.session import scratch, settle
from sparkmeter.store.tables import Store, day_list, on_values

def bucket_of(store: Store, uuid: str = "message_uuid") -> Column:
    """Folder of an id; their number is set by the first commit of a store."""
    return F.pmod(F.xxhash64(uuid), F.lit(store.pointer().buckets)).cast("bigint")


def key_rows(store: Store, facts: DataFrame) -> DataFrame:
    """Rows of the key index for some facts."""
    found = facts.filter("message_uuid IS NOT NULL").select("message_uuid", "date").distinct()
    return conform(found.withColumn("bucket", bucket_of(store)), KEYS)


def touched_rows(store: Store, facts: DataFrame) -> DataFrame:
    """Rows of the change log for some facts."""
    last = facts.groupBy("date", "device_id").agg(
        F.max("id").alias("last_id"),
        F.max(F.coalesce("updated_seq", "id")).alias("seq"),
        F.lit(False).alias("shrunk"),
    )
    return conform(last, TOUCHED)


def catch_up(store: Store) -> None:
    """Bring both tables up to date with facts that were written without them."""
    with store.commit():
        for name, rows in (("keys", key_rows), ("touched", touched_rows)):
            if not store.is_covered(name):
                store.cover(name, rows(store, store.uncovered(name)))


def refresh_sessions(store: Store) -> None:
    """Bring the session bitmaps up to date: days whose facts changed are made again.

    Days without facts left have no row written since; the job that removes them lists them.
    Sessions grow with the facts and are small as files, so they are not left to be broadcast.
    """
    with store.commit(), scratch(store.spark):
        if store.is_covered("session_bits"):
            return
        days = day_list(store.uncovered("session_bits"))
        facts = on_values(store.read("usage"), "date", days)
        known = store.read("sessions").hint("merge")
        fresh = settle(without_keys(first_days(facts), known, ["session_id"]), "fresh")
        start = known.agg(F.coalesce(F.max("session_no") + 1, F.lit(0)).alias("n")).collect()[0]["n"]
        store.append("sessions", number_sessions(fresh, start))
        mine = store.read("sessions").join(
            facts.select("session_id").distinct().hint("merge"), "session_id", "left_semi"
        )
        store.replace_partitions(
            "session_bits", conform(session_bits(facts, mine), SESSION_BITS), days
        )
        store.pointer().covered["session_bits"] = store.pointer().last


def last_number(store: Store) -> int:
    """Largest id or update number ever given in a store (up to date after ``catch_up``)."""
    used = F.max(F.greatest("last_id", "seq"))
    return store.read("touched").agg(F.coalesce(used, F.lit(0)).alias("last")).collect()[0]["last"]


def held_rows(store: Store, ids: DataFrame) -> DataFrame:
    """Stored facts with an id of ``ids`` (message_uuid), from the days that may hold them.

    The folders of the index and the days become filters before the scans: at most as
    many values as there are folders, and at most as many as the calendar has days.
    """
    if "keys" not in store.pointer().tails:
        return store.read("usage").limit(0)
    wanted = ids.filter("message_uuid IS NOT NULL").select("message_uuid").distinct()
    buckets = [r["b"] for r in wanted.select(bucket_of(store).alias("b")).distinct().collect()]
    keys = on_values(store.read("keys"), "bucket", buckets)
    places = settle(
        keys.join(wanted, "message_uuid", "left_semi").select("message_uuid", "date").distinct(),
        "places",
    )
    facts = on_values(store.read("usage"), "date", day_list(places))
    return facts.join(places, ["message_uuid", "date"], "left_semi")


def shrink_rows(days: DataFrame, number: int) -> DataFrame:
    """Change log rows for days of devices that lost facts."""
    return conform(
        days.select("date", "device_id").distinct().withColumns(
            {
                "last_id": F.lit(number),
                "seq": F.lit(number),
                "shrunk": F.lit(True),
            }
        ),
        TOUCHED,
    )
