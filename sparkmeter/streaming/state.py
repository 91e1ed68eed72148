"""Streams with state per key: largest usage of a response, context of a rollout file.

State is dropped when a key was not seen for some days, so it holds the keys of the last days and
not all keys ever seen. What arrives after its state is gone is passed on as if it were new; the save that
follows is keyed and has the last word. Rows travel to the tasks as one JSON column beside the
few columns that the state depends on; batches are handed over by Arrow.

A call for a group costs milliseconds whatever it holds, so the groups are buckets of keys by a hash:
a micro-batch makes as many calls as there are buckets at most, not one for each key. Values and times are
kept for each key of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkmeter.operators.dedupe import scope
from sparkmeter.sources.rollouts import CARRIED, rollout_events, rollout_facts

#: A replay comes with the log that repeats it; a session seldom goes on after a week.
DAYS = 7
_DAY_MS = 24 * 3600 * 1000


#: Groups of keys; a stream with more than some hundred million keys suits more.
BUCKETS = 1 << 14

_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def start_available(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a stream with keyed state that takes what is there and ends.

    A time-out by the clock makes Spark add batches without data for ever; they are switched off
    for this stream. State that is due then goes with the next batch that has data.
    """
    before = spark.conf.get(_NO_DATA)
    spark.conf.set(_NO_DATA, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_NO_DATA, before)


def _packed(df: DataFrame, *own: Column) -> DataFrame:
    """Some columns, and the whole row as text."""
    return df.select(*own, F.to_json(F.struct(*df.columns)).alias("row"))


def _unpacked(df: DataFrame, schema: T.StructType, *own: str) -> DataFrame:
    return df.select(*own, F.from_json("row", schema).alias("row")).select(*own, "row.*")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def _held(state: GroupState) -> dict[str, tuple]:
    """By key of a bucket: when it is due to go, and its values."""
    return {key: tuple(rest) for key, *rest in zip(*state.get, strict=True)} if state.exists else {}


def _hold(state: GroupState, held: dict[str, tuple], now: int) -> None:
    """Keep the keys of a bucket that are not due; the next one that is wakes it up."""
    kept = [(key, *rest) for key, rest in held.items() if rest[0] > now]
    if kept:
        state.update(tuple(map(list, zip(*kept, strict=True))))
        state.setTimeoutDuration(min(row[1] for row in kept) - now)
    elif state.exists:
        state.remove()


def _missing(value: object) -> bool:
    """Whether a value that pandas handed over is null."""
    return value is None or value != value


def _largest(ttl: int, order: list[str]) -> Callable:
    """Pass the largest row of a key on when it has more tokens than any before it."""

    def place(late: object, *ties: object) -> tuple:
        """Order of equal usage: latest first, then by the other columns, nulls last."""
        time = (True, 0) if _missing(late) else (False, -late)
        return (time, *[(True, 0) if _missing(v) else (False, v) for v in ties])

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.getCurrentProcessingTimeMs(), _held(state)
        if not state.hasTimedOut:
            best: dict[str, tuple] = {}
            for rows in frames:
                columns = [rows[c].tolist() for c in ("key", "tokens", "row", "late", *order)]
                for key, *row in zip(*columns, strict=True):
                    top = best.get(key)
                    if top is None or row[0] > top[0] or (
                        row[0] == top[0] and place(*row[2:]) < place(*top[2:])
                    ):
                        best[key] = row
            out = []
            for key, (tokens, row, *_) in best.items():
                if key not in held or tokens > held[key][1]:
                    out.append(row)
                    held[key] = (now + ttl, tokens)
                else:
                    held[key] = (now + ttl, held[key][1])
            yield pd.DataFrame({"row": out})
        _hold(state, held, now)

    return run


def largest_usage_stream(
    facts: DataFrame, order: list[str], days: float = DAYS, buckets: int = BUCKETS
) -> DataFrame:
    """The rows of a stream of facts that a store would not know yet: new ids and larger usage.

    Per response id (and per session and id of prompts) at most one row per micro-batch passes, and
    only when it has more tokens than all that passed before. State is two numbers per key.
    """
    # The length tells where the id ends, and an id from no id.
    uuid = F.concat(F.length("message_uuid"), F.lit(":"), "message_uuid")
    key = F.concat(F.coalesce(uuid, F.lit("-")), scope())
    rows = _packed(
        facts,
        _bucket(key, buckets),
        key.alias("key"),
        F.coalesce("total_tokens", F.lit(0)).alias("tokens"),
        F.unix_micros("ts").alias("late"),
        *[F.col(c) for c in order],
    )
    passed = rows.groupBy("bucket").applyInPandasWithState(
        _largest(int(days * _DAY_MS), order),
        "row string",
        "keys array<string>, due array<bigint>, tokens array<bigint>",
        "update",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    return _unpacked(passed, facts.schema)


def _context(ttl: int) -> Callable:
    """Carry what the lines of a file set along its lines, and number the billed turns."""

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held = state.getCurrentProcessingTimeMs(), _held(state)
        if not state.hasTimedOut:
            out = []
            lines = pd.concat(list(frames)).sort_values(["piece", "chunk", "pos"])
            columns = [lines[c].tolist() for c in ("key", "row", "billed", *CARRIED)]
            for key, row, billed, *sets in zip(*columns, strict=True):
                _, *known, turn = held.get(key, (0, *[None] * len(CARRIED), 0))
                known = [old if new is None else new for old, new in zip(known, sets, strict=True)]
                if billed:
                    turn += 1
                    out.append((row, *known, turn))
                held[key] = (now + ttl, *known, turn)
            yield pd.DataFrame(out, columns=["row", *CARRIED, "turn"])
        _hold(state, held, now)

    return run


def rollout_pieces_stream(
    lines: DataFrame, now: Column, tz: str = "UTC", days: float = DAYS, buckets: int = BUCKETS
) -> DataFrame:
    """Facts of rollout files that arrive in pieces.

    ``lines`` is a stream of lines (file_path, piece, chunk, pos, value) in which ``file_path`` is the
    file a piece belongs to and ``piece`` its number. Model, folder, version and the number of the turn
    go on where the last micro-batch ended, so the facts are those of the whole file. Pieces of one
    file have to come in order, in any number of micro-batches; each batch sorts its own.
    """
    events = rollout_events(lines)
    key = F.coalesce(F.concat(F.lit(":"), "file_path"), F.lit(""))
    own = [F.col(c) for c in ("piece", "chunk", "pos", "billed", *CARRIED)]
    carried = ", ".join(f"{c} string" for c in CARRIED)
    arrays = ", ".join(f"{c} array<string>" for c in CARRIED)
    packed = _packed(events, _bucket(key, buckets), key.alias("key"), *own)
    # Only the rows of billed lines come back.
    rows = packed.withColumn("row", F.when(F.col("billed"), F.col("row")))
    turns = rows.groupBy("bucket").applyInPandasWithState(
        _context(int(days * _DAY_MS)),
        f"row string, {carried}, turn long",
        f"keys array<string>, due array<bigint>, {arrays}, turn array<bigint>",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    plain = T.StructType([f for f in events.schema.fields if f.name not in CARRIED])
    return rollout_facts(_unpacked(turns, plain, *CARRIED, "turn"), now, tz)
