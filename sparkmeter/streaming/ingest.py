"""Streams of log files into a store: growing files by ticks, new files once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkmeter.operators.metrics import rollup_kpis
from sparkmeter.sources.logs import BLANKS, stream_logs
from sparkmeter.operators.sessions import distinct_sessions as count_sessions
from sparkmeter.sources.registry import Source, parse_source
from sparkmeter.store.index import refresh_sessions
from sparkmeter.store.ingest import ingest, save_full
from sparkmeter.store.tables import Store

REFRESH = "5 seconds"


def follow_logs(
    store: Store,
    sources: Iterable[Source],
    checkpoint: str,
    now: Column | Callable[[], Column],
    tz: str = "UTC",
    interval: str | None = None,
    then: Callable[[Store], None] | None = None,
    failed: Callable[[dict[str, str]], None] | None = None,
    glob: str = "*.jsonl",
) -> StreamingQuery:
    """Keep a store up to date with log trees whose files grow in place.

    The stream only ticks: each batch compares the files with the manifest (path, size, time) and
    saves what is new, grown or gone by ``ingest``, one commit per batch of files. So an appended line
    is saved by the next tick, a tick that failed is made good by the next one, and nothing depends on
    a list of seen files. ``then`` runs after ticks that saved something; sources that could
    not be read are given to ``failed`` and tried again. Without ``interval`` there is one tick.
    """
    trees = list(sources)

    def tick(batch: DataFrame, _: int) -> None:
        before = store.pointer().last
        moment = now() if callable(now) else now
        _, failures = ingest(store, trees, moment, tz, glob=glob)
        if failures and failed:
            failed(failures)
        if then and store.pointer().last != before:
            then(store)

    ticks = (
        store.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    )
    writer = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


def store_kpis(store: Store) -> DataFrame:
    """Key figures of a store without a scan of its facts: the rollup and the session bitmaps.

    Distinct sessions are exact: only days that changed since the last call are counted again.
    """
    refresh_sessions(store)
    figures = rollup_kpis(store.read("daily"))
    sessions = count_sessions(store.read("session_bits"))
    return figures.drop("sessions_daily_sum").withColumn("sessions", sessions.scalar())


def batch_lines(batch: DataFrame) -> DataFrame:
    """A micro-batch of a log stream as positioned lines."""
    return batch.select(
        "file_path",
        "chunk",
        F.monotonically_increasing_id().alias("pos"),
        F.trim(F.col("value"), F.lit(BLANKS)).alias("value"),
    ).filter(F.col("value") != "")


def ingest_stream(
    store: Store,
    source: Source,
    checkpoint: str,
    now: Column,
    tz: str = "UTC",
    files_per_trigger: int | None = None,
    interval: str | None = None,
    then: Callable[[Store], None] | None = None,
    glob: str = "*.jsonl",
) -> StreamingQuery:
    """Save every new file of a source; ``then`` runs after each saved batch.

    Without ``interval`` the query takes what is there and ends. There is no cut-off for late
    rows: saves are keyed and the larger usage wins, so a batch that is repeated after a failure
    changes nothing, and the days it touches are recomputed as a whole. A file is read once:
    for files that grow in place use ``follow_logs``.
    """

    def save(batch: DataFrame, _: int) -> None:
        save_full(store, parse_source(batch_lines(batch), source, now, tz), now)
        if then:
            then(store)

    writer = (
        stream_logs(store.spark, source.path, glob, files_per_trigger)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
    )
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


def dashboard_stream(
    store: Store,
    source: Source,
    checkpoint: str,
    now: Column,
    show: Callable[[DataFrame], None],
    interval: str | None = REFRESH,
    tz: str = "UTC",
    glob: str = "*.jsonl",
    distinct_sessions: bool = True,
) -> StreamingQuery:
    """Ingest and show the key figures of the whole store after every batch.

    The figures are exact over all saved rows, which a running aggregate of the raw stream could
    not give while responses may be repeated. No facts are scanned but those of changed days; with
    ``distinct_sessions`` off only the rollup is read and sessions are the sum of the daily counts.
    """

    def refresh(s: Store) -> None:
        show(store_kpis(s) if distinct_sessions else rollup_kpis(s.read("daily")))

    return ingest_stream(
        store, source, checkpoint, now, tz, interval=interval, then=refresh, glob=glob
    )


def daily_totals_stream(facts: DataFrame) -> DataFrame:
    """Running sums per day and model of a stream of facts without repeats (complete mode)."""
    return facts.groupBy("date", "model").agg(
        F.count("*").alias("records"), F.sum("total_tokens").alias("total_tokens")
    )
