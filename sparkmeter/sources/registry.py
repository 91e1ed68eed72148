"""Log sources: validation, and ingestion of several dialects into one set of facts."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.schemas import DEVICE_COLUMNS
from sparkmeter.sources.api_events import parse_api_events
from sparkmeter.sources.logs import scan_logs
from sparkmeter.sources.rollouts import parse_rollouts
from sparkmeter.sources.transcripts import parse_transcripts

# Names of the dialects, the device types, and the allowed id and name patterns.
FORMATS = ["claude", "codex", "hermes"]
DEVICE_TYPES = ["macos", "windows", "linux"]
DEVICE_ID_PATTERN = r"^[a-zA-Z0-9][a-zA-Z0-9_-]{0,63}$"
DEVICE_NAME_PATTERN = r"^[\x20-\x7E]{1,128}$"

#: Parsers by dialect; add an entry to support another one. A parser takes lines, the stand-in
#: for missing times and the zone that defines a day.
PARSERS: dict[str, Callable[[DataFrame, Column, str], DataFrame]] = {
    "claude": lambda lines, now, tz: parse_transcripts(lines, tz),
    "codex": parse_rollouts,
    "hermes": parse_api_events,
}


@dataclass(frozen=True)
class Source:
    """One tree of logs, its dialect and the device it belongs to."""

    path: str
    format: str = "claude"
    device_id: str | None = None
    device_name: str | None = None
    device_type: str | None = None


def validate_sources(registry: DataFrame) -> DataFrame:
    """Entries with a path and allowed device fields; an unknown format becomes the default."""
    return registry.filter(
        (F.col("path") != "")
        & F.col("device_id").rlike(DEVICE_ID_PATTERN)
        & F.col("device_name").rlike(DEVICE_NAME_PATTERN)
        & F.col("device_type").isin(DEVICE_TYPES)
    ).withColumn(
        "format",
        F.when(F.col("format").isin(FORMATS), F.col("format")).otherwise(F.lit(FORMATS[0])),
    )


def registered_sources(registry: DataFrame) -> list[Source]:
    """The valid entries of a registry as sources; an entry is a line of settings, so they are few."""
    columns = ["path", "format", *DEVICE_COLUMNS]
    rows = validate_sources(registry).select(*columns).orderBy(*columns).collect()
    return [Source(**row.asDict()) for row in rows]


def tag_device(facts: DataFrame, source: Source) -> DataFrame:
    """Set the device columns to those of a source."""
    return facts.withColumns(
        {c: F.lit(getattr(source, c)).cast("string") for c in DEVICE_COLUMNS}
    )


def parse_source(lines: DataFrame, source: Source, now: Column, tz: str = "UTC") -> DataFrame:
    """Facts of one source with its device columns."""
    return tag_device(PARSERS[source.format](lines, now, tz), source)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name; columns that only some frames have are null elsewhere."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ingest_sources(
    spark: SparkSession,
    sources: Iterable[Source],
    now: Column,
    tz: str = "UTC",
    glob: str = "*.jsonl",
) -> DataFrame:
    """Facts of all sources, each read in its own dialect."""
    return union_all(parse_source(scan_logs(spark, s.path, glob), s, now, tz) for s in sources)
