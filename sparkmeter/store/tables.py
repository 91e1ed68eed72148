"""Tables of a store as Parquet folders.

Facts and daily facts are partitioned by day, the key index by a hash bucket. Each write adds a
part (a folder ``written=<number>``) that shows once its commit does; see ``store.journal``. Files
are never changed, so rows that were read stay readable while the table they come from is replaced,
and a job that loses executors or its driver leaves the store as it was. One writer per store.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmeter import schemas
from sparkmeter.sources.logs import plain_path
from sparkmeter.store.journal import WHOLE, Files, Journal, Pointer

SCHEMAS = {
    "usage": schemas.USAGE,
    "daily": schemas.DAILY,
    "limits": schemas.LIMITS,
    "manifest": schemas.MANIFEST,
    "ledger": schemas.LEDGER,
    "pricing": schemas.PRICING,
    "sync_state": schemas.STATE,
    "usage_daily": schemas.USAGE_DAILY,
    "devices": schemas.DEVICES,
    "keys": schemas.KEYS,
    "touched": schemas.TOUCHED,
    "sessions": schemas.SESSIONS,
    "session_bits": schemas.SESSION_BITS,
    "batches": schemas.BATCHES,
}
#: Tables in folders by a column, whose values are replaced one by one.
PARTITIONED = {
    "usage": "date",
    "usage_daily": "date",
    "session_bits": "date",
    "keys": "bucket",
}
#: Tables that follow from the facts, brought up to date by reading what was written since.
DERIVED = ("keys", "touched", "session_bits")
PART = "written"
BUCKETS = 16
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Seconds that replaced files are kept for readers (seven days).
RETENTION = 168 * 3600
#: Bytes of a file after compaction; a day is compacted when it has more files than this.
FILE_BYTES = 128 << 20
FILES_PER_DAY = 2


class Store:
    """A folder with one Parquet table per name in ``SCHEMAS``.

    ``buckets`` is the number of folders of a new store's key index: some hundreds suit a store of
    many billions of facts, whose saves then read few of them.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.path = path
        self.files = Files(spark, path)
        self._journal = Journal(self.files, buckets)
        self._open: Pointer | None = None

    def location(self, table: str) -> str:
        return f"{self.path.rstrip('/')}/{table}"

    def pointer(self) -> Pointer:
        """What counts now: the last commit, or the state of the open one."""
        return self._open or self._journal.latest()[1]

    def at(self, pointer: Pointer) -> Store:
        """The store as of a state; only for reading."""
        other = Store(self.spark, self.path)
        other._open = Pointer.of(pointer.text())
        return other

    # --- reading ---------------------------------------------------------------------------

    def exists(self, table: str) -> bool:
        return bool(self.files.names(f"{table}/*"))

    def read(self, table: str) -> DataFrame:
        """The table, with the columns of its schema; empty when it was never written.

        Files written before a column existed give null for it. The parts that count are a filter
        on folder names, so no other file is opened.
        """
        return self._parts(table, self.pointer())

    def since(self, table: str, part: int) -> DataFrame:
        """Rows that count and were written after a part."""
        return self._parts(table, self.pointer(), F.col(PART) > part)

    def _parts(self, table: str, pointer: Pointer, more=None) -> DataFrame:
        schema: T.StructType = SCHEMAS[table]
        stored = T.StructType([*schema.fields, T.StructField(PART, T.LongType())])
        if table not in pointer.tails:
            return self.spark.createDataFrame([], schema)
        try:
            found = self.spark.read.schema(stored).parquet(self.location(table))
        except AnalysisException:
            return self.spark.createDataFrame([], schema)
        floors = pointer.floor(table)
        found = found.filter(F.col(PART) <= pointer.last)
        if floors:
            floor = F.lit(floors.get(WHOLE, 0))
            days = ",".join(f"{day}:{n}" for day, n in sorted(floors.items()) if day != WHOLE)
            if days:
                value = F.coalesce(F.col(PARTITIONED[table]).cast("string"), F.lit(_NO_VALUE))
                own = F.try_element_at(F.str_to_map(F.lit(days)), value).cast("long")
                floor = F.coalesce(own, floor)
            found = found.filter(F.col(PART) >= floor)
        if more is not None:
            found = found.filter(more)
        return found.select(*schema.names)

    # --- writing ---------------------------------------------------------------------------

    @contextmanager
    def commit(self, batch: str | None = None) -> Iterator[bool]:
        """Make all changes of the block one commit; none of them shows if it fails.

        Inside, ``read`` sees what was written so far. Blocks may be nested: the outermost commits. A
        named ``batch`` is applied once: the value is False when an earlier commit applied it,
        and the block should then change nothing.
        """
        outer = self._open
        if outer is None:
            number, self._open, broken = self._journal.begin()
            if broken:
                self._remove_after(self._open.last)
        before = self._open.text()
        try:
            yield self._first_time(batch)
            if outer is None and self._open.text() != before:
                self._journal.commit(number + 1, self._open)
        except BaseException:
            kept = Pointer.of(before)
            if self._journal.is_owner():
                self._remove_after(kept.last)
            self._open = kept
            raise
        finally:
            if outer is None:
                self._open = None
                self._journal.end()

    def _first_time(self, batch: str | None) -> bool:
        if batch is None:
            return True
        if not self.read("batches").filter(F.col("batch") == batch).isEmpty():
            return False
        self.append("batches", self.spark.createDataFrame([(batch,)], SCHEMAS["batches"]))
        return True

    def _remove_after(self, last: int) -> None:
        """Remove parts that no commit covers."""
        for table in SCHEMAS:
            below = f"{table}/*/{PART}=*" if table in PARTITIONED else f"{table}/{PART}=*"
            stale = [p for p in self.files.names(below) if int(p.rsplit("=", 1)[1]) > last]
            self.files.delete_all(stale)

    def append(self, table: str, rows: DataFrame) -> None:
        with self.commit():
            self._write(table, rows)

    def replace_partitions(
        self,
        table: str,
        rows: DataFrame,
        days: Iterable[object] | None = None,
        covered: Iterable[str] = (),
    ) -> None:
        """Write whole days: the days in ``rows`` (and all ``days``) are replaced, others stay.

        A listed day without rows is gone afterwards. ``rows`` may read what it replaces. Derived
        tables that are ``covered`` hold all of it already.
        """
        with self.commit():
            known = [name for name in covered if self.is_covered(name)]
            part = self._write(table, rows)
            for name in known:
                self.pointer().covered[name] = part
            prefix = f"{table}/{PARTITIONED[table]}="
            written = self.files.names(f"{prefix}*/{PART}={part}")
            found = {p.rsplit("/", 2)[1].split("=", 1)[1] for p in written}
            found |= {_NO_VALUE if d is None else str(d) for d in days or ()}
            for day in found:
                self.pointer().retire(table, day, time.time())

    def replace(self, table: str, rows: DataFrame) -> None:
        """Replace the whole table; ``rows`` may read it."""
        with self.commit():
            self._write(table, rows)
            self.pointer().retire(table, WHOLE, time.time())

    def _write(self, table: str, rows: DataFrame) -> int:
        """Write a part; returns its number."""
        pointer = self.pointer()
        pointer.last += 1
        pointer.tails[table] = pointer.last
        out, by = rows.withColumn(PART, F.lit(pointer.last)), [PART]
        if table in PARTITIONED:
            # Files of one day from one place: adaptive execution splits large days and joins
            # small ones, so a busy day is not one task and a quiet one not many files.
            out = out.hint("rebalance", PARTITIONED[table])
            by = [PARTITIONED[table], PART]
        out.write.mode("append").partitionBy(*by).parquet(self.location(table))
        return pointer.last

    # --- derived tables --------------------------------------------------------------------

    def is_covered(self, derived: str) -> bool:
        """Whether a derived table holds all facts."""
        pointer = self.pointer()
        return pointer.covered.get(derived, 0) >= pointer.tails.get("usage", 0)

    def uncovered(self, derived: str) -> DataFrame:
        """Facts that were written since a derived table was last brought up to date."""
        return self.since("usage", self.pointer().covered.get(derived, 0))

    def cover(self, derived: str, rows: DataFrame) -> None:
        """Add the rows that bring a derived table up to date."""
        with self.commit():
            self.append(derived, rows)
            self.pointer().covered[derived] = self.pointer().last

    # --- upkeep ----------------------------------------------------------------------------

    def file_sizes(self, table: str) -> DataFrame:
        """Files that count: day (or ``WHOLE``), path and bytes, from the listing alone."""
        files = (
            self.spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.parquet")
            .load(self.location(table))
            .select(
                plain_path(F.col("_metadata.file_path")).alias("path"),
                F.col("_metadata.file_size").alias("bytes"),
            )
        )
        pointer, by = self.pointer(), PARTITIONED.get(table)
        day = F.regexp_extract("path", f"/{by}=([^/]*)/", 1) if by else F.lit(WHOLE)
        part = F.regexp_extract("path", f"/{PART}=([0-9]+)/", 1).cast("long")
        floors = pointer.floor(table)
        days = ",".join(f"{d}:{n}" for d, n in sorted(floors.items()) if d != WHOLE)
        floor = F.coalesce(
            F.try_element_at(F.str_to_map(F.lit(days)), day).cast("long"),
            F.lit(floors.get(WHOLE, 0)),
        )
        return files.filter((part <= pointer.last) & (part >= floor)).select(
            day.alias("day"), "path", "bytes"
        )

    def crowded_days(self, table: str, files: int, size: int) -> DataFrame:
        """Days with more than ``files`` files that would fit into fewer: day, files, bytes, after."""
        needed = F.greatest(F.ceil(F.sum("bytes") / size), F.lit(1))
        return (
            self.file_sizes(table)
            .groupBy("day")
            .agg(
                F.count("*").alias("files"),
                F.sum("bytes").alias("bytes"),
                needed.cast("long").alias("after"),
            )
            .filter((F.col("files") > files) & (F.col("files") > F.col("after")))
        )

    def compact(
        self,
        table: str,
        files: int = FILES_PER_DAY,
        size: int = FILE_BYTES,
        keep: float = RETENTION,
    ) -> list[str]:
        """Rewrite the days with too many files; returns them. Files replaced long ago go.

        Days are bounded by the calendar (buckets by their number). All other days are not read.
        """
        days: list[str] = []
        if self.exists(table):
            days = [r["day"] for r in self.crowded_days(table, files, size).collect()]
        if days and table not in PARTITIONED:
            self.replace(table, self.read(table).hint("rebalance"))
        elif days:
            column = PARTITIONED[table]
            value = F.coalesce(F.col(column).cast("string"), F.lit(_NO_VALUE))
            # The same rows in other files: what is derived from them stays as it is.
            rows = self.read(table).filter(value.isin(days))
            self.replace_partitions(table, rows, covered=DERIVED if table == "usage" else ())
        self.vacuum(keep)
        return sorted(days)

    def vacuum(self, keep: float = RETENTION, now: float | None = None) -> int:
        """Remove parts that were replaced more than ``keep`` seconds ago; returns how many."""
        due = (time.time() if now is None else now) - keep
        gone = 0
        with self.commit():
            pointer = self.pointer()
            for entry in [e for e in pointer.retired if e[3] <= due]:
                table, day, floor, _ = entry
                below = table
                if table in PARTITIONED:
                    below += "/*" if day == WHOLE else f"/{PARTITIONED[table]}={day}"
                paths = self.files.names(f"{below}/{PART}=*")
                stale = [p for p in paths if int(p.rsplit("=", 1)[1]) < floor]
                self.files.delete_all(stale)
                gone += len(stale)
                pointer.retired.remove(entry)
        return gone


def on_days(df: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the given days, so that only their partitions are read.

    The days become a filter on the partition column before the scan. There are at most as many
    values as the calendar has days, whatever the table holds.
    """
    return on_values(df, "date", day_list(days))


def day_list(days: DataFrame) -> list[object]:
    """The distinct days of a frame; bounded by the calendar."""
    return [r["date"] for r in days.select("date").distinct().collect()]


def on_values(df: DataFrame, column: str, values: Iterable[object]) -> DataFrame:
    """Rows with one of the given values of a partition column."""
    return df.filter(F.col(column).isin(list(values)))
