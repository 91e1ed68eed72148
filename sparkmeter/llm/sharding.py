"""Sharding: a minimax contiguous partition of ordered groups of equal texts.

Equal texts are one atomic group. Groups are ordered by the SHA-256 of their text, so a row finds
its shard by comparing its own digest with the cuts: no row is joined or moved for it, and a group
with a third of all rows is one number. The smallest feasible capacity is found by binary search,
where a capacity is checked by filling shards greedily. The check needs the last group end at or
before a few positions only. Group ends stay distributed: Spark summarises them into a fixed number
of bins, the check runs with a lower and an upper bound of every answer, and only where the two
disagree are the bins that a cut falls into summarised anew.

A null text has no bytes and belongs to the group of the empty text. Repeated rows are separate
rows of one group. An empty table gives no rows. Input columns other than id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import query
from sparkmeter.session import settle

SHARDS = 16
#: Summary rows per cut and job, and buckets of rows per shard when slots are numbered.
BINS = 4096
#: Digest prefixes by which groups are dealt out for their running sums: 4 hexadecimal digits.
_PREFIX = 4


@dataclass(frozen=True)
class Bin:
    """Group ends between two positions: the first and the last of them, and how many."""

    first: int
    last: int
    count: int


#: Summarises the group ends inside each of some ranges by a number of bins.
Summary = Callable[[list[tuple[int, int]], int], list[Bin]]


class EndBins:
    """What is known of the group ends: bins, refined where a search asks for more."""

    def __init__(self, summary: Summary, top: int, bins: int) -> None:
        self.summary, self.parts = summary, max(2, bins)
        self._hold(summary([(1, top)], self.parts * SHARDS))

    def _hold(self, bins: list[Bin]) -> None:
        self.bins = sorted(bins, key=lambda b: b.first)
        self.firsts = [b.first for b in self.bins]

    def _fill(self, shards: int, capacity: int, upper: bool) -> tuple[list[int], set[int]]:
        """Greedy cuts as far as the bins tell (from below or above), and the open bins they hit."""
        cuts, at, opened = [], 0, set()
        for _ in range(shards):
            target = at + capacity
            k = bisect_right(self.firsts, target) - 1
            if k >= 0:
                found = self.bins[k]
                if found.last <= target:
                    at = max(at, found.last)
                else:
                    # The last end at or before the target is inside this bin.
                    if found.count > 2:
                        opened.add(k)
                        at = max(at, target if upper else found.first)
                    else:
                        at = max(at, found.first)
            cuts.append(at)
        return cuts, opened

    def _refine(self, places: set[int]) -> None:
        ranges = [(self.bins[k].first, self.bins[k].last) for k in sorted(places)]
        kept = [b for k, b in enumerate(self.bins) if k not in places]
        self._hold(kept + self.summary(ranges, self.parts))

    def feasible(self, shards: int, capacity: int, total: int) -> bool:
        while True:
            low, some = self._fill(shards, capacity, upper=False)
            if low[-1] >= total:
                return True
            high, more = self._fill(shards, capacity, upper=True)
            if high[-1] < total:
                return False
            self._refine(some | more)

    def cuts(self, shards: int, capacity: int) -> list[int]:
        while True:
            low, some = self._fill(shards, capacity, upper=False)
            if not some:
                return low
            self._refine(some)


def group_ends(groups: DataFrame) -> DataFrame:
    """(digest, end): running sum of ``size`` in digest order, in two levels without one large sort."""
    prefix = F.substring("digest", 1, _PREFIX)
    sums = groups.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("n"))
    # At most 16 ** _PREFIX rows, whatever the table.
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("prefix").orderBy("digest")
    return (
        groups.withColumn("prefix", prefix)
        .withColumn("run", F.sum("size").over(within))
        .join(F.broadcast(starts), "prefix")
        .select("digest", (F.col("start") + F.col("run")).alias("end"))
    )


def _summary(ends: DataFrame) -> Summary:
    """Bins of a table of group ends: one job, with at most ranges x parts rows as its answer."""

    def of(ranges: list[tuple[int, int]], parts: int) -> list[Bin]:
        place: Column = F.lit(None).cast("struct<r:int,b:bigint>")
        inside = F.lit(False)
        for k, (low, high) in enumerate(ranges):
            width = max(1, -(-(high - low + 1) // parts))
            here = F.col("end").between(low, high)
            bin_of = F.floor((F.col("end") - low) / F.lit(width)).cast("bigint")
            place = F.when(here, F.struct(F.lit(k).alias("r"), bin_of.alias("b"))).otherwise(place)
            inside = inside | here
        rows = (
            ends.filter(inside)
            .groupBy(place.alias("p"))
            .agg(F.min("end").alias("first"), F.max("end").alias("last"), F.count("*").alias("n"))
            .collect()
        )
        return [Bin(r["first"], r["last"], r["n"]) for r in rows]

    return of


def search(summary: Summary, shards: int, top: int, bins: int = BINS) -> tuple[int, list[int]]:
    """The smallest capacity for ``shards`` contiguous shards, and where each of them ends."""
    known = EndBins(summary, top, bins)
    low, high = -(-top // shards), top
    while low < high:
        middle = (low + high) // 2
        if known.feasible(shards, middle, top):
            high = middle
        else:
            low = middle + 1
    return high, known.cuts(shards, high)


def minimax_cuts(ends: DataFrame, shards: int, bins: int = BINS) -> tuple[int, list[int]]:
    """``search`` over a table with one row per group and its running sum ``end``.

    An empty table gives (0, zeros).
    """
    top = ends.agg(F.max("end").alias("t")).first()["t"]
    return search(_summary(ends), shards, top, bins) if top else (0, [0] * shards)


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with their size, checksum, digest, shard and gapless slot in the shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settle(
        docs.select(
            F.col(id_col),
            (F.octet_length(body) + 1).cast("bigint").alias("bytes"),
            F.crc32(body).alias("text_crc32"),
            F.sha2(body, 256).alias("digest"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("digest").agg(F.sum("bytes").alias("size"))
    ends = settle(group_ends(groups), "shard-ends")
    _, cuts = minimax_cuts(ends, shards)
    last = {
        r["end"]: r["digest"] for r in ends.filter(F.col("end").isin(sorted(set(cuts)))).collect()
    }
    borders = [last[c] for c in cuts if c in last]
    shard = F.lit(0)
    for border in borders[:-1]:
        shard = shard + (F.col("digest") > border).cast("int")
    placed = rows.withColumns(
        {"shard": shard, "bucket": F.pmod(F.xxhash64(id_col, "digest"), F.lit(BINS))}
    )
    # shards x BINS counts: bounded, so they may be summed in one place and broadcast.
    before = (
        Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy(id_col, "digest")
    return (
        placed.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "bucket"])
        .withColumn("slot", (F.col("start") + F.col("place") - 1).cast("bigint"))
        .drop("place", "start", "bucket")
    )


@query("op1_minimax_shards")
def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        F.col("bytes").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
