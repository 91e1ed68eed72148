"""Substring removal: words of repeated passages, found by prefix-partitioned suffix subtrees.

A suffix matters only if the node at depth ``WINDOW`` on its path has another leaf: then the window
of words it starts with repeats. To leave out most other suffixes without loss, each window is
filed under the least of its ``PREFIX``-word hashes. Equal windows have the same least prefix at
the same place, so only windows whose prefix is found more than once can repeat.

Suffixes that are left are split by that prefix into groups that fit into memory; where a prefix
is found more than ``GROUP`` times, the prefix is lengthened to the whole window, and the rows of
one window are reduced to the first before they are moved. A task sorts the suffixes of its groups
by the path to depth ``WINDOW`` (known by its hash, under one prefix) and then by document and
place. Nodes with one path are the deep internal nodes; the first leaf of each stays, the windows
of all other leaves are covered, and touching ones join to maximal repeats.

Whole copies need no tree: only the text of the smallest id takes part, the others lose every word
if they have a window at all. The texts are shuffled once, by id, and that exchange is used again.

"Earlier" means a smaller id, or the same document and an earlier start; a null id comes last, and
among different texts with one id a text hash decides. Rows with equal id and text are one
document and get equal results. Null texts have no words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import query
from sparkmeter.llm.words import Words, chunks, mix, ngram_hashes, split_words

WINDOW, PREFIX = 20, 8
#: Most suffixes of a group that is held by its short prefix.
GROUP = 4096
_LAST_ID = (1 << 63) - 1
_ROWS = 20_000


class Windows:
    """Windows of the rows of a chunk, each with the place of its least prefix."""

    def __init__(self, found: Words) -> None:
        self.found = found
        words = found.hashes()
        self.rows = np.diff(found.rows)
        self.prefixes = ngram_hashes(words, PREFIX)
        self.paths = ngram_hashes(words, WINDOW, seed=3)
        counts = np.maximum(0, self.rows - WINDOW + 1)
        #: Row and first word of each window inside a row.
        self.row = np.repeat(np.arange(len(counts)), counts)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        self.start = np.arange(firsts[-1]) - firsts[self.row] + found.rows[self.row]
        width = WINDOW - PREFIX + 1
        if len(self.start):
            views = np.lib.stride_tricks.sliding_window_view(self.prefixes, width)
            self.anchor = self.start + views.argmin(axis=1)[self.start]
        else:
            self.anchor = self.start

    def local(self, places: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return places - self.found.rows[rows]


def _with_keys(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Documents by id, with ``leads`` (its text's first id) and ``twin`` (tells texts of one id)."""
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST_ID)).alias("kd"),
        F.xxhash64(body).alias("a"),
        body.alias("text"),
    )
    keys = source.select("kd", "a", F.xxhash64(F.lit(1), "text").alias("b")).distinct()
    firsts = keys.groupBy("a", "b").agg(F.min("kd").alias("first"))
    known = (
        keys.join(firsts, ["a", "b"])
        .groupBy("kd")
        .agg(F.collect_list(F.struct("a", (F.col("first") == F.col("kd")).alias("leads"))).alias("texts"))
    )
    here = F.get(F.filter("texts", lambda t: t["a"] == F.col("a")), F.lit(0))
    return source.join(known.hint("shuffle_hash"), "kd").select(
        "doc_id",
        "kd",
        here["leads"].alias("leads"),
        F.when(F.size("texts") > 1, F.col("a")).otherwise(F.lit(0)).alias("twin"),
        "text",
    )


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, kd, twin, at): the least prefixes of all windows, each place once."""
    for batch in batches:
        for part in chunks(batch, "text"):
            found = Windows(split_words(part.column("text")))
            fresh = np.ones(len(found.anchor), dtype=bool)
            fresh[1:] = (np.diff(found.anchor) != 0) | (np.diff(found.row) != 0)
            row, anchor = found.row[fresh], found.anchor[fresh]
            kd, twin = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("kd", "twin"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.prefixes[anchor].view(np.int64)),
                    pa.array(kd),
                    pa.array(twin),
                    pa.array(found.local(anchor, row).astype(np.int32)),
                ],
                names=["g", "kd", "twin", "at"],
            )


def _marked(part: pa.RecordBatch, found: Windows, field: str) -> Iterator[tuple[int, np.ndarray]]:
    """For each row with a list, the rows of numbers that belong to its text."""
    twins = part.column("twin").to_pylist()
    column = part.column(field)
    for k in range(part.num_rows):
        if column[k].is_valid:
            values = column[k].values
            numbers = np.stack(
                [values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(values.type.num_fields)], axis=1
            )
            yield k, numbers[numbers[:, 0] == twins[k]][:, 1:]


def _candidates(part: pa.RecordBatch, found: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Which windows are filed under a repeated prefix, and which of them under a frequent one."""
    marks = np.zeros(len(found.found.starts) + 1, dtype=np.int8)
    for k, numbers in _marked(part, found, "prefixes"):
        marks[found.found.rows[k] + numbers[:, 0]] = 1 + numbers[:, 1]
    mark = marks[found.anchor]
    return mark > 0, mark > 1


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, kd, twin, at, paths): runs of suffixes under one prefix; frequent ones one by one."""
    names = ["g", "kd", "twin", "at", "paths"]
    for batch in batches:
        singles: list[np.ndarray] = []
        for part in chunks(batch, "text"):
            found = Windows(split_words(part.column("text")))
            some, many = _candidates(part, found)
            ids = [part.column(c).to_numpy(zero_copy_only=False) for c in ("kd", "twin")]
            # Frequent prefixes: the path is the prefix.
            pick = np.flatnonzero(many)
            row = found.row[pick]
            singles.append(
                np.stack(
                    [found.paths[found.start[pick]].view(np.int64), ids[0][row], ids[1][row], found.local(found.start[pick], row)],
                    axis=1,
                )
            )
            pick = np.flatnonzero(some & ~many)
            if not len(pick):
                continue
            breaks = (
                (np.diff(pick) != 1) | (np.diff(found.anchor[pick]) != 0) | (np.diff(found.row[pick]) != 0)
            )
            first = np.concatenate([[0], np.flatnonzero(breaks) + 1])
            row = found.row[pick[first]]
            offsets = pa.array(np.concatenate([first, [len(pick)]]).astype(np.int32))
            paths = pa.ListArray.from_arrays(offsets, pa.array(found.paths[found.start[pick]].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found.prefixes[found.anchor[pick[first]]].view(np.int64)),
                    pa.array(ids[0][row]),
                    pa.array(ids[1][row]),
                    pa.array(found.local(found.start[pick[first]], row).astype(np.int32)),
                    paths,
                ],
                names=names,
            )
        alone = np.concatenate(singles) if singles else np.zeros((0, 4), dtype=np.int64)
        if len(alone):
            alone = alone[np.lexsort(alone.T[::-1])]
            alone = alone[np.concatenate([[True], np.diff(alone[:, 0]) != 0])]
            path = pa.array(alone[:, 0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(mix(alone[:, 0].view(np.uint64), 5).view(np.int64)),
                    *(pa.array(alone[:, c]) for c in (1, 2)),
                    pa.array(alone[:, 3].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(alone) + 1, dtype=np.int32)), path),
                ],
                names=names,
            )


def _first_leaves(rows: pa.Table) -> pa.RecordBatch:
    """(kd, twin, at, n): runs of suffixes that are the first leaf of their node."""
    rows = rows.combine_chunks()
    paths = rows.column("paths").combine_chunks() if rows.num_rows else rows.column("paths")
    sizes = paths.value_lengths().to_numpy(zero_copy_only=False)
    record = np.repeat(np.arange(len(sizes)), sizes)
    path = paths.flatten().to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    g, kd, twin, at = (rows.column(c).to_numpy() for c in ("g", "kd", "twin", "at"))
    at_all = at[record] + np.arange(len(record)) - before[record]
    order = np.lexsort((at_all, twin[record], kd[record], path, g[record]))
    ranked_g, ranked_path = g[record][order], path[order]
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = (np.diff(ranked_g) != 0) | (np.diff(ranked_path) != 0)
    pick = np.sort(order[lead])
    breaks = (np.diff(pick) != 1) | (np.diff(record[pick]) != 0)
    first = np.concatenate([[0], np.flatnonzero(breaks) + 1]) if len(pick) else np.zeros(0, dtype=int)
    n = np.diff(np.concatenate([first, [len(pick)]])) if len(pick) else first
    head = pick[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(kd[record[head]]),
            pa.array(twin[record[head]]),
            pa.array(at_all[head].astype(np.int32)),
            pa.array(n.astype(np.int32)),
        ],
        names=["kd", "twin", "at", "n"],
    )


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First leaves of all nodes of a partition that is sorted by ``g``, a few groups at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < _ROWS:
            continue
        both = pa.Table.from_batches(held)
        g = both.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1], side="left"))
        if cut:
            yield _first_leaves(both.slice(0, cut))
        rest = both.slice(cut)
        if rest.num_rows > GROUP:
            # Only a whole window has that many rows: its first one stands for them.
            rest = rest.sort_by([("kd", "ascending"), ("twin", "ascending"), ("at", "ascending")]).slice(0, 1)
        held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield _first_leaves(pa.Table.from_batches(held))


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every document."""
    for batch in batches:
        for part in chunks(batch, "text"):
            found = Windows(split_words(part.column("text")))
            some, _ = _candidates(part, found)
            first = np.zeros(len(found.found.starts) + 1, dtype=bool)
            for k, numbers in _marked(part, found, "firsts"):
                begin = found.found.rows[k]
                for at, n in numbers:
                    first[begin + at : begin + at + n] = True
            steps = np.zeros(len(found.found.starts) + 1, dtype=np.int64)
            gone = found.start[some & ~first[found.start]]
            np.add.at(steps, gone, 1)
            np.add.at(steps, gone + WINDOW, -1)
            covered = np.cumsum(steps)[:-1] > 0
            leads = part.column("leads").to_numpy(zero_copy_only=False)
            data = found.found.data.tobytes()
            removed, digests = [], []
            for k, (low, high) in enumerate(zip(found.found.rows[:-1], found.found.rows[1:], strict=True)):
                if not leads[k] and high - low >= WINDOW:
                    covered[low:high] = True
                out = int(covered[low:high].sum())
                removed.append(out)
                if out:
                    keep = np.flatnonzero(~covered[low:high]) + low
                    spans = zip(found.found.starts[keep].tolist(), found.found.ends[keep].tolist(), strict=True)
                    body = b" ".join([data[s:e] for s, e in spans])
                else:
                    body = b" ".join(data[found.found.row_bytes[k] : found.found.row_bytes[k + 1]].split())
                digests.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(found.rows.astype(np.int64)),
                    pa.array(removed, pa.int64()),
                    pa.array(digests),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the words, the removed words and the digest of the kept text."""
    keyed = _with_keys(docs, id_col, text)
    prefixes = keyed.filter("leads").select("kd", "twin", "text").mapInArrow(
        _prefix_rows, "g long, kd long, twin long, at int"
    )
    counted = prefixes.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = prefixes.join(counted.select("g", (F.col("n") > GROUP).cast("int").alias("many")), "g")
    lists = repeated.groupBy("kd").agg(
        F.collect_list(F.struct("twin", "at", "many")).alias("prefixes")
    )
    marked = keyed.join(lists.hint("shuffle_hash"), "kd", "left")
    runs = (
        marked.filter(F.col("leads") & F.col("prefixes").isNotNull())
        .select("kd", "twin", "text", "prefixes")
        .mapInArrow(_suffix_rows, "g long, kd long, twin long, at int, paths array<long>")
    )
    leaves = (
        runs.repartition("g")
        .sortWithinPartitions("g")
        .mapInArrow(_subtrees, "kd long, twin long, at int, n int")
    )
    firsts = leaves.groupBy("kd").agg(F.collect_list(F.struct("twin", "at", "n")).alias("firsts"))
    kind = docs.schema[id_col].dataType.simpleString()
    return marked.join(firsts.hint("shuffle_hash"), "kd", "left").mapInArrow(
        _kept_rows, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    )


@query("op9_suffix_subtrees")
def op9_suffix_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
