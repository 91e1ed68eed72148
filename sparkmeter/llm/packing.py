"""Packing: best-fit decreasing into windows of a fixed number of tokens.

Each document is tokenised once, where its text is read, and ends with an end-of-text id. An
overlong document is first cut into full windows; these are sequences of their own. The rests are
dealt to bins of about ``BIN_WINDOWS`` windows by a hash of the document, so a task packs a bounded
number of rows, and each bin is packed best-fit decreasing: pieces from the longest to the
shortest, each into the open window with the least room that still holds it. A segment tree over
the rooms 0 to 2048 holds how many open windows have each room and finds the tightest in eleven
steps. A bin wastes less than one window besides what best fit wastes.

The number of bins comes from the counted tokens, so windows are alike at every size. A null text
is an empty document: one piece with the end-of-text id. Rows that repeat are packed each.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import query
from sparkmeter.llm.words import chunks
from sparkmeter.session import settle

WINDOW = 2048
END_ID = 1
#: Windows of rests in a bin: what one task holds at a time (half a million tokens).
BIN_WINDOWS = 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece_key long"


@cache
def _encoder(ranks_path: str, pattern: str):
    """The tokenizer's encoder: the same ids as the JSON file of this vocabulary gives."""
    import tiktoken

    ranks = {
        base64.b64decode(token): int(rank)
        for token, rank in map(bytes.split, Path(ranks_path).read_bytes().splitlines())
    }
    return tiktoken.Encoding(
        "given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
    )


def tokenizer_ids(texts: list[str]) -> Iterator[list[int]]:
    """Ids of each text under ``byte_bpe_50k``, found where the task runs.

    The vocabulary is read as ranks, which gives the ids of ``byte_bpe_50k.json`` several times
    faster; as there, the special token's string in a text is that token.
    """
    import public_tokenizers

    encoder = _encoder(
        str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    )
    for text in texts:
        if "<|endoftext|>" in text:
            yield encoder.encode(text, allowed_special="all")
        else:
            yield encoder.encode_ordinary(text)


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of each document, all full but the last."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows: list[tuple] = []
                ids = part.column("doc_id").to_pylist()
                texts = [t or "" for t in part.column("text").to_pylist()]
                keys = part.column("key").to_pylist()
                for doc_id, key, tokens in zip(ids, keys, tokenizer_ids(texts), strict=True):
                    data = np.array([*tokens, END_ID], dtype="<u4")
                    for start in range(0, len(data), WINDOW):
                        piece = data[start : start + WINDOW]
                        rows.append(
                            (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(data), key)
                        )
                names = [f.split()[0] for f in PIECES.split(", ")]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(id_col, text).alias("key"),
    )
    return source.mapInArrow(cut, PIECES)


class RoomTree:
    """Open windows by room, as counts in a segment tree over the rooms 0 to ``size``."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << (size + 1 - 1).bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.leaves
        while node:
            self.counts[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``length``, and that room."""
        node = length + self.leaves
        if not self.counts[node]:
            # Up to the first subtree on the right that is not empty, then down to its left.
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.open[room].pop()
        while node:
            self.counts[node] -= 1
            node >>= 1
        return window, room


def best_fit(lengths: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length, best-fit decreasing."""
    tree, used = RoomTree(size), 0
    windows = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        length = int(lengths[k])
        found = tree.take(length)
        if found is None:
            window, room = used, size
            used += 1
        else:
            window, room = found
        windows[k], offsets[k] = window, size - room
        tree.add(room - length, window)
    return windows, offsets


def pack(pieces: DataFrame, bin_windows: int = BIN_WINDOWS) -> DataFrame:
    """Add ``sequence_id`` (gapless from 0) and ``offset`` to settled pieces."""
    full = F.col("length") == WINDOW
    size = pieces.agg(F.sum(F.when(~full, F.col("length"))).alias("n")).first()["n"] or 0
    bins = max(1, -(-size // (bin_windows * WINDOW)))
    parts = pieces.withColumn("bin", F.pmod(F.xxhash64("piece_key", "start"), F.lit(bins)))
    schema = f"{PIECES}, bin long, local long, offset long"

    def place(batch: pa.Table) -> pa.Table:
        order = batch.sort_by(
            [(c, "ascending") for c in ("piece_key", "doc_id", "start", "ids_crc32")]
        )
        windows, offsets = best_fit(order.column("length").to_numpy())
        return order.append_column("local", pa.array(windows)).append_column(
            "offset", pa.array(offsets)
        )

    rests = parts.filter(~full).groupBy("bin").applyInArrow(place, schema)
    # Full windows: numbered inside buckets, bounded in number by the bins.
    ranked = Window.partitionBy("bin").orderBy("piece_key", "doc_id", "start", "ids_crc32")
    wholes = parts.filter(full).select(
        *parts.columns,
        (F.row_number().over(ranked) - 1).cast("bigint").alias("local"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    placed = settle(
        rests.withColumn("kind", F.lit(0)).unionByName(wholes.withColumn("kind", F.lit(1))),
        "packed",
    )
    # One row per bin and kind. A bin holds half a million tokens, so this stays small.
    counts = placed.groupBy("bin", "kind").agg((F.max("local") + 1).alias("n"))
    before = Window.orderBy("kind", "bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bin", "kind", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    return placed.join(starts, ["bin", "kind"]).withColumn(
        "sequence_id", (F.col("at") + F.col("local")).cast("bigint")
    )


COLUMNS = "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(settle(cut_pieces(docs, id_col, text), "pieces")).select(*COLUMNS)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
