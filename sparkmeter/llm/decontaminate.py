"""Benchmark decontamination: latent semantic search, then common subsequences and answer words.

Texts are read as passages of two adjacent blocks of ``BLOCK`` words; a passage is a TF-IDF vector
over hashed words, with document frequencies of all documents. A randomised SVD of the benchmark's
passages, whose products are summed by tasks, gives a latent space of fixed size. Every passage of
every document is compared with every passage of the benchmark in that space, block of items by
block of items: the benchmark is the query set, and a block is bounded, so it is broadcast.
A passage whose weight lies mostly on words that the benchmark lacks is passed over before, since
its TF-IDF cosine with any item is at most the share of its norm on the benchmark's words.

A candidate is a leak if the longest common subsequence of the item and the words around the
passage has at least ``LCS_SHARE`` of the item's words (so reworded items count) and at least
``ANSWER_SHARE`` of the item's rarest words, which stand for its answer, are there too. Items of
fewer than ``SHORTEST`` words must be found whole.

Every place over the threshold is tried, the best first, until one holds the item. There is one row per
document and item: the best over repeated rows, repeated ids and, where an item id has several
texts, over these. Null or empty texts and items match nothing; null ids are one id. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import query
from sparkmeter.llm.words import chunks, split_words
from sparkmeter.session import settle

BLOCK = 16
#: Hashed words: the size of document frequencies and of the latent basis is fixed.
DIMENSIONS = 1 << 15
RANK, EXTRA, POWERS = 96, 16, 2
#: Least cosine in the latent space, and least share of a passage's norm on benchmark words.
COSINE, NORM_SHARE = 0.45, 0.45
LCS_SHARE, ANSWER_SHARE, ANSWER_PART, SHORTEST = 0.6, 0.5, 0.2, 8
#: Items that are searched for in one pass over the documents.
ITEMS_PER_PASS = 4096
SEED = 7


def _word_hashes(texts: pa.Array):
    found = split_words(texts)
    return found, found.hashes(lower=True)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): how many of a task's texts have a word of each bucket; bucket -1: all texts."""
    totals, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for batch in batches:
        for part in chunks(batch, "text"):
            found, hashes = _word_hashes(part.column("text"))
            pairs = np.unique(found.row_of_word() * DIMENSIONS + _buckets(hashes))
            totals += np.bincount(pairs % DIMENSIONS, minlength=DIMENSIONS)
            rows += part.num_rows
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([[-1], used])), pa.array(np.concatenate([[rows], totals[used]]))],
        names=["bucket", "n"],
    )


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weight of each bucket from all documents."""
    parts = docs.select(F.col(text).alias("text")).mapInArrow(_frequencies, "bucket long, n long")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # fixed number of buckets
    counts = np.zeros(DIMENSIONS + 1)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()  # -1 is the last
    return np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1


def _passages(found, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each block, its row, and the row of each passage (two blocks, or one alone)."""
    sizes = np.diff(found.rows)
    blocks = -(-sizes // BLOCK)
    row = np.repeat(np.arange(count), blocks)
    before = np.concatenate([[0], np.cumsum(blocks)])
    start = (np.arange(before[-1]) - before[row]) * BLOCK + found.rows[row]
    # A passage starts at each block that has a next one in its row, or is alone.
    first = np.zeros(len(row), dtype=bool)
    first[:-1] = row[:-1] == row[1:]
    first |= blocks[row] == 1
    return start, row, np.flatnonzero(first)


def _pair_sums(values: np.ndarray, start: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of word values over passages."""
    sums = np.add.reduceat(values, start, axis=0)
    out = sums[first].copy()
    two = first[(first + 1 < len(row))]
    two = two[row[two] == row[two + 1]]
    out[np.searchsorted(first, two)] += sums[two + 1]
    return out


@dataclass(frozen=True)
class Space:
    """TF-IDF weights, the buckets that the benchmark has, and the latent basis of these."""

    idf: np.ndarray
    #: Row of each bucket in the basis; buckets that the benchmark lacks have the last row, all 0.
    index: np.ndarray
    basis: np.ndarray

    def norm_shares(self, buckets: np.ndarray, places) -> np.ndarray:
        """Share of each passage's norm on words of the benchmark (words of a passage once each)."""
        squares = (self.idf**2)[buckets]
        known = np.where((self.index < len(self.basis) - 1)[buckets], squares, 0)
        both = _pair_sums(np.stack([known, squares], axis=1), *places)
        return np.sqrt(both[:, 0] / np.maximum(both[:, 1], 1e-12))


def _products(held: Broadcast):
    """(k, v): a task's part of A'A times a thin matrix, as rows of the result that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, index, right = held.value
        total = np.zeros(right.shape)
        for batch in batches:
            for part in chunks(batch, "text"):
                found, hashes = _word_hashes(part.column("text"))
                if not len(hashes):
                    continue
                places = _passages(found, part.num_rows)
                buckets = _buckets(hashes)
                rows, weights = index[buckets], idf[buckets][:, None]
                scores = _pair_sums(weights * right[rows], *places)
                start, row, first = places
                for k, p in enumerate(first):
                    end = found.rows[row[p] + 1]
                    words = slice(start[p], min(start[p] + 2 * BLOCK, end))
                    np.add.at(total, rows[words], weights[words] * scores[k])
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["k", "v"]
        )

    return run


def _times(passages: DataFrame, idf: np.ndarray, index: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A'A times a thin matrix: summed over tasks, one row per bucket of the benchmark at most."""
    held = passages.sparkSession.sparkContext.broadcast((idf, index, right))
    parts = passages.mapInArrow(_products(held), "k long, v array<double>")
    width = right.shape[1]
    sums = parts.groupBy("k").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(width)])
    found = sums.toArrow()
    held.destroy()
    out = np.zeros(right.shape)
    rows = found.column("k").to_numpy()
    for j in range(width):
        out[rows, j] = found.column(f"v{j}").to_numpy()
    return out


def latent_space(items: DataFrame, idf: np.ndarray) -> Space:
    """Randomised SVD of the items' TF-IDF passages: right singular directions, weighted by idf.

    All matrices have a row for each bucket that the benchmark has, not for all buckets.
    """
    passages = items.select("text")
    seen = passages.mapInArrow(_frequencies, "bucket long, n long").filter("bucket >= 0")
    used = np.sort(seen.select("bucket").distinct().toArrow().column("bucket").to_numpy())
    index = np.full(DIMENSIONS, len(used), dtype=np.int32)
    index[used] = np.arange(len(used))
    basis = np.random.default_rng(SEED).normal(size=(len(used), RANK + EXTRA))
    for _ in range(POWERS):
        basis, _ = np.linalg.qr(_times(passages, idf, index, basis))
    small = basis.T @ _times(passages, idf, index, basis)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[:RANK]
    top = top[values[top] > 1e-9 * max(values.max(), 1e-30)]
    directions = (basis @ turned[:, top]) * idf[used][:, None]
    none = np.zeros((1, directions.shape[1]))
    return Space(idf.astype(np.float32), index, np.concatenate([directions, none]).astype(np.float32))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of ``a``."""
    places: dict[int, int] = {}
    for k, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        hit = row & places.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Item:
    item_id: int
    words: np.ndarray
    answer: frozenset[int]

    def needs(self) -> int:
        n = len(self.words)
        return n if n < SHORTEST else int(np.ceil(LCS_SHARE * n))


def _items(rows: list, idf: np.ndarray) -> tuple[list[Item], pa.Array]:
    items, texts = [], pa.array([r["text"] for r in rows], pa.string())
    found, hashes = _word_hashes(texts)
    for r, low, high in zip(rows, found.rows[:-1], found.rows[1:], strict=True):
        own = hashes[low:high]
        distinct = np.unique(own)
        rare = distinct[np.argsort(-idf[_buckets(distinct)], kind="stable")]
        answer = frozenset(rare[: max(1, int(np.ceil(ANSWER_PART * len(distinct))))].tolist())
        items.append(Item(r["item_id"], own, answer))
    return items, texts


def _places(scores: np.ndarray, row: np.ndarray, start: np.ndarray, owners: np.ndarray) -> list[np.ndarray]:
    """Row, item, cosine and first word of all candidate places, as arrays."""
    p, q = np.nonzero(scores >= COSINE)
    return [row[p], owners[q], scores[p, q], start[p]]


#: Flags of words in rows that are held at a time.
FLAGS = 1 << 24


class Wanted:
    """Words of a pass's items, and the places in texts that have enough of them."""

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.vocabulary = np.unique(np.concatenate([x.words for x in items]))
        self.words = [np.searchsorted(self.vocabulary, x.words) for x in items]
        answers = [np.fromiter(x.answer, dtype=np.uint64, count=len(x.answer)) for x in items]
        self.answers = [np.searchsorted(self.vocabulary, x) for x in answers]
        self.member = np.zeros(len(self.vocabulary) + 1, dtype=bool)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary; other words have the number after the last."""
        found = np.searchsorted(self.vocabulary, hashes)
        found[found == len(self.vocabulary)] = 0
        found[self.vocabulary[found] != hashes] = len(self.vocabulary)
        return found

    def among(self, words: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which ids are among some words."""
        self.member[words] = True
        hit = self.member[ids]
        self.member[words] = False
        return hit

    def possible(self, places: list[np.ndarray], found, ids: np.ndarray) -> np.ndarray:
        """Which places lie in a row that has enough of the item's words, and of its answer's, anywhere.

        Each word counts once for a row, and each place of a word in the item once, so no row that
        holds the item is lost. As each row has a flag for each word, some rows are taken at a time.
        """
        row, owner = places[:2]
        out = np.zeros(len(row), dtype=bool)
        count, step = len(found.rows) - 1, max(1, FLAGS // len(self.member))
        for low in range(0, count, step):
            high = min(low + step, count)
            some = np.flatnonzero((row >= low) & (row < high))
            if not len(some):
                continue
            own = np.repeat(np.arange(high - low), np.diff(found.rows[low : high + 1]))
            has = np.zeros((len(self.member), high - low), dtype=bool)
            has[ids[found.rows[low] : found.rows[high]], own] = True
            holds = np.zeros((len(self.items), high - low), dtype=bool)
            for i in np.unique(owner[some]):
                enough = has[self.answers[i]].sum(axis=0) / len(self.answers[i]) >= ANSWER_SHARE
                holds[i] = enough & (has[self.words[i]].sum(axis=0) >= self.items[i].needs())
            out[some] = holds[owner[some], row[some] - low]
        return out

    def likely(self, places: list[np.ndarray], found, ids: np.ndarray) -> np.ndarray:
        """Which places have enough of the item's words, and of its answer's words as often, around them.

        Counted for all rows of an item at once, by running counts. Words of the answer that come
        again count again, so no place with enough distinct ones is lost.
        """
        row, owner, _, start = places
        out = np.zeros(len(row), dtype=bool)
        order = np.argsort(owner, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            if not len(some):
                continue
            i = owner[some[0]]
            rows, back = np.unique(row[some], return_inverse=True)
            first = found.rows[rows]
            sizes = found.rows[rows + 1] - first
            before = np.concatenate([[0], np.cumsum(sizes)])
            own = ids[np.arange(before[-1]) + np.repeat(first - before[:-1], sizes)]
            low, high = _around(start[some] - first[back], sizes[back], self.items[i])
            low, high = before[back] + low, before[back] + high
            counts = []
            for words in (self.words[i], self.answers[i]):
                until = np.zeros(len(own) + 1, dtype=np.int64)
                np.cumsum(self.among(words, own), out=until[1:])
                counts.append(until[high] - until[low])
            enough = counts[1] / len(self.answers[i]) >= ANSWER_SHARE
            out[some] = enough & (counts[0] >= self.items[i].needs())
        return out


def _around(at: np.ndarray, size: np.ndarray, item: Item) -> tuple[np.ndarray, np.ndarray]:
    """First and last word around places of rows with some words, in which an item may lie."""
    reach = len(item.words) + BLOCK
    return np.maximum(0, at - reach), np.minimum(size, at + 2 * BLOCK + reach)


def _verified(places: list[np.ndarray], wanted: Wanted, found, hashes: np.ndarray) -> list[tuple]:
    """The first place of each row and item that holds the item, as result columns.

    Flags of words pass over the rows with too few words of the item or its answer, then running
    counts over the places with too few around them. Then the distinct words of the answer are counted, and only then words are compared in order; equal words near
    several places are compared once. The best place of a row and item is tried first.
    """
    rows: list[tuple] = []
    if not len(places[0]):
        return rows
    ids = wanted.ids(hashes)
    for told in (wanted.possible, wanted.likely):
        hit = told(places, found, ids)
        places = [x[hit] for x in places]
    row, owner, score, start = places
    order = np.lexsort((start, -score, owner, row))
    tried = zip(*[x[order].tolist() for x in (row, owner, score, start)], strict=True)
    for (k, i), group in groupby(tried, key=lambda x: (x[0], x[1])):
        item = wanted.items[i]
        first, last = found.rows[k], found.rows[k + 1]
        seen = set()
        for _, _, cosine, at in group:
            low, high = _around(at - first, last - first, item)
            near = slice(first + low, first + high)
            own = hashes[near][wanted.among(wanted.words[i], ids[near])]
            share = len(item.answer.intersection(own.tolist())) / len(item.answer)
            if share < ANSWER_SHARE or own.tobytes() in seen:
                continue
            seen.add(own.tobytes())
            lcs = common_subsequence(item.words, own)
            if lcs >= item.needs():
                rows.append((k, item.item_id, cosine, lcs, len(item.words), share))
                break
    return rows


#: Passages that are compared with the benchmark at a time: bounds the matrix of scores.
SLICE = 1024


def _search(held: Broadcast):
    """(doc_id, item_id, cosine, lcs, item_words, answer_share) of the leaks in each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, queries, owners, space = held.value
        wanted = Wanted(items)
        for batch in batches:
            for part in chunks(batch, "text"):
                found, hashes = _word_hashes(part.column("text"))
                rows = []
                if len(hashes):
                    buckets = _buckets(hashes)
                    places = _passages(found, part.num_rows)
                    start, row, first = places
                    near = first[space.norm_shares(buckets, places) >= NORM_SHARE]
                    parts = []
                    for at in range(0, len(near), SLICE):
                        some = near[at : at + SLICE]
                        vectors = _vectors_of(space, buckets, found, start[some], row[some])
                        parts.append(_places(vectors @ queries.T, row[some], start[some], owners))
                    if parts:
                        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
                        rows = _verified(joined, wanted, found, hashes)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(columns[0], pa.int64())),
                        *[pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)],
                    ],
                    names=["doc_id", "item_id", "cosine", "lcs", "item_words", "answer_share"],
                )

    return run


def _vectors_of(space: Space, buckets: np.ndarray, found, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Latent vectors of some passages."""
    ends = np.minimum(start + 2 * BLOCK, found.rows[row + 1])
    sizes = ends - start
    before = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(before[-1]) - np.repeat(before[:-1] - start, sizes)
    sums = np.add.reduceat(space.basis[space.index[buckets[index]]], before[:-1], axis=0)
    return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per leak: (doc_id, item_id, cosine, lcs, item_words, answer_share)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, cosine double, lcs long, item_words long, answer_share double"
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    asked = benchmark.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        F.col("item_id").cast("bigint").alias("item_id"), "text"
    )
    count = asked.count()
    if not count:
        return spark.createDataFrame([], schema)
    idf = inverse_frequencies(docs, text)
    space = latent_space(asked, idf)
    passes = -(-count // ITEMS_PER_PASS)
    dealt = settle(asked.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))), "items")
    held, found = [], None
    for k in range(passes):
        rows = dealt.filter(F.col("pass") == k).collect()  # about ITEMS_PER_PASS items
        if not rows:
            continue
        items, texts = _items(rows, idf)
        words, hashes = _word_hashes(texts)
        start, row, first = _passages(words, len(items))
        queries = _vectors_of(space, _buckets(hashes), words, start[first], row[first])
        held.append(spark.sparkContext.broadcast((items, queries, row[first], space)))
        leaks = source.mapInArrow(_search(held[-1]), schema)
        found = leaks if found is None else found.unionAll(leaks)
    best = F.max(F.struct("lcs", "cosine", "item_words", "answer_share")).alias("b")
    merged = found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.cosine", "b.lcs", "b.item_words", "b.answer_share"
    )
    # Written, so that the benchmark does not stay on the executors.
    written = settle(merged, "leaks")
    for part in held:
        part.destroy()
    return written


@query("op3_latent_leaks")
def op3_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
