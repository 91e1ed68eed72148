"""Collocations: phrases that hold together more than their parts, counted exactly.

A text is lowered (A to Z), cut into pieces at punctuation and line ends, and each piece into words. Phrases
are runs of words inside one piece; everything is counted per language. Two passes find every phrase
with ``THRESHOLD`` occurrences:

1. Misra-Gries summaries per hash partition. A task sums the hashes of its n-grams in bounded buffers and
   sends each hash partition one block per buffer. A partition merges its blocks one by one: when it holds
   more than its capacity, the first count beyond it is taken from all counts and the empty ones go. The
   capacity is twice the partition's occurrences over the threshold, so at most half a threshold
   is ever taken, and every n-gram whose count plus what was taken reaches the threshold survives.
   The occurrences of a partition are known before its blocks, as small rows that sort first.
2. The survivors mark a bitmap of fixed size. Every occurrence that meets a marked bit is counted
   by its words, so counts are exact; false marks and equal hashes cost only time.

Memory does not depend on the corpus: the number of hash partitions follows the bytes of text, a
frequent n-gram adds one entry per buffer to its partition, and the bitmap is a parameter (more
survivors than a tenth of its bits make the second pass count more than it needs, never less).

Scores, cuts and containment are joins over the counted phrases; the first phrases of a language are
taken in two levels, so no task sees a whole language.

Defined results: null and empty texts have no words; a null language is ``und``. Repeated rows and
copies count as often as they occur. Ties are ordered by count, then by the bytes of the phrase. An empty
table gives an empty result. Very long texts are read whole. Other columns are not used, whatever
their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import query
from sparkmeter.llm.words import Words, chunks, mix, ngram_hashes
from sparkmeter.session import settle, shuffles_removed

THRESHOLD = 10
MOST_WORDS = 3
#: A candidate goes when a longer phrase around it has this share (percent) of its occurrences.
COVERED = 50
FIRST = 2000
#: Score of a phrase that is as frequent as each of its parts.
UNIT = 1_000_000
#: Bytes of text per hash partition, entries in a task's buffer, entries in a block.
PARTITION_BYTES = 8 << 20
BUFFER = 2 << 20
BLOCK = 1 << 18
#: Bits of the survivors' bitmap, a power of two.
BITS = 1 << 26
#: Parts of a language whose first phrases are found apart.
PARTS = 64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Pieces:
    """Words of some rows: joined by one space, with the row and the piece each lies in."""

    joined: np.ndarray
    starts: np.ndarray  # places in joined
    ends: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray
    hashes: np.ndarray
    again: np.ndarray  # hashes with another seed

    def grams(self, n: int) -> np.ndarray:
        """First words of the runs of ``n`` words inside a piece."""
        last = len(self.pieces) - n + 1
        if last <= 0:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.pieces[:last] == self.pieces[n - 1 :])

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The runs of ``n`` words from the given words on, as text."""
        begin, end = self.starts[first], self.ends[first + n - 1]
        places = np.concatenate([[0], np.cumsum(end - begin)])
        take = np.repeat(begin - places[:-1], end - begin) + np.arange(places[-1])
        buffers = [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(self.joined[take])]
        return pa.Array.from_buffers(pa.large_string(), len(first), buffers).cast(pa.string())


def read_pieces(texts: pa.Array, second: bool = False) -> Pieces:
    """Words of a string column; each row ends with a line end, so no piece spans two rows."""
    whole = pc.fill_null(texts.cast(pa.large_string()), "")
    whole = pc.binary_join_element_wise(whole, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(whole, pa.ChunkedArray):
        whole = whole.combine_chunks()
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = _LOWER[np.frombuffer(whole.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    word = _WORD[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    own = Words(data, offsets, offsets, starts, ends)
    kept = word.copy()
    kept[ends] = True
    spaced = data.copy()
    spaced[ends] = 0x20
    until = np.cumsum(ends - starts + 1)
    return Pieces(
        joined=spaced[kept],
        starts=until - (ends - starts + 1),
        ends=until - 1,
        rows=np.searchsorted(offsets - offsets[0], starts, side="right") - 1,
        pieces=np.cumsum(_BREAK[data])[starts] if len(starts) else starts,
        hashes=own.hashes(),
        again=own.hashes(seed=1) if second else np.zeros(0, dtype=np.uint64),
    )


def _language_hashes(langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's language in the batch, and a hash of each language."""
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    digests = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in names]
    hashes = np.array([int.from_bytes(d, "little") for d in digests], dtype=np.uint64)
    return coded.indices.to_numpy(zero_copy_only=False), hashes


def _keys(words: np.ndarray, first: np.ndarray, n: int, salt: np.ndarray) -> np.ndarray:
    """64-bit hash of language, length and words of each n-gram."""
    return mix(ngram_hashes(words, n)[first] ^ salt, n)


def hash_bits(size: int) -> int:
    """Bits of a hash in the summaries of some bytes of text: at most one n-gram in a hundred shares its hash."""
    return min(64, size.bit_length() + 8)


def short_keys(keys: np.ndarray, width: int) -> np.ndarray:
    """The part of a hash that the summaries use."""
    return keys >> np.uint64(64 - width)


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, those of equal weight side by side."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _numbers(packed: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * count, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, count).T).view("<u8").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


#: ``size`` is the number of occurrences in the first row of a partition, else of the block's hashes.
BLOCKS = "part long, kind int, size long, keys binary, counts binary"


def count_blocks(partitions: int, most: int, width: int, buffer: int = BUFFER) -> Callable:
    """Per buffer and hash partition: a row with its occurrences, then blocks of counted hashes.

    A partition is a range of hashes, so the steps between its hashes are short.
    """
    reach = -(-(1 << width) // partitions)

    def rows_of(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = keys // np.uint64(reach)
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        rows, held = [], 0
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            total = int(counts[begin:end].sum(dtype=np.int64))
            rows.append((int(part[begin]), 0, total, None, None))
            for at in range(begin, end, BLOCK):
                to = min(end, at + BLOCK)
                steps = np.diff(keys[at:to], prepend=np.uint64(0))
                rows.append((int(part[begin]), 1, to - at, _packed(steps), _packed(counts[at:to])))
                held += to - at
            if held >= 4 * BLOCK:
                yield _batch(rows, BLOCKS)
                rows, held = [], 0
        if rows:
            yield _batch(rows, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for chunk in chunks(batch, "text"):
                found = read_pieces(chunk.column("text"))
                codes, salts = _language_hashes(chunk.column("lang"))
                salt = salts[codes[found.rows]]
                grams = [
                    short_keys(_keys(found.hashes, first, n, salt[first]), width)
                    for n in range(1, most + 1)
                    if len(first := found.grams(n))
                ]
                if not grams:
                    continue
                own, times = np.unique(np.concatenate(grams), return_counts=True)
                keys.append(own)
                counts.append(times.astype(np.uint32))
                held += len(own)
                if held >= buffer:
                    merged = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [merged[0]], [merged[1]]
                    held = len(merged[0])
                    if held >= buffer // 2:
                        yield from rows_of(*merged)
                        keys, counts, held = [], [], 0
        if keys:
            yield from rows_of(*_summed(np.concatenate(keys), np.concatenate(counts)))

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = [
        pa.array(values, type=kinds[kind])
        for values, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)
    ]
    return pa.record_batch(columns, names=[name for name, _ in fields])


class Summary:
    """Misra-Gries counts of one hash partition."""

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold
        self.mass = 0
        self.taken = 0
        self.keys = np.zeros(0, dtype=np.uint64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    @property
    def capacity(self) -> int:
        return 2 * self.mass // self.threshold + 1

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > max(self.capacity, BLOCK):
            self.fold()

    def fold(self) -> None:
        """Merge what waits; beyond the capacity, take the first count too many from all."""
        parts = [(self.keys, self.counts), *self.waiting]
        self.keys, self.counts = _summed(
            np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        )
        self.waiting, self.held = [], 0
        over = len(self.keys) - self.capacity
        if over > 0:
            least = int(np.partition(self.counts, over - 1)[over - 1])
            self.counts = self.counts - least
            kept = self.counts > 0
            self.keys, self.counts = self.keys[kept], self.counts[kept]
            self.taken += least

    def survivors(self) -> np.ndarray:
        self.fold()
        return self.keys[self.counts + self.taken >= self.threshold]


MARKS = "word long, marks long"


def merge_blocks(threshold: int, bits: int) -> Callable:
    """Merge the sorted rows of ``count_blocks`` per hash partition; marked words of the bitmap."""

    def marks(summary: Summary) -> Iterator[pa.RecordBatch]:
        places = np.unique(summary.survivors() % np.uint64(bits))
        if not len(places):
            return
        word = (places >> np.uint64(6)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        own = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
        yield pa.record_batch(
            [pa.array(word[first]), pa.array(own.view(np.int64))], names=["word", "marks"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, Summary(threshold)
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "kind", "size", "keys", "counts")]
            for row in range(batch.num_rows):
                own, kind, size, keys, counts = (c[row] for c in columns)
                if own.as_py() != part:
                    yield from marks(summary)
                    part, summary = own.as_py(), Summary(threshold)
                if kind.as_py() == 0:
                    summary.mass += size.as_py()
                else:
                    steps = _numbers(keys.as_py(), size.as_py())
                    times = _numbers(counts.as_py(), size.as_py()).astype(np.int64)
                    summary.add(np.cumsum(steps, dtype=np.uint64), times)
        yield from marks(summary)

    return run


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def frequent_marks(texts: DataFrame, size: int, threshold: int, most: int, bits: int) -> np.ndarray:
    """Bitmap with the bits of all n-grams that may reach the threshold, in ``size`` bytes of text."""
    partitions = 1 + size // PARTITION_BYTES
    blocks = texts.mapInArrow(count_blocks(partitions, most, hash_bits(size)), BLOCKS)
    ordered = blocks.repartition("part").sortWithinPartitions("part", "kind")
    words = ordered.mapInArrow(merge_blocks(threshold, bits), MARKS)
    with shuffles_removed(texts.sparkSession):
        found = words.groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()
    marked = np.zeros(bits // 64, dtype=np.uint64)
    marked[found.column("word").to_numpy()] = found.column("marks").to_numpy().view(np.uint64)
    return marked


COUNTS = "lang string, size int, phrase string, n long"


def count_marked(held: Broadcast, most: int, width: int) -> Callable:
    """Counts of the phrases that meet a marked bit, and all words of a language as size 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = held.value
        bits = np.uint64(len(marked) * 64)
        for batch in batches:
            for chunk in chunks(batch, "text"):
                found = read_pieces(chunk.column("text"), second=True)
                if not len(found.starts):
                    continue
                langs = chunk.column("lang")
                codes, salts = _language_hashes(langs)
                own = codes[found.rows]
                totals = np.bincount(own, minlength=len(salts))
                names = langs.dictionary_encode().dictionary
                yield _counted(names, 0, pa.array([""] * len(totals)), totals)
                for n in range(1, most + 1):
                    first = found.grams(n)
                    keys = _keys(found.hashes, first, n, salts[own[first]])
                    place = short_keys(keys, width) % bits
                    hit = (marked[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                    first, keys = first[hit == 1], keys[hit == 1]
                    if not len(first):
                        continue
                    again = _keys(found.again, first, n, salts[own[first]])
                    one, times = _distinct(keys, again)
                    yield _counted(
                        names.take(pa.array(own[first[one]])), n, found.phrases(first[one], n), times
                    )

    return run


def _distinct(keys: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place and the number of places of each distinct pair of hashes."""
    _, one, group, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if (again[one[group]] != again).any():
        pairs = np.stack([keys, again], axis=1)
        _, one, times = np.unique(pairs, axis=0, return_index=True, return_counts=True)
    return one, times


def _counted(langs: pa.Array, size: int, phrases: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    sizes = pa.array(np.full(len(times), size, dtype=np.int32))
    return pa.record_batch(
        [langs.cast(pa.string()), sizes, phrases.cast(pa.string()), pa.array(times.astype(np.int64))],
        names=["lang", "size", "phrase", "n"],
    )


def frequent_phrases(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    most: int = MOST_WORDS,
    text: str = "text",
    lang: str = "lang",
    bits: int = BITS,
) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of up to ``most`` words with ``threshold`` occurrences.

    The row of size 0 has the number of words of its language. The result is a written table.
    """
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    size = text_bytes(texts)
    marked = frequent_marks(texts, size, threshold, most, bits)
    held = docs.sparkSession.sparkContext.broadcast(marked)
    counts = texts.mapInArrow(count_marked(held, most, hash_bits(size)), COUNTS)
    summed = counts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    kept = settle(summed.filter((F.col("size") == 0) | (F.col("n") >= threshold)), "phrases")
    held.destroy()
    return kept


def _exact(name: str) -> str:
    return f"CAST({name} AS DECIMAL(15, 0))"


def best_cuts(counts: DataFrame) -> DataFrame:
    """Candidates with the parts of their weakest cut: lang, size, phrase, a, l, r, score."""
    known = counts.filter("size > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    cuts = counts.filter("size > 1").select(
        "lang", "size", "phrase", F.col("n").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"),
    ).withColumns(
        {
            "first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "),
            "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " "),
        }
    )
    for part, name in (("first", "l"), ("rest", "r")):
        own = known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        cuts = cuts.join(own, ["lang", part])
    a, product = _exact("a"), f"({_exact('l')} * {_exact('r')})"
    scored = cuts.withColumn("score", F.expr(f"({UNIT} * {a} * {a}) div {product}"))
    weakest = F.min(F.struct("score", "k", "l", "r"))
    return scored.groupBy("lang", "size", "phrase", "a").agg(weakest.alias("cut")).select(
        "lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def covered_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer phrase around each phrase inside one."""
    words = F.split("phrase", " ")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda k: F.transform(
                F.sequence(F.lit(1), F.col("size") - k + 1),
                lambda at: F.array_join(F.slice(words, at, k), " "),
            ),
        )
    )
    inside = counts.filter("size > 2").select("lang", F.explode(spans).alias("phrase"), "n")
    return inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    most: int = MOST_WORDS,
    covered: int = COVERED,
    first: int = FIRST,
    text: str = "text",
    lang: str = "lang",
    bits: int = BITS,
) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    counts = frequent_phrases(docs, threshold, most, text, lang, bits)
    around = covered_phrases(counts)
    kept = best_cuts(counts).join(around, ["lang", "phrase"], "left").filter(
        F.coalesce(F.col("longer") * 100 < F.col("a") * covered, F.lit(True))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    apart = Window.partitionBy("lang", "part").orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    ranked = (
        kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        .withColumn("rank", F.row_number().over(apart))
        .filter(F.col("rank") <= first)
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= first)
    )
    totals = counts.filter("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


_LEADS = ", ".join(f"lead(w, {n}) OVER o AS w{n}" for n in range(1, MOST_WORDS))
_GRAMS = "SELECT lang, 1 AS size, w AS phrase FROM g" + "".join(
    f" UNION ALL SELECT lang, {n}, concat_ws(' ', w, {', '.join(f'w{k}' for k in range(1, n))}) FROM g"
    f" WHERE w{n - 1} IS NOT NULL"
    for n in range(2, MOST_WORDS + 1)
)
_CUTS = " UNION ALL ".join(
    f"SELECT lang, phrase, size, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS f, "
    f"array_to_string(w[{k + 1}:], ' ') AS e FROM c WHERE size > {k}"
    for k in range(1, MOST_WORDS)
)
COLLOCATIONS_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
s AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS x FROM d),
p AS (SELECT row_number() OVER () AS r, lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS ws FROM s),
w AS (SELECT r, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM p),
g AS (SELECT lang, w, {_LEADS} FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT lang, size, phrase, count(*) AS n FROM ({_GRAMS}) GROUP BY ALL HAVING count(*) >= {THRESHOLD}),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
k AS ({_CUTS}),
q AS (SELECT k.lang, k.phrase, k.size, k.a, k.k, x.n AS l, y.n AS r,
   CAST((CAST({UNIT} AS HUGEINT) * k.a * k.a) // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
  FROM k JOIN f AS x ON x.lang = k.lang AND x.phrase = k.f JOIN f AS y ON y.lang = k.lang AND y.phrase = k.e),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS z FROM q) WHERE z = 1),
i AS (SELECT lang, phrase, max(n) AS longer FROM (
   SELECT lang, a AS n, unnest([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, size)]) AS phrase FROM c WHERE size = 3)
   GROUP BY ALL),
m AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
JOIN t USING (lang) WHERE rank <= {FIRST}
"""


@query("op13_misra_gries_collocations", COLLOCATIONS_SQL)
def op13_misra_gries_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
