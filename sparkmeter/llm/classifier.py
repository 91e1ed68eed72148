"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each whole text becomes a few statistics of its characters, words and lines. Random cosines of the
standardised statistics approximate a Gaussian kernel. Each task sums its part of the normal
equations, a fixed number of values, and Spark adds them up; the driver solves one small system.
The scores are then calibrated on another fold: counts of both labels per score bin are summed by
Spark, and pool-adjacent-violators makes the rate per bin monotone.

Only labelled rows of the learning folds train: those whose crc32 of the id (as text) leaves 0 or 2
modulo 3. Remainder 0 fits the means and the ridge, remainder 2 the calibration; remainder 1 is
held out. Statistics come from the text alone. A null text counts as an empty one. Rows without an
id are not labelled and are scored. Should an id have several labels, each of them counts; should
there be no label at all, every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.expressions import table
from sparkmeter.llm.registry import query
from sparkmeter.llm.words import Words, chunks, split_words
from sparkmeter.session import settle

STATISTICS = (
    "log_words log_chars mean_word var_word symbols digits upper lower spaces stops commas bangs pipes"
    " quotes high_bytes distinct_words distinct_pairs top_word lines mean_line ended_lines capital_words"
).split()
#: Random features; the normal equations have the square of this many values.
FEATURES = 192
#: Width of the kernel, in standard deviations of all statistics together.
WIDTH = 4.0
RIDGE = 1e-3
BINS = 400
SEED = 20240611
FIT, HELD_OUT, CALIBRATE = 0, 1, 2


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 3


def _per_row(mask: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many of the bytes of each row are marked."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[places[1:]] - sums[places[:-1]]


def _byte_classes() -> np.ndarray:
    """A bit per class for each byte."""
    bits = np.zeros(256, dtype=np.uint16)
    groups = [b"#*$%&<>^~@_=+", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b" ", b".", b",;:", b"!", b"|", b"\"'()", bytes(range(128, 256))]
    for k, group in enumerate(groups):
        bits[list(group)] |= np.uint16(1 << k)
    return bits


_CLASSES = _byte_classes()


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    found: Words = split_words(texts)
    n = len(found.rows) - 1
    out = np.zeros((n, len(STATISTICS)))
    put = lambda name, values: out.__setitem__((slice(None), STATISTICS.index(name)), values)
    chars = np.maximum(1, np.diff(found.row_bytes))
    words = np.diff(found.rows)
    some = np.maximum(1, words)
    put("log_words", np.log1p(words))
    put("log_chars", np.log1p(np.diff(found.row_bytes)))
    length = (found.ends - found.starts).astype(float)
    row = found.row_of_word()
    mean = np.bincount(row, length, n) / some
    put("mean_word", np.log1p(mean))
    put("var_word", np.log1p(np.maximum(0, np.bincount(row, length**2, n) / some - mean**2)))
    classes = _CLASSES[found.data]
    names = "symbols digits upper lower spaces stops commas bangs pipes quotes high_bytes".split()
    for k, name in enumerate(names):
        counts = _per_row((classes & (1 << k)) > 0, found.row_bytes)
        per = some if name in ("symbols", "stops", "commas", "bangs", "pipes", "quotes") else chars
        put(name, np.minimum(2.0, counts / per))
    hashes = found.hashes()
    capital = (classes[found.starts] & 4) > 0 if len(found.starts) else np.zeros(0, dtype=bool)
    put("capital_words", np.bincount(row, capital, n) / some)
    for k in range(n):
        own = hashes[found.rows[k] : found.rows[k + 1]]
        if len(own):
            _, counts = np.unique(own, return_counts=True)
            out[k, STATISTICS.index("distinct_words")] = len(counts) / np.sqrt(len(own))
            out[k, STATISTICS.index("top_word")] = counts.max() / len(own)
        if len(own) > 1:
            pairs = own[:-1] * np.uint64(3) + own[1:]
            out[k, STATISTICS.index("distinct_pairs")] = len(np.unique(pairs)) / len(pairs)
    ends = found.data == 10
    lines = _per_row(ends, found.row_bytes) + 1
    put("lines", np.log1p(lines))
    put("mean_line", np.log1p(words / lines))
    after = np.zeros(len(ends), dtype=bool)
    after[:-1] = (found.data[:-1] == 46) & ends[1:]
    put("ended_lines", _per_row(after, found.row_bytes) / lines)
    return out


def _stats_table(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, fold, x): the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                values = statistics(part.column("text"))
                flat = pa.array(values.ravel().astype(np.float32))
                size = pa.array(np.arange(0, values.size + 1, len(STATISTICS)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("fold"), pa.ListArray.from_arrays(size, flat)],
                    names=["doc_id", "fold", "x"],
                )

    source = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(fold(F.col(id_col)), F.lit(-1)).cast("int").alias("fold"),
        F.col(text).alias("text"),
    )
    schema = source.select("doc_id", "fold", F.array(F.lit(0.0).cast("float")).alias("x")).schema
    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Fourier:
    """Standardisation and random cosines."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray) -> Fourier:
        random = np.random.default_rng(SEED)
        waves = random.normal(size=(len(mean), FEATURES)) / WIDTH
        return cls(mean, scale, waves, random.uniform(0, 2 * np.pi, FEATURES))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.waves + self.shifts) * np.sqrt(2 / FEATURES)])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(float)


def _summed(rows: DataFrame, sums) -> np.ndarray:
    """Element sums of what ``sums`` gives for each batch: one fixed-size array per task, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = sums(_matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"]
            )

    parts = rows.select("x", "y").mapInArrow(run, "k long, v double")
    found = parts.groupBy("k").agg(F.sum("v").alias("v")).collect()  # a fixed number of values
    out = np.zeros(max((r["k"] for r in found), default=-1) + 1)
    for r in found:
        out[r["k"]] = r["v"]
    return out


def fit_moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    d = len(STATISTICS)
    sums = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    if not len(sums):
        return None
    mean = sums[1 : d + 1] / sums[0]
    return mean, np.sqrt(np.maximum(sums[d + 1 :] / sums[0] - mean**2, 1e-6))


def fit_ridge(rows: DataFrame, features: Fourier) -> np.ndarray:
    """Ridge weights from the summed normal equations, both labels weighted alike."""
    d = FEATURES + 1

    def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = []
        for label in (0, 1):
            f = features(x[y == label])
            out += [(f.T @ f).ravel(), f.sum(0), [len(f)]]
        return np.concatenate(out)

    total = _summed(rows, sums)
    left, right = np.zeros((d, d)), np.zeros(d)
    for part, sign in ((total[: len(total) // 2], -1.0), (total[len(total) // 2 :], 1.0)):
        count = max(1.0, part[-1])
        left += part[: d * d].reshape(d, d) / count
        right += sign * part[d * d : -1] / count
    return np.linalg.solve(left + RIDGE * np.eye(d), right)


def isotonic(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Monotone rates per bin by pooling adjacent violators; empty bins take the level before."""
    pools: list[list[float]] = []
    for one, count in zip(ones, counts, strict=True):
        pools.append([one, count, 1])
        while len(pools) > 1 and (
            not pools[-1][1] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]
        ):
            one_, count_, width = pools.pop()
            pools[-1] = [pools[-1][0] + one_, pools[-1][1] + count_, pools[-1][2] + width]
    # Half a row of each label keeps rates inside (0, 1).
    return np.concatenate([np.full(w, (a + 0.5) / (c + 1.0)) for a, c, w in pools])


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 2) / 4 * BINS).astype(int), 0, BINS - 1)


@dataclass(frozen=True)
class Model:
    features: Fourier | None
    weights: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, interpolated between bin centres so that ties stay few."""
        if self.features is None:
            return np.full(len(x), 0.5)
        raw = self.features(x) @ self.weights
        centres = (np.arange(BINS) + 0.5) / BINS * 4 - 2
        return np.interp(raw, centres, self.levels)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Model:
    """Learn from the labelled rows of the learning folds."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT))
    rows = settle(stats.filter(F.col("fold") != HELD_OUT).join(known, "doc_id"), "labelled")
    fit, rest = (rows.filter(F.col("fold") == k) for k in (FIT, CALIBRATE))
    moments = fit_moments(fit)
    if moments is None:
        return Model(None, np.zeros(0), np.zeros(0))
    features = Fourier.of(*moments)
    weights = fit_ridge(fit, features)

    def counts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bins = _bin(features(x) @ weights)
        return np.concatenate([np.bincount(bins, y, BINS), np.bincount(bins, minlength=BINS)])

    summed = _summed(rest, counts)
    if not len(summed):
        summed = _summed(fit, counts)
    return Model(features, weights, isotonic(summed[:BINS], summed[BINS:]))


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    stats = settle(_stats_table(docs, id_col, text), "statistics")
    model = train(stats, labels, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pc.equal(batch.column("fold"), HELD_OUT),
                    pa.array(scores),
                    pa.array((scores >= 0.5).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return stats.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


@query("op5_fourier_quality")
def op5_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
