"""Words of whole texts as arrays, for work inside tasks.

A word is a run of bytes other than the space and the controls 9 to 13, which is the pattern
``[^\\x20\\x09-\\x0D]+``. Words are hashed straight from the bytes of an Arrow column, so that
hundreds of millions of words need no Python object each. Hashes have 64 bits; where equal hashes
must mean equal words at any size, two of them with different seeds are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at a time.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits; another seed gives an independent spread."""
    x = values + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _byte_codes(lower: bool, seed: int) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64), seed + 101)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


class _Powers:
    """Powers of an odd base and of its inverse, as long as the longest chunk so far."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def of(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < size:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


@dataclass(frozen=True)
class Words:
    """Words of some rows: bytes of all rows, and per word where it starts and ends in them."""

    data: np.ndarray
    row_bytes: np.ndarray  # rows + 1 places in data
    rows: np.ndarray  # rows + 1 places in starts
    starts: np.ndarray
    ends: np.ndarray

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` takes A to Z as a to z."""
        up, down = _Powers.of(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_byte_codes(lower, seed)[self.data] * up[: len(self.data)], out=sums[1:])
        own = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64), seed)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def split_words(texts: pa.Array) -> Words:
    """Words of a string column; a null row has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    places = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
        texts.offset : texts.offset + len(texts) + 1
    ]
    if not len(texts) or places[-1] == places[0]:
        none = np.zeros(0, dtype=np.int64)
        zeros = np.zeros(len(texts) + 1, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint8), zeros, zeros, none, none)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[places[0] : places[-1]]
    places = places - places[0]
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[places] = True
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, places, np.searchsorted(starts, places), starts, ends)


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of text bytes each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def ngram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``n`` words from each word on, over row borders too (callers cut there)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    base = np.uint64(_BASE)
    total = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        total *= base
        total += words[k : len(words) - n + 1 + k]
    return mix(total, seed + 7)


def shingle_sets(texts: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``n``-word shingles.

    With fewer words, the whole sequence is one shingle; without words the set is empty.
    """
    found = split_words(texts)
    words = found.hashes(lower)
    grams = ngram_hashes(words, n)
    for first, last in zip(found.rows[:-1], found.rows[1:], strict=True):
        if last - first >= n:
            yield np.unique(grams[first : last - n + 1])
        elif last > first:
            yield ngram_hashes(words[first:last], last - first, seed=int(last - first))
        else:
            yield np.zeros(0, dtype=np.uint64)
