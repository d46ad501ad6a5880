"""Words of whole Arrow text columns, hashed without a Python loop per word.

A word is a maximal run of bytes other than space and the controls 9 to 13. Hashes are polynomial sums modulo 2**64 over
a random byte table, so the hash of any range is a difference of prefix sums, and then mixed. Bases and table come from
one seed: every task of every job gives equal words equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEED = 20_011
CHUNK_BYTES = 1 << 21
ARROW_ROWS = 1_000
SHORT_ROWS = 10_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the input reaches every bit of the output."""
    x = x.copy()
    x ^= x >> _U(31)
    x *= _U(0x9E6C63D0876A9A47)
    x ^= x >> _U(29)
    x *= _U(0xC2B2AE3D27D4EB4F)
    x ^= x >> _U(32)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        while len(self.up) <= n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, size, 1 << 64))])


_rng = np.random.Generator(np.random.PCG64(SEED))
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=_U, endpoint=False)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_BYTES = _BYTES[_LOWER]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
# Bases are 5 modulo 8, so their powers repeat as late as they can.
_BASES = [int(x) // 8 * 8 + 5 for x in _rng.integers(1 << 62, 1 << 63, 3, dtype=_U)]
BYTE_POWERS, WORD_POWERS, SPAN_POWERS = (Powers(b) for b in _BASES)


@dataclass
class Words:
    """Words of a text column: bounds of text i are first[i] and first[i + 1]."""

    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The text each word index lies in."""
        return np.searchsorted(self.first, words, side="right") - 1


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Hashed words of every text; `lower` maps A-Z to a-z first."""
    data, bounds = buffers(texts)
    size = len(data)
    if not size:
        return Words(np.zeros(len(bounds), np.int64), np.zeros(0, _U))
    inside = _IN_WORD[data]
    edge = np.zeros(size + 1, bool)
    edge[bounds] = True
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:size]
    stop[:-1] &= ~inside[1:] | edge[1:size]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    BYTE_POWERS.reach(size)
    sums = prefix_sums((_LOWER_BYTES if lower else _BYTES)[data], BYTE_POWERS)
    return Words(np.searchsorted(start, bounds), mix((sums[end] - sums[start]) * BYTE_POWERS.down[start]))


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    powers.reach(len(values))
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers.up[: len(values)], out=sums[1:])
    return sums


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of each range of what `prefix_sums` summed."""
    return mix((sums[end] - sums[start]) * powers.down[start])


def grams(hashes: np.ndarray, k: int, powers: Powers = WORD_POWERS) -> np.ndarray:
    """Hash of the k words from each position on; positions cross from one text to the next."""
    if len(hashes) < k:
        return np.zeros(0, _U)
    sums = prefix_sums(hashes, powers)
    at = np.arange(len(hashes) - k + 1)
    return ranges(sums, at, at + k, powers)


def rightmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the index of its minimum, the rightmost of equal ones."""
    if len(values) < width:
        return np.zeros(0, np.int64)

    def better(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(values[right] <= values[left], right, left)

    index, reach = np.arange(len(values)), 1
    while 2 * reach <= width:
        index = better(index[:-reach], index[reach:])
        reach *= 2
    if reach < width:
        rest = width - reach
        index = better(index[:-rest], index[rest:])
    return index


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of text each; one text is never cut."""
    for batch in batches:
        column = batch.column(text)
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))])
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def small_batches(spark) -> None:
    """Keep Arrow batches of texts small: long texts times the default row count would not fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@contextmanager
def large_batches(spark) -> Iterator[None]:
    """Arrow batches of Spark's own size for jobs within that carry rows of some hundred bytes, whatever held before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(SHORT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
