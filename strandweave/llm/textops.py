"""Vectorised helpers over Arrow text columns, shared by the operators of this subpackage.

Texts are handled as one flat byte buffer a slice: each text is followed by one separator byte, so that words,
windows and runs never cross documents.  A null text counts as an empty one.  A slice holds a few megabytes of text
(or one longer text), whatever the size of the Arrow batch, so that memory doesn't depend on the data.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..deploy import ship
from ..tables import shared_folder

SLICE_BYTES = 1 << 21
BATCH_BYTES = 8 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library has no such call
    _LIBC = None


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of an Arrow batch, as rows of text differ in length by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder of spark.checkpoint.dir and read back; a folder is set only where none is."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def release() -> None:
    """Gives memory that isn't used any more back to the system, as an idle worker would hold it for the next stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, with the worker's memory released at the end of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts have up to limit bytes together (or one row each)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(texts: pa.Array, separator: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1] - 1], then comes the separator."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(separator, pa.large_string()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = joined.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def lower_ascii() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii()


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche over unsigned 64-bit values."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


class Rolling:
    """Polynomial hashes of any substrings of a buffer, modulo 2^64, from prefix sums: a substring at any place has one value."""

    _powers: np.ndarray = np.ones(1, U64)
    _inverse: np.ndarray = np.ones(1, U64)
    _values = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

    @classmethod
    def tables(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n powers of the base, at least, and their inverses."""
        if len(cls._powers) < n:
            cls._powers = _geometric(_BASE, n + 4096)
            cls._inverse = _geometric(pow(_BASE, -1, 1 << 64), n + 4096)
        return cls._powers, cls._inverse

    def __init__(self, raw: np.ndarray) -> None:
        n = len(raw) + 1
        self.tables(n)
        self.sums = np.zeros(n, U64)
        np.cumsum(Rolling._values[raw] * Rolling._powers[: n - 1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * Rolling._inverse[starts] + (ends - starts).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """Of every substring of k bytes, by start."""
        return mix((self.sums[k:] - self.sums[:-k]) * Rolling._inverse[: len(self.sums) - k])


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    out[1:] = U64(base & (2**64 - 1))
    return np.cumprod(out, dtype=U64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def per_text(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index range of sorted positions by text: those of text i are [out[i], out[i + 1])."""
    return np.searchsorted(positions, offsets)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


#: The lowest 0 to 8 bytes of a 64-bit word.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size bytes of a from at on are those of b from to on, pair by pair; long ones one by one, others eight bytes at a time."""
    out = np.ones(len(size), bool)
    long = size > 64
    for i in np.flatnonzero(long).tolist():
        out[i] = np.array_equal(a[at[i] : at[i] + size[i]], b[to[i] : to[i] + size[i]])
    wide_a, wide_b = (np.ndarray(len(x) + 1, "<u8", np.concatenate((x, np.zeros(8, np.uint8))), strides=(1,)) for x in (a, b))
    live = np.flatnonzero(~long & (size > 0))
    k = 0
    while len(live):
        left = size[live] - k
        out[live] &= ((wide_a[at[live] + k] ^ wide_b[to[live] + k]) & _LOWEST[np.minimum(left, 8)]) == 0
        k += 8
        live = live[left > 8]
    return out


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; empty segments give zero."""
    sums = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


class HashIndex:
    """Open-addressing table from unsigned 64-bit keys to positions 0, 1, 2, ...; looked up for whole arrays."""

    def __init__(self, bits: int = 16) -> None:
        self.keys = np.zeros(1 << bits, U64)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.count = 0
        self.order: list[np.ndarray] = []

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        mask = U64(len(self.keys) - 1)
        at = (h & mask).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        at = at[open_]
        while len(open_):
            at = (at + 1) & int(mask)
            got = self.slots[at]
            out[open_] = got
            more = (got >= 0) & (self.keys[at] != h[open_])
            open_, at = open_[more], at[more]
        return out

    def add(self, h: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet, in their order."""
        self.order.append(h)
        if 2 * (self.count + len(h)) > len(self.keys):
            bits = int(2 * (self.count + len(h))).bit_length()
            self.keys, self.slots = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
            every = np.concatenate(self.order)
            self.order, self.count = [every], 0
            self._put(every)
        else:
            self._put(h)

    def _put(self, h: np.ndarray) -> None:
        mask = len(self.keys) - 1
        value = np.arange(self.count, self.count + len(h), dtype=np.int32)
        at = (h & U64(mask)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.slots[at] < 0
            take, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[take], self.slots[take] = h[won], value[won]
            lost = np.ones(len(left), bool)
            lost[np.flatnonzero(free)[first]] = False
            left, at = left[lost], (at[lost] + 1) & mask
        self.count += len(h)
