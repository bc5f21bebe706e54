"""Word spans and hashes of whole Arrow text columns, without Python strings.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR
(``[^\\x20\\x09-\\x0D]+``). All hashes are 64 bit: words by a polynomial over a
random byte table, n-grams by a random linear form of the word hashes, both
finished by a full-avalanche mix. Texts are walked in slices of bounded bytes,
so memory does not follow the batch size.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 15
BATCH_ROWS = 512
_SEED = 0x5EED


def mix(h: np.ndarray) -> np.ndarray:
    """A full-avalanche permutation of 64-bit values (new array)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def random_odd(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=U) * U(2) + U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


class WordHasher:
    """Word spans and hashes; keeps its tables between calls."""

    def __init__(self, seed: int = _SEED):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bytes = rng.integers(0, 2**64, 256, dtype=U)
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self.size = 0
        self._grow(2 * _BLOCK)

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = n
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)

    def hash(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, i, n = np.empty(len(starts), dtype=U), 0, len(starts)
        while i < n:
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + _BLOCK, "right")))
            hi = int(ends[j - 1])
            self._grow(hi - lo + 1)
            x = self.bytes[buf[lo:hi]]
            x *= self.up[: hi - lo]
            np.cumsum(x, out=x)
            a, b = starts[i:j] - lo, ends[i:j] - lo
            h = x[b - 1]
            h[1:] -= x[a[1:] - 1]
            h *= self.down[a]
            h += (b - a).astype(U)
            out[i:j] = mix(h)
            i = j
        return out


def spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts ``buf[bounds[i]:bounds[i+1]]``, and the number of words of each text."""
    word = ~SEPARATOR[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = bounds[(bounds > 0) & (bounds < len(buf))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the row bounds in them; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def row_slices(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_slices(column: pa.Array, hasher: WordHasher, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, words per row) of slices of a text column."""
    buf, bounds = column_bytes(column)
    for i, j in row_slices(bounds, limit):
        part = buf[bounds[i] : bounds[j]]
        starts, ends, counts = spans(part, bounds[i : j + 1] - bounds[i])
        yield i, j, hasher.hash(part, starts, ends), counts


def ngrams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of all runs of n words, also those that cross texts (mask them with ``inside``)."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, dtype=U)
    for k, odd in enumerate(random_odd(n, seed)):
        out += words[k : k + size] * odd
    return mix(out)


def inside(counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the n-gram starts that lie within one text."""
    mask = np.ones(size, dtype=bool)
    for end in np.cumsum(counts):
        mask[max(0, end - n + 1) : end] = False
    return mask


def small_batches(df) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows: texts are long, and a batch lies in memory several times."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def fresh_worker(keep: str | None = None) -> None:
    """At the start of a task: gives back what earlier tasks left in this Python worker (but for the cache entry ``keep``)."""
    held = sys.__dict__.setdefault("_shipwise_worker_cache", {})
    for key in [k for k in held if k != keep]:
        del held[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc can
        ctypes.CDLL(None).malloc_trim(0)


def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: the first column, a text, compressed (null if empty); the other columns as they are."""
    import zstandard
    fresh_worker()
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        buf, bounds = column_bytes(batch.column(0))
        for i, j in row_slices(bounds, 1 << 22):
            z = [press(buf[a:b]) if b > a else None for a, b in zip(bounds[i:j], bounds[i + 1 : j + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.binary()), *(c.slice(i, j - i) for c in batch.columns[1:])], ["z", *batch.schema.names[1:]])


def expanded(column: pa.Array) -> pa.Array:
    """The texts of ``shrink``, as bytes."""
    import zstandard
    unzip = zstandard.ZstdDecompressor().decompress
    return pa.array([unzip(z) if z else b"" for z in column.to_pylist()], pa.large_binary())


def schema_of(carried, more: str):
    """The schema of a DataFrame's columns followed by those of a DDL string; names may not occur twice (ValueError)."""
    from pyspark.sql import types as T
    fields = [*carried.schema.fields, *T.StructType.fromDDL(more).fields]
    names = [f.name.lower() for f in fields]
    if clash := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"columns to carry clash with each other or with result columns: {clash}")
    return T.StructType(fields)


def shipped(spark, model):
    """A broadcast of any object of this package as bytes, which workers open without having the package."""
    from pyspark import cloudpickle
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def opened(sent):
    """The object of a broadcast of ``shipped``."""
    return pickle.loads(sent.value)
