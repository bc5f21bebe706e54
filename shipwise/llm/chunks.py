"""Texts as chunks of word numbers with a vocabulary of their own.

A task packs its texts into chunks of bounded bytes. Words are numbered within
the chunk, the most frequent first. Each chunk deals its distinct words to hash
ranges, one packed row a range, and what the corpus says of a word (its count,
its rank) comes back the same way, in the order in which the words went. So
what moves is one entry a distinct word of a chunk, not one a token, and no
dictionary of the corpus is ever held in one place: a range holds about
RANGE_WORDS entries, whatever the corpus. (A chunk sends at most as many rows
as it has distinct words, so rows, too, grow with the input only.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import U, WordHasher, column_bytes, fresh_worker

#: Bytes of text in a chunk, at least (a longer text is a chunk of its own).
CHUNK_BYTES = 4 << 20
#: Entries of a hash range, on average.
RANGE_WORDS = 1 << 18
#: The columns of a chunk's vocabulary: number of words, their hashes, lengths, bytes and counts.
VOCABULARY = "v long, hashes binary, lengths binary, letters binary, counts binary"
DEALT = "range long, chunk long, lang string, lengths binary, letters binary, counts binary"


def lowered(buf: np.ndarray) -> np.ndarray:
    """The bytes with A to Z as a to z."""
    return buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)


def numbered(buf: np.ndarray, word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of every word, the distinct words by falling frequency, and their counts. ``word``: which bytes belong to words."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf[word]))])
    coded = words.dictionary_encode()
    number = np.asarray(coded.indices, dtype=np.int64)
    counts = np.bincount(number, minlength=len(coded.dictionary))
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return place[number], coded.dictionary.take(pa.array(order)), counts[order]


def squeeze(x: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    import zstandard
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind=np.int32) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def task_number() -> int:
    """A number for the first chunk of this task; those after it follow."""
    from pyspark import TaskContext
    return TaskContext.get().partitionId() << 32


def packed_words(words: pa.Array) -> tuple[bytes, bytes]:
    """(lengths, bytes) of a word list."""
    import zstandard
    buf, at = column_bytes(words)
    return squeeze(np.diff(at).astype(np.int32)), zstandard.ZstdCompressor(level=1).compress(buf.tobytes())


def unpacked_words(lengths: bytes, letters: bytes) -> pa.Array:
    import zstandard
    sizes = expand(lengths, np.int32)
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(zstandard.ZstdDecompressor().decompress(letters))])


def word_hashes(words: pa.Array, hasher: WordHasher) -> np.ndarray:
    """Hashes of words; 0 for the empty one."""
    buf, at = column_bytes(words)
    out, some = np.zeros(len(words), U), at[1:] > at[:-1]
    if some.any():
        out[some] = hasher.hash(buf, at[:-1][some], at[1:][some])
    return out


def vocabulary(words: pa.Array, counts: np.ndarray, hasher: WordHasher) -> list[pa.Array]:
    """The VOCABULARY columns of one chunk."""
    blobs = (squeeze(word_hashes(words, hasher)), *packed_words(words), squeeze(counts.astype(np.int64)))
    return [pa.array([len(words)], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)]


def dealing_order(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk's words go to n ranges, and the range of each in that order."""
    to = (hashes % U(n)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, to[order]


def _deal(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for r in batch.to_pylist():
                order, to = dealing_order(expand(r["hashes"], U), n)
                words = unpacked_words(r["lengths"], r["letters"]).take(pa.array(order))
                counts = expand(r["counts"], np.int64)[order]
                cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, np.int64)
                parts = [(int(to[a]), *packed_words(words.slice(a, b - a)), squeeze(counts[a:b])) for a, b in zip(cut, cut[1:])]
                if parts:
                    ranges, lengths, letters, sent = zip(*parts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ranges, pa.int64()), pa.array([r["chunk"]] * len(parts), pa.int64()), pa.array([r["lang"]] * len(parts), pa.string()),
                         *(pa.array(x, pa.binary()) for x in (lengths, letters, sent))], [c.split()[0] for c in DEALT.split(", ")])
    return run


def dealt(chunks: DataFrame) -> tuple[DataFrame, int]:
    """The chunks' words by range (one packed row a chunk and range; ``chunks``: chunk, lang and VOCABULARY), and the number of ranges."""
    total = chunks.agg(F.sum("v")).first()[0] or 0
    n = max(1, -(-int(total) // RANGE_WORDS))
    return chunks.select("chunk", "lang", "hashes", "lengths", "letters", "counts").mapInArrow(_deal(n), DEALT), n


def by_language(table: pa.Table) -> Iterator[tuple[str, pa.Table, list[int], pa.Array, np.ndarray]]:
    """The rows of one range, language by language: (language, rows, words a row, all words, all counts)."""
    for lang in pc.unique(table.column("lang")).to_pylist():
        own = table.filter(pc.equal(table.column("lang"), lang))
        lists = [unpacked_words(a, b) for a, b in zip(own.column("lengths").to_pylist(), own.column("letters").to_pylist())]
        counts = np.concatenate([expand(c, np.int64) for c in own.column("counts").to_pylist()])
        yield lang, own, [len(x) for x in lists], pa.concat_arrays(lists), counts


def returned(rows: pa.Table, hashes: np.ndarray, n: int, kind=np.int64) -> np.ndarray:
    """What came back for a chunk (rows of range and packed values), in the order of its vocabulary."""
    got = sorted(zip(rows.column("range").to_pylist(), rows.column("values").to_pylist()))
    order, _ = dealing_order(hashes, n)
    out = np.empty(len(order), kind)
    if got:
        out[order] = np.concatenate([expand(x, kind) for _, x in got])
    return out
