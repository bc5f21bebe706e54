"""Token ids in binary shard files with Elias-Fano encoded document boundaries.

A shard file holds segments; a segment holds the concatenated ids of some
documents of ascending doc_id:

  offset  size  field (little-endian)
  0       8     magic "EFIDSEG1"
  8       8     documents n
  16      8     ids u (of all documents of the segment)
  24      8     low bits l per boundary
  32      8     bytes of one id (2 if every id fits, else 4)
  40      8     shard number
  48      8     segment number in the shard
  56      8     bytes of the doc_id block, 8 n
  64      ...   doc_ids; low bits; high bits; ids; each block padded to 8 bytes

The boundary of document k (ids of the segment before its end) has its l low
bits packed and its high part in unary in the high bits: n ones and u >> l
zeros, about 2 + log2(u / n) bits a document in all. ``Boundaries.select``
finds a boundary from counts of ones kept for every SELECT_STEP-th one, so
offsets need no table of 64-bit numbers. A newline follows each segment in the
file (the files are written by Spark's text writer, one row a segment, so any
store that Spark can write will do) and readers skip it.

Documents are dealt to shards by ranges of doc_id with about SHARD_BYTES of
text each, encoded before the shuffle, and a task holds one shard.

Defined cases: null texts count as empty and hold the end id alone; rows with a
null doc_id come first, as the smallest 64-bit integer in the file and null in
the result; rows that share a doc_id stay separate, by their ids; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segments import PART, WHOLE, SegmentTable, pattern_segments, worker_cache
from .text import column_bytes, fresh_worker, row_slices, small_batches

END_ID = 2
SHARD_BYTES = 32 << 20
SEGMENT_IDS = 1 << 22
SELECT_STEP = 64
MAGIC = b"EFIDSEG1"
_HEADER = "<8s7q"
_NULL = np.iinfo(np.int64).min


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


class Boundaries:
    """Elias-Fano sequence of n ascending numbers up to u."""

    def __init__(self, n: int, u: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.u, self.low_bits, self.low, self.high = n, u, low_bits, low, high
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)  # of whole bytes
        self.samples = np.searchsorted(ones, np.arange(0, n, SELECT_STEP), "right").astype(np.int64) if n else np.zeros(0, np.int64)
        self.before = np.r_[0, ones][self.samples] if n else self.samples

    @classmethod
    def encode(cls, values: np.ndarray, u: int) -> Boundaries:
        n = len(values)
        bits = max(0, (u // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        high = np.zeros(n + (u >> bits) + 1, np.uint8)
        high[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, u, bits, low, np.packbits(high, bitorder="little"))

    def select(self, k: int) -> int:
        """The k-th number."""
        byte, before = int(self.samples[k // SELECT_STEP]), int(self.before[k // SELECT_STEP])
        while True:
            here = int(self.high[byte]).bit_count()
            if before + here > k:
                break
            before += here
            byte += 1
        value, bit = int(self.high[byte]), -1
        for _ in range(k - before + 1):
            bit += 1
            while not value >> bit & 1:
                bit += 1
        first = k * self.low_bits
        low = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> first % 8
        return (byte * 8 + bit - k) << self.low_bits | low & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return (ones - np.arange(self.n)) << self.low_bits | low


def write_segment(shard: int, number: int, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    b = Boundaries.encode(np.cumsum(sizes), len(ids))
    docs = doc_ids.astype("<i8").tobytes()
    head = struct.pack(_HEADER, MAGIC, len(sizes), len(ids), b.low_bits, width, shard, number, len(docs))
    return b"".join((head, docs, _padded(b.low.tobytes()), _padded(b.high.tobytes()), _padded(ids.astype(f"<u{width}").tobytes())))


def read_segments(data: bytes | pa.Buffer) -> Iterator[tuple[int, int, np.ndarray, Boundaries, np.ndarray]]:
    """(shard, number, doc_ids, boundaries, ids) of every segment of a shard file."""
    at = 0
    while at < len(data):
        magic, n, u, bits, width, shard, number, size = struct.unpack_from(_HEADER, data, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += struct.calcsize(_HEADER)
        docs = np.frombuffer(data, "<i8", n, at)
        at += size
        low = -(-n * bits // 8)
        high = -(-(n + (u >> bits) + 1) // 8)
        b = Boundaries(n, u, bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low + -low % 8))
        at += low + -low % 8 + high + -high % 8
        yield shard, number, docs, b, np.frombuffer(data, f"<u{width}", u, at)
        at += u * width + -(u * width) % 8 + 1


def encoder(tokenizer_json: str) -> SegmentTable:
    """Segment encodings by the tokenizers library.

    The tokenizer's pattern never joins characters over white space, and in
    plain words (see ``pattern_segments``) its matches are the parts, already
    folded; those go to its model without pattern and normaliser.
    """
    from tokenizers import Tokenizer, pre_tokenizers
    full, plain = Tokenizer.from_str(tokenizer_json), Tokenizer.from_str(tokenizer_json)
    plain.normalizer = None
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    closes = np.zeros(full.get_vocab_size(), bool)
    suffix = plain.model.end_of_word_suffix
    if suffix:
        closes[[i for t, i in full.get_vocab().items() if t.endswith(suffix)]] = True

    def encode(segments: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids; parts go many to a text and are told apart by their word ends, where the model marks them."""
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * len(segments)
        at = np.flatnonzero(kinds == PART).tolist() if suffix else []
        for i in range(0, len(at), 256):
            some = at[i : i + 256]
            flat = np.array(plain.encode_batch_fast([" ".join([segments[k] for k in some])], add_special_tokens=False)[0].ids, np.int32)
            for k, x in zip(some, np.split(flat, np.flatnonzero(closes[flat])[:-1] + 1)):
                ids[k] = x
        rest = np.flatnonzero(kinds == WHOLE).tolist() if suffix else range(len(segments))
        for k, e in zip(rest, full.encode_batch_fast([segments[k] for k in rest], add_special_tokens=False)):
            ids[k] = np.array(e.ids, np.int32)
        return np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids)
    return SegmentTable(encode)


def _encode(tokenizer_json: str, edges: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker("token_file")
    table = worker_cache(("token_file", tokenizer_json), lambda: encoder(tokenizer_json))
    for batch in batches:
        buf, bounds = column_bytes(batch.column(1))
        for i, j in row_slices(bounds, 1 << 20):
            part = pattern_segments(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            ids, at = table.join(*part)
            width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
            ids = np.insert(ids, at[1:], END_ID).astype(f"<u{width}")
            at = at + np.arange(len(at))
            docs = batch.column(0).slice(i, j - i).fill_null(_NULL)
            shard = np.searchsorted(np.array(edges, np.int64), docs.to_numpy(), "left")
            data = ids.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), docs, pa.array([width] * (j - i), pa.int64()), pa.array([data[a * width : b * width] for a, b in zip(at, at[1:])], pa.binary())], ["shard", "doc_id", "width", "ids"])


def _write(table: pa.Table) -> pa.Table:
    """The segments of one shard."""
    fresh_worker()
    shard = table.column("shard")[0].as_py()
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("width").to_pylist(), table.column("ids").to_pylist()))
    out, docs, held, size = [], [], [], 0
    for k, (doc, width, data) in enumerate(rows):
        docs.append(doc)
        held.append(np.frombuffer(data, f"<u{width}"))
        size += len(held[-1])
        if size >= SEGMENT_IDS or k == len(rows) - 1:
            out.append(write_segment(shard, len(out), np.array(docs, np.int64), np.array([len(x) for x in held]), np.concatenate(held)))
            docs, held, size = [], [], 0
    return pa.table({"segment": pa.array(out, pa.binary())})


def shard_edges(docs: DataFrame) -> list[int]:
    """Largest doc_ids of all shards but the last: ranges of about SHARD_BYTES of text (one number a shard reaches the driver)."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    total = sized.select(F.sum("size")).first()[0] or 0
    n = -(-int(total) // SHARD_BYTES)
    if n < 2:
        return []
    share = max(1, SHARD_BYTES // 64)
    weighted = sized.where("doc_id is not null").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("size") / share).cast("int"))))
    at = weighted.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0]
    return sorted({int(x) for x in at})


def write_token_files(docs: DataFrame, path: str, tokenizer_json: str) -> None:
    """Encodes every text and writes the shard files to ``path``."""
    small_batches(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (docs.mapInArrow(partial(_encode, tokenizer_json, shard_edges(docs)), "shard long, doc_id long, width long, ids binary")
     .groupBy("shard").applyInArrow(_write, "segment binary")
     .select(F.col("segment").cast("string").alias("value")).write.text(path))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker()
    for batch in batches:
        for data in batch.column(0):
            for shard, number, docs, b, ids in read_segments(data.as_buffer()):
                at = np.r_[0, b.all()]
                crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(at, at[1:])]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(docs), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shard files of ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    docs = files.mapInArrow(_read, "shard long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long")
    segments = docs.groupBy("shard", "segment").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard", "segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (docs.join(segments.select("shard", "segment", before.alias("before")), ["shard", "segment"])
            .select(F.when(F.col("doc_id") != _NULL, F.col("doc_id")).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def new_folder(spark) -> str:
    """A folder of its own under the shared checkpoint folder."""
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/token-files-{uuid4().hex}"
