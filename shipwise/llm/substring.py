"""Exact substring deduplication with fixed-block anchors.

A window is WINDOW consecutive words of one document. Every word goes that a
window covers whose words also start earlier (in a document of smaller doc_id,
or further ahead in the same one). Windows are judged on the input.

A window of 2 * BLOCK or more words holds a whole aligned block of BLOCK words
wherever its copy lies, so:

1. Anchors. Each document is cut into non-overlapping blocks of BLOCK words;
   their hashes are the index. Every rolling run of BLOCK words is a probe.
   Index and probes of a chunk of documents travel together, as packed sorted
   6-byte hashes with two flags (an aligned block; more than once in the
   chunk), and meet by hash range. A hash that is a block somewhere and is
   probed from two places or more is an anchor. Chunks get back their anchors.
2. Extension. A window is a candidate if it holds an anchor. A chunk sends
   each distinct candidate window once, as a 96-bit hash with its first
   position, so a passage that many documents share costs at most one entry
   for each chunk. The smallest position of all chunks comes back where it is
   another one, or where the chunk holds the window more than once.
3. Removal. Windows that are not the earliest of their kind remove their words;
   overlapping windows make the maximal exact repeats.

Documents are dealt once to chunks of about CHUNK_BYTES by doc_id, compressed;
all three steps read that one exchange. Nothing is dropped or capped: work per
chunk is bounded by its own words, work per hash range by distinct hashes.

Defined cases: null and empty texts have no words and come back as empty text;
rows that share a doc_id are one document each at the same place, so equal
rows do not remove each other's words; a null doc_id sorts before all others;
words are kept unchanged, joined by one space; an empty table gives an empty
result. Only columns named in ``carry`` are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import U, WordHasher, column_bytes, inside, ngrams, shrink, small_batches, spans

WINDOW = 20
BLOCK = WINDOW // 2
CHUNK_BYTES = 8 << 20
RESULT = ("text", "n_words", "n_removed")
_FLAGS = 0b11  # 1: an aligned block, 2: more than once in the chunk
_LOW = np.iinfo(np.int64).min


def _pack(values: np.ndarray) -> bytes:
    """48-bit values, 6 bytes each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(U)


def _range(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n shares a hash falls in, by its lowest 18 bits (the packed value holds the other 46)."""
    return ((h & U(0x3FFFF)) * U(n) >> U(18)).astype(np.int64)


def _texts(packed: pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, starts, ends, words per row) of slices of compressed texts."""
    import zstandard
    unzip = zstandard.ZstdDecompressor().decompress
    rows, at, size = [], 0, 0
    values = packed.to_pylist()
    for k, z in enumerate(values):
        rows.append(unzip(z) if z else b"")
        size += len(rows[-1])
        if size >= limit or k == len(values) - 1:
            buf, bounds = column_bytes(pa.array(rows, pa.large_binary()))
            starts, ends, counts = spans(buf, bounds)
            yield at, k + 1, buf, starts, ends, counts
            rows, at, size = [], k + 1, 0


def _positions(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _anchors_out(n: int):
    def run(table: pa.Table) -> pa.Table:
        hasher, held = WordHasher(), []
        for _, _, buf, starts, ends, counts in _texts(table.column("z")):
            h = ngrams(hasher.hash(buf, starts, ends), BLOCK, 11)
            ok = inside(counts, BLOCK, len(h))
            aligned = _positions(counts)[: len(h)] % BLOCK == 0
            held.append((h[ok] >> U(18) << U(2)) | aligned[ok].astype(U) | (_range(h[ok], n).astype(U) << U(48)))
        v = np.sort(np.concatenate(held)) if held else np.zeros(0, U)
        if not len(v):
            return _rows([], [], [])
        at = np.flatnonzero(np.r_[True, (v[1:] ^ v[:-1]) > U(_FLAGS)])
        many = np.diff(np.r_[at, len(v)]) > 1
        one = np.bitwise_or.reduceat(v, at) | (many.astype(U) << U(1))
        share = (one >> U(48)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, share[1:] != share[:-1], True])
        chunk = table.column("__chunk")[0].as_py()
        return _rows(share[cut[:-1]], [chunk] * (len(cut) - 1), [_pack(one[a:b]) for a, b in zip(cut, cut[1:])])
    return run


def _rows(to: Sequence[int], chunk: Sequence[int], data: Sequence[bytes]) -> pa.Table:
    return pa.table({"__to": pa.array(to, pa.int64()), "__from": pa.array(chunk, pa.int64()), "__data": pa.array(data, pa.binary())})


def _anchors_meet(table: pa.Table) -> pa.Table:
    """What each chunk holds of the hashes that are an aligned block and occur twice or more."""
    parts = [_unpack(x) for x in table.column("__data").to_pylist()]
    v = np.concatenate(parts)
    order = np.argsort(v >> U(2), kind="stable")
    s = v[order]
    at = np.flatnonzero(np.r_[True, (s[1:] >> U(2)) != (s[:-1] >> U(2))])
    n = np.diff(np.r_[at, len(s)])
    flags = np.bitwise_or.reduceat(s & U(_FLAGS), at)
    anchor = ((flags & U(1)) > 0) & ((n > 1) | ((flags & U(2)) > 0))
    hit = np.empty(len(v), bool)
    hit[order] = np.repeat(anchor, n)
    out, k = [], 0
    for chunk, p in zip(table.column("__from").to_pylist(), parts):
        mine = p[hit[k : k + len(p)]]
        k += len(p)
        if len(mine):
            out.append((chunk, _pack(mine >> U(2))))
    return _rows([c for c, _ in out], [0] * len(out), [d for _, d in out])


_WINDOW_ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("pos", "<i4"), ("many", "u1")])


def _squeeze(entries: np.ndarray) -> bytes:
    """Column by column, compressed: runs of one document shrink to little."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(b"".join(entries[f].tobytes() for f in _WINDOW_ENTRY.names))


def _expand(data: bytes) -> np.ndarray:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = np.empty(len(raw) // _WINDOW_ENTRY.itemsize, _WINDOW_ENTRY), 0
    for f in _WINDOW_ENTRY.names:
        k = _WINDOW_ENTRY[f].itemsize * len(out)
        out[f] = np.frombuffer(raw, _WINDOW_ENTRY[f], len(out), at)
        at += k
    return out


def _window_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ngrams(words, WINDOW, 12), (ngrams(words, WINDOW, 13) & U(0xFFFFFFFF)).astype(np.uint32)


def _earliest(e: np.ndarray) -> np.ndarray:
    """The first entry of each (h, g), marked if there were more."""
    e = e[np.lexsort((e["pos"], e["doc"], e["g"], e["h"]))]
    at = np.flatnonzero(np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["g"][1:] != e["g"][:-1])]) if len(e) else np.zeros(0, int)
    if not len(e):
        return e
    first = e[at]
    first["many"] = np.bitwise_or.reduceat(e["many"], at) | (np.diff(np.r_[at, len(e)]) > 1)
    return first


def _candidates(n: int):
    def run(docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not docs.num_rows or not anchors.num_rows:
            return _rows([], [], [])
        known = np.unique(np.concatenate([_unpack(x) for x in anchors.column("__data").to_pylist()]))
        hasher, held, size, ids = WordHasher(), [], 0, docs.column("__doc").to_numpy()
        for i, j, buf, starts, ends, counts in _texts(docs.column("z")):
            words = hasher.hash(buf, starts, ends)
            if len(words) < WINDOW:
                continue
            h = ngrams(words, BLOCK, 11) >> U(18)
            at = np.searchsorted(known, h).clip(0, len(known) - 1)
            hits = np.r_[0, np.cumsum(known[at] == h)]
            size_w = len(words) - WINDOW + 1
            cand = np.flatnonzero(inside(counts, WINDOW, size_w) & (hits[np.arange(size_w) + WINDOW - BLOCK + 1] > hits[:size_w]))
            if not len(cand):
                continue
            a, b = _window_hashes(words)
            e = np.zeros(len(cand), _WINDOW_ENTRY)
            e["h"], e["g"] = a[cand], b[cand]
            e["doc"], e["pos"] = np.repeat(ids[i:j], counts)[cand], _positions(counts)[cand]
            held.append(_earliest(e))
        e = _earliest(np.concatenate(held)) if held else np.empty(0, _WINDOW_ENTRY)
        share = _range(e["h"], n)
        e, share = e[order := np.lexsort((e["pos"], e["doc"], share))], share[order]
        cut = np.flatnonzero(np.r_[True, share[1:] != share[:-1], True]) if len(e) else np.zeros(1, int)
        chunk = docs.column("__chunk")[0].as_py()
        return _rows(share[cut[:-1]], [chunk] * (len(cut) - 1), [_squeeze(e[a:b]) for a, b in zip(cut, cut[1:])])
    return run


def _windows_meet(table: pa.Table) -> pa.Table:
    """For each chunk, the earliest position of all chunks of the windows that it holds later or more than once."""
    parts = [_expand(x) for x in table.column("__data").to_pylist()]
    e = np.concatenate(parts)
    order = np.lexsort((e["pos"], e["doc"], e["g"], e["h"]))
    s = e[order]
    new = np.r_[True, (s["h"][1:] != s["h"][:-1]) | (s["g"][1:] != s["g"][:-1])]
    e[order] = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out, k = [], 0
    for chunk, p in zip(table.column("__from").to_pylist(), parts):
        first = e[k : k + len(p)]
        k += len(p)
        first = first[(p["many"] > 0) | (first["doc"] != p["doc"]) | (first["pos"] != p["pos"])]
        if len(first):
            out.append((chunk, _squeeze(first)))
    return _rows([c for c, _ in out], [0] * len(out), [d for _, d in out])


def _remove(carry: Sequence[str]):
    def run(docs: pa.Table, windows: pa.Table) -> pa.Table:
        known = np.concatenate([_expand(x) for x in windows.column("__data").to_pylist()]) if windows.num_rows else np.empty(0, _WINDOW_ENTRY)
        known = known[np.argsort(known["h"])]
        hasher, ids = WordHasher(), docs.column("__doc").to_numpy()
        text, n_words, n_removed = [], [], []
        for i, j, buf, starts, ends, counts in _texts(docs.column("z")):
            gone = np.zeros(len(starts), bool)
            if len(known) and len(starts) >= WINDOW:
                a, b = _window_hashes(hasher.hash(buf, starts, ends))
                at = np.searchsorted(known["h"], a).clip(0, len(known) - 1)
                k = known[at]
                doc, pos = np.repeat(ids[i:j], counts)[: len(a)], _positions(counts)[: len(a)]
                late = np.flatnonzero((k["h"] == a) & (k["g"] == b) & inside(counts, WINDOW, len(a)) & ((k["doc"] < doc) | ((k["doc"] == doc) & (k["pos"] < pos))))
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, late, 1)
                np.add.at(step, late + WINDOW, -1)
                gone = np.cumsum(step[:-1]) > 0
            data, first = buf.tobytes(), np.r_[0, np.cumsum(counts)]
            for a, b in zip(first, first[1:]):
                keep = a + np.flatnonzero(~gone[a:b])
                text.append(b" ".join([data[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist())]))
                n_words.append(b - a)
                n_removed.append(b - a - len(keep))
        return pa.table([*(docs.column(c) for c in carry), pa.array(text, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                        names=[*carry, *RESULT])
    return run


def dedup_substrings(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row with text (kept words), n_words and n_removed."""
    small_batches(docs)
    if clash := set(carry) & {*RESULT}:
        raise ValueError(f"columns to carry clash with result columns: {sorted(clash)}")
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = max(1, -(-int(size) // CHUNK_BYTES))
    names = [f"__c{k}" for k in range(len(carry))]
    flat = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("__doc"),
                       *(F.col(c).alias(x) for c, x in zip(carry, names)))
    schema = T.StructType([T.StructField("z", T.BinaryType()), *flat.schema.fields[1:]])
    parts = (flat.mapInArrow(shrink, schema).withColumn("__chunk", F.pmod(F.xxhash64("__doc"), F.lit(n)).cast("long")))
    rows = "__to long, __from long, __data binary"
    anchors = (parts.groupBy("__chunk").applyInArrow(_anchors_out(n), rows)
               .groupBy("__to").applyInArrow(_anchors_meet, rows))
    windows = (parts.groupBy("__chunk").cogroup(anchors.groupBy("__to")).applyInArrow(_candidates(n), rows)
               .groupBy("__to").applyInArrow(_windows_meet, rows))
    out = T.StructType([*schema.fields[2:], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return (parts.groupBy("__chunk").cogroup(windows.groupBy("__to")).applyInArrow(_remove(names), out)
            .toDF(*carry, *RESULT))
