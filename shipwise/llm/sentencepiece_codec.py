"""SentencePiece encoding and decoding with the tokenizers library.

``Model.parse`` reads the model's protobuf; ``tokenizer`` rebuilds it: the
normaliser (character map, extra white space, the prefix space and the
white-space mark), unigram scores or, for a BPE model, the merges that its
scores order, and byte fallback. Control, unknown and byte pieces never match
text. Texts are cut before runs of spaces when no piece has the mark after
another character (else they are encoded whole), and distinct segments are
encoded in batches by ``THREADS`` threads; every distinct segment is compared
with the sentencepiece library itself, and ``parity`` says whether all
segments of the document agree.

Decoding joins the pieces' bytes, turns marks into spaces and drops the prefix
space; ``round_trip`` says whether the decoded text is the text.

Defined cases: null and empty texts have no ids, parity and a round trip (null
as the empty text); ids without text (control pieces) decode to nothing; bytes
that are not UTF-8 decode to U+FFFD; repeated rows are encoded each; extra
columns are ignored unless carried.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import FIRST, TEXT, SegmentTable, spaced_segments, worker_cache
from .text import column_bytes, fresh_worker, row_slices, schema_of, small_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
UNIGRAM, BPE = 1, 2  # model types of the format
THREADS = 2
SLICE = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls([])
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                out.pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, bytes(4)), "<f4")[0]), f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                out.kind, out.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                out.char_map = f.get(2, b"")
                out.add_dummy_prefix, out.remove_extra_whitespaces, out.escape_whitespaces = (bool(f.get(k, 1)) for k in (3, 4, 5))
        return out

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @cached_property
    def matching(self) -> dict[str, int]:
        """Pieces that text can match."""
        return {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}

    @cached_property
    def splits_at_spaces(self) -> bool:
        return (self.add_dummy_prefix and self.escape_whitespaces and not self.remove_extra_whitespaces and not self.char_map
                and not any(MARK in p.lstrip(MARK) for p in self.matching))

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, models, normalizers
        own = self.matching
        if self.kind == UNIGRAM:
            # a piece that text must not match gets a name that no text holds
            vocab = [(p if p in own or kind == BYTE else f"\0{i}", s) for i, (p, s, kind) in enumerate(self.pieces)]
            model = models.Unigram(vocab, unk_id=self.unknown, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            merges = []
            for p in sorted(own, key=lambda p: (-self.pieces[own[p]][1], own[p])):
                merges += [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in own and p[k:] in own]
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab=vocab, merges=merges, unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.char_map)] if self.char_map else []
        if self.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        space = MARK if self.escape_whitespaces else " "
        if self.escape_whitespaces:
            steps.append(normalizers.Replace(" ", space))
        if self.add_dummy_prefix:
            steps.append(normalizers.Prepend(space))
        if steps:
            out.normalizer = normalizers.Sequence(steps)
        return out


class Encoder:
    """ids and parity of texts."""

    def __init__(self, data: bytes):
        import sentencepiece
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = Model.parse(data)
        self.full, self.later = self.model.tokenizer(), self.model.tokenizer()
        if self.model.splits_at_spaces:
            from tokenizers import normalizers
            self.later.normalizer = normalizers.Replace(" ", MARK)
        self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.table = SegmentTable(self._encode)

    def _encode(self, segments: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each segment's values: parity, then the ids."""
        values: list[list[int]] = [[]] * len(segments)
        later = np.isin(kinds, (FIRST, TEXT), invert=True)
        for tokenizer, at in ((self.full, np.flatnonzero(~later).tolist()), (self.later, np.flatnonzero(later).tolist())):
            for k, e in zip(at, tokenizer.encode_batch_fast([segments[k] for k in at], add_special_tokens=False)):
                values[k] = e.ids
        # the library puts its own space before a text
        theirs = self.check.encode([s[1:] if x else s for s, x in zip(segments, later)], num_threads=THREADS)
        one = self.model.matching.get(MARK)
        values = [[int(v == t or bool(x and s == " " and v == [one]))] + v for v, t, s, x in zip(values, theirs, segments, later)]
        return np.fromiter(map(len, values), np.int64, len(values)), np.fromiter((x for v in values for x in v), np.int32)

    def __call__(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, bounds of the texts in them, parity of each text)."""
        if self.model.splits_at_spaces:
            starts, ends, kinds, counts = spaced_segments(buf, bounds)
        else:
            counts = (np.diff(bounds) > 0).astype(np.int64)
            starts, ends = bounds[:-1][counts > 0], bounds[1:][counts > 0]
            kinds = np.full(len(starts), TEXT)
        values, bounds = self.table.values(buf, starts, ends, kinds)
        agree = np.r_[0, np.cumsum(values[bounds[:-1]])]
        at = np.r_[0, np.cumsum(counts)]
        ids = np.delete(values, bounds[:-1])
        return ids, (bounds - np.arange(len(bounds)))[at], np.diff(agree[at]) == counts


class Decoder:
    """Texts of ids, as bytes."""

    def __init__(self, model: Model):
        self.prefix = model.add_dummy_prefix
        data = [bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()
                for p, _, kind in model.pieces]
        self.size = np.array([len(d) for d in data])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(data), np.uint8)

    def __call__(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, bounds of the texts in them); the prefix space is outside the bounds."""
        sizes = self.size[ids]
        last = np.r_[0, np.cumsum(sizes)]
        out = self.flat[np.arange(last[-1]) + np.repeat(self.start[ids] - last[:-1], sizes)]
        a, b = last[bounds[:-1]], last[bounds[1:]]
        if self.prefix:
            some = np.flatnonzero(a < b)
            a[some[out[a[some]] == 32]] += 1
        return out, np.stack([a, b])


def _encode(data: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker("sentencepiece")
    encoder = worker_cache(("sentencepiece", data), lambda: Encoder(data))
    decoder = Decoder(encoder.model)
    for batch in batches:
        buf, bounds = column_bytes(batch.column(0))
        for i, j in row_slices(bounds, SLICE):
            part, at = buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            ids, cut, parity = encoder(part, at)
            text, (a, b) = decoder(ids, cut)
            raw, text = part.tobytes(), text.tobytes()
            same = [raw[x:y] == text[p:q] for x, y, p, q in zip(at.tolist(), at[1:].tolist(), a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(i, j - i) for c in batch.columns[1:]), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(cut), pa.int64()), pa.array(parity), pa.array(same)],
                [*batch.schema.names[1:], "ids", "n_ids", "parity", "round_trip"])


def encode(docs: DataFrame, model: bytes, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row with ids, n_ids, parity and round_trip. model: the bytes of a model file."""
    small_batches(docs)
    flat = docs.select(F.col("text").cast("string").alias("__text"), *carry)
    schema = schema_of(flat.select(*carry), "ids array<int>, n_ids long, parity boolean, round_trip boolean")
    return flat.mapInArrow(partial(_encode, model), schema)


def _decode(data: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(Model.parse(data))
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            ids = batch.column(0).slice(i, 256)
            lists = [np.array(x if x is not None else [], np.int64) for x in ids.to_pylist()]
            text, (a, b) = decoder(np.concatenate(lists), np.r_[0, np.cumsum([len(x) for x in lists])])
            text = [None if x is None else text[p:q].tobytes().decode("utf-8", "replace") for x, p, q in zip(ids, a, b)]
            yield pa.RecordBatch.from_arrays([*(c.slice(i, 256) for c in batch.columns[1:]), pa.array(text, pa.string())], [*batch.schema.names[1:], "text"])


def decode(encoded: DataFrame, model: bytes, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row with the text of its ids."""
    flat = encoded.select(F.col("ids").alias("__ids"), *carry)
    return flat.mapInArrow(partial(_decode, model), schema_of(flat.select(*carry), "text string"))
