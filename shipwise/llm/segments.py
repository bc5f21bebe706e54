"""Encodings of texts from encodings of their segments, each distinct segment encoded once.

Where a tokenizer never joins characters across a segment border, the encoding
of a text is the concatenation of its segments' encodings; repeated segments
then cost one look-up in a hash table of NumPy arrays. The segments are walked
in runs of at most RUN, and the table is emptied before a run when it holds
more than LIMIT or might not hold the run, so its memory is bounded whatever
the length of a text.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np

from .text import SEPARATOR, U, WordHasher, mix

LIMIT = 600_000
RUN = 1 << 17
_BITS = 21


def worker_cache(key, make: Callable[[], object]):
    """What ``make`` returned for this key in this Python worker before; one entry is held for each first part of a key."""
    held = sys.__dict__.setdefault("_shipwise_worker_cache", {})
    if key[0] not in held or held[key[0]][0] != key:
        held[key[0]] = (key, make())
    return held[key[0]][1]


class HashTable:
    """Open-addressing map from non-zero 64-bit keys to small integers, read and written array-wise."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys, self.rows = np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32)

    def clear(self) -> None:
        self.keys[:] = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is missing."""
        out = np.full(len(h), -1, np.int64)
        slot, at = (h >> U(64 - self.bits)).view(np.int64), None
        while len(slot):
            k = self.keys[slot]
            hit = k == (h if at is None else h[at])
            found = np.flatnonzero(hit)
            out[found if at is None else at[found]] = self.rows[slot[found]]
            more = np.flatnonzero(~hit & (k != 0))
            at = more if at is None else at[more]
            slot = (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        """New distinct keys."""
        slot = (h >> U(64 - self.bits)).view(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = self.keys[slot] == h
            self.rows[slot[mine]] = rows[mine]
            h, rows, slot = h[~mine], rows[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)


class SegmentTable:
    """Distinct segments with the values that ``encode(segments, kinds)`` gives for each: their numbers of values, and all values."""

    def __init__(self, encode: Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.encode, self.hasher, self.table = encode, WordHasher(), HashTable(_BITS)
        self.room = 1 << (_BITS - 1)
        self.limit, self.run = min(LIMIT, self.room), min(RUN, self.room)
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.size, self.start, self.flat = 0, np.zeros(1, np.int64), np.zeros(0, np.int32)

    def runs(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of the segments, run by run; each run's hold until the next is asked for."""
        for i in range(0, len(starts), self.run):
            a, b = starts[i : i + self.run], ends[i : i + self.run]
            yield self._rows(buf[a[0] : b[-1]], a - a[0], b - a[0], kinds[i : i + self.run])

    def _rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        if self.size > self.limit or self.size + len(starts) > self.room:
            self.clear()
        h = mix(self.hasher.hash(buf, starts, ends) + kinds.astype(U) * U(0x9E3779B97F4A7C15)) | U(1)
        rows = self.table.find(h)
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            data = buf.tobytes()
            sizes, values = self.encode([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())], kinds[at])
            self.table.add(new, np.arange(self.size, self.size + len(new)))
            self.size += len(new)
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, values])
            rows[miss] = self.table.find(h[miss])
        return rows

    def values(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of the segments one after another, and the bounds of the segments in them."""
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for rows in self.runs(buf, starts, ends, kinds):
            sizes = self.start[rows + 1] - self.start[rows]
            last = np.cumsum(sizes)
            flat.append(self.flat[np.arange(last[-1]) + np.repeat(self.start[rows] - (last - sizes), sizes)])
            counts.append(sizes)
        return np.concatenate(flat), np.cumsum(np.concatenate(counts))

    def join(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of the texts one after another, and the bounds of the texts in them; counts: segments per text."""
        flat, bounds = self.values(buf, starts, ends, kinds)
        return flat, bounds[np.concatenate([[0], np.cumsum(counts)])]


_OTHER, _LETTER, _DIGIT, _SYMBOL, _UNSURE = range(5)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[SEPARATOR] = _OTHER
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[0x80:] = _UNSURE
_CLASS[[ord("'"), ord("<")]] = _UNSURE
WHOLE, PART = 0, 1


def pattern_segments(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, kinds, segments per text) for tokenizers that fold case and match runs of letters, digits one by one, runs of symbols.

    A word of ASCII and Latin-1 letters, ASCII digits and symbols (no apostrophe,
    no "<") is cut where those change, folded to lower case, kind PART. Any
    other word stays whole and unchanged, kind WHOLE, for the full tokenizer.
    """
    cls, buf = _CLASS[buf], buf.copy()
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    if len(lead):
        second = buf[lead + 1]
        lead = lead[(second >= 0x80) & (second != 0x97) & (second != 0xB7)]
        cls[lead] = cls[lead + 1] = _LETTER
    word = cls != _OTHER
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = bounds[(bounds > 0) & (bounds < len(buf))]
    first[cuts] = word[cuts]
    at = np.flatnonzero(first)
    unsure = np.add.reduceat(cls == _UNSURE, at, dtype=np.int64) > 0 if len(at) else np.zeros(0, bool)
    inner = np.flatnonzero((cls[1:] != cls[:-1]) | (cls[1:] == _DIGIT)) + 1
    inner = inner[word[inner] & ~first[inner]]
    owner = np.searchsorted(at, inner, "right") - 1
    inner = inner[~unsure[owner]]
    starts = np.sort(np.concatenate([at, inner]))
    gap = first.copy()
    gap[inner] = True
    gap[cuts] = True
    close = word.copy()
    close[:-1] &= ~word[1:] | gap[1:]
    ends = np.flatnonzero(close) + 1
    whole = unsure[np.searchsorted(at, starts, "right") - 1] if len(starts) else np.zeros(0, bool)
    # lower case, outside words that stay whole
    fold = (buf >= ord("A")) & (buf <= ord("Z"))
    if len(lead):
        two = lead + 1
        fold[two[(buf[two] <= 0x9E)]] = True
    fold = np.flatnonzero(fold)
    fold = fold[~unsure[np.searchsorted(at, fold, "right") - 1]] if len(at) else fold
    buf[fold] += 32
    return buf, starts, ends, np.where(whole, WHOLE, PART), np.diff(np.searchsorted(starts, bounds))


FIRST, LATER, TEXT = 0, 1, 2
_MARK = (0xE2, 0x96, 0x81)


def spaced_segments(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, kinds, segments per text): texts cut before every run of spaces.

    Kind FIRST: the text's first segment, before which the tokenizer puts a
    space; LATER: any other. A text that holds the space mark itself is one
    segment, kind TEXT.
    """
    start = buf == 32
    start[1:] &= buf[:-1] != 32
    begin = bounds[:-1][np.diff(bounds) > 0]
    start[begin] = True
    marks = np.flatnonzero((buf[:-2] == _MARK[0]) & (buf[1:-1] == _MARK[1]) & (buf[2:] == _MARK[2])) if len(buf) > 2 else np.zeros(0, int)
    texts = np.unique(np.searchsorted(bounds, marks, "right") - 1)
    for t in texts:
        start[bounds[t] + 1 : bounds[t + 1]] = False
    starts = np.flatnonzero(start)
    ends = np.concatenate([starts[1:], [len(buf)]]) if len(starts) else starts
    kinds = np.full(len(starts), LATER)
    kinds[np.searchsorted(starts, begin)] = FIRST
    if len(texts):
        kinds[np.searchsorted(starts, bounds[texts])] = TEXT
    return starts, ends, kinds, np.diff(np.searchsorted(starts, bounds))
