"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary enumerates every match of a text
by its end. Dynamic programming over the ends keeps the best score and its
number of pieces, nothing else: no path and no ids. The rules are those of the
unigram tokenizer: scores add up; where two paths to a position tie, the one
whose last piece starts first (the longest) stays; a character that is no piece
costs the smallest score less UNKNOWN_PENALTY and loses ties; with byte
fallback it counts as its UTF-8 bytes, else a run of such characters counts as
one. Control, unknown and byte pieces match no text.

The vocabulary and its scores are those of a model file of any type. Texts are
normalised like the model's (a space before the text, spaces as marks) and cut
before runs of spaces when no piece spans such a cut; each distinct segment is
searched once a worker.

Defined cases: null and empty texts count 0; repeated rows count each; extra
columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import FIRST, SegmentTable, spaced_segments, worker_cache
from .sentencepiece_codec import MARK, Model
from .text import column_bytes, fresh_worker, row_slices, schema_of, small_batches

UNKNOWN_PENALTY = 10.0
SLICE = 1 << 20


class Counter:
    """Numbers of pieces of the best segmentations."""

    def __init__(self, model: Model):
        import ahocorasick
        if model.char_map or model.remove_extra_whitespaces or not (model.add_dummy_prefix and model.escape_whitespaces):
            raise ValueError("only models that keep text as it is, with a prefix space and space marks")
        self.cuts, self.bytes = model.splits_at_spaces, model.byte_fallback
        self.vocab = ahocorasick.Automaton()
        for p, i in model.matching.items():
            self.vocab.add_word(p, (len(p), model.pieces[i][1], len(p) == 1))
        self.vocab.make_automaton()
        self.unknown = min(s for _, s, _ in model.pieces) - UNKNOWN_PENALTY
        self.table = SegmentTable(self._search)

    def count(self, text: str) -> int:
        """Of one normalised text."""
        n = len(text)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        unknown, reached = self.unknown, 0
        ends = iter(self.vocab.iter(text))
        end, match = next(ends, (n, None))
        loose = False  # the best path to the last position ends in a character that is no piece
        for at in range(n):
            score = None
            known = False
            while end == at:  # the longest match comes first, so a later one has to be better to replace it
                size, own, one = match
                known = known or one
                s = best[at + 1 - size] + own
                if score is None or s > score:
                    score, reached = s, pieces[at + 1 - size] + 1
                end, match = next(ends, (n, None))
            was, loose = loose, False
            if not known:
                s = best[at] + unknown
                if score is None or s > score:
                    score, loose = s, True
                    reached = pieces[at] + (len(text[at].encode("utf-8", "surrogatepass")) if self.bytes else 0 if was else 1)
            best[at + 1], pieces[at + 1] = score, reached
        return pieces[n]

    def _search(self, segments: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        marked = ((MARK if k <= FIRST else "") + s.replace(" ", MARK) for s, k in zip(segments, kinds.tolist()))
        return np.ones(len(segments), np.int64), np.fromiter(map(self.count, marked), np.int32, len(segments))

    def __call__(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.cuts:
            starts, ends, kinds, counts = spaced_segments(buf, bounds)
            kinds = np.where(kinds == 1, 1, FIRST)
        else:
            counts = (np.diff(bounds) > 0).astype(np.int64)
            starts, ends = bounds[:-1][counts > 0], bounds[1:][counts > 0]
            kinds = np.full(len(starts), FIRST)
        n, _ = self.table.values(buf, starts, ends, kinds)
        return np.diff(np.r_[0, np.cumsum(n, dtype=np.int64)][np.r_[0, np.cumsum(counts)]])


def _count(data: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker("token_count")
    counter = worker_cache(("token_count", data), lambda: Counter(Model.parse(data)))
    for batch in batches:
        buf, bounds = column_bytes(batch.column(0))
        for i, j in row_slices(bounds, SLICE):
            n = counter(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), pa.array(n, pa.int64())], [*batch.schema.names[1:], "n_tokens"])


def count_tokens(docs: DataFrame, model: bytes, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row with n_tokens. model: the bytes of a model file, whose pieces and scores are the vocabulary."""
    small_batches(docs)
    flat = docs.select(F.col("text").cast("string").alias("__text"), *carry)
    return flat.mapInArrow(partial(_count, model), schema_of(flat.select(*carry), "n_tokens long"))
