"""Toxicity scores from a counterfactual-regularised linear classifier.

Features of a text are its distinct words (case folded, cut at punctuation) and
its distinct word beginnings of PREFIX bytes, as hashes. Learning uses at most
SAMPLE labelled documents that are not held out (those of smallest hash of the
doc_id), a bound that is a parameter:

1. The FEATURES features of that sample whose document counts differ most
   between the labels (chi-square), and the identity terms' features.
2. A logistic regression with L1 and L2 penalties (proximal gradient steps).
   For each sampled sentence set that names a group, the same text with every
   identity term swapped for the next of its group is a counterfactual, and
   ``swap_penalty`` times the mean square of the score change is added to the
   loss. Neutral mentions of a group thus cannot carry weight of their own.

score is the fitted probability of label 1 for the whole text, with both labels
as frequent.

Defined cases: null and empty texts get the score of a text without features;
null labels teach nothing, several labels of a document count as the largest;
without labelled documents of both kinds all scores are the share of label 1
(0 without any); repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import held_out
from .segments import WHOLE, pattern_segments
from .text import U, WordHasher, column_bytes, fresh_worker, mix, opened, row_slices, schema_of, shipped, small_batches

SAMPLE = 30_000
FEATURES = 8192
PREFIX = 5
SLICE = 1 << 19
THRESHOLD = 0.7
#: Terms that may be swapped for each other.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"),
    ("immigrant", "refugee", "foreigner", "citizen", "native"),
    ("disabled", "blind", "deaf", "autistic"),
)

_PARTS = re.compile(r"[^\W\d_]+|\d|[\W_]+")


class Features:
    """Hashed features of texts."""

    def __init__(self):
        self.hasher = WordHasher()

    def __call__(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature); also of repeated words."""
        buf, starts, ends, kinds, counts = pattern_segments(buf, bounds)
        text = np.repeat(np.arange(len(counts)), counts)
        whole = np.flatnonzero(kinds == WHOLE)
        if not len(whole):
            return self._hashed(buf, starts, ends, text)
        # words that op2 leaves as they are: folded and cut here
        part, owner = kinds != WHOLE, []
        cut = []
        for a, b, t in zip(starts[whole].tolist(), ends[whole].tolist(), text[whole].tolist()):
            parts = _PARTS.findall(buf[a:b].tobytes().decode("utf-8", "replace").lower())
            cut += parts
            owner += [t] * len(parts)
        more, at = column_bytes(pa.array(cut, pa.string()))
        x, y = self._hashed(buf, starts[part], ends[part], text[part]), self._hashed(more, at[:-1], at[1:], np.array(owner, np.int64))
        return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])

    def _hashed(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = ends - starts > PREFIX
        h = self.hasher.hash(buf, starts, ends)
        p = mix(self.hasher.hash(buf, starts[long], starts[long] + PREFIX))
        return np.concatenate([text, text[long]]), np.concatenate([h, p])

    def of_words(self, words: list[str]) -> list[np.ndarray]:
        return [self(*column_bytes(pa.array([w])))[1] for w in words]


def distinct(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
    return text[new], h[new]


def swaps() -> tuple[np.ndarray, np.ndarray]:
    """Features of identity terms, sorted, and those of the terms that replace them."""
    f, pairs = Features(), {}
    for group in IDENTITY:
        of = f.of_words(list(group))
        for a, b in zip(of, of[1:] + of[:1]):
            pairs.update(zip(a.tolist(), (b if len(b) == len(a) else np.resize(b, len(a))).tolist()))
    keys = np.array(sorted(pairs), dtype=U)
    return keys, np.array([pairs[k] for k in keys.tolist()], dtype=U)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n, n_toxic) of the documents of one task."""
    features, held = Features(), []
    for batch in batches:
        toxic = batch.column(1).to_numpy().astype(np.int64)
        buf, bounds = column_bytes(batch.column(0))
        for i, j in row_slices(bounds, SLICE):
            text, h = distinct(*features(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
            held.append(np.stack([h, np.ones(len(h), U), toxic[i:j][text].astype(U)]))
    if held:
        h, n, y = np.concatenate(held, axis=1)
        order = np.argsort(h)
        at = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0])
        if len(h):
            yield pa.RecordBatch.from_arrays([pa.array(h[order][at].view(np.int64)), *(pa.array(np.add.reduceat(x[order], at).view(np.int64)) for x in (n, y))], ["feature", "n", "n_toxic"])


def _look_up(vocab: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(vocab, h).clip(0, len(vocab) - 1)
    return at, vocab[at] == h


def _sampled(vocab: np.ndarray, keys: np.ndarray, other: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(toxic, columns, swapped columns) of each document; swapped is null if no identity term occurs."""
        features = Features()

        def columns(text, h, n):
            text, h = distinct(text, h)
            at, ok = _look_up(vocab, h)
            text, at = text[ok], at[ok].astype(np.int32)
            cut = np.searchsorted(text, np.arange(n + 1))
            return [at[a:b] for a, b in zip(cut, cut[1:])]
        for batch in batches:
            buf, bounds = column_bytes(batch.column(0))
            for i, j in row_slices(bounds, SLICE):
                text, h = features(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                at, hit = _look_up(keys, h)
                named = np.zeros(j - i, bool)
                named[text[hit]] = True
                swapped = columns(text, np.where(hit, other[at], h), j - i)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(columns(text, h, j - i), pa.list_(pa.int32())),
                                                  pa.array([s if k else None for s, k in zip(swapped, named)], pa.list_(pa.int32()))], ["toxic", "x", "swapped"])
    return run


class Rows:
    """A sparse 0/1 matrix."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n)

    def dot_transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, r[self.row], self.width)


def fit_weights(x: list[np.ndarray], y: np.ndarray, swapped: list, width: int, l1: float = 0.02, l2: float = 1e-5, swap_penalty: float = 1.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept (accelerated proximal gradient with a fixed step). Both labels weigh alike; the L1 penalty is l1 / sqrt(rows)."""
    named = [k for k, s in enumerate(swapped) if s is not None]
    m, a, b = Rows(x, width), Rows([x[k] for k in named], width), Rows([swapped[k] for k in named], width)
    n = len(x)
    l1 = l1 / np.sqrt(n)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    # largest curvature, by power iteration
    v = np.ones(width)
    for _ in range(12):
        d = a.dot(v) - b.dot(v)
        v2 = m.dot_transposed(weight * m.dot(v)) / (4 * n) + 2 * swap_penalty * (a.dot_transposed(d) - b.dot_transposed(d)) / max(1, len(named))
        bound = np.linalg.norm(v2) / max(np.linalg.norm(v), 1e-12)
        v = v2 / max(np.linalg.norm(v2), 1e-12)
    rate = 1 / (1.1 * bound + 0.25 + l2)
    w, c, t = np.zeros(width), 0.0, 1.0
    pw, pc = w, c
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(m.dot(pw) + pc, -40, 40))) - y
        r *= weight
        d = a.dot(pw) - b.dot(pw)
        grad = m.dot_transposed(r) / n + l2 * pw + 2 * swap_penalty * (a.dot_transposed(d) - b.dot_transposed(d)) / max(1, len(named))
        step = pw - rate * grad
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        new_c = pc - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pc = new + (t - 1) / t2 * (new - w), new_c + (t - 1) / t2 * (new_c - c)
        w, c, t = new, new_c, t2
    return w, float(c)


class Classifier:
    def __init__(self, vocab: np.ndarray, weights: np.ndarray, intercept: float):
        some = weights != 0
        self.vocab, self.weights, self.intercept = np.r_[vocab[some], U(2**64 - 1)], np.r_[weights[some], 0.0], intercept

    def scores(self, features: Features, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        text, h = features(buf, bounds)
        at, ok = _look_up(self.vocab, h)
        text, at = distinct(text[ok], at[ok])
        z = np.bincount(text, self.weights[at], len(bounds) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learns from the sampled documents that are not held out."""
    small_batches(docs)
    spark = docs.sparkSession
    learnable = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
                 .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    ids = learnable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic")  # at most ``sample`` rows
    keys, other = swaps()
    stats = texts.mapInArrow(_counts, "feature long, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("y"))
    total = texts.agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).first()
    n, y = total.n, total.y or 0
    if not 0 < y < n:
        return Classifier(np.zeros(0, U), np.zeros(0), 40.0 if n and y == n else -40.0)
    # chi-square of the 2 x 2 table of feature and label
    a, b = F.col("y").cast("double"), F.col("n") - F.col("y")
    chi = n * F.pow(a * (n - y - b) - b * (y - a), 2) / (F.col("n") * (F.lit(float(n)) - F.col("n")) * float(y) * float(n - y))
    best = stats.where((F.col("n") > 2) & (F.col("n") < n)).orderBy(chi.desc(), "feature").limit(FEATURES).select("feature").toArrow()
    vocab = np.unique(np.concatenate([best.column(0).to_numpy().view(U), keys]))
    rows = texts.mapInArrow(_sampled(vocab, keys, other), "toxic int, x array<int>, swapped array<int>").toArrow()
    x = [np.array(v, np.int64) for v in rows.column("x").to_pylist()]
    swapped = [None if v is None else np.array(v, np.int64) for v in rows.column("swapped").to_pylist()]
    weights, intercept = fit_weights(x, rows.column("toxic").to_numpy().astype(float), swapped, len(vocab))
    return Classifier(vocab, weights, intercept)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        features, classifier = Features(), opened(model)
        for batch in batches:
            buf, bounds = column_bytes(batch.column(0))
            for i, j in row_slices(bounds, SLICE):
                s = classifier.scores(features, buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])
    return run


def score(docs: DataFrame, model: Classifier, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row with score and predicted."""
    small_batches(docs)
    flat = docs.select(F.col("text").cast("string").alias("__text"), *carry)
    return flat.mapInArrow(_score(shipped(docs.sparkSession, model)), schema_of(flat.select(*carry), "score double, predicted int"))
