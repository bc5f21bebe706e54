"""Language-model scores of texts: a hashed maximum-entropy model with class-factored softmax.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text, A to Z lower-cased,
and one end. The probability of a token is that of its class in its context
times that of the word in its class.

* Classes: the end, each of the HEAD most frequent words by itself, and TAIL
  classes of all other words by their last two characters.
* Class given context: softmax over the classes of a sum of weight rows, one
  for each feature of the context: none (bias), the word before (bigram), the
  two before (trigram), the second and the third before alone (skips).
  Features are hashed to ROWS rows.
* Word given class: count in the class, less the share that Good and Turing
  leave to unknown words (words seen once, by words); each class has one type
  of unknown word, so known words and unknown types sum to one.

Training: the counts of all (feature row, class) pairs of all learning texts
are summed in Spark and give the first weights (shrunk log ratios); then ROUNDS
gradient steps. For each, every task sums class indicator minus probability
over all positions of its learning texts, by rows; the sums of all tasks meet in
Spark, and the driver takes a diagonally scaled step.
What the driver and the broadcasts hold are ROWS x classes weights, whatever
the input; word counts come back to the chunks one entry a distinct word
(``chunks``).

Scoring runs in batches of tokens: weight rows are gathered by feature and
added, in single precision; log probabilities are summed in double precision.

Defined cases: null texts are empty (one token, the end); rows with a null
doc_id are scored and learned from like others; repeated rows count and are
scored each; without learning texts all counts are zero (base_score 0); texts
of any length are one chunk's at most; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .chunks import CHUNK_BYTES, VOCABULARY, by_language, dealt, expand, lowered, numbered, packed_words, returned, squeeze, task_number, unpacked_words, vocabulary, word_hashes
from .text import SEPARATOR, U, WordHasher, column_bytes, fresh_worker, mix, random_odd, small_batches

HEAD, TAIL = 31, 32
ROWS = 1 << 14
ROUNDS, RATE = 3, 0.5
#: Every how many positions a gradient takes one: all are taken.
STRIDE = 1
#: Counts that a pair needs to move its first weight half the way, and the share of a log ratio that a feature takes.
PRIOR, SHARE = 8.0, 0.45
FEATURES = 4
#: Rows that travel together, tokens taken at once, parts in which sums are formed first.
BLOCK, SLICE, PARTS = 256, 1 << 17, 16
#: Tokens whose class scores are formed in the processor's cache.
CACHED = 1 << 10

_CHUNKS = f"chunk long, lang string, docs array<long>, learn array<boolean>, sizes array<long>, seq binary, tails binary, {VOCABULARY}"
_READY = "chunk long, docs array<long>, learn array<boolean>, sizes array<long>, seq binary, hashes binary, known binary, kinds binary"
_TOTALS = "chunk long, range long, values binary, lengths binary, letters binary"
_SUMS = "block int, part int, sums binary"
RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (text, doc_id, learn) as chunks; the last word of a chunk's vocabulary is the end, ''."""
    fresh_worker()
    number, hasher, held, size = task_number(), WordHasher(), [], 0
    gap = np.array([10], np.uint8)

    def chunk() -> pa.RecordBatch:
        nonlocal number, held, size
        docs, learn, texts = zip(*held)
        buf = lowered(np.concatenate([x for t in texts for x in (t, gap)]))
        bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        word = ~SEPARATOR[buf]
        edge = np.diff(np.r_[False, word, False].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ids, words, _ = numbered(buf, word, starts, ends)
        sizes = np.diff(np.searchsorted(starts, bounds)) + 1
        last = np.cumsum(sizes) - 1
        is_word = np.ones(len(ids) + len(sizes), bool)
        is_word[last] = False
        seq = np.full(len(is_word), len(words), np.int32)
        seq[is_word] = ids
        counts = np.bincount(seq[np.repeat(np.array(learn), sizes)], minlength=len(words) + 1)
        words = pa.concat_arrays([words, pa.array([b""], pa.large_binary())])
        number, held, size = number + 1, [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array([number - 1]), pa.array([""]), pa.array([docs], pa.list_(pa.int64())), pa.array([learn], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int64())),
             pa.array([squeeze(seq)], pa.binary()), pa.array([squeeze(tail_classes(words))], pa.binary()), *vocabulary(words, counts, hasher)],
            [c.split()[0] for c in _CHUNKS.split(", ")])
    for batch in batches:
        buf, bounds = column_bytes(batch.column(0))
        for doc, learn, a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), bounds, bounds[1:]):
            held.append((doc, learn, buf[a:b].copy()))
            size += int(b - a) + 64
            if size >= CHUNK_BYTES:
                yield chunk()
    if held:
        yield chunk()


def tail_classes(words: pa.Array) -> np.ndarray:
    """Class of each word that is not among the most frequent: by its last two letters (bytes that end a character count
    with those before them); 0 for the end."""
    buf, at = column_bytes(words)
    size = np.diff(at)
    last = lambda k: np.where(size >= k, buf[np.maximum(at[1:] - k, 0)] if len(buf) else 0, 0).astype(np.int64)
    wide = last(1) >= 0x80  # the last letter is longer than a byte: it is taken with what precedes it
    code = last(1) + 257 * last(2) + np.where(wide, 65_537 * last(3), 0)
    kind = HEAD + 1 + (mix(code.astype(U)) % U(TAIL)).astype(np.int64)
    return np.where(size == 0, 0, kind).astype(np.uint8)


def _totals(table: pa.Table) -> pa.Table:
    """The counts of one range's words over all chunks: a row for each chunk with those of its words, and one (chunk -1) with the distinct words."""
    fresh_worker()
    (_, rows, sizes, words, counts), = by_language(table)
    coded = words.dictionary_encode()
    at = np.asarray(coded.indices)
    c = np.bincount(at, counts, len(coded.dictionary)).astype(np.int64)
    cut = np.r_[0, np.cumsum(sizes)]
    values = [squeeze(c[at[a:b]]) for a, b in zip(cut, cut[1:])]
    some = np.flatnonzero(c > 0)
    lengths, letters = packed_words(coded.dictionary.take(pa.array(some)))
    none = [None] * len(values)
    return pa.table({"chunk": pa.array([*rows.column("chunk").to_pylist(), -1], pa.int64()), "range": pa.array([table.column("range")[0].as_py()] * (len(values) + 1), pa.int64()),
                     "values": pa.array([*values, squeeze(c[some])], pa.binary()), "lengths": pa.array([*none, lengths], pa.binary()), "letters": pa.array([*none, letters], pa.binary())})


def _most_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each range's HEAD most frequent words, ties by the word's bytes."""
    for batch in batches:
        for r in batch.to_pylist():
            c, words = expand(r["values"], np.int64), unpacked_words(r["lengths"], r["letters"])
            order = pc.sort_indices(pa.table({"c": -c, "w": words}), [("c", "ascending"), ("w", "ascending")])[: HEAD + 1]
            yield pa.RecordBatch.from_arrays([words.take(order).cast(pa.large_string()).cast(pa.string()), pa.array(c[order.to_numpy()])], ["word", "c"])


def kinds_of(words_hashes: np.ndarray, tails: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Classes: those of the tails, but for words whose hash is one of ``head``."""
    kinds = tails.copy()
    if len(head):
        order = np.argsort(head)
        at = np.searchsorted(head[order], words_hashes).clip(0, len(head) - 1)
        hit = (head[order][at] == words_hashes) & (tails > 0)
        kinds[hit] = order[at[hit]] + 1
    return kinds


def _class_sums(head: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per class: its tokens, words, and words seen once."""
        fresh_worker()
        hasher, total = WordHasher(), np.zeros((3, 1 + HEAD + TAIL), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                c, words = expand(r["values"], np.int64), unpacked_words(r["lengths"], r["letters"])
                if len(c):
                    kind = kinds_of(word_hashes(words, hasher), tail_classes(words), head)
                    for k, x in enumerate((c, np.ones_like(c), (c == 1).astype(np.int64))):
                        total[k] += np.bincount(kind, x, total.shape[1]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1]), pa.int32()), *(pa.array(x) for x in total)], ["kind", "n", "v", "once"])
    return run


def _with_counts(n: int, head: np.ndarray):
    def run(chunk: pa.Table, words: pa.Table) -> pa.Table:
        """A chunk with its words' counts in the corpus and their classes in place of its own vocabulary."""
        fresh_worker()
        hashes = expand(chunk.column("hashes")[0].as_py(), U)
        kinds = kinds_of(hashes, expand(chunk.column("tails")[0].as_py(), np.uint8), head)
        return (chunk.select(["chunk", "docs", "learn", "sizes", "seq", "hashes"])
                .append_column("known", pa.array([squeeze(returned(words, hashes, n))], pa.binary())).append_column("kinds", pa.array([squeeze(kinds)], pa.binary())))
    return run


class _Chunk:
    """The tokens of one chunk with their features."""

    def __init__(self, r: dict):
        self.docs = r["docs"]
        self.sizes = np.array(r["sizes"], np.int64)
        self.learn = np.repeat(np.array(r["learn"], bool), self.sizes)
        self.seq = expand(r["seq"], np.int32)
        self.hashes = expand(r["hashes"], U)
        self.known, self.kinds = expand(r["known"], np.int64), expand(r["kinds"], np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.seq)) - np.repeat(self.first, self.sizes)

    def features(self, at: np.ndarray, rows: int) -> np.ndarray:
        """(FEATURES x positions) weight rows of the contexts of the tokens at ``at``."""
        odd = random_odd(5, 17)
        back = []
        for k in (1, 2, 3):
            h = self.hashes[self.seq[np.maximum(at - k, 0)]]
            h[self.place[at] < k] = U(k)  # before the text
            back.append(h)
        one, two, three = back
        mixed = (one * odd[0], one * odd[1] + two * odd[2], two * odd[3], three * odd[4])
        return np.stack([(mix(h) % U(rows)).astype(np.int64) for h in mixed])


def _blocks_of(sums: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    """(rows x classes) sums as rows of BLOCK weight rows."""
    cut = [(b, sums[b * BLOCK : (b + 1) * BLOCK]) for b in range(-(-len(sums) // BLOCK))]
    cut = [(b, x) for b, x in cut if x.any()]
    if cut:
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array([squeeze(x.reshape(-1)) for _, x in cut], pa.binary())], ["block", "part", "sums"])


def _part() -> int:
    return (task_number() >> 32) % PARTS


def _observed(rows: int, classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the (weight row, class) pairs of the learning texts; the last row: of the classes."""
        fresh_worker()
        total = np.zeros((rows + 1) * classes, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                c = _Chunk(r)
                at = np.flatnonzero(c.learn)
                kind = c.kinds[c.seq[at]].astype(np.int64)
                total[rows * classes :] += np.bincount(kind, minlength=classes)
                for f in c.features(at, rows):
                    total[: rows * classes] += np.bincount(f * classes + kind, minlength=rows * classes)
        yield from _blocks_of(total.astype(np.float64).reshape(rows + 1, classes), _part())
    return run


def class_scores(weights: np.ndarray, features: np.ndarray, biased: np.ndarray | None = None) -> np.ndarray:
    """(positions x classes) sums of the bias, the last row, and the features' rows. ``biased``: ``with_bias`` of the
    weights, if it is at hand."""
    biased = with_bias(weights) if biased is None else biased
    z = np.empty((features.shape[1], weights.shape[1]), weights.dtype)
    for a in range(0, len(z), CACHED):
        own = z[a : a + CACHED]
        own[:] = biased.take(features[0, a : a + CACHED], 0)
        for f in features[1:]:
            own += weights.take(f[a : a + CACHED], 0)
    return z


def with_bias(weights: np.ndarray) -> np.ndarray:
    """The features' rows, each with the bias added."""
    return weights[:-1] + weights[-1]


def _gradient(weights, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums over the learning positions of class indicator minus probability, for each weight row."""
        fresh_worker()
        w = weights.value
        rows, classes, biased = len(w) - 1, w.shape[1], with_bias(w)
        total = np.zeros((classes, rows + 1))
        for batch in batches:
            for r in batch.to_pylist():
                c = _Chunk(r)
                at = np.arange((r["chunk"] * 7 + offset) % STRIDE, len(c.seq), STRIDE)
                at = at[c.learn[at]]
                for k in range(0, len(at), SLICE):
                    part = at[k : k + SLICE]
                    features, kinds = c.features(part, rows), c.kinds[c.seq[part]]
                    each = np.empty((classes, len(part)), np.float32)  # a row a class: its sums by weight row are counts
                    for a in range(0, len(part), CACHED):
                        own, z = each[:, a : a + CACHED], class_scores(w, features[:, a : a + CACHED], biased)
                        own[:] = np.exp(z, out=z).T
                        own /= -own.sum(0)
                        own[kinds[a : a + CACHED], np.arange(len(z))] += 1
                    for own, x in zip(total[:-1], each):
                        x = x.astype(np.float64)
                        own[-1] += x.sum()
                        for f in features:
                            own[:-1] += np.bincount(f, x, rows)
        total[-1] = -total[:-1].sum(0)  # a position's differences add up to nothing
        # a task's sums travel in single precision
        yield from _blocks_of((total.T * STRIDE).astype(np.float32).astype(np.float64), _part())
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of consecutive rows of one (block, part)."""
    key, total = None, None
    for batch in batches:
        for b, p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            x = expand(data.as_py(), np.float64)
            if (b, p) != key:
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([squeeze(total)], pa.binary())], ["block", "part", "sums"])
                key, total = (b, p), x
            else:
                total = total + x
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([squeeze(total)], pa.binary())], ["block", "part", "sums"])


def _gathered(sums: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sums of all tasks, added in parts and then in all; ``shape`` numbers reach the driver."""
    for part in (F.col("part"), F.lit(0)):
        sums = sums.withColumn("part", part).repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(_add, _SUMS)
    out = np.zeros(shape)
    for r in sums.toArrow().to_pylist():
        x = expand(r["sums"], np.float64).reshape(-1, shape[1])
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x
    return out


def first_weights(observed: np.ndarray) -> np.ndarray:
    """Weights from the counts of (row, class) pairs, the last row of the classes: the bias is the log share of a class, a
    feature's weight SHARE of the log ratio of its counts to those that the bias expects, both with PRIOR counts of the bias."""
    classes = (observed[-1] + 1) / (observed[-1].sum() + observed.shape[1])
    rows = observed[:-1]
    expected = rows.sum(1, keepdims=True) * classes
    prior = PRIOR * classes + 0.5
    return np.vstack([SHARE * np.log((rows + prior) / (expected + prior)), np.log(classes)])


def step(weights: np.ndarray, gradient: np.ndarray, observed: np.ndarray) -> np.ndarray:
    """A gradient step scaled by the larger of what was observed and expected, at most 1 a weight."""
    scale = np.maximum(observed, observed - gradient) + PRIOR
    return weights + np.clip(RATE * gradient / scale, -1, 1)


class Model:
    """Weights of the classes, and for each class its tokens (n), words (v) and words seen once (once)."""

    def __init__(self, weights: np.ndarray, n: np.ndarray, v: np.ndarray, once: np.ndarray):
        self.weights, self.n, self.v, self.once = weights.astype(np.float32), n, v, once

    @property
    def plain(self) -> tuple:
        """All that scoring needs, as arrays."""
        single = np.arange(len(self.n)) <= HEAD
        unknown = np.where(single, 0.0, (self.once + 1) / (self.n + 2))
        unknown[(self.n == 0) & ~single] = 1.0
        return self.weights, self.n, unknown, int(self.n.sum()), int(self.v.sum())


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        weights, n, unknown, tokens, types = model.value
        biased = with_bias(weights)
        single = np.arange(len(n)) <= HEAD
        for batch in batches:
            for r in batch.to_pylist():
                c = _Chunk(r)
                k = c.kinds.astype(np.int64)
                base = np.log10((c.known + 1) / (tokens + types + 1))
                share = np.where(c.known > 0, c.known / np.maximum(n[k], 1) * (1 - unknown[k]), unknown[k])
                word = np.log10(np.where(single[k], 1.0, share))
                total = word[c.seq]
                for a in range(0, len(c.seq), SLICE):
                    at = np.arange(a, min(a + SLICE, len(c.seq)))
                    features, kinds = c.features(at, len(weights) - 1), k[c.seq[at]]
                    for b in range(0, len(at), CACHED):
                        z = class_scores(weights, features[:, b : b + CACHED], biased)
                        own = z[np.arange(len(z)), kinds[b : b + CACHED]].astype(np.float64)
                        total[a + b : a + b + len(z)] += (own - np.log(np.exp(z, out=z).sum(1, dtype=np.float64))) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.docs, pa.int64()), pa.array(c.sizes), *(pa.array(np.add.reduceat(x, c.first)) for x in ((c.known > 0).astype(np.int64)[c.seq], base[c.seq], total))],
                    [f.split()[0] for f in RESULT.split(", ")])
    return run


def prepare(docs: DataFrame, learn: Column, folder: str) -> tuple[DataFrame, DataFrame]:
    """The chunks with each word's count in the learning texts and class, and (kind, n, v, once) of the classes."""
    spark = docs.sparkSession
    small_batches(docs)
    flat = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn, F.lit(True)).alias("learn"))
    flat.mapInArrow(_encode, _CHUNKS).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    words, n = dealt(chunks)
    words.groupBy("range").applyInArrow(_totals, _TOTALS).write.parquet(f"{folder}/totals")
    distinct = spark.read.parquet(f"{folder}/totals").where("chunk = -1")
    # HEAD words reach the driver
    top = distinct.mapInArrow(_most_frequent, "word string, c long").where("word <> ''").orderBy(F.col("c").desc(), "word").limit(HEAD).collect()
    head = word_hashes(pa.array([r.word for r in top], pa.string()), WordHasher())
    stats = (distinct.mapInArrow(_class_sums(head), "kind int, n long, v long, once long")
             .groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n", "v", "once"))))
    back = spark.read.parquet(f"{folder}/totals").where("chunk >= 0").select("chunk", "range", "values")
    (spark.read.parquet(f"{folder}/chunks").select("chunk", "docs", "learn", "sizes", "seq", "hashes", "tails").groupBy("chunk").cogroup(back.groupBy("chunk"))
     .applyInArrow(_with_counts(n, head), _READY).write.parquet(f"{folder}/ready"))
    return spark.read.parquet(f"{folder}/ready"), stats


def fit(ready: DataFrame, stats: DataFrame, rows: int = ROWS, rounds: int = ROUNDS) -> Model:
    """Learns from the chunks' learning texts."""
    classes = 1 + HEAD + TAIL
    n, v, once = np.zeros((3, classes), np.int64)
    for r in stats.collect():
        n[r.kind], v[r.kind], once[r.kind] = r.n, r.v, r.once
    shape = (rows + 1, classes)
    observed = _gathered(ready.mapInArrow(_observed(rows, classes), _SUMS), shape)
    weights = first_weights(observed)
    for k in range(rounds):
        sent = ready.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # rows x classes numbers
        weights = step(weights, _gathered(ready.mapInArrow(_gradient(sent, 5 * k), _SUMS), shape), observed)
        sent.destroy()
    return Model(weights, n, v, once)


def score_texts(docs: DataFrame, learn: Column, folder: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; ``learn``: which rows the model learns from."""
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/lm-{uuid4().hex}"
    ready, stats = prepare(docs, learn, folder)
    model = fit(ready, stats)
    found = ready.mapInArrow(_score(spark.sparkContext.broadcast(model.plain)), RESULT)
    return found.withColumn("train_tokens", F.lit(int(model.n.sum())).cast("long")).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
