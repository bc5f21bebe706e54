"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

1. Corpus statistics: document frequencies of all words of all documents.
   A word's idf is ``1 + ln(N / df)`` with df held at or above ``N *
   IDF_FLOOR``, so that words rarer than that weigh alike. At most (mean
   distinct words per document) / IDF_FLOOR words can stand above the floor,
   whatever the corpus size: only those are broadcast.
2. A shingle is five consecutive words (a text of one to four words is one
   shingle). Its weight is its term frequency in the document times the mean
   idf of its words, in steps of IDF_STEP. The idf is taken from the words,
   because the df of a shingle mostly counts the copies of its own document,
   which would hide just the large groups of copies.
3. Signature: SAMPLES consistent weighted samples. For a shingle of weight S
   and sample i with r, c ~ Gamma(2, 1) and beta ~ U(0, 1), t = floor(ln S / r
   + beta) and ln a = ln c - r (t + 1 - beta); the sample is the (shingle, t)
   of least a. Two documents share a sample with the probability of their
   weighted Jaccard similarity. The random triples stand in a table that a hash
   of shingle and sample number indexes; equal a are ordered by shingle hash.
4. Bands of ROWS samples are hashed; texts with equal word sequences are
   collapsed to their smallest doc_id first, so a group of copies of any size
   is one row from there on. In every bucket the smallest document is compared
   with all others. Buckets whose members are then not all connected have the
   remaining pairs compared as signatures, in blocks of at most about BLOCK / 2
   members and BLOCK_BYTES of vectors a side, and the likely ones (LIKELY) verified there, the likeliest
   first, so that only links leave a block. A pair already connected through
   others needs no comparison, as classes are what is returned.
5. Every candidate pair is verified on the full weight vectors: it links if
   sum(min) / sum(max) >= THRESHOLD. Classes are the connected components. The
   vectors of documents in shared buckets are made once and stored; they hold
   32 bits of each shingle's hash (for two texts of n shingles, one false match
   in n * n / 2**32 cases, which moves the similarity by about 1 / n).

Defined cases: null and empty texts, and texts of separators only, link with
nothing; rows with a null doc_id get a null class and are kept; rows that
share a doc_id are one document (any of its texts may link it); extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, release
from .text import U, WordHasher, expanded, fresh_worker, inside, mix, ngrams, opened, random_odd, shipped, shrink, small_batches, word_slices

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 6
SAMPLES = BANDS * ROWS
IDF_FLOOR = 0.001
IDF_STEP = 0.5
BLOCK = 1024
BLOCK_BYTES = 4 << 20
LIKELY = 0.64  # share of equal samples that a similarity of 0.8 falls short of with odds of about 1e-5
_TABLE_BITS = 15
_COMPACT = 1 << 21


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies (word, n) of the texts of one task, combined before they leave it."""
    fresh_worker()
    hasher, held, size = WordHasher(), [], 0

    def combined():
        h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        order = np.argsort(h)
        h, n = h[order], n[order]
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[at], np.add.reduceat(n, at)

    def out(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for i, j, words, counts in word_slices(batch.column(0), hasher):
            if not len(words):
                continue
            doc = np.repeat(np.arange(j - i, dtype=np.int32), counts)
            order = np.argsort(words, kind="stable")
            h, d = words[order], doc[order]
            new = np.r_[True, h[1:] != h[:-1]]
            one = new | np.r_[True, d[1:] != d[:-1]]
            at = np.flatnonzero(new)
            held.append((h[at], np.add.reduceat(one.astype(np.int64), at)))
            size += len(at)
            if size > _COMPACT:
                held = [combined()]
                size = len(held[0][0])
                if size > _COMPACT // 2:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*combined())


class Idf:
    """idf of words from the sorted hashes of the words above the floor."""

    def __init__(self, words: np.ndarray, df: np.ndarray, documents: int):
        order = np.argsort(words)
        self.words = np.r_[words[order], U(2**64 - 1)]
        self.rare = np.float32(1 - np.log(IDF_FLOOR))
        self.idf = np.r_[(1 + np.log(max(documents, 1) / df[order])).astype(np.float32), self.rare]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, h)
        return np.where(self.words[at] == h, self.idf[at], self.rare)


def fit_idf(docs: DataFrame, documents: int) -> Idf:
    """The words in at least IDF_FLOOR of the documents (a number bounded by the mean document, not by the corpus)."""
    df = (docs.select("text").mapInArrow(word_counts, "word long, n long")
          .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= IDF_FLOOR * documents)
          .toArrow())
    return Idf(df.column("word").to_numpy().view(U), df.column("n").to_numpy().astype(np.float64), documents)


def weighted_shingles(words: np.ndarray, counts: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, tf, idf step) of the distinct shingles, by text and shingle."""
    w, n = idf(words).astype(np.float64), len(words)
    size = max(0, n - SHINGLE + 1)
    full = inside(counts, SHINGLE, size)
    h = ngrams(words, SHINGLE, 1)[full]
    mean = sum((w[k : k + size] for k in range(SHINGLE)), np.zeros(size))[full] / SHINGLE
    text = np.repeat(np.arange(len(counts)), counts)[:size][full]
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        odd, extra = random_odd(SHINGLE, 2), []
        for s in short:
            x = words[ends[s] - counts[s] : ends[s]]
            extra.append((s, mix((x * odd[: len(x)]).sum(keepdims=True, dtype=U))[0], w[ends[s] - counts[s] : ends[s]].mean()))
        text = np.r_[text, [x[0] for x in extra]]
        h = np.r_[h, np.array([x[1] for x in extra], dtype=U)]
        mean = np.r_[mean, [x[2] for x in extra]]
    order = np.lexsort((h, text))
    h, mean, text = h[order], mean[order], text[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, int)
    tf = np.diff(np.r_[new, len(h)])
    step = np.maximum(1, np.rint(mean[new] / IDF_STEP)).astype(np.int64)
    return text[new], h[new], tf, step


class Sampler:
    """Consistent weighted samples of shingle sets."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(7))
        size = 1 << _TABLE_BITS
        u = 1 - rng.random((5, size))
        self.r, self.log_c, self.beta = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
        self.odd, self.salt = random_odd(SAMPLES, 8), random_odd(SAMPLES, 9)
        self.steps = int(np.ceil((1 - np.log(IDF_FLOOR)) / IDF_STEP)) + 1
        self.of_step = np.concatenate([self.keys(np.log(max(s, 1) * IDF_STEP), np.arange(size)) for s in range(self.steps)])

    def keys(self, log_weight, at: np.ndarray) -> np.ndarray:
        """ln a in the high 32 bits, in the order of the floats."""
        r, beta = self.r[at], self.beta[at]
        a = (self.log_c[at] - r * (np.floor(log_weight / r + beta) + 1 - beta)).astype(np.float32).view(np.uint32)
        return np.where(a >> 31, ~a, a | np.uint32(1 << 31)).astype(U) << U(32)

    def __call__(self, starts: np.ndarray, h: np.ndarray, tf: np.ndarray, step: np.ndarray) -> np.ndarray:
        """One row of SAMPLES values for each run of shingles that begins at ``starts``."""
        out = np.empty((len(starts), SAMPLES), dtype=U)
        low = h & U(0xFFFFFFFF)
        base = (step.clip(0, self.steps - 1) << _TABLE_BITS).astype(np.int64)
        odd = np.flatnonzero((tf > 1) | (step >= self.steps))
        log_weight = np.log(tf[odd] * step[odd] * IDF_STEP)
        for i in range(SAMPLES):
            at = (((h ^ self.salt[i]) * self.odd[i]) >> U(64 - _TABLE_BITS)).view(np.int64)
            key = self.of_step.take(at + base)
            if len(odd):
                key[odd] = self.keys(log_weight, at[odd])
            key |= low
            out[:, i] = np.minimum.reduceat(key, starts)
        return out


def _text_digests(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of the word sequence of each text."""
    ends = np.cumsum(counts)
    at = np.arange(len(words)) - np.repeat(ends - counts, counts)
    out = np.zeros((2, len(counts)), dtype=U)
    some = counts > 0
    if some.any():
        for k, seed in enumerate((3, 4)):
            x = mix(words * random_odd(1, seed)[0] + at.astype(U) * random_odd(1, seed + 20)[0])
            out[k, some] = np.add.reduceat(x, (ends - counts)[some])
    return out


def signer(idf) -> object:
    """mapInArrow function: (doc_id, words, d1, d2, samples, bands) of every document; samples and bands are null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        hasher, sampler, table = WordHasher(), Sampler(), opened(idf)
        for batch in batches:
            ids = batch.column(0)
            for i, j, words, counts in word_slices(batch.column(1), hasher, 1 << 17):
                d = _text_digests(words, counts)
                text, h, tf, step = weighted_shingles(words, counts, table)
                at = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, int)
                samples = [None] * (j - i)
                bands = [None] * (j - i)
                if len(at):
                    s = mix(sampler(at, h, tf, step))
                    b = np.stack([mix((s[:, k * ROWS : (k + 1) * ROWS] * random_odd(ROWS, 100 + k)).sum(axis=1, dtype=U)) for k in range(BANDS)], axis=1).view(np.int64)
                    s = s.astype(np.uint32)
                    for k, t in enumerate(text[at]):
                        samples[t], bands[t] = s[k].tobytes(), b[k]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(counts, pa.int64()), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)),
                     pa.array(samples, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "words", "d1", "d2", "samples", "bands"])
    return run


def vectors(idf) -> object:
    """mapInArrow function over compressed texts: (doc_id, shingles, weights), packed and sorted; weights in as few bytes as they need."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        hasher, table = WordHasher(), opened(idf)
        for batch in batches:
            texts, ids = expanded(batch.column(0)), batch.column(1)
            for i, j, words, counts in word_slices(texts, hasher):
                text, h, tf, step = weighted_shingles(words, counts, table)
                h, w = (h >> U(32)).astype(np.uint32), (tf * step).astype(np.uint32)
                cut = np.searchsorted(text, np.arange(j - i + 1))
                widths = [np.uint8 if a == b or w[a:b].max() < 256 else np.uint32 for a, b in zip(cut, cut[1:])]
                order = np.lexsort((h, text))
                h, w = h[order], w[order]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([w[a:b].astype(t).tobytes() for a, b, t in zip(cut, cut[1:], widths)], pa.binary())], ["doc_id", "shingles", "weights"])
    return run


def unpacked(shingles: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(shingles, np.uint32)
    return h, np.frombuffer(weights, np.uint8 if len(weights) == len(h) else np.uint32).astype(np.float64)


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """sum(min) / sum(max) of two sparse vectors with sorted keys."""
    if not len(h1) or not len(h2):
        return 0.0
    at = np.searchsorted(h1, h2).clip(0, len(h1) - 1)
    both = h1[at] == h2
    shared = float(np.minimum(w1[at[both]], w2[both]).sum())
    return shared / (float(w1.sum()) + float(w2.sum()) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, h1, w1, h2, w2 = (batch.column(k) for k in range(6))
        keep = [k for k in range(len(a)) if weighted_jaccard(*unpacked(h1[k].as_buffer(), w1[k].as_buffer()), *unpacked(h2[k].as_buffer(), w2[k].as_buffer())) >= THRESHOLD]
        yield pa.RecordBatch.from_arrays([x.take(pa.array(keep, pa.int64())) for x in (a, b)], ["a", "b"])


def verified(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose weighted Jaccard similarity is at least THRESHOLD."""
    one = pairs.select("a", "b").distinct().join(vecs.toDF("b", "h2", "w2"), "b")
    return (one.join(vecs.toDF("a", "h1", "w1"), "a").select("a", "b", "h1", "w1", "h2", "w2")
            .mapInArrow(_verify, "a long, b long").distinct())


def _link_block(part: pd.DataFrame) -> pd.DataFrame:
    """Links between different components in one pair of blocks of one bucket, enough to connect what is connected there.

    Likely pairs are verified from the likeliest on; a pair whose components an
    earlier link has joined is skipped, as is a pair that meets in an earlier band.
    """
    s = np.stack([np.frombuffer(x, np.uint32) for x in part["samples"]])
    ids, comp, side, band = part["rep"].to_numpy(), part["component"].to_numpy().copy(), part["side"].to_numpy(), part["band"].iloc[0]
    vec = [unpacked(h, w) for h, w in zip(part["shingles"], part["weights"])]
    i, j = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.arange(len(part)),) * 2
    found = []
    for x in i:
        y = j[comp[j] != comp[x]] if i is not j else j[(comp[j] != comp[x]) & (j > x)]
        same = s[y] == s[x]
        n = same.sum(axis=1)
        likely = n >= LIKELY * SAMPLES
        y, n = y[likely], n[likely]
        met = same[likely].reshape(-1, BANDS, ROWS).all(axis=2)
        here = met[:, band] & (met.argmax(axis=1) == band)
        found += zip((-n[here]).tolist(), [int(x)] * int(here.sum()), y[here].tolist())
    a, b = [], []
    for _, x, y in sorted(found):
        if comp[x] != comp[y] and weighted_jaccard(*vec[x], *vec[y]) >= THRESHOLD:
            comp[comp == comp[y]] = comp[x]
            a.append(min(ids[x], ids[y]))
            b.append(max(ids[x], ids[y]))
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def remaining_links(members: DataFrame, labels: DataFrame, signed: DataFrame) -> DataFrame:
    """Verified links (a, b) within buckets whose members are not all connected yet.

    members: (value, band, rep) of buckets with several texts; signed: rep with
    its samples, shingles and weights. A bucket is cut by hash into blocks of at
    most about BLOCK / 2 members and BLOCK_BYTES of vectors, and each pair of
    blocks is one group, so a bucket of any size is spread over tasks.
    """
    m = members.join(labels.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    m = m.join(signed.select("rep", (F.length("shingles") + F.length("weights")).alias("bytes")), "rep")
    size = (m.groupBy("value").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo < hi and n > 2")
            .select("value", F.greatest(F.ceil(F.col("n") * 2 / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")))
    m = (m.join(size, "value").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
         .select("value", "band", "rep", "component", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                 (F.col("block") > F.col("other")).cast("int").alias("side")))
    return m.join(signed, "rep").groupBy("value", "lo", "hi").applyInPandas(_link_block, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, kept) of every row: class_id is the smallest doc_id of its class, kept marks that document."""
    small_batches(docs)
    spark = docs.sparkSession
    release(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    idf = shipped(spark, fit_idf(docs, docs.count()))
    signed = docs.select("doc_id", "text").mapInArrow(signer(idf), "doc_id long, words long, d1 long, d2 long, samples binary, bands array<long>").checkpoint()
    some = signed.where("words > 0 and doc_id is not null")
    reps = some.groupBy("d1", "d2").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"))
    banded = reps.select("rep", F.posexplode("bands").alias("band", "value")).distinct()
    buckets = banded.groupBy("value").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = banded.join(buckets, "value").select("value", "band", "hub", "rep").checkpoint()
    release(spark)
    ids = members.select(F.col("rep").alias("doc_id")).distinct()
    vecs = (docs.mapInArrow(shrink, "z binary, doc_id long").join(ids, "doc_id", "left_semi").select("z", "doc_id")
            .mapInArrow(vectors(idf), "doc_id long, shingles binary, weights binary").checkpoint())
    links = verified(members.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")), vecs).checkpoint()
    release(spark)
    full = some.select("doc_id", "samples").join(vecs, "doc_id").withColumnRenamed("doc_id", "rep")
    links = links.union(remaining_links(members.select("value", "band", "rep"), components(links), full))
    same_text = some.join(reps.select("d1", "d2", "rep"), ["d1", "d2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels = components(links.union(same_text))
    return (signed.select("doc_id").join(labels.toDF("doc_id", "class_id"), "doc_id", "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))))
