"""Embedding near-duplicates by cross-polytope hashing.

A hash turns a vector by three rounds of random signs and fast Hadamard
transforms and takes the axis it then lies nearest to, with its sign (2 d'
values for d' the next power of two). A code is HASHES(n) such hashes, so that
about TARGET of n random vectors share a bucket; TABLES codes are drawn.
Multiprobe: a vector is also filed under codes in which one hash takes one of
its PROBES - 1 next nearest axes, so that pairs on a cell border still meet.

Equal vectors are one row with a multiplicity from the start. A bucket of
more than BLOCK vectors is cut into blocks by hash, and each pair of blocks is
one group, so no task gets a whole large bucket. Within a group cosines are
exact, in doubles. A pair that meets in several buckets counts in the first one
only, which both rows can tell from their codes; so links are counted without
ever being written out. Out of a group come, for each vector, its number of
links there and the smallest member of its cluster there.

Defined cases: vectors that are null, zero or hold null or non-finite
components have no links and are components of their own, as are rows with a
null vec_id; rows that repeat a vec_id are vectors of their own that are counted
one by one and reached by that id; vectors of different lengths never link; an
empty table gives an empty result; labels and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .vectors import matrix, packed

THRESHOLD = 0.9
TABLES = 8  # for one hash a code; each further hash doubles them
PROBES = 3
TARGET = 1024
BLOCK = 1024


def hashes(n: int, dim: int) -> int:
    """Hashes a code for n vectors."""
    cells = 2 * (1 << max(1, dim - 1).bit_length())
    return max(1, int(np.ceil(np.log(max(n, 1) / TARGET) / np.log(cells))))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[-1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, per_code: int) -> np.ndarray:
    """(vectors x tables x filings): a vector's own code, then its probes."""
    n, dim = x.shape
    size = 1 << max(1, dim - 1).bit_length()
    rng = np.random.Generator(np.random.PCG64(size))
    tables = TABLES << (per_code - 1)
    out = np.empty((n, tables, 1 + (PROBES - 1) * per_code), np.int64)
    wide = np.zeros((n, size))
    wide[:, :dim] = x
    for t in range(tables):
        near = []
        for _ in range(per_code):
            y = wide
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], size))
            a = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : min(PROBES, size)]
            near.append(2 * a + (np.take_along_axis(y, a, axis=1) > 0))
        place = (2 * size) ** np.arange(per_code)
        own = sum(p * m[:, 0] for p, m in zip(place, near))
        out[:, t, 0] = own
        for k in range(per_code):
            for q in range(1, PROBES):
                out[:, t, 1 + k * (PROBES - 1) + q - 1] = own + place[k] * (near[k][:, min(q, size - 1)] - near[k][:, 0])
    return out


def _file(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, dim, t, code) of distinct vectors: one row for each filing."""
    for batch in batches:
        dims = np.array([len(v) // 8 for v in batch.column(1).to_pylist()])
        for d in np.unique(dims):
            at = pa.array(np.flatnonzero(dims == d))
            c = codes(matrix(batch.column(1).take(at)), hashes(n, int(d)))
            rep = np.repeat(batch.column(0).take(at).to_numpy(), c.shape[1] * c.shape[2])
            t = np.tile(np.repeat(np.arange(c.shape[1]), c.shape[2]), len(at))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.full(len(rep), d)), pa.array(t), pa.array(c.ravel())], ["rep", "dim", "t", "code"])


def _compare(n: int):
    def run(table: pa.Table) -> pa.Table:
        """(rep, links, low) of one pair of blocks of one bucket."""
        t, code = table.column("t")[0].as_py(), table.column("code")[0].as_py()
        rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
        side = table.column("side").to_numpy()
        x = matrix(table.column("vector"))
        per_code = hashes(n, x.shape[1])
        norm = np.sqrt((x * x).sum(axis=1))
        i = np.flatnonzero(side == 0)
        j = np.flatnonzero(side == 1) if (side == 1).any() else i
        links, edges, c, at_c = np.zeros(len(rep), np.int64), [], None, np.full(len(rep), -1)
        for at in range(0, len(i), 128):
            rows = i[at : at + 128]
            a, b = np.nonzero((x[rows] @ x[j].T) / (norm[rows][:, None] * norm[j]) >= THRESHOLD)
            a, b = rows[a], j[b]
            keep = a < b if j is i else np.ones(len(a), bool)
            a, b = a[keep], b[keep]
            some = np.unique(np.r_[a, b])
            new = some[at_c[some] < 0]  # codes again, only of rows that have links
            if len(new):
                own = codes(x[new], per_code)
                at_c[new] = np.arange(len(new)) + (0 if c is None else len(c))
                c = own if c is None else np.concatenate([c, own])
            first = np.ones(len(a), bool)
            for s in range(t + 1) if len(a) else ():  # no earlier bucket holds both
                for p in range(c.shape[2]):
                    here = c[at_c[a], s, p]
                    both = (here[:, None] == c[at_c[b], s]).any(axis=1)
                    first &= ~(both & ((s < t) | (here < code)))
            edges.append((a, b))
            a, b = a[first], b[first]
            np.add.at(links, a, size[b])
            np.add.at(links, b, size[a])
        a, b = (np.concatenate(e) for e in zip(*edges))
        low = rep.copy()
        while True:
            m = np.minimum(low[a], low[b])
            new = low.copy()
            np.minimum.at(new, a, m)
            np.minimum.at(new, b, m)
            if (new == low).all():
                break
            low = new
        some = np.flatnonzero((links > 0) | (low != rep))
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "low": pa.array(low[some], pa.int64())})
    return run


def near_duplicate_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = packed(embeddings).checkpoint()
    usable = rows.where("vector is not null and vec_id is not null")
    distinct = usable.groupBy("vector").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("size"))
    distinct = distinct.withColumn("rep", F.monotonically_increasing_id()).checkpoint()
    n = distinct.count()
    filed = (distinct.select("rep", "vector").mapInArrow(partial(_file, n), "rep long, dim long, t long, code long").distinct())
    full = filed.groupBy("dim", "t", "code").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = (filed.join(full, ["dim", "t", "code"]).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("rep", "dim", "t", "code", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side")))
    found = (dealt.join(distinct.select("rep", "vector", "size"), "rep").groupBy("dim", "t", "code", "lo", "hi")
             .applyInArrow(_compare(n), "rep long, links long, low long").checkpoint())
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = distinct.join(links, "rep", "left").select("vector", "rep", "low_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    cluster = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    classes = classes.join(cluster.toDF("rep", "cluster"), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep")).checkpoint()
    # rows that repeat a vec_id join the clusters of their vectors
    ids = usable.join(classes.select("vector", "cluster"), "vector").select("vec_id", "cluster").distinct()
    low = ids.groupBy("cluster").agg(F.min("vec_id").alias("low"))
    near = components(ids.join(low, "cluster").select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    return (rows.join(classes.select("vector", "n_links"), "vector", "left").join(near.toDF("vec_id", "component_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.coalesce("component_id", "vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
