"""Approximate nearest neighbours along shifted space-filling curves.

CURVES times, all vectors are projected to DIMS random orthogonal directions,
scaled by the projections' spread, shifted at random and put in the order of a
Hilbert curve of BITS bits a direction. Each order is range-partitioned into
cells at the quantiles of its keys. A query takes its own cell and the two next
to it on every curve; candidates of all curves merge and are reranked by exact
inner products in doubles.

Windows are near in direction, inner products also follow the norms. So the
vectors of one length are searched by shells, each holding the norms within a
factor of the square root of two of its largest (all vectors, if their norms are
alike), with curves and cells of its own; a query visits every shell.

CELLS is the number of cells of a curve, so a window is a fixed share of a shell
and recall does not fall as the table grows, but work grows with queries times
rows; a shell of fewer than CELLS * LEAST rows has fewer cells, down to one
(which is exact). A key that many vectors share is one cell's, not several's.

A cell is dealt by hash into blocks of at most about BLOCK rows and its queries
into blocks of QUERY_BLOCK, and a task compares one block with one: a cell
that one repeated vector fills is spread like any other.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, nor do rows with a null vec_id; vectors are compared
with those of the same length; rows that repeat a vec_id count as one candidate
(with the larger score) and are never their own neighbour; equal scores go to
the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import U
from .vectors import matrix, packed

CURVES = 24
DIMS, BITS = 8, 3
CELLS = 60
LEAST = 64
SHELLS = 64
BLOCK = 8192
QUERY_BLOCK = 1024
K = 20
SLACK = 1e-9  # above the rounding of an inner product


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys of integer points (rows) on the Hilbert curve of their number of dimensions."""
    x = points.astype(U).T.copy()
    q = U(1) << U(bits - 1)
    while q > 1:
        low = q - U(1)
        for i in range(len(x)):
            high = (x[i] & q) > 0
            swap = np.where(high, U(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= U(1)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), U(1) << U(bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - U(1), U(0))
        q >>= U(1)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << U(1)) | ((row >> U(b)) & U(1))
    return key


def directions(dim: int) -> np.ndarray:
    """(dim x CURVES x directions), orthonormal within a curve."""
    rng = np.random.Generator(np.random.PCG64(dim))
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : min(DIMS, dim)] for _ in range(CURVES)], axis=1)


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, largest squared norm)."""
    most: dict[int, float] = {}
    for dim, _, x in _by_length(batches):
        most[dim] = max(most.get(dim, 0.0), float((x * x).sum(axis=1).max()))
    yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.float64())], ["dim", "most"])


def _shells(most: dict[int, float], dim: int, x: np.ndarray) -> np.ndarray:
    """The shell of each vector, as one number with its length."""
    ratio = most[dim] / np.maximum((x * x).sum(axis=1), 1e-300)
    return dim * SHELLS + np.floor(np.log2(np.maximum(ratio, 1))).clip(0, SHELLS - 1).astype(np.int64)


def _moments(most: dict[int, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers, sums and sums of squares of the projections, and sums of squared norms, by shell."""
    held: dict[int, list] = {}
    for dim, _, x in _by_length(batches):
        of = _shells(most, dim, x)
        for shell in np.unique(of).tolist():
            own = x[of == shell]
            y = np.tensordot(own, directions(dim), 1)
            m = held.setdefault(shell, [0, 0.0, 0.0, 0.0])
            held[shell] = [m[0] + len(y), m[1] + y.sum(axis=0), m[2] + (y * y).sum(axis=0), m[3] + float((own * own).sum())]
    for shell, (n, s, q, w) in held.items():
        k = s.size
        yield pa.RecordBatch.from_arrays([pa.array([shell] * k), pa.array(np.arange(k)), pa.array([n] * k), pa.array(s.ravel()), pa.array(q.ravel()), pa.array([w] * k)], ["shell", "k", "n", "s", "q", "w"])


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        dims = np.array([len(v) // 8 for v in batch.column("vector").to_pylist()])
        for d in np.unique(dims):
            rows = batch.take(pa.array(np.flatnonzero(dims == d)))
            yield int(d), rows, matrix(rows.column("vector"))


def _keys(most: dict[int, float], scale: dict[int, tuple[np.ndarray, np.ndarray, float]], queries: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, shell, curve, key), one row a curve: of a vector in its own shell, of a query in all shells of its length."""
    for dim, rows, x in _by_length(batches):
        of = None if queries else _shells(most, dim, x)
        shift = np.random.Generator(np.random.PCG64(dim + 1)).random((CURVES, min(DIMS, dim))) * 0.5
        for shell in [s for s in scale if s // SHELLS == dim]:
            at = np.arange(len(x)) if queries else np.flatnonzero(of == shell)
            if not len(at):
                continue
            mean, spread, norm = scale[shell]
            own = x[at]
            if queries:  # as long as the shell's vectors: only its direction counts
                own = own * (norm / np.sqrt((own * own).sum(axis=1, keepdims=True)))
            y = (np.tensordot(own, directions(dim), 1) - mean) / spread
            u = 0.5 / (1 + np.exp(-1.702 * y.clip(-50, 50)))  # about the normal distribution function, halved
            grid = ((u + shift) * (1 << BITS)).clip(0, (1 << BITS) - 1)
            ids = rows.column("vec_id").take(pa.array(at))
            for c in range(u.shape[1]):
                key = hilbert(grid[:, c], BITS).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array([shell] * len(at)), pa.array([c] * len(at)), pa.array(key)], ["vec_id", "shell", "curve", "key"])


def _top(k: int):
    def run(table: pa.Table) -> pa.Table:
        """Each query's k nearest of the block's candidates, as lists."""
        ids, role = table.column("vec_id").to_numpy(), table.column("query").to_numpy(zero_copy_only=False)
        x = matrix(table.column("vector"))
        qs, cs = np.flatnonzero(role), np.flatnonzero(~role)
        out_id, out_score = [], []
        for at in range(0, len(qs), 64):
            rough = x[qs[at : at + 64]] @ x[cs].T
            rough[ids[qs[at : at + 64]][:, None] == ids[cs][None, :]] = -np.inf
            for r, q in zip(rough, qs[at : at + 64]):
                n = min(k, len(cs))
                near = np.flatnonzero((r >= np.partition(r, len(r) - n)[len(r) - n] - SLACK) & (r > -np.inf)) if n else cs[:0]
                score = (x[cs[near]] * x[q]).sum(axis=1)
                best = np.lexsort((ids[cs[near]], -score))[:k]
                out_id.append(ids[cs[near[best]]])
                out_score.append(score[best])
        return pa.table({"query_id": pa.array(ids[qs], pa.int64()), "ids": pa.array(out_id, pa.list_(pa.int64())), "scores": pa.array(out_score, pa.list_(pa.float64()))})
    return run


def _merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        query = table.column("query_id")[0].as_py()
        ids, score = (np.concatenate([np.array(v) for v in table.column(c).to_pylist()] or [np.zeros(0)]) for c in ("ids", "scores"))
        order = np.lexsort((ids, -score))
        _, first = np.unique(ids[order], return_index=True)
        best = order[np.sort(first)][:k]
        n = len(best)
        return pa.table({"query_id": pa.array([query] * n, pa.int64()), "rank": pa.array(np.arange(1, n + 1), pa.int32()), "vec_id": pa.array(ids[best], pa.int64()), "score": pa.array(score[best], pa.float64())})
    return run


def nearest(embeddings: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` (over vec_id) holds for."""
    rows = packed(embeddings).where("vector is not null and vec_id is not null").distinct().checkpoint()
    most = {r.dim: r.most for r in rows.mapInArrow(_norms, "dim long, most double").groupBy("dim").agg(F.max("most").alias("most")).collect()}  # a row a length
    moments = rows.mapInArrow(partial(_moments, most), "shell long, k long, n long, s double, q double, w double").groupBy("shell", "k").agg(*(F.sum(c).alias(c) for c in "nsqw")).toPandas()
    scale, cells = {}, {}
    for shell, m in moments.sort_values("k").groupby("shell"):
        mean = m["s"] / m["n"]
        spread = np.sqrt(np.maximum(m["q"] / m["n"] - mean * mean, 1e-24))
        scale[int(shell)] = (mean.to_numpy().reshape(CURVES, -1), spread.to_numpy().reshape(CURVES, -1), float(np.sqrt(m["w"].iloc[0] / m["n"].iloc[0])))
        cells[int(shell)] = max(1, min(CELLS, int(m["n"].iloc[0]) // LEAST))
    kind = "vec_id long, shell long, curve long, key long"
    keys = rows.mapInArrow(partial(_keys, most, scale, False), kind).distinct().checkpoint()
    cut: dict[tuple[int, int], np.ndarray] = {}
    for n in {c for c in cells.values() if c > 1}:
        own = keys.where(F.col("shell").isin([s for s, c in cells.items() if c == n]))
        for r in own.groupBy("shell", "curve").agg(F.percentile_approx("key", [c / n for c in range(1, n)], 100 * n).alias("cuts")).collect():
            cut[r.shell, r.curve] = np.unique(np.array(r.cuts, np.int64))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shell, curve, key = (batch.column(c).to_numpy() for c in (1, 2, 3))
            cell = np.zeros(len(key), np.int64)
            for d, c in {*zip(shell.tolist(), curve.tolist())} & cut.keys():
                at = (shell == d) & (curve == c)
                cell[at] = np.searchsorted(cut[d, c], key[at], "left")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell)], ["vec_id", "shell", "curve", "cell"])
    in_cell = keys.mapInArrow(placed, "vec_id long, shell long, curve long, cell long").checkpoint()
    asked = rows.where(is_query).mapInArrow(partial(_keys, most, scale, True), kind).mapInArrow(placed, "vec_id long, shell long, curve long, cell long").distinct()
    queries = asked.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))).checkpoint()
    at = ["shell", "curve", "cell"]
    sizes = (in_cell.groupBy(at).agg(F.count("*").alias("c")).join(queries.groupBy(at).agg(F.count("*").alias("q")), at)
             .select(*at, F.ceil(F.col("c") / BLOCK).cast("int").alias("cb"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qb")))
    mine = F.pmod(F.xxhash64("vec_id"), F.when(F.col("query"), F.col("qb")).otherwise(F.col("cb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("cb")).otherwise(F.col("qb")) - 1))
    dealt = (in_cell.withColumn("query", F.lit(False)).unionByName(queries.withColumn("query", F.lit(True))).join(sizes, at)
             .withColumn("mine", mine).withColumn("other", other)
             .select("vec_id", "query", *at, F.when(F.col("query"), F.col("other")).otherwise(F.col("mine")).alias("cblock"),
                     F.when(F.col("query"), F.col("mine")).otherwise(F.col("other")).alias("qblock")))
    with_vector = dealt.join(rows.withColumnRenamed("vec_id", "id"), (F.col("vec_id") == F.col("id")) & (F.length("vector") == F.floor(F.col("shell") / SHELLS) * 8)).drop("id")
    return (with_vector.groupBy(*at, "cblock", "qblock").applyInArrow(_top(k), "query_id long, ids array<long>, scores array<double>")
            .groupBy("query_id").applyInArrow(_merge(k), "query_id long, rank int, vec_id long, score double"))
