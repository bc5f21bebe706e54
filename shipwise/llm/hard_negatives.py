"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

A row's vector is quantised to integers (floor of SCALE times each component);
scores are integer inner products with an anchor. Higher scores come first,
ties go to the smaller vec_id.

1. All rows are range-partitioned by (label, length, place on a Hilbert curve,
   vec_id) and cut into blocks, which are written as Parquet: one row a block
   with the packed vectors, and the smallest and largest label and component
   of each dimension (its zone map) in columns of their own.
2. Each anchor's windows are intervals of scores: for positives from the
   fifth best score that its own block shows upwards, for negatives ``low`` to
   ``high`` per cent of each positive's score.
3. Anchors are packed into groups. Interval arithmetic on the zone maps alone
   (the vectors are not read) bounds the scores of a block for every anchor; a
   group reads the blocks whose bounds meet a window of one of its anchors,
   and skips those that cannot beat what it has found so far.
4. What the tasks find meets in a limit per (anchor, window).

No step gathers an unbounded group: blocks, pages of zone maps, groups and the
blocks that a task joins with a group (its slot) are of fixed size; equal
vectors and rows of one label are spread over blocks by vec_id. The pruning is
exact: every row that may belong to the answer is read. How much it saves
depends on the vectors; on spread-out directions of many dimensions the zone
maps mostly save by label.

Defined cases: rows with a null vec_id, label, vector or any null or
non-finite component take no part; rows that repeat a vec_id count as one, the
smallest by (label, vector); vectors meet vectors of their own length (zero
vectors and empty ones have score 0); an anchor without other rows of its
label has no positives, a positive without rows in its window no negatives;
an empty table gives an empty result; other columns are ignored. Scores must
stay under 2**56 in size (OverflowError otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .ann import hilbert

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Directions and bits of the Hilbert curve.
DIRECTIONS, BITS = 8, 4
#: Rows of a block (fewer if its vectors would pass BLOCK_BYTES), blocks of a page of zone maps and of a slot, anchors of a group.
BLOCK, BLOCK_BYTES = 512, 1 << 18
PAGE, SLOT, GROUP = 256, 16, 256
LEAST, MOST = -(2**62), 2**62

_KEYED = "vec_id long, label long, anchor boolean, dim int, place long, vector binary"
_BLOCKS = ("block long, dim int, label_lo long, label_hi long, zone_lo binary, zone_hi binary, "
           "ids binary, labels binary, anchors binary, vectors binary")
_ANCHORS = "anchor_id long, label long, dim int, home long, vector binary, lo array<long>, hi array<long>"
_GROUPS = "group long, dim int, ids binary, labels binary, vectors binary, lo binary, hi binary"
_FOUND = "anchor_id long, window int, vec_id long, score long"


def _task() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId() << 32


def _one(ddl: str, row: tuple) -> pa.RecordBatch:
    """One row of a packed table."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[kind]) for v, (_, kind) in zip(row, columns)], [name for name, _ in columns])


def _narrow(x: np.ndarray) -> bytes:
    """Integers in the narrowest width that holds them; the length of the bytes tells it."""
    top = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64).tobytes()


def _wide(data: bytes, rows: int, dim: int) -> np.ndarray:
    width = len(data) // max(1, rows * dim)
    return np.frombuffer(data, {0: np.int64, 2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(rows, dim).astype(np.int64)


def _long(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _place(q: np.ndarray) -> np.ndarray:
    """Place of each row's direction on a Hilbert curve over a few random directions."""
    dim = q.shape[1]
    if not dim or not len(q):
        return np.zeros(len(q), np.int64)
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))[0][:, :DIRECTIONS]
    x = q.astype(np.float64)
    size = np.sqrt((x * x).sum(1))
    y = (x @ basis) * (np.sqrt(dim) / np.maximum(size, 1e-300))[:, None]
    share = 1 / (1 + np.exp(-1.7 * np.clip(y, -30, 30)))  # close to the normal distribution's
    cell = np.minimum((share * 2**BITS).astype(np.int64), 2**BITS - 1)
    return hilbert(cell, BITS).view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        sizes = np.asarray(lists.value_lengths())
        values = lists.flatten().to_numpy(zero_copy_only=False)
        scaled = np.floor(SCALE * values.astype(np.float64))
        if scaled.size and np.abs(scaled).max() >= 2.0**62:
            raise OverflowError("a component is too large to be scored in 64 bits")
        q, ends = scaled.astype(np.int64), np.cumsum(sizes)
        place = np.zeros(len(sizes), np.int64)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            place[at] = _place(q[(ends[at] - dim)[:, None] + np.arange(dim)])
        data = [q[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(place), pa.array(data, pa.binary())],
                                         ["vec_id", "label", "anchor", "dim", "place", "vector"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted rows of a task into blocks: at a new length, when full, or at a new label if a quarter full."""
    number, held = _task(), []

    def block():
        nonlocal number, held
        ids, labels, anchors = (np.array([r[k] for r in held], np.int64) for k in range(3))
        dim = held[0][3]
        q = np.frombuffer(b"".join(r[4] for r in held), np.int64).reshape(len(held), dim)
        row = (number, dim, int(labels.min()), int(labels.max()), q.min(0).tobytes(), q.max(0).tobytes(), ids.tobytes(), labels.tobytes(), anchors.astype(np.uint8).tobytes(), _narrow(q))
        number, held = number + 1, []
        return _one(_BLOCKS, row)
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5))):
            if held:
                full = min(BLOCK, max(16, BLOCK_BYTES // max(1, 2 * row[3])))
                if row[3] != held[0][3] or len(held) >= full or (row[1] != held[-1][1] and len(held) >= full // 4):
                    yield block()
            held.append(row)
    if held:
        yield block()


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = a.shape[1] * (int(np.abs(a).max()) if a.size else 0) * (int(np.abs(b).max()) if b.size else 0)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**56:
        return a @ b.T
    raise OverflowError("scores pass 2**56")


def _own_blocks(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The anchors of each block; lo: the k-th best score among its other rows of the label."""
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels = _long(r["ids"]), _long(r["labels"])
                at = np.flatnonzero(np.frombuffer(r["anchors"], np.uint8))
                if not len(at):
                    continue
                q = _wide(r["vectors"], len(ids), r["dim"])
                s = np.where((labels[at][:, None] == labels) & (at[:, None] != np.arange(len(ids))), _dots(q[at], q), LEAST)
                lo = np.partition(s, -k, axis=1)[:, -k] if len(ids) >= k else np.full(len(at), LEAST)
                yield pa.RecordBatch.from_pydict(
                    {"anchor_id": ids[at], "label": labels[at], "dim": pa.array([r["dim"]] * len(at), pa.int32()), "home": pa.array([r["block"]] * len(at), pa.int64()),
                     "vector": pa.array([q[i].tobytes() for i in at], pa.binary()), "lo": pa.array([[x] for x in lo.tolist()], pa.list_(pa.int64())), "hi": pa.array([[MOST]] * len(at), pa.list_(pa.int64()))})
    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs the anchors of a task, sorted by length and block, into groups."""
    number, held = _task(), []

    def group():
        nonlocal number, held
        width = max(len(r["lo"]) for r in held)
        lo = np.array([r["lo"] + [MOST] * (width - len(r["lo"])) for r in held], np.int64)
        hi = np.array([r["hi"] + [LEAST] * (width - len(r["hi"])) for r in held], np.int64)
        row = (number, held[0]["dim"], np.array([r["anchor_id"] for r in held], np.int64).tobytes(), np.array([r["label"] for r in held], np.int64).tobytes(),
               b"".join(r["vector"] for r in held), lo.tobytes(), hi.tobytes())
        number, held = number + 1, []
        return _one(_GROUPS, row)
    for batch in batches:
        for r in batch.to_pylist():
            if held and (r["dim"] != held[0]["dim"] or len(held) >= GROUP):
                yield group()
            held.append(r)
    if held:
        yield group()


def _page(table: pa.Table) -> pa.Table:
    """The zone maps of one page as one row."""
    head = table.slice(0, 1).select(["dim", "page"])
    out = {"blocks": table.column("block"), "label_lo": table.column("label_lo"), "label_hi": table.column("label_hi")}
    for name, column in out.items():
        head = head.append_column(name, pa.array([np.asarray(column, np.int64).tobytes()], pa.binary()))
    for name in ("zone_lo", "zone_hi"):
        head = head.append_column(name, pa.array([b"".join(table.column(name).to_pylist())], pa.binary()))
    return head


def _bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each row of a with any point of each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return _dots(up, lo) + _dots(down, hi), _dots(up, hi) + _dots(down, lo)


class _Group:
    """The anchors of a group, their windows, and the best rows found for them so far."""

    def __init__(self, r: dict, same: bool, k: int):
        self.ids, self.labels, self.same, self.k = _long(r["ids"]), _long(r["labels"]), same, k
        n = len(self.ids)
        self.vectors = _long(r["vectors"]).reshape(n, r["dim"])
        self.lo, self.hi = (_long(r[c]).reshape(n, -1).copy() for c in ("lo", "hi"))
        self.score = np.full((*self.lo.shape, k), LEAST)
        self.found = np.full((*self.lo.shape, k), MOST)

    def needs(self, label_lo: np.ndarray, label_hi: np.ndarray, zone_lo: np.ndarray, zone_hi: np.ndarray) -> np.ndarray:
        """(anchor x block): may the block hold a row of one of the anchor's windows?"""
        least, most = _bounds(self.vectors, zone_lo, zone_hi)
        of = self.labels[:, None]
        ok = (label_lo <= of) & (of <= label_hi) if self.same else ~((label_lo == of) & (of == label_hi))
        meets = np.zeros(ok.shape, bool)
        for w in range(self.lo.shape[1]):
            meets |= (most >= self.lo[:, w, None]) & (least <= self.hi[:, w, None])
        return ok & meets

    def read(self, r: dict) -> None:
        ids, labels = _long(r["block_ids"]), _long(r["block_labels"])
        dim = self.vectors.shape[1]
        zones = (_long(r[c]).reshape(1, dim) for c in ("zone_lo", "zone_hi"))
        at = np.flatnonzero(self.needs(np.array([r["label_lo"]]), np.array([r["label_hi"]]), *zones)[:, 0])
        if not len(at):
            return
        order = np.argsort(ids, kind="stable")  # the first of equal scores is the smallest vec_id
        ids, labels, q = ids[order], labels[order], _wide(r["block_vectors"], len(ids), dim)[order]
        s = _dots(self.vectors[at], q)
        alike = self.labels[at][:, None] == labels
        fits = (alike if self.same else ~alike) & (self.ids[at][:, None] != ids)
        rows = np.arange(len(at))
        for w in range(self.lo.shape[1]):
            t = np.where(fits & (s >= self.lo[at, w, None]) & (s <= self.hi[at, w, None]), s, LEAST)
            score, found = [self.score[at, w]], [self.found[at, w]]
            for _ in range(min(self.k, len(ids))):
                best = t.argmax(1)
                top = t[rows, best]
                if not (top > LEAST).any():
                    break
                score.append(top[:, None])
                found.append(np.where(top > LEAST, ids[best], MOST)[:, None])
                t[rows, best] = LEAST
            if len(score) > 1:
                score, found = np.concatenate(score, 1), np.concatenate(found, 1)
                first = np.lexsort((found, -score), axis=1)[:, : self.k]
                self.score[at, w], self.found[at, w] = np.take_along_axis(score, first, 1), np.take_along_axis(found, first, 1)
                self.lo[at, w] = np.maximum(self.lo[at, w], self.score[at, w, -1])

    def result(self) -> pa.RecordBatch:
        a, w, k = np.nonzero(self.score > LEAST)
        return pa.RecordBatch.from_pydict({"anchor_id": self.ids[a], "window": pa.array(w, pa.int32()), "vec_id": self.found[a, w, k], "score": self.score[a, w, k]})


def _select(same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(group, slot, block) of the blocks that a group must read, by the zone maps of a page."""
        for batch in batches:
            for r in batch.to_pylist():
                blocks, lo, hi = (_long(r[c]) for c in ("blocks", "label_lo", "label_hi"))
                zones = (_long(r[c]).reshape(len(blocks), r["dim"]) for c in ("zone_lo", "zone_hi"))
                hit = blocks[_Group(r, same, 1).needs(lo, hi, *zones).any(0)]
                # a slot: blocks of one page that one task reads with the group
                slot = r["page"] * PAGE + np.arange(len(hit)) // SLOT
                yield pa.RecordBatch.from_pydict({"group": pa.array([r["group"]] * len(hit), pa.int64()), "slot": pa.array(slot, pa.int64()), "block": pa.array(hit, pa.int64())})
    return run


def _score(same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, current = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if (r["group"], r["slot"]) != current:
                    if group is not None:
                        yield group.result()
                    group, current = _Group(r, same, k), (r["group"], r["slot"])
                group.read(r)
        if group is not None:
            yield group.result()
    return run


def _search(anchors: DataFrame, blocks: DataFrame, n_blocks: int, same: bool, k: int) -> DataFrame:
    """The first k rows of each window of each anchor: anchor_id, window, vec_id, score, rank. ``same``: rows of the anchor's label, else of other labels."""
    groups = (anchors.repartitionByRange("dim", "home", "anchor_id").sortWithinPartitions("dim", "home", "anchor_id")
              .mapInArrow(_grouped, _GROUPS).checkpoint())  # numbered by task: read as written from here on
    n_pages = -(-n_blocks // PAGE)
    zones = blocks.select("block", "dim", "label_lo", "label_hi", "zone_lo", "zone_hi").withColumn("page", F.pmod(F.xxhash64("block"), F.lit(n_pages)))
    pages = zones.groupBy("dim", "page").applyInArrow(_page, "dim int, page long, blocks binary, label_lo binary, label_hi binary, zone_lo binary, zone_hi binary")
    dealt = groups.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_pages - 1).cast("long"))))
    hits = dealt.join(pages, ["dim", "page"]).mapInArrow(_select(same), "group long, slot long, block long").checkpoint()
    # a group goes once to each slot that has blocks for it
    wanted = hits.select("group", "slot").distinct().join(groups, "group")
    read = (hits.join(blocks.drop("dim", "anchors"), "block")
            .withColumnsRenamed({"ids": "block_ids", "labels": "block_labels", "vectors": "block_vectors"}))
    found = wanted.join(read, ["group", "slot"]).mapInArrow(_score(same, k), _FOUND)
    order = W.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def window_bounds(score: Column, low: int, high: int) -> tuple[Column, Column]:
    """Smallest and largest integer s with low * score <= 100 * s <= high * score."""
    cent = F.lit(100).cast("long")
    a, b = score * F.lit(low).cast("long"), score * F.lit(high).cast("long")
    lift, drop = a + F.pmod(-a, cent), b - F.pmod(b, cent)
    return F.call_function("div", lift, cent), F.call_function("div", drop, cent)


def mine(embeddings: DataFrame, anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, folder: str | None = None) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    ``anchor``: which rows are anchors; ``label``: the label to use (default: the column label); ``folder``: where the
    blocks are written (default: a new folder under spark.checkpoint.dir).
    """
    spark = embeddings.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/blocks-{uuid4().hex}"
    label = F.col("label") if label is None else label
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = (embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("embedding"), finite.alias("finite"))
            .where("label is not null and finite")
            .groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "anchor")).alias("r"))
            .select("vec_id", "r.label", "r.anchor", "r.embedding"))
    order = ("label", "dim", "place", "vec_id")
    (rows.mapInArrow(_keyed, _KEYED).repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(_blocks, _BLOCKS).write.parquet(folder))
    blocks = spark.read.parquet(folder)
    n_blocks = max(1, blocks.count())
    anchors = blocks.mapInArrow(_own_blocks(positives), _ANCHORS).checkpoint()
    near = (_search(anchors, blocks, n_blocks, True, positives)
            .select("anchor_id", F.col("rank").alias("positive_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).checkpoint())
    lo, hi = window_bounds(F.col("positive_score"), low, high)
    windows = (near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_rank", lo.alias("lo"), hi.alias("hi")))).alias("w"))  # at most ``positives`` items
               .select("anchor_id", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi")))
    far = (_search(anchors.drop("lo", "hi").join(windows, "anchor_id").select(*(c.split()[0] for c in _ANCHORS.split(", "))), blocks, n_blocks, False, negatives)
           .select("anchor_id", (F.col("window") + 1).alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))
    return near.join(far, ["anchor_id", "positive_rank"]).select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
         vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
