"""Gradient-boosted trees by distributed histograms, with resumable training.

One trainer serves both models: the mean (squared error) and the ``alpha``
percentile (pinball loss, leaves set to the exact percentile of the residuals
of their rows).

* Rows are packed once into blocks: features as bin numbers (one byte each) and
  the target, stored as Parquet. Training works on an RDD of these blocks and
  the rows' margins (current predictions), because a round is a handful of very
  short jobs over per-partition NumPy arrays.
* A level of a tree is one job: every task adds up (gradient, rows) per node,
  feature and bin, for the smaller of two children only (the other is what it
  leaves of their parent). The sums of a level meet on the driver if they are at
  most DIRECT_BYTES in all (their size follows nodes and bins, not rows), else
  on the executors, where each node's best split is found. Rows are not moved.
* A job of a level takes longer to start than the sums of millions of rows. So
  a training of at most LOCAL_ROWS rows a task has its blocks dealt once over
  tasks that run at once (a barrier stage, on half of the cores: two models
  train side by side), and a job is ``every`` rounds. The tasks tell each other
  the sums of a level as files beside the checkpoints (a barrier's own messages
  take a second each); all of them find the same splits. One task is enough for
  TASK_ROWS rows, and has to do where such files cannot be shared or the number
  of cores may change. Larger trainings run a job a level; where their blocks
  lie in one task, nodes of at most LOCAL_ROWS rows are finished there in one
  further job. The trees are the same.
* Trees grow ``max_depth`` levels and are then cut to the ``max_leaves - 1``
  splits that best-first growth takes.
* Sums are integers (gradients in steps of 2**-20), so neither the partitioning
  nor a retried task changes a tree.
* Leaf percentiles are exact. Every task gives the order statistics around the
  percentile of its own rows of a leaf; where those of all tasks hold the
  target ranks between them, they decide it. For other leaves, counts by the
  leading bits of the residuals' order-preserving integer form narrow the ranks
  to a few values, which alone are gathered (by leaf, on the executors).

Training state lives in ``folder``: the blocks, the settings, and the trees of
every ``every`` rounds, appended when the margins are checkpointed. A run that
finds state there continues it (margins are rebuilt from the stored trees by
the same additions) and ends with the trees that an unbroken run gives; a
finished training is only read. Without a folder, one under the folder of
``spark.checkpoint.dir`` is named after the data and the settings, so a model is trained once
for any number of reports.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import pickle
import shutil
import sys
import time
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from urllib.parse import unquote, urlparse
from uuid import uuid4

import numpy as np
from pyspark import BarrierTaskContext, StorageLevel, cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import percentile
from ..session import ensure_checkpoint_dir, shared_dir
from .features import FEATURES, TARGET

# the functions below travel with their closures: workers need NumPy, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIXED = float(1 << 20)   # integer steps of a gradient or loss
BLOCK_ROWS = 1 << 16
LOCAL_ROWS = 1 << 23     # rows of a task that runs whole rounds, at most (some 600 MB with what it adds up)
MEETING_TASKS = 16       # tasks that run a training's rounds together, at most
WAIT_SECONDS = 3600      # that a task waits for what another one has to tell, before it fails
TASK_ROWS = 1 << 18      # rows that a task of a level job is worth starting for
MOST_ROWS = 1 << 22      # rows of a task from which on there are more tasks than cores
SCORE_ROWS = 1 << 15     # rows that are scored at once
RUN_ROWS = 1 << 18       # rows of a task that are added up at once
JOINT_BINS = 1 << 12     # bins of several features that are counted as one key
DIRECT_BYTES = 1 << 24   # sums of one level that may meet on the driver; more meet on the executors
JOINT_ROWS = 1 << 12     # a node of so many rows is added up by groups of features
JOINT = ((1 << 15, 1 << 14), (1 << 11, 1 << 12))  # rows a node on average, and bins of several features that are then counted as one key
ABOVE_BITS = 26
ABOVE = float(1 << ABOVE_BITS)  # what a row above the prediction adds; the rows of a task are fewer
DEVIATIONS = 4.0         # standard deviations of a sample's percentile that a task gives on either side
GATHER = 4096            # values of a leaf that are gathered at the end of a selection
NODE_SCHEMA = ("tree int, node int, feature int, bin int, threshold double, left int, right int, "
               "gain double, rows long, value double, loss double")


@dataclass
class Tree:
    """Node arrays; ``feature`` is -1 at leaves, rows with bin <= ``bin`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    gain: np.ndarray
    rows: np.ndarray
    value: np.ndarray
    loss: float = 0.0     # mean train loss before this tree

    def records(self, number: int) -> list[tuple]:
        cols = [c.tolist() for c in (self.feature, self.bin, self.threshold, self.left, self.right, self.gain, self.rows, self.value)]
        return [(number, i, *row, float(self.loss)) for i, row in enumerate(zip(*cols))]


def walk(feature: np.ndarray, at_most: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Node that each column of ``x`` (features x rows) ends in; values up to ``at_most`` go left."""
    ends, open_ = np.zeros(x.shape[1], np.int64), [(0, np.arange(x.shape[1]))]
    while open_:
        node, rows = open_.pop()
        if feature[node] < 0:
            ends[rows] = node
        elif len(rows):
            goes = x[feature[node]].take(rows) <= at_most[node]
            open_ += [(left[node], rows.compress(goes)), (right[node], rows.compress(~goes))]
    return ends


# ------------------------------------------------------------------ objectives
def gradients(alpha: float | None, r: np.ndarray) -> np.ndarray:
    """Integer-valued gradients of the loss at residuals ``r`` (target less prediction): squared error, or pinball if ``alpha`` is given."""
    if alpha is None:
        return np.rint(-r * FIXED)
    return np.where(r > 0, np.rint(-alpha * FIXED), np.rint((1 - alpha) * FIXED))


def losses(alpha: float | None, r: np.ndarray) -> int:
    """Sum of the losses in integer steps."""
    each = r * r if alpha is None else np.where(r > 0, alpha * r, (alpha - 1) * r)
    return int(np.rint(each * FIXED).sum())


def in_bag(seed: int, round_: int, block: int, n: int, share: float) -> np.ndarray:
    """The rows of a block that this round's tree is grown on."""
    if share >= 1:
        return np.ones(n, bool)
    return np.random.Generator(np.random.PCG64([seed, round_, block & 0xFFFFFFFF, block >> 32])).random(n) < share


# ------------------------------------------------------------------ one level
def in_runs(blocks: Iterator[tuple], bag: tuple) -> Iterator[tuple]:
    """(bins, residuals, sampled rows, blocks) of about RUN_ROWS rows at a time."""
    held, size = [], 0

    def joined():
        r = [y - margin for _, _, y, margin in held]
        used = [in_bag(bag[0], bag[1], block, len(y), bag[2]) for block, _, y, _ in held]
        x = held[0][1] if len(held) == 1 else np.concatenate([b[1] for b in held], 1)
        return x, np.concatenate(r), np.flatnonzero(np.concatenate(used)), r
    for item in blocks:
        held.append(item)
        size += len(item[2])
        if size >= RUN_ROWS:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def rows_of(arrays: tuple, nodes: Sequence[int], x: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    """Those of ``rows`` that pass each of ``nodes``; branches that lead to none of them are not walked."""
    feature, at_most, left, right = (a.tolist() for a in arrays)
    parent = {side[n]: n for side in (left, right) for n in range(len(feature)) if feature[n] >= 0}
    wanted, above = set(nodes), set()
    for n in nodes:
        while n in parent and parent[n] not in above:
            n = parent[n]
            above.add(n)
    out, open_ = {}, [(0, rows)]
    while open_:
        node, own = open_.pop()
        if node in wanted:
            out[node] = own
        if node in above:
            goes = x[feature[node]].take(own) <= at_most[node]
            for side, to in ((left[node], True), (right[node], False)):
                if side in wanted or side in above:
                    open_.append((side, own.compress(goes if to else ~goes)))
    return out


def joint_groups(sizes: Sequence[int], most: float) -> list[list[int]]:
    """Places of ``sizes`` in groups whose product is at most ``most``: the bins of a group are counted as one key."""
    groups: list[list] = []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        for group in groups:
            if group[0] * sizes[k] <= most:
                group[0] *= sizes[k]
                group[1].append(k)
                break
        else:
            groups.append([sizes[k], [k]])
    return [group for _, group in groups]


def joint_key(columns: list[np.ndarray], sizes: Sequence[int]) -> np.ndarray:
    """One number for the bins of a group's features."""
    key = columns[0]
    for column, size in zip(columns[1:], sizes[1:]):
        key = key.astype(np.uint16) * np.uint16(size) + column
    return key


def marginal(cells: np.ndarray, group: list[int]) -> Iterator[tuple]:
    """(place, sums by its bins) of every feature of a group; ``cells``: (anything, bins of the features...)."""
    for axis, k in enumerate(group):
        yield k, cells.sum(tuple(a for a in range(1, len(group) + 1) if a != axis + 1))


def level_histograms(alpha, arrays: tuple, frontier: list[int], features: list[int], bins: int | Sequence[int], bag: tuple, with_loss: bool):
    """mapPartitions function: (place in the frontier, (2, bins of all features) sums of gradients and rows); -1: (loss,
    rows). ``bins``: of every feature, or of each."""
    sizes = [bins] * len(features) if isinstance(bins, int) else list(bins)
    starts = np.r_[0, np.cumsum(sizes)].tolist()
    low, high = (int(v) for v in gradients(alpha, np.array([1.0, -1.0]))) if alpha is not None else (0, 0)

    def added(sums: np.ndarray, x: np.ndarray, r: np.ndarray, parts: dict[int, np.ndarray]) -> None:
        own = [parts.get(n, np.zeros(0, np.intp)) for n in frontier]
        rows = np.concatenate(own)
        place = np.repeat(np.arange(len(frontier)), [len(p) for p in own])
        if alpha is None:
            weights = gradients(alpha, r).take(rows)
        else:  # two gradients only: rows, and those above the prediction, in one number
            weights = np.where(r > 0, 1.0 + ABOVE, 1.0).take(rows)
        for group in joint_groups(sizes, min(JOINT_BINS, len(rows) / len(frontier) / 2)):
            shape = [sizes[k] for k in group]
            size = int(np.prod(shape))
            key = place * size + joint_key([x[features[k]] for k in group], shape).take(rows)
            total = np.bincount(key, weights, size * len(frontier)).astype(np.int64)
            if alpha is None:
                both = (total, np.bincount(key, minlength=size * len(frontier)))
            else:
                n = total & int(ABOVE) - 1
                both = (high * n + (low - high) * (total >> ABOVE_BITS), n)
            for j, cells in enumerate(both):
                for k, own_sums in marginal(cells.reshape(len(frontier), *shape), group):
                    sums[:, j, starts[k] : starts[k + 1]] += own_sums

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        sums, loss, rows = None, 0, 0
        for x, r, used, by_block in in_runs(blocks, bag):
            if with_loss:
                loss, rows = loss + sum(losses(alpha, own) for own in by_block), rows + len(r)
            if sums is None:
                sums = np.zeros((len(frontier), 2, starts[-1]), np.int64)
            added(sums, x, r, rows_of(arrays, frontier, x, used))
        if sums is not None:
            yield from ((k, sums[k].copy()) for k in range(len(frontier)))
        if with_loss:
            yield -1, np.array([loss, rows], np.int64)
    return run


def node_rows(alpha, arrays: tuple, nodes: list[int], features: list[int], bag: tuple, with_loss: bool):
    """mapPartitions function: (node, (bins of the features, residuals)) of the sampled rows of some nodes; -1: (loss, rows)."""
    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        loss, rows = 0, 0
        for block, x, y, margin in blocks:
            r = y - margin
            if with_loss:
                loss, rows = loss + losses(alpha, r), rows + len(y)
            used = in_bag(bag[0], bag[1], block, len(y), bag[2])
            ends = walk(*arrays, x)
            for node in nodes:
                at = np.flatnonzero(used & (ends == node))
                if len(at):
                    yield node, (x[np.ix_(features, at)], r[at])
        if with_loss:
            yield -1, (loss, rows)
    return run


def grouped(items: Iterator[tuple]) -> Iterator[tuple]:
    """What ``groupByKey`` gives for the items of one task."""
    held: dict = {}
    for key, value in items:
        held.setdefault(key, []).append(value)
    yield from held.items()


def grow_rest(alpha, features: list[int], bins: int, depths: dict[int, int], find, percentiles: bool = True, sizes: Sequence[int] | None = None,
              ends: np.ndarray | None = None):
    """Grows the subtree of a node whose rows are all here: (node, [(parent, side, split record or None, percentile)]), the
    subtree's nodes level by level.

    A node is the list of its rows. Only the smaller of two children is added up: the other is what it leaves of their
    parent. Large nodes are added up by groups of features (``sizes``: the bins of each). ``percentiles``: take those of the
    nodes' residuals too. ``ends``: takes the place, in the list, of the node that each row ends in."""
    def run(item: tuple) -> tuple:
        node, parts = item
        if node < 0:
            parts = list(parts)
            return node, (sum(a for a, _ in parts), sum(b for _, b in parts))
        xs, rs = zip(*parts)
        x, r = [np.concatenate(c) for c in zip(*xs)], np.concatenate(rs)
        widths = [bins] * len(features) if sizes is None else list(sizes)
        groups = joint_groups(widths, JOINT_BINS) if len(r) >= JOINT_ROWS else []
        if alpha is None:
            weights = gradients(alpha, r)
        else:  # two gradients only: rows, and those above the prediction, in one number
            weights = np.where(r > 0, 1.0 + ABOVE, 1.0)
            low, high = (int(v) for v in gradients(alpha, np.array([1.0, -1.0])))
        if groups:  # a row's weight and keys side by side: one look a row
            names, size = [f"k{j}" for j in range(len(groups))], 8 + 2 * len(groups)
            records = np.empty(len(r), {"names": ["weight", *names], "formats": ["f8"] + ["u2"] * len(groups),
                                        "offsets": [0, *range(8, size, 2)], "itemsize": 1 << (size - 1).bit_length()})
            records["weight"] = weights
            for name, group in zip(names, groups):
                records[name] = joint_key([x[k] for k in group], [widths[k] for k in group])

        def counted(key: np.ndarray, own: np.ndarray, size: int) -> list[np.ndarray]:
            """Sums of gradients and rows by key."""
            key = key.astype(np.intp)
            total = np.bincount(key, own, size).astype(np.int64)
            if alpha is None:
                return [total, np.bincount(key, minlength=size)]
            n = total & int(ABOVE) - 1
            return [high * n + (low - high) * (total >> ABOVE_BITS), n]

        def sums_of(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((2, len(features), bins), np.int64)
            if len(rows) < JOINT_ROWS:
                own = weights.take(rows)
                for k in range(len(features)):
                    out[:, k] = counted(x[k].take(rows), own, bins)
                return out
            taken = records.take(rows) if len(rows) < len(records) else records
            own = np.ascontiguousarray(taken["weight"])
            for name, group in zip(names, groups):
                shape = [widths[k] for k in group]
                both = counted(taken[name], own, int(np.prod(shape)))
                for k, cells in marginal(np.stack(both).reshape(2, *shape), group):
                    out[:, k, : widths[k]] = cells
            return out
        rows = np.arange(len(r))
        made, level = [[-1, 0, None, None]], [(0, rows, sums_of(rows))]
        for depth in range(depths[node] + 1):
            following = []
            for n, rows, sums in level:
                if alpha is not None and percentiles:
                    made[n][3] = selected_percentile(r.take(rows), alpha)
                split = made[n][2] = find(sums) if depth < depths[node] else None
                if split is None or not split[0] > 0:
                    if ends is not None:
                        ends[rows] = n
                    continue
                goes = x[features.index(split[1])].take(rows) <= split[2]
                left, right = rows.compress(goes), rows.compress(~goes)
                by_side = [None, None]
                if depth + 1 < depths[node]:
                    small = int(len(left) > len(right))
                    by_side[small] = sums_of((left, right)[small])
                    by_side[1 - small] = sums - by_side[small]
                following += [(len(made), left, by_side[0]), (len(made) + 1, right, by_side[1])]
                made += [[n, 0, None, None], [n, 1, None, None]]
            level = following
        return node, [tuple(m) for m in made]
    return run


def selected_percentile(v: np.ndarray, q: float) -> float | None:
    """Linear interpolation between the closest ranks of ``v``."""
    if not len(v):
        return None
    at = (len(v) - 1) * q
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    v = np.partition(v, (lo, hi))
    t, a, b = at - lo, float(v[lo]), float(v[hi])
    return b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t


def split_of(features: list[int], min_rows: int, l1: float, l2: float):
    """The best split of a node's sums: (gain, feature, bin, left gradient, left rows, gradient, rows)."""
    def score(g, n):
        return np.maximum(np.abs(g) - l1, 0) ** 2 / (n + l2)

    def run(sums: np.ndarray) -> tuple:
        if sums.ndim == 1:
            return tuple(int(v) for v in sums)  # the loss
        g, n = np.cumsum(sums[0], 1), np.cumsum(sums[1], 1)
        all_g, all_n = int(g[0, -1]), int(n[0, -1])
        gl, gr = g / FIXED, (all_g - g) / FIXED
        ok = (n >= min_rows) & (all_n - n >= min_rows)
        gain = np.where(ok, score(gl, n) + score(gr, np.maximum(all_n - n, 0)) - score(all_g / FIXED, all_n), -np.inf)
        k = int(np.argmax(gain))
        f, b = divmod(k, gain.shape[1])
        return float(gain[f, b]), features[f], b, int(g[f, b]), int(n[f, b]), all_g, all_n
    return run


def splits_of(features: list[int], sizes: Sequence[int], min_rows: int, l1: float, l2: float):
    """``split_of`` for many nodes at once, on sums whose features have ``sizes`` bins each: (nodes, 2, bins of all features)."""
    def score(g, n):
        return np.maximum(np.abs(g) - l1, 0) ** 2 / (n + l2)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)

    def run(sums: np.ndarray) -> list[tuple]:
        c = np.cumsum(sums, 2)
        c = c - (c[:, :, starts] - sums[:, :, starts])[:, :, of]  # running sums of each feature
        g, n = c[:, 0], c[:, 1]
        all_g, all_n = g[:, ends[0] - 1].tolist(), n[:, ends[0] - 1].tolist()
        rest_g, rest_n = np.array(all_g)[:, None] - g, np.array(all_n)[:, None] - n
        whole = np.array([score(a / FIXED, b) for a, b in zip(all_g, all_n)])[:, None]
        gain = np.where((n >= min_rows) & (rest_n >= min_rows), score(g / FIXED, n) + score(rest_g / FIXED, np.maximum(rest_n, 0)) - whole, -np.inf)
        best = np.argmax(gain, 1).tolist()
        return [(float(gain[k, b]), features[of[b]], int(b - starts[of[b]]), int(g[k, b]), int(n[k, b]), all_g[k], all_n[k]) for k, b in enumerate(best)]
    return run


# ------------------------------------------------------------------ exact selection in groups
def around_percentile(arrays: tuple, bag: tuple, leaves: Sequence[int], q: float):
    """mapPartitions function: (leaf, (rows, rows before the given ones, residuals in order)): the order statistics of the
    task's sampled rows of a leaf around their ``q`` percentile."""
    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        held: dict = {}
        for x, r, used, _ in in_runs(blocks, bag):
            for leaf, rows in rows_of(arrays, leaves, x, used).items():
                if len(rows):
                    held.setdefault(leaf, []).append(r.take(rows))
        for leaf, parts in held.items():
            yield leaf, around(np.concatenate(parts), q)
    return run


def around(v: np.ndarray, q: float) -> tuple[int, int, np.ndarray]:
    """(values, values before the given ones, values in order around the ``q`` percentile)."""
    n, reach = len(v), DEVIATIONS * np.sqrt(q * (1 - q) * len(v)) + 2
    lo, hi = max(0, int((n - 1) * q - reach)), min(n - 1, int((n - 1) * q + reach) + 1)
    return n, lo, np.sort(np.partition(v, (lo, hi))[lo : hi + 1])


def met_percentile(parts: Iterator[tuple], q: float) -> float | None:
    """The ``q`` percentile of the rows of all ``parts`` of ``around_percentile``, or None if they do not decide it.

    What a task leaves out before its part is at most the part's first value, what it leaves out after it at least the
    last: a value between all firsts and lasts keeps its rank."""
    parts = list(parts)
    n, before = sum(p[0] for p in parts), sum(p[1] for p in parts)
    first = max((p[2][0] for p in parts if p[1]), default=-np.inf)
    last = min((p[2][-1] for p in parts if p[1] + len(p[2]) < p[0]), default=np.inf)
    v = np.sort(np.concatenate([p[2] for p in parts]))
    at = (n - 1) * q
    lo, hi = int(np.floor(at)) - before, int(np.ceil(at)) - before
    if lo < 0 or hi >= len(v) or v[lo] < first or v[hi] > last:
        return None
    t, a, b = at - np.floor(at), float(v[lo]), float(v[hi])
    return b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t


def ordered_bits(v: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 and 0.0 alike)."""
    u = (v + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63) == 1, ~u, u | np.uint64(1 << 63))


def from_bits(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, np.uint64)
    return np.where(u >> np.uint64(63) == 1, u & np.uint64((1 << 63) - 1), ~u).view(np.float64)


def group_percentiles(values, q: float, step: int = 16, gather: int = GATHER) -> dict[int, float]:
    """Exact ``q`` percentile (linear interpolation) of each group of an RDD of (groups, values) array pairs.

    Each pass counts the values of every open group by their next ``step``
    bits and keeps the one or two buckets that hold the target ranks; when a
    group's buckets hold at most ``gather`` values, or no bits are left, they
    decide. One small record a group and pass reaches the driver.
    """
    def counted(prefixes: dict, shift: int):
        def run(parts: Iterator[tuple]) -> Iterator[tuple]:
            total: dict = {}
            for group, v in parts:
                u = ordered_bits(v)
                if prefixes is not None:
                    keep = np.isin(group, list(prefixes))
                    group, u = group[keep], u[keep]
                    above = u >> np.uint64(shift + step)
                    allowed = np.zeros(len(group), bool)
                    for g, heads in prefixes.items():
                        at = np.flatnonzero(group == g)
                        allowed[at] = np.isin(above[at], np.array(heads, np.uint64))
                    group, u = group[allowed], u[allowed]
                head = u >> np.uint64(shift)
                order = np.lexsort((head, group))
                group, head = group[order], head[order]
                new = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (head[1:] != head[:-1])]) if len(group) else np.zeros(0, np.int64)
                n = np.diff(np.r_[new, len(group)])
                for g, h, c in zip(group[new].tolist(), head[new].tolist(), n.tolist()):
                    mine = total.setdefault(g, {})
                    mine[h] = mine.get(h, 0) + c
            yield from total.items()
        return run

    def merged(a: dict, b: dict) -> dict:
        for h, c in b.items():
            a[h] = a.get(h, 0) + c
        return a

    def narrowed(targets: dict | None):
        def run(item: tuple) -> tuple:
            """(group, (rows, [(bucket, values before it, values in it) of the target ranks]))."""
            g, heads = item
            hs = sorted(heads)
            cs = np.cumsum([heads[h] for h in hs])
            if targets is None:
                n, before = int(cs[-1]), 0
                lo, hi = int(np.floor((n - 1) * q)), int(np.ceil((n - 1) * q))
            else:
                n, lo, hi, bases = targets[g]
            out = []
            if targets is None:
                for h in sorted({hs[int(np.searchsorted(cs, r, "right"))] for r in (lo, hi)}):
                    k = hs.index(h)
                    out.append((h, int(cs[k]) - heads[h], heads[h]))
            else:  # ranks count from the values before each kept bucket
                own = {}
                for h in hs:
                    own.setdefault(h >> step, []).append(h)
                for head, before in bases:
                    at = before
                    for h in own.get(head, ()):
                        c = heads[h]
                        if any(at <= r < at + c for r in (lo, hi)):
                            out.append((h, at, c))
                        at += c
            return g, (n, lo, hi, out)
        return run
    shift, prefixes, targets = 64 - step, None, None
    done: dict[int, tuple] = {}
    while True:
        found = values.mapPartitions(counted(prefixes, shift)).reduceByKey(merged).map(narrowed(targets)).collect()
        prefixes, targets = {}, {}
        for g, (n, lo, hi, heads) in found:
            if shift == 0 or sum(c for _, _, c in heads) <= gather:
                done[g] = (shift, lo, hi, [(h, at) for h, at, _ in heads], n)
            else:
                prefixes[g], targets[g] = [h for h, _, _ in heads], (n, lo, hi, [(h, at) for h, at, _ in heads])
        if not prefixes:
            break
        shift = max(0, shift - step)

    def gathered(parts: Iterator[tuple]) -> Iterator[tuple]:
        for group, v in parts:
            u = ordered_bits(v)
            for g, (s, _, _, heads, _) in done.items():
                at = np.flatnonzero(group == g)
                if len(at):
                    own = u[at] >> np.uint64(s)
                    for h, _ in heads:
                        if len(hit := u[at[own == h]]):
                            # with all bits fixed the bucket is one value, however many rows hold it
                            yield (g, h), hit[:1] if s == 0 else hit

    def picked(item: tuple) -> tuple:
        (g, h), u = item
        s, lo, hi, heads, _ = done[g]
        before = dict(heads)[h]
        u = np.sort(u)
        return g, {r: float(from_bits(u[:1] if s == 0 else u[r - before : r - before + 1])[0]) for r in (lo, hi) if s == 0 or before <= r < before + len(u)}
    out: dict[int, float] = {}
    ranks: dict[int, dict] = {}
    for g, values_at in values.mapPartitions(gathered).reduceByKey(lambda a, b: np.concatenate([a, b])).map(picked).collect():
        ranks.setdefault(g, {}).update(values_at)
    for g, (_, lo, hi, _, n) in done.items():
        a, b, t = ranks[g][lo], ranks[g][hi], (n - 1) * q - lo
        out[g] = b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t
    return out


# ------------------------------------------------------------------ the trainer
@dataclass
class BoostedTrees:
    """Defaults are the source's settings; ``alpha=None`` fits the mean, else that percentile.

    ``colsample``: share of the features that each tree may use (12 of 15);
    ``subsample``: share of the rows that each tree is grown on. Features are
    binned at ``max_bins`` quantiles, or at every value if there are no more.
    """

    alpha: float | None = None
    rounds: int = 500
    learning_rate: float = 0.05
    max_depth: int = 7
    max_leaves: int = 63
    min_rows: int = 20
    l1: float = 0.1
    l2: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    max_bins: int = 255
    seed: int = 42
    every: int = 25
    calibrate: bool = False   # shift all predictions by the percentile of the train residuals
    features: Sequence[str] = FEATURES
    label: str = TARGET
    folder: str | None = None

    def settings(self) -> dict:
        """What decides the trees (not the number of rounds: more rounds continue the same training)."""
        kept = asdict(self)
        for name in ("folder", "rounds", "every", "calibrate"):
            kept.pop(name)
        return kept | {"features": list(self.features)}

    def fit(self, train: DataFrame, stop_after: int | None = None) -> "BoostedModel":
        """Trains, or continues, up to ``rounds`` trees. ``stop_after``: end this run after so many new rounds."""
        spark = train.sparkSession
        folder = self.folder or self._folder(train)
        meta = _stored(spark, f"{folder}/meta", "value string")
        if meta is None:
            meta = self._prepare(train, folder)
        else:
            meta = json.loads(meta.first()["value"])
            if meta["settings"] != json.loads(json.dumps(self.settings())):
                raise ValueError(f"{folder} holds a training with other settings")
        trees = stored_trees(spark, folder)
        if len(trees) < self.rounds and meta["rows"]:
            self._train(spark, folder, meta, trees, min(self.rounds, len(trees) + stop_after) if stop_after else self.rounds)
            trees = stored_trees(spark, folder)
        trees = trees[: self.rounds]
        shift = 0.0
        if self.calibrate and self.alpha is not None and meta["rows"]:
            done = spark.read.parquet(f"{folder}/blocks").rdd.map(_unpacker(len(self.features), meta["base"], trees, self.learning_rate))
            shift = group_percentiles(done.map(_all_residuals), self.alpha)[0]
        return BoostedModel(meta["base"] + shift, self.learning_rate, trees, tuple(self.features), folder)

    # -------------------------------------------------------------- state
    def _folder(self, train: DataFrame) -> str:
        row = train.select(F.xxhash64(*self.features, self.label).alias("h")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
        key = json.dumps([self.settings(), row["n"], str(row["s"])], sort_keys=True)
        name = "mean" if self.alpha is None else f"p{round(self.alpha * 100)}"
        return f"{shared_dir(train.sparkSession)}/boosted-{name}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"

    def _edges(self, x: DataFrame) -> list[list[float]]:
        """Upper edges of each feature's bins but the last: all values if few, else quantiles."""
        names, most = list(self.features), self.max_bins
        own = Window.partitionBy("f").orderBy("v")
        values = x.select(*names).mapInArrow(_few_values(names, most + 2), "f string, v double").distinct().withColumn("k", F.row_number().over(own))
        few: dict[str, list[float]] = {f: [] for f in names}
        for r in values.where(F.col("k") <= most + 1).collect():  # a few values a feature
            few[r["f"]].append(float(r["v"]))
        edges: dict[str, list[float]] = {f: [] for f in names}
        many = [f for f in names if len(few[f]) >= most - 1]  # only so many values can have a quantile each
        if many:
            at = ", ".join(repr(k / most) + "D" for k in range(1, most))
            row = x.agg(*[F.expr(f"percentile_approx(`{f}`, array({at}), {40 * most})").alias(f) for f in many]).first()
            edges.update({f: sorted(set(row[f] or [])) for f in many})
        # quantiles that coincide: there may be few values, and then rare ones among them get bins too
        edges.update({f: sorted(v)[:-1] for f, v in few.items() if len(v) <= most and len(edges[f]) < most - 1})
        return [edges[f] for f in names]

    def _prepare(self, train: DataFrame, folder: str) -> dict:
        spark = train.sparkSession
        y = F.col(self.label).cast("double")
        x = train.where(y.isNotNull()).select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in self.features], y.alias("_y"))
        edges = self._edges(x)
        x.mapInArrow(_packer([np.array(e) for e in edges]), "block long, x binary, y binary, n long").write.mode("overwrite").parquet(f"{folder}/blocks")
        rows = int(spark.read.parquet(f"{folder}/blocks").agg(F.sum("n")).first()[0] or 0)
        if not rows:
            base = 0.0
        elif self.alpha is None:
            base = float(x.agg(F.sum(F.col("_y").cast("decimal(38,12)")).alias("s")).first()["s"]) / rows
        else:
            base = float(percentile(x, "_y", self.alpha, alias="p").first()["p"])
        meta = {"settings": json.loads(json.dumps(self.settings())), "rows": rows, "base": base, "edges": edges}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")
        return meta

    # -------------------------------------------------------------- rounds
    def _train(self, spark: SparkSession, folder: str, meta: dict, trees: list[Tree], rounds: int) -> None:
        ensure_checkpoint_dir(spark)
        n_features = len(self.features)
        blocks = spark.read.parquet(f"{folder}/blocks").rdd
        tasks = min(-(-meta["rows"] // TASK_ROWS), max(spark.sparkContext.defaultParallelism, -(-meta["rows"] // MOST_ROWS)))
        blocks = blocks.coalesce(max(1, min(blocks.getNumPartitions(), tasks)))
        meeting = _meeting_folder(spark)
        together = min(meeting_tasks(spark), -(-meta["rows"] // TASK_ROWS)) if meeting else 1
        if together > 1 and meta["rows"] <= LOCAL_ROWS * together:
            self._train_together(spark, folder, meta, trees, rounds, together, meeting)
            return
        if meta["rows"] <= LOCAL_ROWS:
            self._train_here(spark, folder, meta, blocks.coalesce(1).map(_unpacker(n_features, meta["base"], trees, self.learning_rate)), len(trees), rounds)
            return
        current = blocks.map(_unpacker(n_features, meta["base"], trees, self.learning_rate)).persist(StorageLevel.MEMORY_AND_DISK)
        held, fresh = [], []
        for m in range(len(trees), rounds):
            tree = self._grow(current, drawn(self.seed, m, n_features, self.colsample), m, meta)
            fresh.append(tree)
            old, current = current, current.map(_stepper(tree, self.learning_rate)).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(old)
            if len(fresh) == self.every or m + 1 == rounds:
                current.checkpoint()
                current.count()
                for rdd in held:
                    rdd.unpersist()
                held = []
                _store(spark, folder, fresh, m + 1)
                fresh = []
            elif len(held) > 2:  # the one before feeds the next round's lineage, older ones are rebuilt through it if lost
                held.pop(0).unpersist()
        current.unpersist()

    def _train_together(self, spark: SparkSession, folder: str, meta: dict, trees: list[Tree], rounds: int, tasks: int, meeting: str) -> None:
        """The rounds of a training whose blocks lie in some tasks that run at once."""
        sc, n_features = spark.sparkContext, len(self.features)
        fixed = {k: v for k, v in self.settings().items() if k not in ("features", "label")}
        stored = spark.read.parquet(f"{folder}/blocks")
        task_of = evenly([tuple(r) for r in stored.select("block", "n").collect()], tasks)
        blocks = (stored.rdd.map(lambda r: (r["block"], (np.frombuffer(r["x"], np.uint8).reshape(n_features, -1), np.frombuffer(r["y"], np.float64))))
                  .partitionBy(tasks, task_of.__getitem__).persist(StorageLevel.MEMORY_AND_DISK))
        steps = [(t.feature, t.bin, t.left, t.right, t.value) for t in trees]
        os.makedirs(meeting)
        try:
            for start in range(len(trees), rounds, self.every):
                stop = min(start + self.every, rounds)
                sent = sc.broadcast(steps)
                made = [Tree(*fields) for fields in blocks.barrier().mapPartitions(
                    rounds_together(fixed, meta["edges"], start, stop, meeting, sent, meta["base"])).collect()]
                _store(spark, folder, made, stop)
                steps += [(t.feature, t.bin, t.left, t.right, t.value) for t in made]
                sent.destroy()
                for old in os.listdir(meeting):  # files of these rounds
                    if not old.startswith(f"margins-{stop}-"):
                        _drop(f"{meeting}/{old}")
        finally:
            blocks.unpersist()
            _drop(meeting)

    def _train_here(self, spark: SparkSession, folder: str, meta: dict, blocks, first: int, rounds: int) -> None:
        """The rounds of a training whose blocks fit one task."""
        held, fixed = None, {k: v for k, v in self.settings().items() if k not in ("features", "label")}
        for start in range(first, rounds, self.every):
            stop = min(start + self.every, rounds)
            done = blocks.mapPartitions(rounds_here(fixed, meta["edges"], start, stop)).persist(StorageLevel.MEMORY_AND_DISK)
            done.checkpoint()
            trees = done.filter(lambda item: item[0] is None).flatMap(lambda item: item[1]).collect()
            if held is not None:
                held.unpersist()
            _store(spark, folder, [Tree(*fields) for fields in trees], stop)
            held, blocks = done, done.filter(lambda item: item[0] is not None)
        held.unpersist()

    def _grow(self, blocks, chosen: list[int], m: int, meta: dict) -> Tree:
        nodes = _Growing(meta["rows"])
        frontier, small, loss = [0], {}, None
        sizes = [len(meta["edges"][f]) + 1 for f in chosen]
        limits, bag = (self.min_rows, self.l1, self.l2), (self.seed, m, self.subsample)
        find = splits_of(chosen, sizes, *limits)
        width = blocks.getNumPartitions()
        held: dict = {}  # sums of the nodes of the level before
        for depth in range(self.max_depth + 1):
            if width == 1:  # the rows of a node lie in one task already
                small.update({n: self.max_depth - depth for n in frontier if nodes.rows[n] <= LOCAL_ROWS})
                frontier = [n for n in frontier if n not in small]
            if not frontier or depth == self.max_depth:
                break
            direct = width * len(frontier) * sum(sizes) * 16 <= DIRECT_BYTES
            # (smaller child, larger child) whose parent's sums are here: the larger need not be added up
            left_over = {b: (a, p) for p in held for a, b in [sorted((nodes.left[p], nodes.right[p]), key=nodes.rows.__getitem__)]
                         if direct and a in frontier and b in frontier}
            counted = [n for n in frontier if n not in left_over]
            sums = blocks.mapPartitions(level_histograms(self.alpha, nodes.arrays(), counted, chosen, sizes, bag, loss is None))
            if direct:
                total: dict = {}
                for k, part in sums.collect():
                    total[k] = total[k] + part if k in total else part
                loss = total.pop(-1, loss)
                own = {counted[k]: part for k, part in total.items()}
                own.update({b: held[p] - own[a] for b, (a, p) in left_over.items()})
                held = own
                found = dict(zip(frontier, find(np.stack([own[n] for n in frontier]))))
            else:  # the sums of a node meet in one of at most ``width`` tasks
                split = lambda item: (item[0], tuple(item[1].tolist()) if item[0] < 0 else find(item[1][None])[0])
                records = dict(sums.reduceByKey(np.add, max(1, min(width, len(counted)))).map(split).collect())
                loss = records.pop(-1, loss)
                found, held = {counted[k]: record for k, record in records.items()}, {}
            frontier = [child for n in sorted(found) for child in nodes.split(n, found[n])]
            held = {n: v for n, v in held.items() if nodes.feature[n] >= 0}
        if small:
            rows = blocks.mapPartitions(node_rows(self.alpha, nodes.arrays(), list(small), chosen, bag, loss is None))
            grown = dict(rows.mapPartitions(grouped).map(grow_rest(self.alpha, chosen, max(sizes), small, split_of(chosen, *limits), sizes=sizes)).collect())
            loss = grown.pop(-1, loss)
            for node in sorted(grown):
                nodes.attach(node, grown[node])
        tree, old = self._cut(nodes, meta["edges"])
        tree.loss = loss[0] / FIXED / max(1, loss[1])
        if self.alpha is not None:
            leaves = np.flatnonzero(tree.feature < 0)
            tree.value[leaves] = [nodes.percentile.get(old[k], 0.0) for k in leaves]
            large = {int(k) for k in leaves if old[k] not in nodes.percentile}
            if large:
                for leaf, v in self._leaf_percentiles(blocks, (tree.feature, tree.bin, tree.left, tree.right), bag, large, meta["rows"]).items():
                    tree.value[leaf] = v
        return tree

    def _leaf_percentiles(self, blocks, walked: tuple, bag: tuple, leaves: set[int], rows: int) -> dict[int, float]:
        q, width = self.alpha, blocks.getNumPartitions()
        near = blocks.mapPartitions(around_percentile(walked, bag, sorted(leaves), q))
        if 8 * width * len(leaves) * (2 * DEVIATIONS * (q * (1 - q) * rows / width / len(leaves)) ** 0.5 + 8) <= DIRECT_BYTES:
            parts: dict = {}
            for leaf, part in near.collect():
                parts.setdefault(leaf, []).append(part)
            got = {leaf: met_percentile(own, q) for leaf, own in parts.items()}
        else:
            got = dict(near.groupByKey(max(1, min(width, len(leaves)))).mapValues(lambda own: met_percentile(own, q)).collect())
        out = {leaf: v for leaf, v in got.items() if v is not None}
        if len(out) < len(got):
            out.update(group_percentiles(blocks.map(_residuals(walked, bag, set(got) - set(out))), q))
        return out

    def _cut(self, nodes: "_Growing", edges: list) -> tuple[Tree, list[int]]:
        fields, order = cut(nodes, edges, self.max_leaves, self.l1, self.l2)
        return Tree(*fields), order


class _Growing:
    """The nodes of a tree while it grows (``rows`` of the root: at most)."""

    def __init__(self, rows: int):
        self.feature, self.at_most, self.left, self.right = [-1], [0], [-1], [-1]
        self.gain, self.rows, self.grad, self.percentile = [0.0], [rows], [0], {}

    def arrays(self) -> tuple:
        return tuple(np.array(a, np.int64) for a in (self.feature, self.at_most, self.left, self.right))

    def split(self, node: int, record: tuple) -> list[int]:
        """Takes the node's sums and, if it gains, its split; the new children."""
        gain, f, b, gl, nl, all_g, all_n = record
        self.rows[node], self.grad[node] = all_n, all_g
        if not gain > 0:
            return []
        self.feature[node], self.at_most[node], self.gain[node] = f, b, gain
        children = [len(self.feature), len(self.feature) + 1]
        self.left[node], self.right[node] = children
        for g, n in ((gl, nl), (all_g - gl, all_n - nl)):
            for a, v in zip((self.feature, self.at_most, self.left, self.right, self.gain, self.rows, self.grad), (-1, 0, -1, -1, 0.0, n, g)):
                a.append(v)
        return children

    def attach(self, node: int, made: list[tuple]) -> None:
        """Adds the subtree that ``grow_rest`` made of a node."""
        number = {0: node}
        for k, (parent, side, record, percentile) in enumerate(made):
            if k:
                number[k] = (self.left, self.right)[side][number[parent]]
            if record is not None:
                self.split(number[k], record)
            if percentile is not None:
                self.percentile[number[k]] = percentile


def cut(nodes: _Growing, edges: list, max_leaves: int, l1: float, l2: float) -> tuple[tuple, list[int]]:
    """The splits that best-first growth to ``max_leaves`` takes, as the arrays of a tree, renumbered in the order taken;
    the old numbers."""
    order, kept = [0], set()
    heap = [(-nodes.gain[0], 0)] if nodes.feature[0] >= 0 else []
    while heap and len(kept) < max_leaves - 1:
        _, node = heapq.heappop(heap)
        kept.add(node)
        for child in (nodes.left[node], nodes.right[node]):
            order.append(child)
            if nodes.feature[child] >= 0:
                heapq.heappush(heap, (-nodes.gain[child], child))
    new = {node: k for k, node in enumerate(order)}
    inner = np.array([node in kept for node in order])
    pick = lambda a, other, kind: np.array([a[n] if k else other for n, k in zip(order, inner)], kind)
    bins, feats = pick(nodes.at_most, 0, np.int64), pick(nodes.feature, -1, np.int64)
    n, g = np.array([nodes.rows[k] for k in order], np.int64), np.array([nodes.grad[k] for k in order], np.int64)
    value = -np.sign(g) * np.maximum(np.abs(g) / FIXED - l1, 0) / (n + l2)
    threshold = np.array([edges[f][b] if f >= 0 else 0.0 for f, b in zip(feats.tolist(), bins.tolist())])
    sides = [np.array([new[side[k]] if i else -1 for k, i in zip(order, inner)], np.int64) for side in (nodes.left, nodes.right)]
    return (feats, bins, threshold, *sides, pick(nodes.gain, 0.0, np.float64), n, np.where(inner, 0.0, value)), order


def kept_leaves(nodes: _Growing, old: list[int], feature: np.ndarray) -> np.ndarray:
    """Of every grown node, the leaf of the cut tree that its rows end in (of inner nodes: themselves)."""
    new = {node: k for k, node in enumerate(old)}
    out, open_ = np.zeros(len(nodes.feature), np.intp), [(0, 0)]
    while open_:
        node, k = open_.pop()
        out[node] = k
        if nodes.feature[node] >= 0:
            open_ += [(child, new[child] if feature[k] >= 0 else k) for child in (nodes.left[node], nodes.right[node])]
    return out


def drawn(seed: int, round_: int, n_features: int, share: float) -> list[int]:
    """The features that this round's tree may use."""
    return sorted(np.random.Generator(np.random.PCG64([seed, round_])).permutation(n_features)[: max(1, round(share * n_features))].tolist())


def joint_records(x: np.ndarray, sizes: Sequence[int], most: int) -> tuple[list[list[int]], np.ndarray]:
    """Groups of features, and every row's keys of them side by side: one look a row."""
    groups = joint_groups(sizes, most)
    names, size = [f"k{j}" for j in range(len(groups))], 2 * len(groups)
    records = np.empty(x.shape[1], {"names": names, "formats": ["u2"] * len(groups), "offsets": [*range(0, size, 2)], "itemsize": 1 << (size - 1).bit_length()})
    for name, group in zip(names, groups):
        records[name] = joint_key([x[k] for k in group], [sizes[k] for k in group])
    return groups, records


def level_sums(alpha: float | None, chosen: list[int], sizes: Sequence[int], x: np.ndarray, joint: list[tuple], weights: np.ndarray):
    """Function of the rows of some nodes: (nodes, 2, bins of the chosen features) sums of gradients and rows. ``joint``:
    (rows a node from which on it is used, groups, records), the largest groups first. ``weights``: gradients, or for a
    percentile 1 and, above the prediction, ABOVE more (two gradients only: both counts in one number)."""
    starts = np.r_[0, np.cumsum([sizes[f] for f in chosen])].tolist()
    place = {f: k for k, f in enumerate(chosen)}
    low, high = (int(v) for v in gradients(alpha, np.array([1.0, -1.0]))) if alpha is not None else (0, 0)

    def run(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(parts), 2, starts[-1]), np.int64)
        rows = np.concatenate(parts)
        own, node = weights.take(rows), np.repeat(np.arange(len(parts)), [len(part) for part in parts])

        def add(column: np.ndarray, group: list[int]) -> None:
            shape = [sizes[f] for f in group]
            size = int(np.prod(shape))
            key = node * size
            key += column
            total = np.bincount(key, own, size * len(parts)).astype(np.int64)
            if alpha is None:
                both = (total, np.bincount(key, minlength=size * len(parts)))
            else:
                n = total & int(ABOVE) - 1
                both = (high * n + (low - high) * (total >> ABOVE_BITS), n)
            for j, cells in enumerate(both):
                for f, sums in marginal(cells.reshape(len(parts), *shape), group):
                    if f in place:
                        out[:, j, starts[place[f]] : starts[place[f] + 1]] = sums
        for least, groups, records in joint:
            if len(rows) >= least * len(parts):
                taken = records.take(rows)
                for name, group in zip(records.dtype.names, groups):
                    if any(f in place for f in group):
                        add(taken[name], group)
                return out
        for f in chosen:
            add(x[f].take(rows), [f])
        return out
    return run


def grown(nodes: "_Growing", depth: int, find, x: np.ndarray, rows: np.ndarray, root: np.ndarray, sums_of, meet) -> dict[int, np.ndarray]:
    """Grows a tree level by level on ``rows``, the sampled ones that are here; the rows of every node that was not split.
    ``root``: the sums over all rows of all tasks; ``meet``: what sums are over all tasks. Only the smaller of two children is
    added up: the other is what it leaves of their parent."""
    held, sums, frontier = {0: rows}, {0: root}, [0]
    for level in range(depth):
        below = []
        for n, record in zip(frontier, find(np.stack([sums[n] for n in frontier]))):
            children = nodes.split(n, record)
            if children:
                own = held.pop(n)
                goes = x[nodes.feature[n]].take(own) <= nodes.at_most[n]
                held[children[0]], held[children[1]] = own.compress(goes), own.compress(~goes)
                below.append((n, sorted(children, key=nodes.rows.__getitem__)))
        if not below or level + 1 == depth:
            break
        added = meet(sums_of([held[small] for _, (small, _) in below]))
        following = {}
        for (n, (small, large)), own in zip(below, added):
            following[small], following[large] = own, sums[n] - own
        sums, frontier = following, sorted(following)
    return held


def rounds_on(fixed: dict, edges: list, start: int, stop: int, held: list[tuple], tell=None) -> tuple[list[tuple], np.ndarray]:
    """Some rounds on the blocks (number, bins, target, margin): the trees' arrays and losses, and the margins in the order of
    the blocks. ``tell``: what all tasks of the training tell each other (bytes to a list of bytes); None: all blocks are here."""
    alpha, sizes, rate = fixed["alpha"], [len(e) + 1 for e in edges], fixed["learning_rate"]
    numbers, lengths = [item[0] for item in held], [len(item[2]) for item in held]
    cuts = np.r_[0, np.cumsum(lengths)].astype(int).tolist()
    x = np.concatenate([item[1] for item in held], 1) if held else np.zeros((len(edges), 0), np.uint8)
    y, margin = (np.concatenate([item[k] for item in held]) if held else np.zeros(0) for k in (2, 3))
    held.clear()
    joint = [(least, *joint_records(x, sizes, most)) for least, most in JOINT]

    def meet(sums: np.ndarray) -> np.ndarray:
        return sums if tell is None else np.sum([np.frombuffer(part, np.int64) for part in tell(sums.tobytes())], 0).reshape(sums.shape)
    made = []
    for m in range(start, stop):
        r = y - margin
        bag = np.concatenate([np.zeros(0, bool), *(in_bag(fixed["seed"], m, block, n, fixed["subsample"]) for block, n in zip(numbers, lengths))])
        chosen = drawn(fixed["seed"], m, len(edges), fixed["colsample"])
        weights = gradients(None, r) if alpha is None else np.where(r > 0, 1.0 + ABOVE, 1.0)
        sums_of, used = level_sums(alpha, chosen, sizes, x, joint, weights), np.flatnonzero(bag)
        own = sums_of([used])[0]
        *root, loss, total = meet(np.r_[own.ravel(), sum(losses(alpha, r[a:b]) for a, b in zip(cuts, cuts[1:])), len(y)]).tolist()
        find = splits_of(chosen, [sizes[f] for f in chosen], fixed["min_rows"], fixed["l1"], fixed["l2"])
        nodes = _Growing(total)
        ends = grown(nodes, fixed["max_depth"], find, x, used, np.array(root, np.int64).reshape(own.shape), sums_of, meet)
        fields, old = cut(nodes, edges, fixed["max_leaves"], fixed["l1"], fixed["l2"])
        feature, at_most, _, left, right, *_, value = fields
        leaf_of = kept_leaves(nodes, old, feature)
        by_leaf: dict[int, list] = {int(k): [] for k in np.flatnonzero(feature < 0)}
        for n, rows in ends.items():
            by_leaf[int(leaf_of[n])].append(rows)
        if alpha is not None:
            found = together_percentiles({k: np.concatenate([r.take(rows) for rows in own]) for k, own in by_leaf.items()}, alpha, tell)
            for k in by_leaf:
                value[k] = found[k]
        others = rows_of((feature, at_most, left, right), list(by_leaf), x, np.flatnonzero(~bag))
        for k, own in by_leaf.items():
            for rows in (*own, others[k]):
                margin[rows] = margin.take(rows) + rate * value[k]
        made.append((*fields, loss / FIXED / max(1, total)))
    return made, margin


def together_percentiles(leaves: dict[int, np.ndarray], q: float, tell) -> dict[int, float]:
    """The ``q`` percentile of each leaf's residuals over all tasks, 0 for a leaf without any."""
    if tell is None:
        return {k: selected_percentile(v, q) or 0.0 for k, v in leaves.items()}
    parts: dict = {k: [] for k in leaves}
    for told in tell(pickle.dumps({k: around(v, q) for k, v in leaves.items() if len(v)})):
        for k, part in pickle.loads(told).items():
            parts[k].append(part)
    out = {k: met_percentile(own, q) if own else 0.0 for k, own in parts.items()}
    open_ = [k for k, v in out.items() if v is None]
    if open_:
        out.update(group_percentiles(_Told([(np.full(len(leaves[k]), k), leaves[k]) for k in open_], tell), q))
    return out


class _Told:
    """The part of an RDD's methods that ``group_percentiles`` calls, over what the tasks of a barrier stage tell each other:
    ``items`` are this task's until they are reduced, then all tasks' alike."""

    def __init__(self, items: list, tell):
        self.items, self.tell = items, tell

    def mapPartitions(self, f):  # noqa: N802
        return _Told(list(f(iter(self.items))), self.tell)

    def map(self, f):
        return _Told([f(item) for item in self.items], self.tell)

    def reduceByKey(self, add):  # noqa: N802
        total: dict = {}
        for told in self.tell(pickle.dumps(self.items)):
            for key, value in pickle.loads(told):
                total[key] = add(total[key], value) if key in total else value
        return _Told(list(total.items()), self.tell)

    def collect(self) -> list:
        return self.items


def told_through(folder: str, task: int, tasks: int):
    """What each of some tasks that run at once has to tell, as files of a folder that all of them see: bytes to the list of
    all tasks' bytes. A task that has all of one turn knows that all have read the turn before it."""
    turn = 0

    def tell(data: bytes) -> list[bytes]:
        nonlocal turn
        with open(f"{folder}/.{turn}-{task}", "wb") as f:
            f.write(data)
        os.replace(f"{folder}/.{turn}-{task}", f"{folder}/{turn}-{task}")
        out, until = [], time.monotonic() + WAIT_SECONDS
        for other in range(tasks):
            while True:
                try:
                    with open(f"{folder}/{turn}-{other}", "rb") as f:
                        out.append(f.read())
                    break
                except FileNotFoundError:
                    if time.monotonic() > until:
                        raise TimeoutError(f"task {other} of {tasks} tells nothing in {folder}") from None
                    time.sleep(0.0005)
        if turn:
            os.unlink(f"{folder}/{turn - 1}-{task}")
        turn += 1
        return out
    return tell


def rounds_here(fixed: dict, edges: list, start: int, stop: int):
    """mapPartitions function over the one task that holds all blocks: some rounds' trees, (None, arrays and losses), then the blocks with their margins."""
    def run(items: Iterator[tuple]) -> Iterator[tuple]:
        held = sorted(items, key=lambda item: item[0])
        made, margin = rounds_on(fixed, edges, start, stop, list(held))
        yield None, made
        taken = 0
        for block, x, y, _ in held:
            yield block, x, y, margin[taken : taken + len(y)]
            taken += len(y)
    return run


def rounds_together(fixed: dict, edges: list, start: int, stop: int, folder: str, trees, base: float):
    """mapPartitions function of a barrier stage whose tasks hold the blocks (number, (bins, target)): some rounds' trees, from
    the first task. The margins stay in ``folder`` for the next rounds; if those of the rounds before are not there, the
    ``trees`` so far (a broadcast) give them."""
    rate = fixed["learning_rate"]

    def run(items: Iterator[tuple]) -> Iterator[tuple]:
        context = BarrierTaskContext.get()
        task, tasks = context.partitionId(), len(context.getTaskInfos())
        blocks = sorted(items, key=lambda item: item[0])
        rows = sum(len(y) for _, (_, y) in blocks)
        try:
            margin = np.load(f"{folder}/margins-{start}-{task}.npy")
        except FileNotFoundError:
            margin = np.concatenate([np.zeros(0), *(margins_of(x, base, trees.value, rate) for _, (x, _) in blocks)])
        cuts = np.r_[0, np.cumsum([len(y) for _, (_, y) in blocks])].astype(int).tolist()
        held = [(block, x, y, margin[a:b]) for (block, (x, y)), a, b in zip(blocks, cuts, cuts[1:])]
        del blocks, margin
        # one attempt's files are not another's
        mine = f"{folder}/{start}-{context.allGather(str(context.taskAttemptId()))[0]}"
        os.makedirs(mine, exist_ok=True)
        made, margin = rounds_on(fixed, edges, start, stop, held, told_through(mine, task, tasks))
        assert len(margin) == rows
        np.save(f"{folder}/.margins-{stop}-{task}.npy", margin)
        os.replace(f"{folder}/.margins-{stop}-{task}.npy", f"{folder}/margins-{stop}-{task}.npy")
        if task == 0:
            yield from made
    return run


def margins_of(x: np.ndarray, base: float, steps: list[tuple], rate: float) -> np.ndarray:
    """What the trees so far, (feature, bin, left, right, value), predict for the rows of ``x``."""
    margin = np.full(x.shape[1], base)
    for *arrays, value in steps:
        margin = margin + rate * value[walk(*arrays, x)]
    return margin


def evenly(blocks: list[tuple], tasks: int) -> dict[int, int]:
    """A task for each of the (block, rows), largest blocks first to the task with the fewest rows."""
    held, out = [(0, t) for t in range(tasks)], {}
    for block, rows in sorted(blocks, key=lambda b: (-b[1], b[0])):
        size, task = heapq.heappop(held)
        out[block] = task
        heapq.heappush(held, (size + rows, task))
    return out


def _few_values(names: list[str], most: int):
    """mapInArrow function: the distinct values of each column in a task, or ``most`` of them if there are more."""
    def run(batches):
        import pyarrow as pa
        held = {f: np.zeros(0) for f in names}
        for batch in batches:
            for k, f in enumerate(names):
                if len(held[f]) < most:
                    held[f] = np.unique(np.concatenate([held[f], batch.column(k).to_numpy(zero_copy_only=False)]))[:most]
        for f, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(v), pa.string()), pa.array(v, pa.float64())], ["f", "v"])
    return run


def _packer(edges: list[np.ndarray]):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block():
            nonlocal number, held, size
            x, y = np.concatenate([a for a, _ in held], 1), np.concatenate([b for _, b in held])
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([number - 1]), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()), pa.array([len(y)])], ["block", "x", "y", "n"])
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            held.append((np.stack([np.searchsorted(e, c, "left").astype(np.uint8) for e, c in zip(edges, columns)]), columns[-1].astype(np.float64)))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield block()
        if size:
            yield block()
    return run


def _unpacker(n_features: int, base: float, trees: list[Tree], rate: float):
    """Blocks as (block, bins, target, margin); the margin by the trees so far."""
    steps = [(t.feature, t.bin, t.left, t.right, t.value) for t in trees]

    def run(row) -> tuple:
        x, y = np.frombuffer(row["x"], np.uint8).reshape(n_features, -1), np.frombuffer(row["y"], np.float64)
        return row["block"], x, y, margins_of(x, base, steps, rate)
    return run


def _stepper(tree: Tree, rate: float):
    arrays, value = (tree.feature, tree.bin, tree.left, tree.right), tree.value

    def run(item: tuple) -> tuple:
        block, x, y, margin = item
        return block, x, y, margin + rate * value[walk(*arrays, x)]
    return run


def _residuals(arrays: tuple, bag: tuple, leaves: set[int]):
    def run(item: tuple) -> tuple:
        block, x, y, margin = item
        leaf = walk(*arrays, x)
        use = in_bag(bag[0], bag[1], block, len(y), bag[2]) & np.isin(leaf, list(leaves))
        return leaf[use], (y - margin)[use]
    return run


def _all_residuals(item: tuple) -> tuple:
    _, _, y, margin = item
    return np.zeros(len(y), np.int64), y - margin


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The text or node table at ``path``; None if it isn't there."""
    try:
        return spark.read.text(path) if schema == "value string" else spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _meeting_folder(spark: SparkSession) -> str | None:
    """A new folder beside the checkpoints that Python can open in every task; None if the store is one that only Spark reads."""
    at = urlparse(ensure_checkpoint_dir(spark))
    return f"{unquote(at.path).rstrip('/')}/meeting-{uuid4().hex}" if at.scheme in ("", "file") else None


def meeting_tasks(spark: SparkSession) -> int:
    """Tasks of one model that are sure to run at once: half of the cores, as two models train side by side. 1 where the
    number of cores is not known or may change (barrier stages need it)."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true" or conf.get("spark.default.parallelism", None) or conf.get("spark.task.cpus", "1") != "1":
        return 1
    return min(MEETING_TASKS, max(1, spark.sparkContext.defaultParallelism // 2))


def _drop(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else os.unlink(path)


def _store(spark: SparkSession, folder: str, trees: list[Tree], upto: int) -> None:
    """Appends the last trees of the first ``upto`` to the state."""
    records = [r for k, t in enumerate(trees) for r in t.records(upto - len(trees) + k)]
    spark.createDataFrame(records, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/trees/upto={upto}")


def stored_trees(spark: SparkSession, folder: str) -> list[Tree]:
    """The trees trained so far (at most rounds x (2 max_leaves - 1) node records)."""
    table = _stored(spark, f"{folder}/trees", NODE_SCHEMA)
    if table is None:
        return []
    rows = sorted(tuple(r) for r in table.select(*[c.split()[0] for c in NODE_SCHEMA.split(", ")]).distinct().collect())
    trees: list[Tree] = []
    start = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k][0] != rows[start][0]:
            cols = list(zip(*rows[start:k]))
            trees.append(Tree(*(np.array(c, kind) for c, kind in zip(cols[2:10], (np.int64, np.int64, np.float64, np.int64, np.int64, np.float64, np.int64, np.float64))), loss=cols[10][0]))
            start = k
    return trees


@dataclass
class BoostedModel:
    """Fitted ensemble: ``base + learning_rate * sum of the trees' leaf values``.

    Scoring evaluates all trees in one vectorised pass over Arrow batches: a
    projection a tree would make a plan hundreds of levels deep."""

    base: float
    learning_rate: float
    trees: list
    features: tuple
    folder: str | None = None

    def scorer(self):
        """Predictions of a (features x rows) matrix of feature values."""
        base, rate, n = self.base, self.learning_rate, len(self.features)
        # the thresholds of a feature in order: a value's place among them decides every split as the value does
        cuts = [np.unique([t for tree in self.trees for t in tree.threshold[tree.feature == f]]) for f in range(n)]
        steps = []
        for t in self.trees:
            at_most = np.zeros(len(t.feature), np.int64)
            for k in np.flatnonzero(t.feature >= 0):
                at_most[k] = np.searchsorted(cuts[t.feature[k]], t.threshold[k])
            steps.append((t.feature, at_most, t.left, t.right, t.value))

        def run(x: np.ndarray) -> np.ndarray:
            pred = np.full(x.shape[1], base)
            x = np.stack([np.searchsorted(c, v, "left").astype(np.min_scalar_type(len(c))) for c, v in zip(cuts, x)])
            for *arrays, value in steps:
                pred = pred + rate * value[walk(*arrays, x)]
            return pred
        return run

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        return score_all(df, {out: self})

    def history(self) -> list[float]:
        """Mean train loss before each tree."""
        return [t.loss for t in self.trees]

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table: tree, node, feature (name, NULL at leaves), threshold, left, right, gain, rows, value."""
        names = list(self.features)
        rows = [(k, i, names[f] if f >= 0 else None, float(t) if f >= 0 else None, le if f >= 0 else None, r if f >= 0 else None, float(g), n, v if f < 0 else None)
                for k, tree in enumerate(self.trees) for _, i, f, _, t, le, r, g, n, v, _ in tree.records(k)]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, left int, right int, gain double, rows long, value double")


def score_all(df: DataFrame, models: dict[str, BoostedModel]) -> DataFrame:
    """All of ``models``' predictions as columns of ``df``, in one pass over the rows."""
    scorers = {out: (list(m.features), m.scorer()) for out, m in models.items()}
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType(), False) for out in scorers])

    def scored(held: list):
        import pandas as pd
        pdf = held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
        for out, (cols, score) in scorers.items():
            pdf[out] = score(np.ascontiguousarray(pdf[cols].to_numpy(dtype=np.float64).T))
        return pdf

    def run(batches):  # a walk of a tree has a price of its own, so several batches take it together
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= SCORE_ROWS:
                yield scored(held)
                held, size = [], 0
        if held:
            yield scored(held)
    return df.mapInPandas(run, schema)
