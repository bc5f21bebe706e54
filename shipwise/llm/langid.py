"""Language identification by cross-parsing against suffix automata.

Training: for every label value, up to SAMPLE_DOCS distinct texts of any length
(the smallest hashes of the text) make the language's text of at most
SAMPLE_CHARS characters: an equal piece of each, at a place that its hash
chooses, where what short texts leave goes to the longer ones. A suffix
automaton of it recognises every substring. Both bounds are parameters of
``fit``.

Prediction: a text is parsed greedily into the longest phrases that occur in
the language's text. A language's cross-parsing entropy is phrases *
log2(training length) / characters; the least wins, ties to the smaller label.
Letters are folded to lower case, runs of anything else are one separator. Every
letter of the samples is a symbol of its own: the 62 most frequent have dense
transitions, the others sorted ones; a letter of no sample matches nothing. All
characters of a text are parsed; it is cut into lanes of LANE characters (a
phrase ends there), which step through the automata together as NumPy rows.

score is 1 - least / second least entropy (1 if one language was learned).
``und``, score 0: null or letterless texts, or no language learned.

Defined cases: null labels teach nothing; null doc_ids hash as the empty text;
repeated rows are predicted each on their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import column_bytes, fresh_worker, opened, row_slices, schema_of, shipped, small_batches

SAMPLE_DOCS = 200
SAMPLE_CHARS = 32_768
LANE = 2048
SLICE = 2 << 20
_CLASSES = 64  # with dense transitions: separator, 62 letters, letters of no sample; rarer letters follow
_MISS = 1 << 30


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def class_table(sample: str, letter: np.ndarray) -> np.ndarray:
    """Class of every code point, upper and lower case alike."""
    seen, n = np.unique(code_points([sample.lower()]), return_counts=True)
    seen, n = seen[letter[seen]], n[letter[seen]]
    out = np.where(letter, _CLASSES - 1, 0)
    rank = np.arange(1, len(seen) + 1)
    out[seen[np.lexsort((seen, -n))]] = rank + (rank >= _CLASSES - 1)
    for c in np.flatnonzero(letter):
        low = chr(c).lower()
        if len(low) == 1 and ord(low) != c:
            out[c] = out[ord(low)]
    return out.astype(np.min_scalar_type(out.max()))


def folded(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, runs of separators as one, and the bounds of the texts."""
    cls = table[code_points(texts)]
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    keep = cls > 0
    keep[1:] |= cls[:-1] > 0
    keep[bounds[:-1][bounds[:-1] < len(cls)]] = True
    at = np.r_[0, np.cumsum(keep)]
    return cls[keep], at[bounds]


def automaton(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton: (states x dense classes), -1 where there is none, and rows of state, class and next state for the rarer letters."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in cls.tolist():
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
        last = cur
    out = np.full((len(go), _CLASSES), -1, np.int32)
    rare = []
    for s, edges in enumerate(go):
        dense = [c for c in edges if c < _CLASSES]
        out[s, dense] = [edges[c] for c in dense]
        rare += [(s, c, t) for c, t in edges.items() if c >= _CLASSES]
    return out, np.array(rare, np.int64).reshape(-1, 3)


class Parser:
    """The automata of all languages in one table, and the parsing of many texts at once."""

    def __init__(self, samples: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS):
        self.letter = letters()
        self.langs = sorted(samples)
        texts = {k: "\n".join(v)[:sample_chars] for k, v in samples.items()}
        self.table = class_table("".join(texts.values()), self.letter)
        self.size = int(self.table.max()) + 1
        parts, keys, values, self.roots, self.bits, base = [], [], [], [], [], 0
        for k in self.langs:
            cls, _ = folded([texts[k]], self.table)
            own, rare = automaton(cls)
            # one entry holds the next state's row; a miss restarts at the root and is flagged
            again = np.where(own[0] >= 0, own[0], 0) * _CLASSES + base + _MISS
            parts.append(np.where(own >= 0, own * _CLASSES + base, again[None, :]).astype(np.int32).ravel())
            keys.append((rare[:, 0] * _CLASSES + base) * self.size + rare[:, 1])
            values.append(rare[:, 2] * _CLASSES + base)
            self.roots.append(base)
            self.bits.append(np.log2(max(2, len(cls))))
            base += own.size
        if base >= _MISS:
            raise ValueError("too many languages for this sample size")
        self.go = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.keys, self.values = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, values))
        order = np.argsort(self.keys)
        self.keys, self.values = self.keys[order], self.values[order]

    def _rare(self, state: np.ndarray, cls: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Next entries for letters without dense transitions; ``nxt`` where not even the root has one."""
        for own, flag in ((np.array(self.roots, np.int64)[:, None], _MISS), (state, 0)):
            want = own * self.size + cls
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            nxt = np.where(self.keys[at] == want, self.values[at] + flag, nxt)
        return nxt

    def entropies(self, texts: list[str]) -> np.ndarray:
        """(texts x languages); inf for an empty text."""
        cls, bounds = folded(texts, self.table)
        size = np.diff(bounds)
        lanes = -(-size // LANE)
        doc = np.repeat(np.arange(len(texts)), lanes)
        start = bounds[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        length = np.minimum(LANE, bounds[doc + 1] - start)
        order = np.argsort(-length, kind="stable")
        doc, start, length = doc[order], start[order], length[order]
        state = np.repeat(np.array(self.roots, np.int64)[:, None], len(doc), axis=1)
        phrases = np.ones((len(self.langs), len(doc)), np.int64)
        cls = cls.astype(np.int64)
        dense = np.minimum(cls, _CLASSES - 1)
        rare = bool((cls >= _CLASSES).any())
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
        for p, n in enumerate(active.tolist()):
            at = state[:, :n] + dense[start[:n] + p]
            nxt = self.go.take(at)
            if rare:
                c = cls[start[:n] + p]
                few = np.flatnonzero(c >= _CLASSES)
                nxt[:, few] = self._rare(state[:, few], c[few], nxt[:, few])
            if p:  # a lane's first character opens its first phrase, known or not
                phrases[:, :n] += nxt >> 30
            np.bitwise_and(nxt, _MISS - 1, out=state[:, :n], casting="unsafe")
        total = np.zeros((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            total[:, k] = np.bincount(doc, phrases[k], len(texts))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(size[:, None] > 0, total * np.array(self.bits) / size[:, None], np.inf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        points = self.letter[code_points(texts)]
        at = np.r_[0, np.cumsum([len(t) for t in texts])]
        some = np.diff(np.r_[0, np.cumsum(points)][at]) > 0
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        h = self.entropies(texts)
        best = h.argmin(axis=1)
        if len(self.langs) > 1:
            two = np.partition(h, 1, axis=1)
            score = np.where(some, 1 - two[:, 0] / np.where(some, two[:, 1], 1), 0.0)
        else:
            score = some.astype(float)
        return [self.langs[b] if s else "und" for b, s in zip(best, some)], score.clip(0, 1)


def shares(sizes: list[int], budget: int) -> list[int]:
    """An equal share of the budget for each text; what short texts leave goes to the others."""
    out = [0] * len(sizes)
    for i, k in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        out[k] = min(sizes[k], budget // (len(sizes) - i))
        budget -= out[k]
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Parser:
    """Learns from text and lang of the documents that are not held out; at most ``sample_chars`` characters of ``sample_docs`` distinct texts of each language reach the driver."""
    text = F.col("text").cast("string")
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.length(text) > 0) & F.col("doc_id").isNotNull()).select("lang", text.alias("text"), F.xxhash64(text).alias("h"))
    first = W.partitionBy("lang").orderBy("h")
    sizes = usable.groupBy("lang", "h").agg(F.min(F.length("text")).alias("n")).withColumn("k", F.row_number().over(first))
    chosen: dict[str, list] = {}
    for r in sizes.where(F.col("k") <= min(sample_docs, (sample_chars + 1) // 2)).orderBy("lang", "k").collect():
        chosen.setdefault(r.lang, []).append((r.h, r.n))
    rows = []
    for lang, texts in chosen.items():
        own = shares([n for _, n in texts], sample_chars - len(texts) + 1)  # a line break between two
        rows += [(lang, h, h % (n - m + 1) + 1, m) for (h, n), m in zip(texts, own)]
    if not rows:
        return Parser({})
    schema = T.StructType([usable.schema["lang"], *T.StructType.fromDDL("h long, start int, m int").fields])
    places = docs.sparkSession.createDataFrame(rows, schema)
    pieces = usable.join(F.broadcast(places), ["lang", "h"]).select("lang", "h", F.col("text").substr(F.col("start"), F.col("m")).alias("piece"))
    samples: dict[str, list] = {}
    for r in pieces.groupBy("lang", "h").agg(F.min("piece").alias("piece")).orderBy("lang", "h").collect():
        samples.setdefault(r.lang, []).append(r.piece)
    return Parser(samples, sample_chars)


def _predict(parser, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker()
    parser = opened(parser)
    for batch in batches:
        _, bounds = column_bytes(batch.column(0))
        for i, j in row_slices(bounds, SLICE):
            lang, score = parser.predict([x or "" for x in batch.column(0).slice(i, j - i).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), pa.array(lang), pa.array(score)], [*batch.schema.names[1:], "lang_pred", "score"])


def identify(docs: DataFrame, parser: Parser, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row with lang_pred and score."""
    small_batches(docs)
    flat = docs.select(F.col("text").cast("string").alias("__text"), *carry)
    schema = schema_of(flat.select(*carry), "lang_pred string, score double")
    return flat.mapInArrow(partial(_predict, shipped(docs.sparkSession, parser)), schema)
