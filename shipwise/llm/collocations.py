"""Phrase collocations, counted in tiles of frequency-ranked pairs.

Texts are lower-cased (A to Z only), cut into pieces at ``[.,;:!?\\x0A-\\x0D]``
and into words ``[^\\x20\\x09]+``. Everything is counted per language.

1. Chunks of text are numbered by their own vocabularies; the chunks' distinct
   words meet by hash range (``chunks``) and give the word counts of the corpus.
   Words in at least ``least`` places are ranked by frequency within their
   language; the ranks go back to the chunks, so a chunk is now a sequence of
   ranks.
2. Pairs of neighbouring symbols are counted by tile: TILE x TILE ranks. Within
   a chunk a tile with many pairs is counted by ``bincount`` on its cells, the
   others as sorted (cell, count) lists. Rows of one tile are merged, first by
   parts of the chunks, then in all, by whichever of the two fits their number.
3. Pairs in at least ``least`` places become symbols themselves, ranked by
   frequency, and step 2 runs on them: neighbouring frequent pairs overlap in
   a word and make the phrases of three words, and so on up to ``longest``.
   No phrase is missed, as its parts are at least as frequent.
4. Joins by phrase give each cut its counts, and each candidate the most
   frequent longer one that holds it.

A task holds one chunk, or the cells of one tile (TILE x TILE at most) however
many chunks send some; a chunk receives only the symbols that it holds itself.
No dictionary is broadcast.

Defined cases: null texts are empty, a null language is ``und`` (as is the
language of that name); repeated rows count each; texts of any length are cut
at piece borders; a text without words adds nothing; an empty table gives an
empty result; other columns are ignored. Counts are 64-bit and products
decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import rank_rows
from ..session import ensure_checkpoint_dir
from .chunks import CHUNK_BYTES, VOCABULARY, by_language, dealt, expand, lowered, numbered, returned, squeeze, task_number, vocabulary
from .text import U, WordHasher, column_bytes, fresh_worker, small_batches

LEAST = 100
LONGEST = 5
COVER = 100
TOP = 2000
#: A tile is 2**TILE ranks wide; it is counted cell by cell from 1 pair in DENSE cells on.
TILE, DENSE = 11, 32
#: Parts in which the rows of a tile are merged first.
PARTS = 16
#: Cells that a merge holds before it adds them up.
HELD = 1 << 22
#: Rows of tiles that a task is worth starting for.
TASK_ROWS = 1 << 12

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _PIECE.copy()
_GAP[[32, 9]] = True

_CHUNKS = f"chunk long, lang string, n long, seq binary, {VOCABULARY}"
_CELLS = "tile long, part int, chunk long, codes binary, counts binary"


def _runs(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in runs of about CHUNK_BYTES, cut behind the end of a piece."""
    while len(data) > 2 * CHUNK_BYTES:
        cuts = np.flatnonzero(_PIECE[data[CHUNK_BYTES : 2 * CHUNK_BYTES]])
        if not len(cuts):
            cuts = np.flatnonzero(_PIECE[data[2 * CHUNK_BYTES :]]) + CHUNK_BYTES
            if not len(cuts):
                break
        cut = CHUNK_BYTES + int(cuts[0]) + 1
        yield data[:cut]
        data = data[cut:]
    yield data


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh_worker()
    number, held, size, hasher = task_number(), {}, {}, WordHasher()

    def chunk(lang: str) -> pa.RecordBatch | None:
        nonlocal number
        buf = lowered(np.concatenate(held.pop(lang)))
        size.pop(lang)
        word = ~_GAP[buf]
        edge = np.diff(np.r_[False, word, False].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            return None
        ids, words, counts = numbered(buf, word, starts, ends)
        piece = np.cumsum(_PIECE[buf])[starts]
        cut = np.r_[False, piece[1:] != piece[:-1]]
        seq = np.full(len(ids) + int(cut.sum()), -1, np.int32)
        seq[np.arange(len(ids)) + np.cumsum(cut)] = ids
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([number - 1]), pa.array([lang]), pa.array([len(ids)]), pa.array([squeeze(seq)], pa.binary()), *vocabulary(words, counts, hasher)],
            [c.split()[0] for c in _CHUNKS.split(", ")])

    def flushed(least: int):
        for lang in [x for x, n in size.items() if n >= least]:
            if (out := chunk(lang)) is not None:
                yield out
    gap = np.array([10], np.uint8)
    for batch in batches:
        buf, bounds = column_bytes(batch.column(0))
        for lang, a, b in zip(batch.column(1).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
            for run in _runs(buf[a:b]):
                if len(run):
                    held.setdefault(lang, []).extend((run.copy(), gap))
                    size[lang] = size.get(lang, 0) + len(run)
                    if size[lang] >= CHUNK_BYTES:
                        yield from flushed(CHUNK_BYTES)
                    elif sum(size.values()) >= 4 * CHUNK_BYTES:
                        yield from flushed(1)
    yield from flushed(1)


def _tiles(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs of neighbouring symbols, their tile and their cell in it."""
    at = np.flatnonzero((seq[:-1] >= 0) & (seq[1:] >= 0))
    a, b = seq[at], seq[at + 1]
    low = (1 << TILE) - 1
    return at, (a >> TILE) << 32 | b >> TILE, ((a & low) << TILE | b & low).astype(np.int32)


def _added(codes: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of one tile in order, and their sums: by direct address if there are many, else sorted."""
    if len(codes) * DENSE >= 1 << 2 * TILE:
        total = np.bincount(codes, counts, 1 << 2 * TILE)
        cells = np.flatnonzero(total)
        return cells.astype(np.int32), total[cells].astype(np.int64)
    if counts is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        return codes[first], np.diff(np.r_[first, len(codes)])
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(counts[order], first)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each tile of each chunk."""
    fresh_worker()
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            _, tile, code = _tiles(expand(data.as_py(), np.int64))
            if not len(tile):
                continue
            kinds, of = np.unique(tile, return_inverse=True)
            many = np.bincount(of) * DENSE >= 1 << 2 * TILE
            rows = {t: _added(code[of == t], None) for t in np.flatnonzero(many).tolist()}
            rest = np.flatnonzero(~many[of])
            if len(rest):  # all sparse tiles in one sort
                key = np.sort(of[rest].astype(np.int64) << 2 * TILE | code[rest])
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                key, n = key[first], np.diff(np.r_[first, len(key)])
                t, c = key >> 2 * TILE, (key & ((1 << 2 * TILE) - 1)).astype(np.int32)
                cut = np.flatnonzero(np.r_[True, t[1:] != t[:-1], True])
                rows.update((int(t[x]), (c[x:y], n[x:y])) for x, y in zip(cut, cut[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(kinds[t]) for t in rows], pa.int64()), pa.array([(chunk ^ chunk >> 32) % PARTS] * len(rows), pa.int32()), pa.array([chunk] * len(rows), pa.int64()),
                 pa.array([squeeze(c) for c, _ in rows.values()], pa.binary()), pa.array([squeeze(n.astype(np.int64)) for _, n in rows.values()], pa.binary())],
                ["tile", "part", "chunk", "codes", "counts"])


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the cells of consecutive rows of one (tile, part); those under ``least`` go."""
        fresh_worker()
        key, codes, counts, size = None, [], [], 0

        def add():
            nonlocal codes, counts, size
            c, n = _added(np.concatenate(codes), np.concatenate(counts))
            codes, counts, size = [c], [n], 0  # what is added up is one tile at most

        def row():
            add()
            keep = counts[0] >= least
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([0], pa.int64()), pa.array([squeeze(codes[0][keep])], pa.binary()), pa.array([squeeze(counts[0][keep])], pa.binary())],
                ["tile", "part", "chunk", "codes", "counts"]) if keep.any() else None
        for batch in batches:
            tiles, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, now in enumerate(zip(tiles, parts)):
                if key is not None and now != key:
                    if (out := row()) is not None:
                        yield out
                    codes, counts, size = [], [], 0
                key = now
                codes.append(expand(batch.column(3)[i].as_py(), np.int32))
                counts.append(expand(batch.column(4)[i].as_py(), np.int64))
                size += len(codes[-1])
                if size >= HELD:
                    add()
        if key is not None and (out := row()) is not None:
            yield out
    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a cell: a, b, f."""
    fresh_worker()
    for batch in batches:
        for tile, codes, counts in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4)):
            c, f = expand(codes.as_py(), np.int32).astype(np.int64), expand(counts.as_py(), np.int64)
            a, b = (tile >> 32 << TILE) + (c >> TILE), ((tile & 0xFFFFFFFF) << TILE) + (c & ((1 << TILE) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(f)], ["a", "b", "f"])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols (tile, code, id) of consecutive rows of one tile, in the order of the codes, as one row; they take the place
    of counts."""
    fresh_worker()
    held: list = []  # of the last tile so far

    def rows(of: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([t for t, *_ in of], pa.int64()), pa.array([squeeze(c) for _, c, _ in of], pa.binary()), pa.array([squeeze(i) for *_, i in of], pa.binary())],
            ["tile", "codes", "counts"])

    def joined() -> tuple:
        return held[0][0], np.concatenate([c for _, c, _ in held]), np.concatenate([i for *_, i in held])
    for batch in batches:
        tile, code, symbol = (batch.column(k).to_numpy() for k in range(3))
        cut = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]) if len(tile) else np.zeros(1, np.int64)
        out = []
        for x, y in zip(cut, cut[1:]):
            now = (int(tile[x]), code[x:y].astype(np.int32), symbol[x:y].astype(np.int64))
            if held and held[0][0] != now[0]:
                out.append(joined())
                held = []
            held.append(now)
        if out:
            yield rows(out)
    if held:
        yield rows([joined()])


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of the cells of each (tile, chunk), behind the row (chunk -1) that holds the tile's symbols."""
    fresh_worker()
    key, known, symbol = None, None, None
    for batch in batches:
        out = []
        for i, now in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
            if now[2] < 0:
                key, known, symbol = now[:2], expand(batch.column(3)[i].as_py(), np.int32), expand(batch.column(4)[i].as_py(), np.int64)
            elif now[:2] == key:
                codes = expand(batch.column(3)[i].as_py(), np.int32)
                at = np.searchsorted(known, codes).clip(0, len(known) - 1)
                hit = known[at] == codes
                if hit.any():
                    out.append((now[2], now[0], squeeze(codes[hit]), squeeze(symbol[at[hit]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["chunk", "tile", "codes", "symbols"])


def _frequent(least: int):
    def run(table: pa.Table) -> pa.Table:
        """The words of one range in at least ``least`` places: range, lang, word, f."""
        fresh_worker()
        langs, words, totals = [], [], []
        for lang, _, _, held, counts in by_language(table):
            coded = held.dictionary_encode()
            f = np.bincount(np.asarray(coded.indices), counts, len(coded.dictionary)).astype(np.int64)
            often = np.flatnonzero(f >= least)
            langs += [lang] * len(often)
            words.append(coded.dictionary.take(pa.array(often)).cast(pa.large_string()).cast(pa.string()))
            totals.append(f[often])
        return pa.table({"range": pa.array([table.column("range")[0].as_py()] * len(langs), pa.int64()), "lang": pa.array(langs, pa.string()),
                         "word": pa.concat_arrays(words), "f": pa.array(np.concatenate(totals))})
    return run


def _ids(table: pa.Table, symbols: pa.Table) -> pa.Table:
    """For each chunk of one range, the ranks of its words, -1 for rarer ones: chunk, range, values."""
    fresh_worker()
    chunk, values = [], []
    for lang, rows, sizes, words, _ in by_language(table) if table.num_rows else ():
        own = symbols.filter(pc.equal(symbols.column("lang"), lang))
        known = own.column("word").combine_chunks().cast(pa.large_string()).cast(pa.large_binary())
        rank = np.r_[own.column("id").to_numpy(), -1].astype(np.int64)
        at = pc.index_in(words, known).fill_null(len(known)).to_numpy(zero_copy_only=False) if len(known) else np.zeros(len(words), np.int64)
        cut = np.r_[0, np.cumsum(sizes)]
        chunk += rows.column("chunk").to_pylist()
        values += [squeeze(rank[at[a:b]]) for a, b in zip(cut, cut[1:])]
    number = table.column("range")[0].as_py() if table.num_rows else 0
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "range": pa.array([number] * len(chunk), pa.int64()), "values": pa.array(values, pa.binary())})


def _ranked_words(n: int):
    def run(chunk: pa.Table, ranks: pa.Table) -> pa.Table:
        """A chunk's own word numbers become ranks; -1 for rarer words and between pieces."""
        fresh_worker()
        seq = expand(chunk.column("seq")[0].as_py(), np.int32)
        own = np.r_[returned(ranks, expand(chunk.column("hashes")[0].as_py(), U), n), -1]
        return pa.table({"chunk": chunk.column("chunk").slice(0, 1), "seq": pa.array([squeeze(own[seq])], pa.binary())})
    return run


def _ranked_pairs(chunk: pa.Table, symbols: pa.Table) -> pa.Table:
    """A chunk's pairs become symbols, each in the place of its first half; -1 for rarer pairs. A chunk without any goes."""
    fresh_worker()
    if not chunk.num_rows or not symbols.num_rows:
        return pa.table({"chunk": pa.array([], pa.int64()), "seq": pa.array([], pa.binary())})
    seq = expand(chunk.column("seq")[0].as_py(), np.int64)
    at, tile, code = _tiles(seq)
    kinds, order = np.unique(symbols.column("tile").to_numpy(), return_inverse=True)
    codes = [expand(x, np.int32) for x in symbols.column("codes").to_pylist()]
    known = np.concatenate([k << 2 * TILE | c.astype(np.int64) for k, c in zip(order.tolist(), codes)])
    ids = np.concatenate([expand(x, np.int64) for x in symbols.column("symbols").to_pylist()])
    by = np.argsort(known)
    known, ids = known[by], ids[by]
    place = np.searchsorted(kinds, tile).clip(0, len(kinds) - 1)
    key = place << 2 * TILE | code
    found = np.searchsorted(known, key).clip(0, len(known) - 1)
    hit = (kinds[place] == tile) & (known[found] == key)
    out = np.full(max(0, len(seq) - 1), -1, np.int64)
    out[at[hit]] = ids[found[hit]]
    return pa.table({"chunk": chunk.column("chunk").slice(0, 1), "seq": pa.array([squeeze(out)], pa.binary())})


def _spread(df: DataFrame) -> int:
    """In how many tasks rows of tiles are dealt: what they cost follows their number, not their bytes, so Spark is not left
    to put small ones together by size."""
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS)))


def _sorted(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    return df.repartition(tasks, "tile", "part").sortWithinPartitions("tile", "part", *keys)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, n) and (lang, size, phrase, f) of all phrases of up to ``longest`` words in at least ``least`` places."""
    spark = docs.sparkSession
    small_batches(docs)
    folder = folder or f"{ensure_checkpoint_dir(spark)}/phrases-{uuid4().hex}"
    flat = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    flat.mapInArrow(_encode, _CHUNKS).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    total = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    words, n = dealt(chunks)
    words.write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    often = words.groupBy("range").applyInArrow(_frequent(least), "range long, lang string, word string, f long")
    symbols = rank_rows(often, ["lang", F.col("f").desc(), "word"], "id")
    phrases = symbols.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
    levels = [phrases.withColumn("size", F.lit(1))]
    ranks = (spark.read.parquet(f"{folder}/words").groupBy("range").cogroup(symbols.select("range", "lang", "word", "id").groupBy("range"))
             .applyInArrow(_ids, "chunk long, range long, values binary"))
    seqs = (spark.read.parquet(f"{folder}/chunks").select("chunk", "seq", "hashes").groupBy("chunk").cogroup(ranks.groupBy("chunk"))
            .applyInArrow(_ranked_words(n), "chunk long, seq binary"))
    for size in range(2, longest + 1):
        seqs = seqs.checkpoint()
        seqs.mapInArrow(_pairs, _CELLS).write.parquet(f"{folder}/cells-{size}")
        cells = spark.read.parquet(f"{folder}/cells-{size}")
        tasks = _spread(cells)
        parts = _sorted(cells, tasks).mapInArrow(_merge(1), _CELLS)
        often = _sorted(parts.withColumn("part", F.lit(0)), tasks).mapInArrow(_merge(least), _CELLS)
        symbols = rank_rows(often.mapInArrow(_cells, "a long, b long, f long"), [F.col("f").desc(), "a", "b"], "id")
        left = phrases.select(F.col("id").alias("a"), "lang", "phrase")
        right = phrases.select(F.col("id").alias("b"), "last")
        phrases = (symbols.join(left, "a").join(right, "b")
                   .select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f").checkpoint())
        levels.append(phrases.withColumn("size", F.lit(size)))
        if size == longest or phrases.isEmpty():
            break
        tile = F.shiftleft(F.shiftright("a", TILE), 32).bitwiseOR(F.shiftright("b", TILE))
        low = F.lit((1 << TILE) - 1)
        code = F.shiftleft(F.col("a").bitwiseAND(low), TILE).bitwiseOR(F.col("b").bitwiseAND(low))
        tables = (symbols.select(tile.alias("tile"), code.alias("code"), "id").repartition(tasks, "tile").sortWithinPartitions("tile", "code")
                  .mapInArrow(_tables, "tile long, codes binary, counts binary")
                  .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).withColumn("chunk", F.lit(-1).cast("long")))
        held = _sorted(cells.unionByName(tables), tasks, "chunk").mapInArrow(_look_up, "chunk long, tile long, codes binary, symbols binary")
        seqs = seqs.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(_ranked_pairs, "chunk long, seq binary")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return total, out.select("lang", "size", "phrase", "f")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase in a places, of a language of n words, cut into parts in l and r places, scores floor(1000 a n / (l r)) by
    its lowest-scoring cut (of equals the one with the shortest first part). It is dropped if a longer phrase of at least
    ``least`` places holds its words in a row and has at least ``cover`` per cent of its places.
    """
    total, counts = phrase_counts(docs, least, longest)
    counts = counts.checkpoint()
    words = F.split("phrase", " ")
    found = counts.where("size > 1").select("lang", "size", "phrase", words.alias("w"), F.col("f").alias("a"))
    cuts = (found.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest")))
    scored = (cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
              .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
              .join(total, "lang"))
    big = [F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")]
    score = F.call_function("div", big[0] * big[1] * F.lit(1000).cast("decimal(4,0)"), big[2] * big[3])
    best = (scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n")))
    inner = (found.where("size > 2").select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
             .select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
             .groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer")))
    kept = best.join(inner, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(cover)} * a")
    order = W.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
spans AS (
  SELECT lang, m, w, unnest(generate_series(1, len(w) - m + 1)) AS i
  FROM pieces CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
f AS (
  SELECT lang, m, w[i : i + m - 1] AS p, CAST(count(*) AS HUGEINT) AS f FROM spans GROUP BY lang, m, p HAVING count(*) >= 100),
cuts AS (
  SELECT x.lang, x.p, x.f AS a, l.f AS l, r.f AS r, n, k, 1000 * x.f * n // (l.f * r.f) AS score
  FROM (SELECT lang, p, f, k, p[1 : k] AS head, p[k + 1 : m] AS tail FROM (SELECT lang, p, m, f, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1)) x
  JOIN f l ON l.lang = x.lang AND l.p = head JOIN f r ON r.lang = x.lang AND r.p = tail JOIN total ON total.lang = x.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT lang, q, max(f) AS longer
  FROM (SELECT lang, f, p[i : i + s - 1] AS q FROM (
          SELECT lang, f, p, s, unnest(generate_series(1, m - s + 1)) AS i
          FROM (SELECT lang, f, p, m, unnest(generate_series(2, m - 1)) AS s FROM f WHERE m > 2)))
  GROUP BY lang, q),
ranked AS (
  SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
         array_to_string(p, ' ') AS phrase, a, l, r, n, score
  FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.q = best.p WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""
