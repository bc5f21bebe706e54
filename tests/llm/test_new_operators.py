"""Hard negatives, language-model scores and phrase collocations against brute force, with their defined cases."""

import collections
import math
import re
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shipwise.llm import chunks, collocations, hard_negatives, lm_score
from shipwise.llm.queries import op11_hard_negatives, op12_lm_scores, op13_phrase_collocations, oracle_sql
from shipwise.oracle.compare import compare

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTORS = "vec_id long, embedding array<double>, label int, score double, block string"
DOCS = "doc_id long, text string, lang string, score double, chunk string"


# ------------------------------------------------------------------ op11
def mined(rows, step=3, positives=5, negatives=3):
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score by hand."""
    q = {}
    for i, v, y, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        q.setdefault(i, ([math.floor(256 * x) for x in v], y))
    out = set()
    for a, (v, y) in q.items():
        if a % step:
            continue
        scored = sorted((-sum(p * r for p, r in zip(v, w)), i, z) for i, (w, z) in q.items() if i != a and len(w) == len(v))
        for s, p, _ in [t for t in scored if t[2] == y][:positives]:
            window = [t for t in scored if t[2] != y and 50 * -s <= 100 * -t[0] <= 95 * -s]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(window[:negatives])}
    return out


def vectors(n=400):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 2)], int(rng.integers(4)), 0.1, "b") for i in range(n)]
    hot = rows[5][1]
    rows += [(n + i, hot, 1 if i % 2 else 2, None, None) for i in range(200)]  # one vector, a third of all rows
    rows += [(n + 300 + i, [float(x) for x in np.round(rng.normal(size=3), 2)], i % 2, None, None) for i in range(12)]  # another length
    rows += [rows[3], rows[6], (9, [0.5] * 6, 0, None, None)]  # rows given twice, an id with two vectors
    rows += [(None, hot, 1, None, None), (2001, None, 1, None, None), (2002, hot, None, None, None), (2004, [1.0, None] * 3, 1, None, None),
             (2007, [float("nan")] + [1.0] * 5, 1, None, None), (2010, [float("inf")] + [1.0] * 5, 1, None, None), (2013, [0.0] * 6, 1, None, None), (2016, [], 1, None, None), (2019, [], 2, None, None)]
    return rows


def answer(df):
    return [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "GROUP", 8)
    monkeypatch.setattr(hard_negatives, "PAGE", 4)
    monkeypatch.setattr(hard_negatives, "SLOT", 2)
    rows = vectors()
    got = answer(hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 3 == 0))
    assert len(got) == len(set(got)) and set(got) == mined(rows)


def test_hard_negatives_of_large_components_and_few_rows(spark):
    rows = [(i, [(-1.0) ** i * 2.0**k for k in range(10, 18)], i % 3, 0.0, "") for i in range(6)]
    got = answer(hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 3 == 0, positives=1))
    assert set(got) == mined(rows, positives=1)
    alone = spark.createDataFrame([(0, [1.0], 1, None, None)], VECTORS)
    assert answer(hard_negatives.mine(alone, F.col("vec_id") % 3 == 0)) == []
    assert answer(hard_negatives.mine(alone.limit(0), F.col("vec_id") % 3 == 0)) == []
    with pytest.raises(Exception, match="too large|2\\*\\*56"):
        answer(hard_negatives.mine(spark.createDataFrame([(0, [1e300], 1, None, None), (1, [1e300], 1, None, None)], VECTORS), F.lit(True)))


def test_zone_map_bounds_hold():
    rng = np.random.default_rng(1)
    a, x = rng.integers(-50, 50, (20, 9)), rng.integers(-50, 50, (40, 9))
    least, most = hard_negatives._bounds(a, x.min(0)[None], x.max(0)[None])
    s = a @ x.T
    assert (least[:, 0] <= s.min(1)).all() and (s.max(1) <= most[:, 0]).all()


def test_window_bounds(spark):
    scores = [-101, -100, -1, 0, 1, 2, 3, 99, 100, 101, 12_345]
    low, high = hard_negatives.window_bounds(F.col("s"), 50, 95)
    for r in spark.createDataFrame([(s,) for s in scores], "s long").select("s", low.alias("lo"), high.alias("hi")).collect():
        fits = [s for s in range(-20_000, 20_000) if 50 * r.s <= 100 * s <= 95 * r.s]
        assert (fits == []) if r.lo > r.hi else (fits[0], fits[-1]) == (r.lo, r.hi)


# ------------------------------------------------------------------ op12
def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), ""]


def lm_rows():
    rng = np.random.default_rng(2)
    vocab = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(60)]
    rows = [(i, " ".join(np.roll(vocab, int(rng.integers(60)))[: int(rng.integers(1, 50))]), "x", 1.0, "c") for i in range(80)]
    rows += [(100, None, None, None, None), (101, "", "x", None, None), (102, " \n\t", None, None, None), (103, "Never SEEN é words", None, None, None), (None, "abc NULL id", None, None, None),
             (104, " ".join(vocab * 300), None, None, None), rows[0], rows[0]]
    return rows


def test_lm_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(chunks, "RANGE_WORDS", 100)
    rows = lm_rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(t for i, text, *_ in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    learn = ~F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
    got = lm_score.score_texts(spark.createDataFrame(rows, DOCS), learn).collect()
    want = collections.Counter((i, len(t := tokens(text)), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, text, *_ in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in got)
    # the order of the words is learned: texts that follow it are likelier than by counts alone
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_lm_defined_cases(spark):
    docs = spark.createDataFrame(lm_rows(), DOCS)
    assert lm_score.score_texts(docs.limit(0), F.lit(True)).count() == 0
    silent = docs.where("text is null or trim(text) = ''")
    assert {(r.n_tokens, r.n_known) for r in lm_score.score_texts(silent, F.lit(True)).collect()} == {(1, 1)}
    got = lm_score.score_texts(docs.limit(5), F.lit(False)).collect()
    assert {(r.train_tokens, r.base_score, r.n_known) for r in got} == {(0, 0.0, 0)} and all(math.isfinite(r.score) for r in got)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    classes = 1 + lm_score.HEAD + lm_score.TAIL
    n, v, once = rng.integers(5, 50, classes), rng.integers(1, 5, classes), rng.integers(0, 3, classes)
    weights, _, unknown, _, _ = lm_score.Model(rng.normal(size=(9, classes)), n, v, once).plain
    z = np.exp(lm_score.class_scores(weights, rng.integers(0, 8, (lm_score.FEATURES, 7))).astype(float))
    p = z / z.sum(1, keepdims=True)
    single = np.arange(classes) <= lm_score.HEAD
    in_class = np.where(single, 1.0, (n / n) * (1 - unknown) + unknown)  # the counts of a class's words sum to n
    assert np.allclose(p @ in_class, 1)


def test_lm_gradient_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm_score, "STRIDE", 1)
    rows, classes = 64, 1 + lm_score.HEAD + lm_score.TAIL
    ready, stats = lm_score.prepare(spark.createDataFrame(lm_rows(), DOCS), F.col("doc_id") % 2 == 0, str(tmp_path / "lm"))
    weights = np.random.default_rng(3).normal(size=(rows + 1, classes)).astype(np.float32)
    seen, want = np.zeros((rows + 1, classes)), np.zeros((rows + 1, classes))
    for r in ready.collect():
        c = lm_score._Chunk(r.asDict())
        for i in np.flatnonzero(c.learn):
            at = [*c.features(np.array([i]), rows)[:, 0], rows]
            p = np.exp(weights[at].astype(float).sum(0))
            p /= -p.sum()
            p[c.kinds[c.seq[i]]] += 1
            for f in at:
                want[f] += p
                seen[f, c.kinds[c.seq[i]]] += 1
    observed = lm_score._gathered(ready.mapInArrow(lm_score._observed(rows, classes), lm_score._SUMS), (rows + 1, classes))
    assert (observed == seen).all() and observed[-1].sum() == sum(r.n for r in stats.collect())
    sent = spark.sparkContext.broadcast(weights)
    got = lm_score._gathered(ready.mapInArrow(lm_score._gradient(sent, 0), lm_score._SUMS), (rows + 1, classes))
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)
    # the steps raise the likelihood of the learning texts
    likelihood = []
    for rounds in (0, 3):
        m = lm_score.fit(ready, stats, rounds=rounds)
        sent = spark.sparkContext.broadcast(m.plain)
        likelihood.append(sum(r.score for r in ready.mapInArrow(lm_score._score(sent), lm_score.RESULT).collect()))
    assert likelihood[1] > likelihood[0]


def test_lm_class_scores_are_formed_in_cache_whatever_the_slices(spark, tmp_path, monkeypatch):
    rows, classes = 64, 1 + lm_score.HEAD + lm_score.TAIL
    ready, _ = lm_score.prepare(spark.createDataFrame(lm_rows(), DOCS), F.lit(True), str(tmp_path / "lm"))
    batches, weights = ready.toArrow().to_batches(), np.random.default_rng(4).normal(size=(rows + 1, classes)).astype(np.float32)
    plain = lm_score.Model(weights, *np.full((3, classes), 9)).plain
    widths, formed = [], lm_score.class_scores

    def class_scores(weights, features, *more):
        widths.append(features.shape[1])
        return formed(weights, features, *more)
    monkeypatch.setattr(lm_score, "class_scores", class_scores)
    monkeypatch.setattr(lm_score, "fresh_worker", lambda: None)
    monkeypatch.setattr(lm_score, "_part", lambda: 0)
    found = []
    for slice_, cached in ((1 << 15, 1 << 10), (100, 16), (37, 64)):
        monkeypatch.setattr(lm_score, "SLICE", slice_)
        monkeypatch.setattr(lm_score, "CACHED", cached)
        widths.clear()
        scores = [r for b in lm_score._score(types.SimpleNamespace(value=plain))(iter(batches)) for r in b.column("score").to_pylist()]
        sums = [lm_score.expand(x, np.float64) for b in lm_score._gradient(types.SimpleNamespace(value=weights), 0)(iter(batches)) for x in b.column("sums").to_pylist()]
        assert widths and max(widths) <= cached
        found.append((np.array(scores), np.concatenate(sums).reshape(-1, classes)))
    for scores, sums in found:
        assert np.allclose(scores, found[0][0], rtol=1e-6) and np.allclose(sums, found[0][1], rtol=1e-4, atol=1e-3)
        assert np.allclose(sums.sum(1), 0, atol=1e-2)  # what one class gains the others lose


def test_lm_gradient_takes_every_position(spark, tmp_path):
    rows, classes = 64, 1 + lm_score.HEAD + lm_score.TAIL
    ready, stats = lm_score.prepare(spark.createDataFrame(lm_rows(), DOCS), F.lit(True), str(tmp_path / "lm"))
    n = np.zeros(classes)
    for r in stats.collect():
        n[r.kind] = r.n
    sent = spark.sparkContext.broadcast(np.zeros((rows + 1, classes), np.float32))
    for offset in (0, 5):
        got = lm_score._gathered(ready.mapInArrow(lm_score._gradient(sent, offset), lm_score._SUMS), (rows + 1, classes))
        assert np.allclose(got[-1], n - n.sum() / classes, rtol=1e-5, atol=1e-3)


def test_lm_query(spark):
    got = op12_lm_scores(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double", "held_out": "boolean"}
    rows = got.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


# ------------------------------------------------------------------ op13
def phrases(rows, least, top=2000, longest=5):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    f = {k: c for k, c in f.items() if c >= least}
    longer = collections.Counter()
    for (lang, p), c in f.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], c)
    out = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and longer[lang, p] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])}


def phrase_rows():
    rng = np.random.default_rng(6)
    vocab = [*"abcdefghijklmnop", "Éa", "zz"]
    rows = []
    for i in range(200):
        w = list(rng.choice(vocab, 30, p=np.r_[np.full(3, 0.2), np.full(15, 0.4 / 15)]))
        w[5:5] = ["New", "York", "city", "hall", "now"] if i % 3 else ["new", "york"]
        rows.append((i, "".join(x + rng.choice([" ", " ", "  ", ", ", "\t", ".\n"]) for x in w), (None, "en", "und", "de")[i % 4], None, None))
    same = ("a a a a a a a b. ", "en", None, None)
    return [*rows, (900, None, "en", None, None), (901, "", None, None, None), (902, " .,! \n", "fr", None, None), (None, *same), (903, *same), (903, *same), (904, "long text " * 3000, "en", None, None)]


@pytest.mark.parametrize(("tile", "dense", "held"), [(11, 32, 1 << 22), (2, 1, 8), (3, 10**9, 1)])
def test_collocations_equal_brute_force(spark, monkeypatch, tile, dense, held):
    monkeypatch.setattr(collocations, "TILE", tile)
    monkeypatch.setattr(collocations, "DENSE", dense)
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "PARTS", 3)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 700)
    monkeypatch.setattr(chunks, "RANGE_WORDS", 50)
    rows = phrase_rows()
    got = [tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, DOCS), least=5, top=40).collect()]
    assert len(got) == len(set(got)) and set(got) == phrases(rows, 5, 40)


def test_symbols_of_a_tile_make_one_row_whatever_the_batches(spark, monkeypatch):
    """Tiles follow each other in a task: no call and no group of its own for each."""
    rng = np.random.default_rng(3)
    rows = sorted({(int(t), int(c)): i for i, (t, c) in enumerate(rng.integers(0, [60, 400], (3000, 2)))}.items())
    want = {t: [(c, i) for (u, c), i in rows if u == t] for (t, _), _ in rows}
    table = collocations.pa.table({"tile": [t for (t, _), _ in rows], "code": [c for (_, c), _ in rows], "id": [i for _, i in rows]})
    monkeypatch.setattr(collocations, "fresh_worker", lambda: None)
    for size in (1, 7, 10_000):
        got = [r for b in collocations._tables(iter(table.to_batches(size))) for r in b.to_pylist()]
        assert {r["tile"]: list(zip(collocations.expand(r["codes"], np.int32).tolist(), collocations.expand(r["counts"], np.int64).tolist())) for r in got} == want
        assert len(got) == len(want)
    assert list(collocations._tables(iter(()))) == []
    monkeypatch.setattr(collocations, "TASK_ROWS", 10)
    many = spark.range(35)
    assert collocations._spread(many) == 4 and collocations._spread(many.limit(0)) == 1  # at most the session's shuffle partitions
    assert collocations._sorted(many.selectExpr("id as tile", "id % 3 as part"), 3).rdd.getNumPartitions() == 3


def test_collocations_defined_cases(spark):
    docs = spark.createDataFrame(phrase_rows(), DOCS)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.where("lang = 'fr'")).count() == 0
    assert collocations.collocations(docs.where("doc_id = 904"), least=100).count() == len(phrases([r for r in phrase_rows() if r[0] == 904], 100))


def test_runs_keep_the_text(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 50)
    for text in (b"word " * 300 + b". " + b"more words, " * 40, b"x" * 500, b"", b"a.b"):
        runs = list(collocations._runs(np.frombuffer(text, np.uint8)))
        assert b"".join(r.tobytes() for r in runs) == text
        assert all(r.tobytes()[-1:] in (b".", b",") for r in runs[:-1])


def test_packed_integers():
    for kind in (np.uint8, np.int32, np.int64, np.uint64):
        x = np.array([0, 1, 200, 7], kind)
        assert (chunks.expand(chunks.squeeze(x), kind) == x).all() and len(chunks.expand(chunks.squeeze(x[:0]), kind)) == 0


# ------------------------------------------------------------------ registered queries
@pytest.mark.parametrize("query", [op11_hard_negatives, op13_phrase_collocations])
def test_queries_equal_sql(spark, duck, query):
    ok, message = compare(query(spark, SF), duck, oracle_sql()[query.__name__])
    assert ok, message
