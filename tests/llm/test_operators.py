"""Small tables against brute force, and the defined cases of every operator."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipwise.llm import ann, embed_dedup, langid, minhash, mixing, sentencepiece_codec, substring, token_count, token_file, toxicity
from shipwise.llm.queries import WORD_BPE, op9_source_mixing, piece_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words long, score double, rep string"
SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_rows():
    """Nulls in every column, empty, very long and repeated texts, rows given twice, clashing extra columns."""
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    body = " ".join(rng.choice(vocab, 60))
    near = body.split()
    near[30] = "changed"
    far = " ".join(rng.choice(vocab, 60))
    texts = {1: body, 2: body, 3: " ".join(near), 4: far, 5: "", 6: None, 7: "one two", 8: "one two", 9: " \n\t ", 10: " ".join(rng.choice(vocab, 20_000)),
             11: far.upper() + "!?", 12: "12 34 --", 13: "tail " + body + " " + far, 14: body.replace(" ", "\n")}
    rows = [(i, t, "xx" if i % 2 else "yy", f"s{i % 3}" if i % 4 else None, None, 7, 0.5, "r") for i, t in texts.items()]
    return [*rows, rows[3], (None, body, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_minhash_cases(odd, empty):
    got = {(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    cls = {i: c for i, c, _ in got}
    assert cls[1] == cls[2] == cls[3] == cls[14] == 1 and cls[7] == cls[8] == 7
    assert all(cls[i] == i for i in (4, 5, 6, 9, 10, 12, 13)) and cls[None] is None
    assert {i for i, _, k in got if not k} == {2, 3, 14, 8}
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_equals_brute_force(real):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(real).collect()}
    rows = [(r.doc_id, words(r.text)) for r in real.collect()]
    n = len(rows)
    df = {}
    for _, w in rows:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    idf = {x: 1 + np.log(n / max(c, minhash.IDF_FLOOR * n)) for x, c in df.items()}
    vec = {}
    for i, w in rows:
        tf = {}
        for k in range(max(1, len(w) - 4) if w else 0):
            tf[tuple(w[k : k + 5])] = tf.get(tuple(w[k : k + 5]), 0) + 1
        vec[i] = {g: c * max(1, round(np.mean([idf[x] for x in g]) / minhash.IDF_STEP)) for g, c in tf.items()}
    parent = {i: i for i in vec}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(vec)
    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            shared = vec[a].keys() & vec[b].keys()
            if shared:
                low = sum(min(vec[a][g], vec[b][g]) for g in shared)
                if low / (sum(vec[a].values()) + sum(vec[b].values()) - low) >= minhash.THRESHOLD:
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    assert got == {i: find(i) for i in ids}


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    sampler, h = minhash.Sampler(), rng.integers(0, 2**64, 600, dtype=np.uint64)
    tf, step = rng.integers(1, 3, 600), rng.integers(2, 14, 600)
    a, b = slice(0, 500), slice(100, 600)
    other = np.where(np.arange(600) % 7 == 0, step + 3, step)
    same, both = [], []
    for k in range(6):
        x = sampler(np.array([0]), h[a] ^ np.uint64(k * 77777), tf[a], step[a])
        y = sampler(np.array([0]), h[b] ^ np.uint64(k * 77777), tf[b], other[b])
        same.append((x == y).mean())
    w1, w2 = np.zeros(600), np.zeros(600)
    w1[a], w2[b] = (tf * step)[a], (tf * other)[b]
    both = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs(np.mean(same) - both) < 0.06


def brute_substrings(rows):
    """Kept words of each row; rows that share a doc_id stand at the same place."""
    first, out = {}, []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - 19):
            first[tuple(w[p : p + 20])] = min(first.get(tuple(w[p : p + 20]), (i is not None, i or 0, p)), (i is not None, i or 0, p))
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < (i is not None, i or 0, p):
                gone[p : p + 20] = [True] * 20
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1 << 24, 1 << 14])
def test_substring_equals_brute_force(odd, real, empty, chunk, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", chunk)
    for docs in (odd, real):
        got = substring.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))
        assert sorted(map(tuple, got.collect()), key=str) == brute_substrings([(r.doc_id, r.text) for r in docs.collect()])
    assert substring.dedup_substrings(empty).count() == 0
    with pytest.raises(ValueError):
        substring.dedup_substrings(odd.withColumnRenamed("words", "n_words"), ("doc_id", "n_words"))


def test_mixing(spark, odd, empty, real):
    got = mixing.mixed(odd).collect()
    assert len(got) == odd.count() and all(r.copies <= 3 for r in got)
    assert {r.doc_id: r["size"] for r in got}[6] == 0 and mixing.mixed(empty).count() == 0
    by = {}
    for r in op9_source_mixing(spark, SF).collect():
        by.setdefault(r.target, []).append(r)
    for target, rows in by.items():
        sources = {r.source_size for r in rows}
        assert abs(sum(r.taken for r in rows) - target * len(sources)) <= len(sources) * max(r["size"] for r in rows)
        assert all(r.taken <= 3 * r["size"] for r in rows)
    again = sorted(map(tuple, op9_source_mixing(spark, SF).collect()))
    assert again == sorted(tuple(r) for rows in by.values() for r in rows)
    assert mixing.mixed_copies(real).columns == real.columns


def test_one_capped_source(spark):
    rows = [(i, "w " * 10, "a" if i == 0 else "b") for i in range(20)]
    got = {r.source_size: r.target for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {10: 30.0, 190: 170.0}


def test_token_files(spark, odd, empty, tmp_path, monkeypatch):
    from tokenizers import Tokenizer
    spec = open(public_tokenizers.path(WORD_BPE), encoding="utf-8").read()
    monkeypatch.setattr(token_file, "SHARD_BYTES", 1 << 14)
    monkeypatch.setattr(token_file, "SEGMENT_IDS", 1 << 8)
    token_file.write_token_files(odd, f"{tmp_path}/a", spec)
    got = [tuple(r) for r in token_file.read_token_files(spark, f"{tmp_path}/a").orderBy("start").collect()]
    tokenizer, start = Tokenizer.from_str(spec), 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert [g[0] for g in got] == sorted([r.doc_id for r in odd.collect()], key=lambda x: (x is not None, x or 0))
    for i, at, n, crc in got:
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        assert (at, n, crc) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    token_file.write_token_files(empty, f"{tmp_path}/b", spec)
    assert token_file.read_token_files(spark, f"{tmp_path}/b").count() == 0


def test_plain_words_encode_like_the_whole_text():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from shipwise.llm.segments import pattern_segments
    from shipwise.llm.text import column_bytes
    spec = open(public_tokenizers.path(WORD_BPE), encoding="utf-8").read()
    tokenizer, table, rng = Tokenizer.from_str(spec), token_file.encoder(spec), np.random.default_rng(0)
    texts = ["Don't <|endoftext|> 12.5 ÀÉß×÷", "É́a b\xa0c a\x1cb Σας"] + ["".join(rng.choice(list("aB'1.,<|é É×÷ß́日 \n\tΣ"), 30)) for _ in range(500)]
    ids, at = table.join(*pattern_segments(*column_bytes(pa.array(texts))))
    for t, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_texts_of_more_distinct_segments_than_the_table_holds(monkeypatch):
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    from shipwise.llm import segments
    from shipwise.llm.text import column_bytes
    monkeypatch.setattr(segments, "_BITS", 8)
    monkeypatch.setattr(segments, "LIMIT", 60)
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    texts = ["short one", " ".join(vocab + vocab[::-1]), "", "short one", " ".join(vocab[:100]) + " Don't", " ".join(vocab[50:300])]
    buf, bounds = column_bytes(pa.array(texts))

    spec = open(public_tokenizers.path(WORD_BPE), encoding="utf-8").read()
    tokenizer = Tokenizer.from_str(spec)
    ids, at = token_file.encoder(spec).join(*segments.pattern_segments(buf, bounds))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    model = piece_model()
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids, at, parity = sentencepiece_codec.Encoder(model)(buf, bounds)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [theirs.encode(t) for t in texts] and parity.all()

    unigram = sentencepiece_codec.Model.parse(model)
    unigram.kind = sentencepiece_codec.UNIGRAM
    tokenizer = unigram.tokenizer()
    counter = token_count.Counter(sentencepiece_codec.Model.parse(model))
    assert counter(buf, bounds).tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    empty = column_bytes(pa.array(["", None]))
    assert counter(*empty).tolist() == [0, 0] and len(sentencepiece_codec.Encoder(model)(*empty)[0]) == 0


@pytest.mark.parametrize("sizes", [[1], [0, 0, 0], [5, 0, 1000, 3], [1 << 20], list(range(300)), [1] * 1000])
def test_boundaries_select(sizes):
    values = np.cumsum(sizes)
    b = token_file.Boundaries.encode(values, int(values[-1]))
    assert b.all().tolist() == values.tolist() == [b.select(k) for k in range(len(sizes))]


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 24))
    x[100:160] = x[100] + 0.15 * rng.standard_normal((60, 24))
    x[200:230] = x[200]
    x[230] = 3 * x[200]
    rows = [(i, [float(v) for v in r], i % 3, "e") for i, r in enumerate(x)]
    rows += [(400, None, 1, None), (401, [0.0] * 24, 1, "e"), (402, [float("nan")] * 24, None, "e"), (403, [1.0, None] * 12, 1, "e"), (404, [float("inf")] + [0.0] * 23, 1, "e"),
             (405, [1.0, 2.0], 1, "e"), (406, [2.0, 4.0], 1, "e"), (407, [], 1, "e")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string"), x


def test_embedding_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    df, x = vectors(spark)
    got = {r.vec_id: r for r in embed_dedup.near_duplicate_vectors(df).collect()}
    n = np.linalg.norm(x, axis=1)
    links = (x @ x.T) / np.outer(n, n) >= embed_dedup.THRESHOLD
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([comp[row].min() for row in links])
        if (new == comp).all():
            break
        comp = new
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i].sum() - 1, comp[i], comp[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (400, 401, 402, 403, 404, 407))
    assert (got[405].n_links, got[406].component_id) == (1, 405)
    assert embed_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_codes_of_several_hashes_still_meet():
    rng = np.random.default_rng(2)
    u = rng.standard_normal((400, 64))
    v = u + 0.45 * rng.standard_normal((400, 64))
    cos = (u * v).sum(1) / np.linalg.norm(u, axis=1) / np.linalg.norm(v, axis=1)
    a, b = embed_dedup.codes(u, 2), embed_dedup.codes(v, 2)
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met[cos >= 0.9].mean() > 0.97


def test_nearest_neighbours(spark):
    df, x = vectors(spark)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 400, 20))
    hit = 0
    for q, ranks in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        true = np.lexsort((np.arange(len(x)), -s))[:20]
        hit += len({v for v, _ in ranks.values()} & {*true.tolist()})
        listed = [ranks[k] for k in range(1, 21)]
        assert listed == sorted(listed, key=lambda t: (-t[1], t[0])) and all(abs(s[v] - c) < 1e-9 for v, c in listed)
    assert hit / (20 * len(got)) >= 0.9
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]


def recall(spark, x, ids=None):
    """Share of the true 20 nearest found; every returned score is exact and every query gets 20."""
    n = len(x)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        assert abs(x[r.query_id] @ x[r.vec_id] - r.score) < 1e-9 * max(1, abs(r.score))
        found.setdefault(r.query_id, []).append(r.score)
    hit = 0
    for q in range(0, n, 20):
        s = np.delete(x @ x[q], q)
        assert len(found[q]) == 20
        hit += min(20, sum(v >= np.sort(s)[-20] - 1e-9 for v in found[q]))  # equal scores are as near
    return hit / (20 * len(range(0, n, 20)))


def test_nearest_neighbours_of_unequal_norms_and_a_hot_vector(spark):
    rng = np.random.default_rng(12)
    unit = rng.normal(size=(3000, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert recall(spark, unit * np.exp(0.7 * rng.normal(size=(3000, 1)))) >= 0.9
    hot = unit.copy()
    hot[1000:2000] = unit[7]
    assert recall(spark, hot) >= 0.9


def test_nearest_neighbours_of_several_lengths(spark):
    rng = np.random.default_rng(13)
    rows = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(2500)] + [(2500 + i, [float(v) for v in rng.normal(size=5)]) for i in range(15)]
    rows += [(None, rows[0][1]), rows[40], (9001, [0.0] * 16), (9002, None), (9003, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") >= 2500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    x = {i: np.array(v) for i, v in rows[2500:2515]}
    assert set(got) == set(x)  # vectors that take no part aren't asked for, the rarer length finds all of its own
    for q, listed in got.items():
        want = sorted((-(x[q] @ v), i) for i, v in x.items() if i != q)
        assert [(r, v) for r, v, _ in sorted(listed)] == [(k + 1, i) for k, (_, i) in enumerate(want)]


def test_hilbert_is_a_curve():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    order = points[np.argsort(ann.hilbert(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_language_id(spark, odd, empty, real):
    got = langid.identify(odd, langid.fit(odd), ("doc_id", "score2") if "score2" in odd.columns else ("doc_id",)).collect()
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == odd.count() and all(pred[i] == ("und", 0.0) for i in (5, 6, 9, 12)) and pred[1][0] in ("xx", "yy")
    assert all(0 <= s <= 1 for _, s in pred.values())
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    none = langid.identify(odd, langid.fit(empty)).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("h", langid.held_out(F.col("doc_id")))
    rows = langid.identify(docs, langid.fit(docs), ("lang", "h")).where("h").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_language_sample_spans_all_distinct_texts(spark):
    rng = np.random.default_rng(8)
    vocab = [["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)] for _ in range(4)]

    def text(v, n):
        return " ".join(rng.choice(vocab[v], n))
    # lang a: most rows, and the smallest ids, are copies of one passage; lang c: only long texts
    copied = text(0, 300)
    rows = [(copied, "a")] * 60 + [(text(1, 300), "a") for _ in range(15)] + [(text(2, 300), "b") for _ in range(15)] + [(text(3, 5000), "c") for _ in range(6)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    parser = langid.fit(docs)
    assert parser.langs == ["a", "b", "c"]
    pred, score = parser.predict([text(v, 100) for v in (0, 1, 2, 3)])
    assert pred == ["a", "a", "b", "c"] and score.min() > 0.3
    few = langid.fit(docs, sample_docs=2, sample_chars=100)
    assert few.langs == ["a", "b", "c"] and 2 ** max(few.bits) <= 100
    assert langid.shares([5, 100, 1, 50], 56) == [5, 25, 1, 25]


def test_cross_parsing_counts_phrases():
    parser = langid.Parser({"a": ["abcabd"], "b": ["xyz"]})
    h = parser.entropies(["abcabdab", "xyxz", "q"])
    train = [np.log2(6), np.log2(3)]
    # a: abcabd|ab ; b: eight unseen letters. xyxz: four unseen letters; xy|x|z
    assert np.allclose(h[0], [2 * train[0] / 8, 8 * train[1] / 8]) and np.allclose(h[1], [4 * train[0] / 4, 3 * train[1] / 4])
    cut = parser.entropies(["abd" * 3000])
    assert abs(cut[0, 0] / (train[0] / 3) - 1) < 0.01


def test_cross_parsing_tells_all_letters_apart():
    rng = np.random.default_rng(6)
    letters = [chr(0x4E00 + k) for k in range(200)] + list("abcdefghij")
    words = {k: ["".join(rng.choice(letters, 3)) for _ in range(150)] for k in ("x", "y")}
    train = {k: "".join(rng.choice(w, 900)) + "".join(letters) for k, w in words.items()}
    parser = langid.Parser({k: [t] for k, t in train.items()})
    texts = ["".join(rng.choice(words[k], 40)) for k in "xyxy"]

    def phrases(text, sample):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            n, at = n + 1, at + size
        return n
    expected = [[phrases(t, train[k]) * np.log2(len(train[k])) / len(t) for k in "xy"] for t in texts]
    assert np.allclose(parser.entropies(texts), expected)
    assert parser.predict(texts)[0] == list("xyxy")


def test_sentencepiece(odd, empty):
    import sentencepiece
    model = piece_model()
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = sentencepiece_codec.encode(odd, model, ("doc_id", "text", "words"))
    for r in got.collect():
        assert list(r.ids) == theirs.encode(r.text or "") and r.parity and r.round_trip and r.n_ids == len(r.ids)
    for r in sentencepiece_codec.decode(got, model, ("doc_id",)).join(odd.select("doc_id", F.col("text").alias("t")), "doc_id").collect():
        assert r.text == (r.t or "")
    assert sentencepiece_codec.encode(empty, model).count() == 0


def test_sentencepiece_odd_spaces_and_unigram(spark):
    import sentencepiece
    model = piece_model()
    theirs, rng = sentencepiece.SentencePieceProcessor(model_proto=model), np.random.default_rng(0)
    texts = ["  two  sp ace ", "a▁b ▁c", "▁", " ", "<s> <0x41>", "é́ \x00"] + ["".join(rng.choice(list("ab the1.é日 \n▁"), 25)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(list(r.ids) == theirs.encode(r.text) for r in sentencepiece_codec.encode(rows, model, ("text",)).collect())
    unigram = sentencepiece_codec.Model.parse(model)
    unigram.kind = sentencepiece_codec.UNIGRAM
    tokenizer = unigram.tokenizer()
    for r in token_count.count_tokens(rows, model, ("text",)).collect():
        assert r.n_tokens == len(tokenizer.encode(r.text, add_special_tokens=False).ids), r.text


def test_toxicity_features_of_words_beside_quotes():
    features = toxicity.Features()
    plain = set(features.of_words(["idiots"])[0].tolist())
    for w in ("“Idiots”", "idiots’", "Idiots…", "—idiots—", "idiots's", "<IDIOTS>", "ИДИОТ idiots"):
        assert plain <= set(features.of_words([w])[0].tolist()), w
    one, other = features.of_words(["“Идиот”", "идиот"])
    assert set(other.tolist()) <= set(one.tolist())


def test_token_counts(odd, empty):
    model = sentencepiece_codec.Model.parse(piece_model())
    model.kind = sentencepiece_codec.UNIGRAM
    tokenizer = model.tokenizer()
    for r in token_count.count_tokens(odd, piece_model(), ("doc_id", "text")).collect():
        assert r.n_tokens == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    assert token_count.count_tokens(empty, piece_model()).count() == 0


def labelled(spark, n=600):
    rng = np.random.default_rng(4)
    names, plain = ["muslim", "jewish", "gay", "woman"], ["".join(rng.choice(list("klmnop"), 4)) for _ in range(80)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = list(rng.choice(plain, 20)) + (["dreck"] if toxic else []) + ([names[i // 4 % 4]] if toxic or i % 9 == 0 else [])
        docs.append((i, " ".join(rng.permutation(w)), "e"))
        labels.append((i, int(toxic)))
    docs += [(n, None, "e"), (n + 1, "", None)]
    labels += [(n, None), (None, 1), (0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, predicted string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = {r.doc_id for r in docs.where(langid.held_out(F.col("doc_id"))).collect()}
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held if i < 600]) > 0.97
    assert got[600].score == got[601].score and 0 <= got[600].score <= 1
    mention = spark.createDataFrame([(1, "klmn a muslim woman"), (2, "klmn a jewish man"), (3, "klmn")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score(mention, model).collect()}
    assert max(s.values()) < 0.5
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


def test_swap_penalty_takes_weight_off_identity_terms():
    x = [np.array([0, 2])] * 30 + [np.array([1])] * 30 + [np.array([3])] * 30
    y = np.r_[np.ones(30), np.zeros(60)]
    swapped = [np.array([0, 3])] * 30 + [None] * 30 + [np.array([2])] * 30
    free, _ = toxicity.fit_weights(x, y, swapped, 4, swap_penalty=0.0)
    held, _ = toxicity.fit_weights(x, y, swapped, 4, swap_penalty=10.0)
    assert abs(held[2] - held[3]) < 0.1 * abs(free[2] - free[3])
