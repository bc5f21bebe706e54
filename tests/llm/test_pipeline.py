"""The pipeline against a brute-force version, and its stages on odd tables."""

import numpy as np
import pytest

import corpus_pipeline
from shipwise.llm import langid, minhash

from .test_operators import DOCS, brute_substrings, odd_rows, words

SF = "/root/testdata/sf0.001"


def test_run_equals_stages_by_hand(spark):
    import sentencepiece

    from shipwise.llm import mixing
    from shipwise.llm.queries import piece_model
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    parser = langid.fit(docs)
    kept = [i for i, r in rows.items() if parser.predict([r.text or ""])[0][0] != "und"]
    left = docs.where(docs.doc_id.isin(kept))
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(left).collect()}
    kept = [i for i in kept if classes[i] == i]
    first, texts = {}, {}
    for i in sorted(kept):
        w = words(rows[i].text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first.setdefault(tuple(w[p : p + 20]), (i, p)) != (i, p):
                gone[p : p + 20] = [True] * 20
        text = [x for x, g in zip(w, gone) if not g]
        if text or not w:
            texts[i] = " ".join(text)
    mixed = spark.createDataFrame([(i, t, rows[i].source) for i, t in texts.items()], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies if r["size"] else 0 for r in mixing.mixed(mixed).collect()}
    theirs = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    expected = sorted((i, rows[i].lang, rows[i].source, tuple(theirs.encode(t))) for i, t in texts.items() for _ in range(copies[i]))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in got) == expected
    assert all(r.parity and r.round_trip for r in got)


@pytest.mark.parametrize("rows", [odd_rows(), []], ids=["odd", "empty"])
def test_stages_keep_columns(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_each_stage_acts(spark):
    docs = spark.createDataFrame(odd_rows(), DOCS)
    ids = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert not ids & {5, 6, 9, 12} and ids >= {1, 2, 3, 4, 7, 10, 11, 13, None}
    ids = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert sorted(ids, key=str) == sorted([1, 4, 5, 6, 7, 9, 10, 11, 12, 13, None], key=str)
    out = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, docs, SF).collect()}
    assert 2 not in out and out[13].text == "tail" and out[13].n_chars == 4
    assert len(brute_substrings([(r[0], r[1]) for r in odd_rows()])) == len(odd_rows())
    assert np.isin([5, 6, 9], list(out)).all()


def test_near_dedup_keeps_every_text_of_a_repeated_doc_id(spark):
    rng = np.random.default_rng(9)
    a, b, c, d = (" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)) for _ in range(4))
    rows = [(1, a), (1, b), (2, b), (3, c), (4, d), (4, d), (5, c), (5, a), (5, ""), (5, None), (0, d), (None, c)]
    docs = spark.createDataFrame([(i, t, "l", "s", None, 1, 0.5, "r") for i, t in rows], DOCS)
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str)
    assert got == sorted([(0, d), (1, a), (1, b), (3, c), (5, ""), (None, c)], key=str)


def test_equal_rows_but_for_other_columns_leave_the_same_one(spark):
    """Of rows equal in doc_id and text one stays, whatever the partitions."""
    rows = [(i, f"text number {i} of its own words here", "en", s, i) for i in range(60) for s in ("b", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted(tuple(r) for r in corpus_pipeline.near_dedup(spark, docs.repartition(n), "").collect()) for n in (1, 3, 7)]
    assert kept[0] == kept[1] == kept[2] and {r[3] for r in kept[0]} == {"a"}
