import zlib

import numpy as np

from graphloom.llm import langid

EN = "the quick brown fox jumps over the lazy dog while the children were watching from their window and laughing"
DE = "der schnelle braune fuchs springt über den faulen hund während die kinder aus dem fenster zuschauen und lachen"
RU = "быстрая коричневая лиса прыгает через ленивую собаку пока дети смотрят из окна и смеются"


def rows(n=40):
    rng = np.random.default_rng(3)
    return [(i, " ".join(rng.permutation(t.split())), lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * n)]


def test_learns_and_labels_spans(spark):
    docs = spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, text string, lang string, score int")
    model = langid.fit(docs.where(~langid.held_out()))
    assert model.langs == ["de", "en", "ru"]
    cases = [(0, EN), (1, DE.upper()), (2, RU), (3, None), (4, ""), (5, "12 ²Ⅷ !? 中文"[:9]), (6, EN + " " + DE), (7, EN), (7, EN), (8, "x " * 60_000)]
    got = langid.predict(spark.createDataFrame([(i, t, "zz", 1) for i, t in cases], "doc_id long, text string, lang string, spans int"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(cases) and [by[i].lang_pred for i in range(6)] == ["en", "de", "ru", "und", "und", "und"]
    mixed = by[6].spans
    assert [s.lang for s in mixed] == ["en", "de"] and mixed[0].start == 0 and mixed[0].end == mixed[1].start == len(EN) + 1 and mixed[1].end == len(EN + " " + DE)
    assert all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id for r in docs.where(langid.held_out()).collect()}
    assert held == {i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1}


def test_prediction_decides_rows_and_languages(spark):
    model = langid.fit(spark.createDataFrame(rows(), "doc_id long, text string, lang string"))
    cases = [(1, EN, "de", 1), (2, DE, None, 2), (3, "人人生而自由在尊严和权利上一律平等", "en", 3), (4, None, "en", 4), (5, "12 34", "en", 5), (None, RU, "en", 6), (1, EN + " " + DE, "ru", 7)]
    docs = spark.createDataFrame(cases, "doc_id long, text string, lang string, lang_pred int")
    kept = langid.identified(docs, model)
    assert kept.dtypes == docs.dtypes
    assert {(r.lang_pred, r.lang) for r in kept.collect()} - {(7, "de"), (7, "en")} == {(1, "en"), (2, "de"), (6, "ru")} and kept.count() == 4
    assert [r[0] for r in docs.where("doc_id IS NULL").select(langid.held_out()).collect()] == [False]


def test_nothing_learned_and_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert langid.predict(docs, model).count() == 0
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string"), model).collect()] == ["und"]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(30, 3)).astype(np.float32) * 3
    docs = [rng.integers(0, 30, n) for n in (0, 1, 2, 7, 5, 7)]
    for d, path in zip(docs, langid.viterbi(docs, scores, 2.0), strict=True):
        def total(p):
            return sum(scores[w, s] for w, s in zip(d, p, strict=True)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))

        every = [[]]
        for _ in d:
            every = [p + [s] for p in every for s in range(3)]
        assert abs(total(path.tolist()) - max(map(total, every))) < 1e-3


def test_spans_of_letters_with_longer_lower_case():
    text = "İİ abc Ünd"
    path = np.array([0, 0, 1])[: len(langid.words(text.lower()))]
    if len(langid.words(text.lower())) == len(path):
        assert langid.spans_of(text, path, ["a", "b"])[-1][2] == len(text)


def test_held_out_accuracy_of_the_query(spark):
    import os

    import pytest

    from graphloom.llm import queries

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(f"{folder}/documents.parquet"):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    rows = queries.op1_language_spans(spark, folder).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if r.held_out and r.lang is not None and len(r.text or "") > 100]
    assert len(tested) > 100 and sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in rows)
