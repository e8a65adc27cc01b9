import os
import random

import test_decontaminate
import test_jaccard
import test_repeats
import test_tokens

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st")]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, prose(20)) for i in range(4)]
    shared = prose(50)
    texts = [None, "", "1234 5678 !!", *(prose(rng.randint(5, 120)) for _ in range(40))]
    for _ in range(8):
        w = rng.choice(texts[3:43]).split()
        w[len(w) // 2] = "zzz"
        texts.append(" ".join(w))
    texts += [f"{prose(20)} {shared} {prose(20)}" for _ in range(5)]
    texts += [f"{prose(10)} {items[i % 4][1]} {prose(10)}" for i in range(6)] + texts[5:9]
    docs = [(i, t, rng.choice(["en", "fr"]), "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = [(d, t) for d, t, *_ in docs if t and any(c.isalpha() for c in t)]
    labels = {d: c for d, _, c in test_jaccard.brute(now)}
    now = [(d, t) for d, t in now if labels[d] == d]
    seen, cut = {}, []
    for d, t in now:
        raw = t.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - 99):
            if seen.setdefault(raw[i : i + 100], (d, i)) != (d, i):
                gone[i : i + 100] = [True] * 100
        cut.append((d, bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")))
    bad = {x[0] for x in test_decontaminate.brute(cut, items)}
    left = {d: t for d, t in cut if d not in bad}
    assert len(bad) >= 3 and len(now) < len(docs) - 8 and len(test_repeats.brute(now)) == len(now)

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = dict(zip(left, test_tokens.plain_ids(list(left.values()), 0), strict=True))
    assert {r.doc_id for r in rows} == set(left)
    for d, ids in want.items():
        assert sum(r.length for r in rows if r.doc_id == d) == len(ids)


def test_stages_keep_columns_and_take_nothing(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(1, "one word or two", "en", "s", 15)]):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes and out.count() == len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null and repeated ids, nulls everywhere, a very long text, and columns of the names that operators use."""
    clashing = "doc_id long, text string, lang string, source string, n_chars long, _a int, _b string, _d long, _crc long, _row int, g int, id int, key string, component_id int, item_id long, W string"
    say = "the old mill by the river turned slowly while seven children counted boats and their mother called them home"
    plan = "a quiet garden behind the school grows beans and peas that nobody picks before the first cold night of autumn"
    long = " ".join(f"{a}{b}" for a in dict.fromkeys(plan.split()) for b in range(900))
    texts = [(1, say), (1, say), (1, plan), (None, plan), (None, None), (2, ""), (None, None), (3, long), (4, long + " end")]
    docs = spark.createDataFrame([(d, t, None if i % 2 else "en", None, None, 1, "x", None, 7, i, 2, 3, "k", 4, 5, None) for i, (d, t) in enumerate(texts)], clashing)
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), clashing)
        kept[name] = sorted((r._row, len(r.text or "")) for r in docs.collect())
    assert [r for r, _ in kept["language_id"]] == [0, 1, 2, 3, 7, 8]
    assert [r for r, _ in kept["near_duplicates"]] == [0, 2, 7] or [r for r, _ in kept["near_duplicates"]] == [1, 2, 7]
    assert kept["decontamination"] == kept["repeat_removal"] == kept["near_duplicates"]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {1, 3}


def test_tables_that_no_later_stage_reads_are_deleted(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda spark, docs, sf_dir: docs) for name in ("one", "two", "three")])
    out = corpus_pipeline.run(spark, str(tmp_path))
    folder = os.path.dirname(out.inputFiles()[0].removeprefix("file://"))
    assert os.listdir(os.path.dirname(folder)) == ["three"] and out.count() == 2
