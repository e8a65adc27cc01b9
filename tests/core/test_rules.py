"""Rules and plans that the SQL of the queries can't show alone."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.operators import evaluate, methods, order, search, templates, text_join, vectors
from graphloom.plans import catalogue
from graphloom.sources import files
from graphloom.storage import Steps


def edges(spark, rows):
    return spark.createDataFrame([(h, r, u, f"{i:05d}") for i, (h, r, u) in enumerate(rows)], "h string, r string, u string, seq string")


def test_cases_need_two_beaten_runs(spark):
    rows = [("a", "full", True, 0.5), ("a", "x", False, 0.0), ("a", "y", True, 0.0), ("b", "full", True, 0.4), ("b", "x", False, 0.0), ("b", "y", False, 0.0), ("c", "full", False, 0.9), ("c", "x", False, 0.0), ("c", "y", False, 0.0)]
    got = evaluate.cases(spark.createDataFrame(rows, "qid string, run string, correct boolean, recall double"), "full").collect()
    assert [(r.qid, r.wrong) for r in got] == [("b", 2)]


def test_siblings_of_small_and_large_classes(spark):
    rows = [(f"s{i}", "is_a", "small") for i in range(5)] + [(f"s{i}", "made_from", f"m{i}") for i in range(5)]
    rows += [(f"l{i}", "is_a", "large") for i in range(200)] + [(f"l{i}", "used_for", f"u{i}") for i in range(200)]
    rows += [("t0", "is_a", "two"), ("t1", "is_a", "two"), ("t0", "used_for", "x"), ("t1", "used_for", "y"), ("one", "is_a", "alone")]
    got = templates.comparatives(edges(spark, rows), Steps(spark, "t")).collect()
    by = {}
    for r in got:
        by.setdefault(r["class"], set()).add((r.a, r.b))
    assert len(by["small"]) == 10 and by["two"] == {("t0", "t1")} and "alone" not in by
    assert len(by["large"]) == 600 and len({x for p in by["large"] for x in p}) == 200


def test_pairs_of_predicates_that_share_a_hub_go(spark):
    rows = [(h, "made_from", "A") for h in ("x", "y", "z", "hub")] + [(h, "used_for", "B") for h in ("x", "y", "w")] + [(h, "made_by", "C") for h in ("x", "hub", "v")]
    rows += [("hub", "q", f"n{i}") for i in range(50)]
    got = {(r.u1, r.u2): r.answer for r in templates.intersections(edges(spark, rows)).collect()}
    assert got == {("A", "B"): "x;y", ("C", "B"): "x"}  # A and C share the hub


def test_contained_items_against_search(spark):
    rng = random.Random(2)
    words = ["ab", "abc", "b", "c,", "", "dé", "x\ny"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None]
    items = ["b", "ab c,", "", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(40))]
    items += [t[rng.randint(0, 5) : rng.randint(6, 60)] for t in texts[:30] if t]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = text_join.contained(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == sorted((i, d) for i, x in enumerate(items) for d, t in enumerate(texts) if t is not None and x in t)


def test_blocks_of_vectors_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2300, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    got = {(r.query_id, r.id) for r in vectors.similar(rows.where("id % 20 = 0"), rows, least=0.97).collect()}
    assert got == {(q, i) for q in range(0, 2300, 20) for i in range(2300) if i != q and s[q, i] > 0.97}
    top = vectors.similar(rows.where("id = 40"), rows, k=4).orderBy("rank").collect()
    s[40, 40] = -2
    assert [r.id for r in top] == np.argsort(-s[40])[:4].tolist()


def test_places_in_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(500)]
    got = order.numbered(spark.createDataFrame(rows, "k string, x int, i int").repartition(7), ["k"], ["x", "i"], Steps(spark, "t")).collect()
    want = {}
    for k in ("a", "b", None):
        for place, r in enumerate(sorted(r for r in rows if r[0] == k)) if k else enumerate(sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])):
            want[r[2]] = place
    assert {r.i: r.place for r in got} == want


def test_a_cluster_needs_a_shared_folder():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
    assert storage.shared_folder(session("local[4]")).startswith("file:///")
    with pytest.raises(RuntimeError):
        storage.shared_folder(session("spark://host:7077"))


def test_methods_by_name(spark):
    assert set(methods.METHODS) == {"direct", "know", "know+", "fmt", "graph", "react", "walk"}
    with pytest.raises(ValueError):
        methods.retrieve("none", {})
    chains = spark.createDataFrame([("q", "support", 1.0, ["a|r|b", "b|r|c"]), ("q", "partial", 2.0, ["a|r|b", "x|r|y"])], "qid string, verdict string, score double, edges array<string>")
    assert [(r.h, r.u) for r in methods.retrieve("walk", {"chains": chains, "budget": 3}).orderBy("k").collect()] == [("a", "b"), ("x", "y"), ("b", "c")]


def test_agent_numbers_facts_for_good(spark):
    fact = "array<struct<h:string,r:string,u:string>>"
    shown = spark.createDataFrame([("a", [("a", "r", "1"), ("a", "r", "2")]), ("b", [("b", "r", "3")])], f"entity string, facts {fact}")
    q = spark.createDataFrame([("q", "x")], "qid string, question string")
    script = ['{"action": "expand", "arg": "a"}', '{"action": "expand", "arg": "nobody", "keep": [9, 2]}', '{"action": "search", "arg": "z"}', '{"action": "expand", "arg": "b"}', '{"action": "finish", "keep": [3, 1, 2]}']
    decide = lambda question, history, seen: F.element_at(F.array(*map(F.lit, script)), F.size(history) + 1)
    got = methods.react(q, decide, shown, Steps(spark, "t"), keep=2).orderBy("k").collect()
    assert [r.u for r in got] == ["2", "3"]


def test_every_query_but_few_has_sql():
    missing = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert missing == {"beam_walk"} and len(catalogue.queries()) > 160


def test_visual_floor_is_the_one_of_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    for m in (2, 6, 12, 18):  # 6 * 0.6 / 0.4 is 9 in decimals and below 9 in doubles; 2 of 5 is the share itself
        rows = [(f"v{i:02d}", True) for i in range(m)] + [(f"t{i:02d}", False) for i in range(m * 3 // 2 + (m > 2))]
        items = spark.createDataFrame(rows, "qid string, multimodal boolean")
        keep = int(duckdb.execute("SELECT floor(CAST(? AS BIGINT) * 0.6 / 0.4)", [m]).fetchone()[0])
        got = sorted(r.qid for r in templates.visual_floor(items, 0.4).collect() if not r.multimodal)
        assert got == [f"t{i:02d}" for i in range(keep)]


def plain_evidence(rows, budget, way, numbers):
    chains = [r[3] for r in sorted((r for r in rows if r[1] != "reject"), key=lambda r: (search.VERDICTS.index(r[1]) if r[1] in search.VERDICTS else 2, -r[2], r[3]))]
    every = list(dict.fromkeys(e for c in chains for e in c))
    chosen = list(dict.fromkeys(every[i - 1] for i in numbers or [] if 1 <= i <= min(40, len(every))))[:budget]
    if way == "best" or (way == "choice" and len(every) <= budget):
        return every[:budget]
    return chosen if way == "choice" and chosen else search.by_turns(chains, budget)


def test_evidence_is_a_column_function_and_the_plain_fold(spark):
    rng = random.Random(3)
    verdicts = ["support", "partial", "none", "reject", "other", None]
    rows = [(f"q{q:02d}", rng.choice(verdicts), rng.choice([0.5, 1.0, 2.0]), [f"e{rng.randrange(9)}" for _ in range(rng.randrange(6))]) for q in range(40) for _ in range(rng.randrange(1, 5))]
    numbers = {f"q{q:02d}": rng.choice([None, [], [99], [0, 3, 3, 1, 2], [2, 41]]) for q in range(0, 40, 2)}
    chains = spark.createDataFrame(rows, "qid string, verdict string, score double, edges array<string>")
    picks = spark.createDataFrame(list(numbers.items()), "qid string, numbers array<int>")
    for way in ("turns", "best", "choice"):
        out = search.evidence(chains, 3, way, picks if way == "choice" else None)
        assert "Arrow" not in out._jdf.queryExecution().executedPlan().toString()  # no Python task for each question
        want = {(q, i + 1, e) for q in {r[0] for r in rows} for i, e in enumerate(plain_evidence([r for r in rows if r[0] == q], 3, way, numbers.get(q)))}
        assert {(r.qid, r["rank"], r.edge) for r in out.collect()} == want


def test_rest_of_a_cut_sentence_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = ["a" * 2000 + "\n" + "b" * 50, "a" * 1999 + "\n b", "a" * 2000 + " \n " + "b. Next one.", "a" * 3999 + " \tzz. More."]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
        want = set(db.execute(catalogue.oracle_sql()["document_paragraphs"]).fetchall())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reader = SimpleNamespace(read=SimpleNamespace(parquet=lambda path: frame))
    assert {tuple(r) for r in catalogue.queries()["document_paragraphs"](reader, "").collect()} == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_roots_meet_in_one_group(spark):
    q = spark.createDataFrame([("q",), ("r",)], "qid string")
    m = spark.createDataFrame([("q", 0, "a", None, 0.0), ("q", 1, None, "b", 0.6), ("q", 2, None, "c", 0.5), ("x", 0, "a", None, 0.0)], "qid string, pos int, name string, near string, sim double")
    i = spark.createDataFrame([("q", "d", 0.9), ("q", "e", -0.5), ("r", "a", -0.1)], "qid string, name string, score double")
    t = spark.createDataFrame([("q", "e", 1.0), ("r", "a", 0.2), ("r", "b", 0.19), ("r", "c", 0.1)], "qid string, name string, score double")
    out = methods.roots(q, m, i, t)
    assert sorted((r.qid, r.k, r.name) for r in out.collect()) == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, "d"), ("r", 1, "b"), ("r", 2, "a")]
    assert "Join" not in plan(out)


def test_an_agent_stops_where_no_question_goes_on(spark):
    steps, names = Steps(spark, "stop"), []
    q = spark.createDataFrame([("q", "where is a")], "qid string, question string")
    shown = methods.facts(edges(spark, [("a", "is", "b")]))
    out = methods.react(q, methods.expand_first, shown, lambda df, name: names.append(name) or steps(df, name))
    assert [(r.h, r.r, r.u) for r in out.collect()] == [("a", "is", "b")] and len(names) == 2  # expand, finish


def test_questions_are_dealt_before_they_are_grouped(spark):
    arms = [spark.createDataFrame([(f"q{i}",) for i in range(n)] * 2, "qid string") for n in (5, 3, 4)]
    out = evaluate.common(*arms)
    assert sorted(r.qid for r in out.collect()) == ["q0", "q1", "q2"] and "REPARTITION_BY_NUM" in plan(out)
    questions = spark.createDataFrame([("q", "who made the old mill, the old Mill?")], "qid string, question string")
    roots = search.question_roots(questions, spark.createDataFrame([("old mill",), ("mill",), ("absent",)], "name string"))
    assert [(r["rank"], r.name) for r in roots.orderBy("rank").collect()] == [(1, "old mill"), (2, "mill")]
    assert "REPARTITION_BY_NUM" in plan(roots)


def test_hashes_that_share_most_bits_are_no_rows_of_pairs(spark):
    rows = spark.createDataFrame([(i, i * 7) for i in range(300)], "id long, hash long")
    known = spark.createDataFrame([(i, i * 3) for i in range(300, 0, -1)], "match long, hash long")
    out = files.best_matches(rows, known, most=2)
    want = {}
    for i in range(300):
        d, m = min(((i * 7) ^ (j * 3)).bit_count() * 1000 + j for j in range(1, 301)).__divmod__(1000)
        if d <= 2:
            want[i] = (m, d)
    assert {r.id: (r.match, r.distance) for r in out.collect()} == want and "band" not in plan(out)


def test_pairs_of_blocks_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 30))
        v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "id long, v array<double>")
        assert vectors.similar(v, v, k=1).count() == 4
        assert int(spark.conf.get(key)) <= storage.BATCH_BYTES
    finally:
        spark.conf.set(key, before)
