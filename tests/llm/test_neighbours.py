import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import neighbours as nb
from graphloom.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:1500] = x[500]  # a third alike
    rows = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(10_000 + 50 * i, v, 1, 0.5) for i, v in enumerate(odd)] + [(7, x[7].tolist(), 1, 0.5), (None, x[3].tolist(), 1, 0.5)]
    got = nb.search(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 50 == 0, Scratch(spark, "t")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 3000, 50))
    d = x.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    hit = 0
    for q, own in by.items():
        own.sort(key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and len({r.vec_id for r in own}) == 5
        s = d @ d[q]
        s[q] = -2
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in own)
        truth = np.lexsort((np.arange(3000), -np.round(s, 13)))[:5]
        hit += len(set(truth.tolist()) & {r.vec_id for r in own})
        if 500 <= q < 1500:
            assert [r.vec_id for r in own] == [i for i in range(500, 507) if i != q][:5]
    assert hit / (5 * len(by)) >= 0.9


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0], 1, 0.0), (50, [1.0, 1.0], 1, 0.0), (3, [0.0, 1.0], 1, 0.0)]
    got = nb.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, Scratch(spark, "t")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert nb.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0, Scratch(spark, "t")).count() == 0
    assert nb.search(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") % 50 == 0, Scratch(spark, "t")).count() == 0


def test_infinite_ratio_is_exact_and_columns_may_clash(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    docs = spark.createDataFrame([(i, v.tolist(), 1, 2, 3.0, 4, [5.0]) for i, v in enumerate(x)] + [(50, [9.0] * 24, 1, 2, 3.0, 4, [5.0])], "vec_id long, embedding array<double>, list int, rank int, recall double, id int, v array<double>")
    got = nb.search(docs, F.col("vec_id") % 50 == 0, Scratch(spark, "t"), ratio=float("inf")).collect()
    x[50] = min(x[50].tolist(), [9.0] * 24)  # of rows that repeat an id the least counts
    d = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 1500, 50):
        s = d @ d[q]
        s[q] = -2
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.argsort(-s)[:5].tolist()


def test_graph_reaches_every_centroid():
    rng = np.random.default_rng(1)
    g = nb.Graph(nb.unit(rng.normal(size=(300, 8))))
    q = nb.unit(rng.normal(size=(20, 8)))
    assert np.isfinite(g.search(q, 300)).all()
    near = g.search(q, 10)
    assert (near.argmin(1) == (q @ g.c.T).argmax(1)).mean() >= 0.95


def test_memory_is_bounded_for_many_lists_and_many_copies():
    import tracemalloc

    vectors = pa.array(np.random.default_rng(1).standard_normal((64, 64)).tolist(), pa.list_(pa.float64()))
    part = pa.RecordBatch.from_arrays([pa.array(range(64)), vectors], ["id", "v"])
    rows, lists = np.indices((64, 2000))
    seen = 0
    for batch in nb.dealt(part, rows.ravel(), lists.ravel()):
        assert batch.nbytes < 2 * nb.BATCH_BYTES
        assert np.array_equal(batch.column("list"), lists.ravel()[seen : seen + batch.num_rows])
        assert np.array_equal(batch.column("id"), rows.ravel()[seen : seen + batch.num_rows])
        seen += batch.num_rows
    assert seen == rows.size
    same = np.ones((4000, 64))
    tracemalloc.start()
    q, v, score = nb.top(np.arange(4000), same, np.arange(128), same[:128], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert v[:5].tolist() == [1, 2, 3, 4, 5] and len(q) == 640 and np.allclose(score, 1)
    assert peak < 100_000_000
