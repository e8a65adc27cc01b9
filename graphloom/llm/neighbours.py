"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced split of a bounded sample.  Every vector goes to the list of its nearest centroid
and, where it lies near a boundary, to further lists (up to REPLICAS, none that a chosen centroid shadows).  The
centroids form a graph in memory; a search walks it.  A query reads the lists whose centroid distance is within a
ratio of the nearest one's.  The ratio is the least for which the search itself, walk and all, finds TARGET of the
true neighbours of a few calibration queries, which are compared with every row; as many other queries measure the
recall.  With an infinite ratio a query reads all lists, which is the exact way.

Lists are stored in blocks of bounded size, so that one that holds a third of all rows is many rows.  Scores are
cosines in double precision of the original vectors.

Defined results: vectors that are null, zero, of another length than the most common one (ties: the longer), or
that hold nulls or non-finite numbers take no part, neither as query nor as candidate; equal scores go to the
smaller vec_id; equal vectors under different ids are neighbours of score 1; of rows that repeat a vec_id the least
vector counts; fewer candidates than k give fewer rows; empty tables give none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Scratch, mix, trim

#: Vectors of a list, about; most lists; sampled vectors for each list; neighbours of a centroid in the graph.
LIST, MOST_LISTS, SAMPLED, DEGREE = 128, 8192, 24, 24
#: Lists a vector is in at the most; how much farther than the nearest these may be; vectors of a stored block; queries taken at once.
REPLICAS, BOUNDARY, BLOCK, QUERIES = 6, 0.15, 1024, 128
#: Calibration queries, and as many that measure; share of their true neighbours that the fitted ratio finds.
CALIBRATION, TARGET = 64, 0.97
#: Bytes of the sample that centroids come from, at the most; it lowers the number of lists where vectors are very long.
SAMPLE_BYTES = 1 << 27


class Graph:
    """Unit centroids, each linked to its nearest and to some far ones; distances are Euclidean between unit vectors."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.float32)
        k = len(centroids)
        near = min(DEGREE, k - 1)
        links = np.zeros((k, near), np.int64)
        for i in range(0, k, 512):
            d = self.c[i : i + 512] @ self.c.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = -np.inf
            links[i : i + 512] = np.argpartition(-d, near - 1, axis=1)[:, :near] if near else links[i : i + 512]
        far = (mix(np.arange(4 * k, dtype=np.uint64)) % np.uint64(max(k, 1))).astype(np.int64).reshape(k, 4)
        # a ring makes the graph connected, so that no list is out of reach
        self.links = np.concatenate([links, far, (np.arange(k)[:, None] + 1) % k], axis=1)
        self.entry = np.unique(np.linspace(0, k - 1, min(8, k)).astype(np.int64))

    def search(self, q: np.ndarray, least: int, ratio: float = 1.0, wide: int = 4) -> np.ndarray:
        """Distances of each query to all centroids that the walk met (inf: not met).  It goes on until the nearest
        centroid not yet expanded is neither within the ratio nor among the `least` nearest."""
        n, k = len(q), len(self.c)
        d = np.full((n, k), np.inf, np.float32)
        todo = np.zeros((n, k), bool)
        d[:, self.entry] = _distance(q @ self.c[self.entry].T)
        todo[:, self.entry] = True
        active, least = np.arange(n), min(least, k)
        while len(active):
            open_ = np.where(todo[active], d[active], np.inf)
            step = min(wide, k)
            best = np.argpartition(open_, step - 1, axis=1)[:, :step]
            value = np.take_along_axis(open_, best, 1)
            limit = np.maximum(np.partition(d[active], least - 1, axis=1)[:, least - 1], d[active].min(1) * ratio)
            go = np.isfinite(value) & (value <= limit[:, None])
            rows, at = np.nonzero(go)
            keep = go.any(1)
            rows, nodes = active[rows], best[rows, at]
            todo[rows, nodes] = False
            to = self.links[nodes]
            rows = np.repeat(rows, to.shape[1])
            to = to.ravel()
            fresh = ~np.isfinite(d[rows, to])
            rows, to = rows[fresh], to[fresh]
            d[rows, to] = _distance(np.einsum("ij,ij->i", q[rows], self.c[to]))
            todo[rows, to] = True
            active = active[keep]
        return d


def _distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dot, 1e-9)).astype(np.float32)


def balanced_centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Means of k parts of nearly equal size: the largest part is split in half, across the line between two means."""
    parts = [np.arange(len(sample))]
    while len(parts) < min(k, len(sample)):
        parts.sort(key=len)
        own = parts.pop()
        x = sample[own]
        a, b = x[0], x[int(np.argmin(x @ x[0]))]
        for _ in range(4):
            side = x @ (a - b) > np.median(x @ (a - b))
            if side.all() or not side.any():
                break
            a, b = x[side].mean(0), x[~side].mean(0)
        order = np.argsort(x @ (a - b), kind="stable")
        parts += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    means = np.stack([sample[p].mean(0) for p in parts])
    size = np.linalg.norm(means, axis=1, keepdims=True)
    return np.where(size > 1e-6, means / np.maximum(size, 1e-6), sample[[p[0] for p in parts]])


def lists_of(graph: Graph, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each vector: the nearest list, and boundary lists that no chosen list shadows."""
    d = graph.search(unit, 2 * REPLICAS)
    most = min(2 * REPLICAS, d.shape[1])
    near = np.argsort(d, axis=1, kind="stable")[:, :most]
    dist = np.take_along_axis(d, near, 1)
    take = dist <= dist[:, :1] * (1 + BOUNDARY)
    take[:, 0] = True
    between = _distance(np.einsum("nik,njk->nij", graph.c[near], graph.c[near]))
    for j in range(1, most):
        shadowed = (take[:, :j] & (between[:, j, :j] < dist[:, j : j + 1])).any(1)
        take[:, j] &= ~shadowed & (take[:, :j].sum(1) < REPLICAS)
    rows, j = np.nonzero(take)
    return rows, near[rows, j]


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls and of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows; the same numbers give the same score wherever they stand."""
    q, v = q / np.abs(q).max(1, keepdims=True), v / np.abs(v).max(1, keepdims=True)
    return (q * v).sum(1) / np.sqrt((q * q).sum(1) * (v * v).sum(1))


def top(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query, vec, score) of the k best rows of a block for each query, itself left out."""
    rough = unit(queries) @ unit(vectors).T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    n = min(k, len(ids))
    limit = np.partition(rough, len(ids) - n, axis=1)[:, len(ids) - n]
    # single precision only prepares: all that may tie with the last one are scored exactly
    q, v = np.nonzero((rough >= limit[:, None] - 1e-5) & np.isfinite(rough))
    # of copies of one vector all tie, which may be every pair of a block
    step = max(1, BATCH_BYTES // (8 * vectors.shape[1]))
    score = np.concatenate([np.zeros(0), *(cosine(queries[q[i : i + step]], vectors[v[i : i + step]]) for i in range(0, len(q), step))])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    head = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - head < k
    return query_ids[q[keep]], ids[v[keep]], score[keep]


def usable(vectors: DataFrame, scratch: Scratch, key: str = "vec_id", value: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, v of the rows that take part, a row for each id, and the vectors' length."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(value).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(fine)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    if sizes is None:
        return rows, 0
    return scratch.table(rows.where(F.size("v") == sizes["n"]).groupBy("vec_id").agg(F.min("v").alias("v")), "usable"), sizes["n"]


def _pack(table: pa.Table) -> pa.Table:
    x = matrix(table.column("v").combine_chunks())
    ids = table.column("id").to_numpy()
    return pa.table({"list": table.column("list")[:1], "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "data": pa.array([x.astype("<f8").tobytes()], pa.binary())})


_PACKED = "list long, ids binary, data binary"


def _scores(pairs: DataFrame, size: int, k: int) -> DataFrame:
    """Best candidates of packed queries (qids, qdata) in packed blocks (ids, data)."""

    def run(batches):
        for batch in batches:
            for qi, qd, vi, vd in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                found = top(np.frombuffer(vi, "<i8"), np.frombuffer(vd, "<f8").reshape(-1, size), np.frombuffer(qi, "<i8"), np.frombuffer(qd, "<f8").reshape(-1, size), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    return pairs.select("qids", "qdata", "ids", "data").mapInArrow(run, "query_id long, vec_id long, score double")


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, each candidate once, in order of rank."""
    # partial lists are cut before the shuffle by the aggregate's map side having one row for each candidate
    once = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    packed = once.groupBy("query_id", F.pmod("vec_id", F.lit(16)).alias("salt")).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id"))), 1, k).alias("x"))
    both = packed.groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("x"))), 1, k).alias("x"))
    return both.select("query_id", F.posexplode("x").alias("rank", "c")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "c.vec_id", (-F.col("c.m")).alias("score"))


def exact(rows: DataFrame, queries: DataFrame, size: int, k: int) -> DataFrame:
    """A bounded set of queries (vec_id, v) against every row, in blocks."""
    own = queries.collect()
    ids, x = np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64).reshape(-1, size)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = top(batch.column(0).to_numpy(), matrix(batch.column(1)), ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return _best(rows.mapInArrow(run, "query_id long, vec_id long, score double"), k)


def near_lists(graph: Graph, unit_queries: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists that each query reads."""
    if not np.isfinite(ratio):
        rows, lists = np.indices((len(unit_queries), len(graph.c)))
        return rows.ravel(), lists.ravel()
    d = graph.search(unit_queries, 8, ratio)
    return np.nonzero(d <= d.min(1, keepdims=True) * ratio)


def dealt(part: pa.RecordBatch, rows: np.ndarray, lists: np.ndarray):
    """Batches of list, id and v for vectors (id, v) that stand in several lists: of bounded bytes, however many lists."""
    step = max(1, BATCH_BYTES // (8 * max(1, len(part.column(1).flatten()) // max(1, part.num_rows))))
    for i in range(0, len(rows), step):
        r = pa.array(rows[i : i + step])
        yield pa.RecordBatch.from_arrays([pa.array(lists[i : i + step].astype(np.int64)), part.column(0).take(r), part.column(1).take(r)], ["list", "id", "v"])


def found_share(graph: Graph, queries: list, ratio: float) -> float:
    """The share of true neighbours (query, [lists of a neighbour]...) that lie in lists which the search reads."""
    rows, lists = near_lists(graph, unit(np.array([q for q, _ in queries], np.float64)), ratio)
    reads: dict[int, set] = {}
    for r, x in zip(rows.tolist(), lists.tolist(), strict=True):
        reads.setdefault(r, set()).add(x)
    hits = [not reads[i].isdisjoint(own) for i, (_, neighbours) in enumerate(queries) for own in neighbours]
    return sum(hits) / len(hits) if hits else 1.0


def fitted_ratio(graph: Graph, queries: list) -> float:
    """The least ratio of a rising sequence for which the search finds TARGET of the true neighbours."""
    ratio = 1.0
    while ratio < 8:
        if found_share(graph, queries, ratio) >= TARGET:
            return ratio
        ratio = 1 + max(0.01, (ratio - 1) * 1.15)
    return float("inf")


def search(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 5, ratio: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score and recall (as measured on other queries) of the neighbours found of every row that
    is_query (over vec_id) selects.  `ratio`: None is fitted, inf is exact."""
    spark = vectors.sparkSession
    rows, size = usable(vectors, scratch)
    n = rows.count() if size else 0
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, recall double")
    room = SAMPLE_BYTES // (8 * size)
    k_lists = int(max(1, min(MOST_LISTS, round(n / LIST), room // SAMPLED)))
    share = min(1.0, SAMPLED * k_lists / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("v").toArrow()
    sample = matrix(sample.column("v").combine_chunks()) if sample.num_rows else matrix(rows.limit(1).select("v").toArrow().column("v").combine_chunks())
    graph = Graph(balanced_centroids(unit(sample), k_lists))
    held = spark.sparkContext.broadcast(graph)

    def assign(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield from dealt(part, *lists_of(held.value, unit(matrix(part.column(1)))))
            trim()

    placed = rows.select("vec_id", "v").mapInArrow(assign, "list long, id long, v array<double>")
    placed = scratch.table(placed, "placed")
    counts = placed.groupBy("list").agg(F.count(F.lit(1)).alias("c"))  # a row for each list
    blocks = placed.join(F.broadcast(counts), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / BLOCK)))
    stored = scratch.table(blocks.groupBy("list", "block").applyInArrow(lambda t: _pack(t.select(["list", "id", "v"])), _PACKED), "lists")

    asked = rows.where(is_query)
    recall = 1.0
    if ratio is None:
        few = asked.orderBy(F.xxhash64("vec_id")).limit(2 * CALIBRATION)
        truth = exact(rows, few, size, k).select("query_id", "vec_id")
        of = truth.join(few.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(placed.select(F.col("id").alias("vec_id"), "list"), "vec_id")
        near = of.groupBy("query_id", "vec_id").agg(F.first("q").alias("q"), F.collect_set("list").alias("lists")).collect()  # 2 * CALIBRATION * k rows
        known: dict[int, tuple] = {}
        for r in near:
            known.setdefault(r["query_id"], (r["q"], []))[1].append(r["lists"])
        queries = [known[q] for q in sorted(known)]
        ratio = fitted_ratio(graph, queries[0::2]) if queries else 1.0
        recall = found_share(graph, queries[1::2], ratio) if queries[1::2] else 1.0
    chosen = ratio

    def choose(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                yield from dealt(part, *near_lists(held.value, unit(matrix(part.column(1))), chosen))
            trim()

    wanted = asked.select("vec_id", "v").mapInArrow(choose, "list long, id long, v array<double>")
    asks = wanted.groupBy("list").agg(F.count(F.lit(1)).alias("c"))
    wanted = wanted.join(F.broadcast(asks), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / QUERIES)))
    packed = wanted.groupBy("list", "block").applyInArrow(lambda t: _pack(t.select(["list", "id", "v"])), _PACKED)
    packed = scratch.table(packed.withColumnsRenamed({"ids": "qids", "data": "qdata"}), "asks")
    return _best(_scores(packed.join(stored, "list"), size, k), k).withColumn("recall", F.lit(float(recall)))
