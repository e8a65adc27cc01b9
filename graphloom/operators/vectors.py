"""Vector operators.  A stated set of queries is compared with all rows, block by block; no rows are multiplied out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import Config
from ..storage import bound_batches

DEFAULT = Config()
#: Vectors of a block.
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-12) -> Column:
    """A vector of length 1; very short ones are divided by the floor.  The length is an argument of the outer function,
    so that it is worked out once and not for each component."""
    size = F.greatest(norm(a), F.lit(floor))
    return F.get(F.transform(F.array(size), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def fuse(a: Column, b: Column, share: float = DEFAULT.gamma) -> Column:
    """share * a + (1 - share) * b."""
    return F.zip_with(a, b, lambda x, y: F.lit(share) * x + F.lit(1 - share) * y)


def means(vectors: DataFrame, key: str, value: str = "embedding") -> DataFrame:
    """key, pos, mean: the mean vector of each key, one row for each component, so that no group is gathered."""
    return vectors.select(key, F.posexplode(value).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mean_vectors(vectors: DataFrame, key: str, value: str = "embedding") -> DataFrame:
    """key, embedding: the renormalised mean vector."""
    rows = means(vectors, key, value).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("x"))
    return rows.select(key, unit(F.transform("x", lambda s: s["mean"])).alias("embedding"))


def blocks(rows: DataFrame) -> DataFrame:
    """ids, data: rows (id, vector) packed where they are, BLOCK of them at the most to a row."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(part.num_rows, -1)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["ids", "data"])

    return rows.mapInArrow(run, "ids binary, data binary")


def similar(queries: DataFrame, rows: DataFrame, least: float | None = None, k: int | None = None) -> DataFrame:
    """query_id, id, sim of rows (id, vector) for queries (id, vector): those above `least`, or the k best of each, or
    both (the cut at k comes first).  A row is not compared with the query of its own id.

    The stated queries meet all rows block by block: each pair of blocks is one matrix product, wherever Spark places it,
    and only what may stay becomes rows.  A batch holds few such pairs, however many blocks there are."""
    bound_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            for ids, data, qids, qdata in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                at, names = np.frombuffer(ids, "<i8"), np.frombuffer(qids, "<i8")
                s = np.frombuffer(qdata, "<f8").reshape(len(names), -1) @ np.frombuffer(data, "<f8").reshape(len(at), -1).T
                keep = names[:, None] != at[None, :]
                if k is not None and len(at) > k:  # what no block needs to send on
                    keep &= s >= np.partition(np.where(keep, s, -2), len(at) - k, axis=1)[:, len(at) - k][:, None] - 1e-9
                elif k is None:
                    keep &= s > least
                q, r = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(at[r]), pa.array(s[q, r])], ["query_id", "id", "sim"])

    pairs = blocks(rows).crossJoin(blocks(queries).withColumnsRenamed({"ids": "qids", "data": "qdata"}))
    out = pairs.select("ids", "data", "qids", "qdata").mapInArrow(run, "query_id long, id long, sim double")
    if k is not None:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "id"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= k)
        if least is not None:
            out = out.where(F.col("sim") >= least)
    return out


def greedy_filter(edges: DataFrame, nodes: DataFrame, materialise) -> DataFrame:
    """The kept nodes of a filter that drops a node if an earlier kept one is too similar.  edges: a < b (similar);
    nodes: id.  Rounds: who has no undecided or kept earlier neighbour stays, who has a kept one goes; each round
    decides at least the first undecided node, and chains of similar nodes are short in practice."""
    open_nodes, kept, k = nodes.select("id"), None, 0
    while True:
        free = open_nodes.join(edges.join(open_nodes.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")), "id", "left_anti")
        free = materialise(free, f"kept{k}")
        kept = free if kept is None else kept.unionByName(free)
        gone = edges.join(free.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        open_nodes = materialise(open_nodes.join(free, "id", "left_anti").join(gone, "id", "left_anti"), f"open{k}")
        k += 1
        if open_nodes.isEmpty():
            return kept
