"""Connected components of a table of edges, by large-star and small-star rounds; few edges take one task (no edge meets the
driver)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that one task takes (16 bytes each); more go through rounds of joins.
ONE_TASK = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # ends are roots here
        while (label[label] != label).any():
            label = label[label]
        x, y = label[x], label[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[label]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large) or not larger (small) neighbours of each node to the least of its neighbours."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    # a hub's rows are one row each here, so the join can be split where a node has very many
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, component (the least node of its component) of every node that has an edge.  Edges: columns a, b."""
    now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), f"{name}0")
    if now.count() <= ONE_TASK:

        def run(batches):
            held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
            if held:
                found = least_labels(*(np.concatenate(side) for side in zip(*held, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])

        return now.coalesce(1).mapInArrow(run, "node long, component long")
    state, turn = None, 0
    while True:
        turn += 1
        now = scratch.table(_star(_star(now, True), False), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
