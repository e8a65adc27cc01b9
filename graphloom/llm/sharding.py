"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0..N-1 in ascending order of doc_id.  A Feistel network over the smallest power of two
that holds N permutes numbers; a result of N or more is put through the network again until it is below N
(cycle walking), which makes the whole a permutation of 0..N-1.  The permuted number p gives shard p mod S
and slot p div S, so counts of shards differ by one at most, slots have no gaps, and both directions can be
computed from the number, N, S and the key alone.

Defined results: a null text has size 1 and the CRC of no bytes; rows that repeat a doc_id are separate rows,
numbered in the order of (size, CRC, text order is not needed: such rows are alike); a null doc_id comes
first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix

#: Rounds of the network, and the default key.
ROUNDS, KEY = 6, 0x5EED


class Permutation:
    """A permutation of range(n), decided by n and the key."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        bits = max(2, (max(n, 1) - 1).bit_length())
        self.n, self.left, self.right = n, np.uint64(bits // 2), np.uint64(bits - bits // 2)
        self.keys = mix(np.arange(rounds, dtype=np.uint64) + np.uint64(mix(np.array([key], np.uint64))[0]))

    def _round(self, value: np.ndarray, key, bits) -> np.ndarray:
        return mix(value ^ key) & ((np.uint64(1) << bits) - np.uint64(1))

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        """Rounds turn by turn change the left half by the right one and the right by the left, so halves may differ in width."""
        a, b = x >> self.right, x & ((np.uint64(1) << self.right) - np.uint64(1))
        order = range(len(self.keys))
        for i in reversed(order) if back else order:
            if i % 2 == 0:
                a = a ^ self._round(b, self.keys[i], self.left)
            else:
                b = b ^ self._round(a, self.keys[i], self.right)
        return (a << self.right) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._network(np.asarray(x, np.uint64), back)
        while len(out := np.flatnonzero(x >= self.n)):
            x[out] = self._network(x[out], back)
        return x.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def backward(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, True)


def shard(documents: DataFrame, shards: int, scratch: Scratch, key: int = KEY) -> DataFrame:
    """doc_id, size, text_crc32, row number, shard and slot of every row; texts are not moved."""
    spark = documents.sparkSession
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "size", "text_crc32")
    # the id's upper part is the partition, ascending with doc_id, the lower 33 bits the place in it
    numbered = scratch.table(ordered.withColumn("at", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("at", 33)
    # a row for each partition
    counts = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    parts = np.array([p for p, _ in counts], np.int64)
    sizes = np.array([n for _, n in counts], np.int64)
    base, n = np.cumsum(sizes) - sizes, int(sizes.sum())

    def run(batches):
        permutation = Permutation(n, key)
        for batch in batches:
            at = np.asarray(batch.column(3))
            row = base[np.searchsorted(parts, at >> 33)] + (at & ((1 << 33) - 1))
            place = permutation.forward(row)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(row), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], ["doc_id", "size", "text_crc32", "row", "shard", "slot"])

    return numbered.mapInArrow(run, "doc_id long, size long, text_crc32 long, row long, shard int, slot long")
