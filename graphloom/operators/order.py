"""Places in a global order, without one task that sees a whole group; and rows dealt by their number."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of files behind the rows that one task of `spread` gets; most tasks.
PART_BYTES, MOST_PARTS = 4 << 20, 1 << 13


def spread(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """df dealt by keys over as many tasks as its files ask for, so that a task's share doesn't grow with them; `times`:
    rows that will come of each.  Adaptive execution, which leaves this number alone, would put rows that pack well into few."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 60)  # beyond that Spark says that it doesn't know
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size * times / PART_BYTES))
    return df.repartition(min(MOST_PARTS, parts), *keys)


def numbered(df: DataFrame, keys: list[str], order: list[str], materialise: Callable[[DataFrame, str], DataFrame], name: str = "numbered") -> DataFrame:
    """df with `place`: where a row stands among the rows of its keys, from 0, in the given order.  Rows are sorted over
    range partitions and written; a key goes on over partitions by the counts of those before, a row for each."""
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = materialise(ordered.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    base = materialise(parts.withColumn("_base", before).drop("_n"), f"{name}_parts")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "_part"]]
    joined = rows.alias("r").join(base.alias("b"), same)
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("r._at") - F.col("b._first") + F.col("b._base")).alias("place"))
