"""Tables written between steps: iterative operators cut their plans here, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Bytes of an Arrow batch that Spark gives to a Python worker.  Without a bound a batch has 10,000 rows, however long.
BATCH_BYTES = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a single machine, and an error on a cluster, whose
    executors don't share the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="graphloom-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        found = f"file://{_OWN[0]}"
    if "://" not in found:  # in the file system that paths without one mean here
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        if found.startswith("file:/") and not found.startswith("file://"):
            found = f"file://{found.removeprefix('file:')}"
    return found.rstrip("/")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Results may be read from a written folder as long as the application runs; when it ends, the folder goes."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


class Steps:
    """Calling it writes a table under a name (each call in a folder of its own) and gives it back, read from its files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.marked = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", False
        self.written = 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.written += 1
        path = f"{self.root}/{self.written:04d}-{name}"
        df.write.mode("overwrite").parquet(path)
        if not self.marked:
            delete_at_end(self.spark, self.root)
            self.marked = True
        return self.spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold BATCH_BYTES at the most (a single larger row apart)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key, None) or BATCH_BYTES + 1)
    except ValueError:  # a size with a unit was set on purpose
        return
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
