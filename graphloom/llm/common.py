"""What the operators of this subpackage share: the shared folder, written intermediate tables, files
that executors write there, and batching of whole texts by bytes."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BATCH_BYTES, bound_batches, delete_at_end, shared_folder  # noqa: F401

#: Bytes of text that a Python worker turns into arrays at once.  A longer single text is taken alone.
CHUNK_BYTES = 1_000_000

def trim() -> None:
    """Give memory that arrays have left back to the system, so that a worker which waits for its next task holds none."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


class Scratch:
    """Written tables and files of one operator call, under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root, self.marked = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}", False

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back: the plan above starts from files, whatever executors are lost later."""
        path = f"{self.root}/{name}"
        with shuffle_cleanup(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        if not self.marked:
            delete_at_end(self.spark, self.root)
            self.marked = True
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table or folder that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Let Spark delete the shuffle files of each write as soon as it ends; its result is in files by then."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def open_fs(uri: str):
    """(filesystem, path) of a URI, on driver or executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, parts) -> int:
    """Write byte strings to a file in one step: readers see the whole file or none, and a retried task
    replaces it with the same content."""
    fs, path = open_fs(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    temporary, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(temporary) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    fs.move(temporary, path)
    return n


def read_file(uri: str, start: int = 0, length: int | None = None) -> bytes:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return f.read_at((f.size() if length is None else start + length) - start, start)


def chunks(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to `most` at the most, or that hold one larger row."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts (with the end); nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    large = column.cast(pa.large_binary())
    if large.null_count:
        large = large.fill_null(b"")
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    data = large.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    base = int(offsets[0]) if len(offsets) else 0
    end = int(offsets[-1]) if len(offsets) else 0
    return data[base:end], (offsets - base if len(offsets) else np.zeros(1, np.int64))


def text_chunks(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in slices of bounded bytes: (slice, bytes, starts)."""
    data, starts = byte_column(batch.column(batch.schema.get_field_index(name)))
    for a, b in chunks(np.diff(starts)):
        yield batch.slice(a, b - a), data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
    trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has (Spark's names are alike in any letter case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_text(df: DataFrame, *columns: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the columns asked for, under the names that operators use."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *columns)
