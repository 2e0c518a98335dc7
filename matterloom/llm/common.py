"""What the operators of this subpackage share: written tables, batches, and row keys.

Intermediate tables are written to the folder that the cluster names in ``spark.checkpoint.dir``, which every
executor can reach, so a lost executor costs a re-read and never a lost block.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="matterloom-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a folder of our own serves a local session, as in tests;
    on a cluster other machines would not see it, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_dir()}"


def new_path(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder, not made yet."""
    return f"{shared_dir(spark).rstrip('/')}/matterloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._matterloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._matterloom_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def row_keys() -> Iterator[int]:
    """Numbers that no other task of the same stage gives out; a task that runs again gives the same ones."""
    n = TaskContext.get().partitionId() << 40
    while True:
        yield n
        n += 1


def with_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``_row`` of :func:`row_keys`."""
    keys = row_keys()
    for batch in batches:
        yield pa.record_batch([*batch.columns, pa.array([next(keys) for _ in range(batch.num_rows)], pa.int64())], [*batch.schema.names, "_row"])


@cache
def _libc() -> ctypes.CDLL | None:
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def give_back() -> None:
    """Return freed memory to the system, since a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds at most ``rows`` rows and about ``size`` bytes of text (a single row may be
    larger). After the last one, what the task has freed goes back to the system."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            end, total = at, 0
            while end < batch.num_rows and end - at < rows and (end == at or total + lengths[end] <= size):
                total += int(lengths[end])
                end += 1
            yield batch.slice(at, end - at)
            at = end
    give_back()
