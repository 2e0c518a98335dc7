"""Intermediate tables and checkpoints in the folder that the cluster names in ``spark.checkpoint.dir``, which all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="matterloom-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a folder of our own serves a local session, as in tests; other machines of a
    cluster would not see it, so that is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_dir()}"


def new_path(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder, not made yet."""
    return f"{shared_dir(spark)}/matterloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: ``df`` as Parquet in the shared folder, read back with its schema."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._matterloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._matterloom_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
