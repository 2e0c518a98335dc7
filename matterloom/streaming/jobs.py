"""Streams of job events and trials (K1-K4). Keys are scenes and cases, which are finite; a watermark only lets finished ones expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .logs import Deltas


def latest_states(events: DataFrame, keys: list[str], state: str, order: list[str], **more: Column) -> DataFrame:
    """The last state of each key, and further aggregates by name, that a stream keeps up in update or complete mode (K1)."""
    return events.groupBy(*keys).agg(F.max_by(state, F.struct(*order)).alias(state), *[c.alias(name) for name, c in more.items()])


def upsert(path: str, keys: list[str], every: int = 16):
    """A sink for :func:`latest_states` (K1): each batch's rows stand for those of their keys, see :class:`..logs.Deltas`. A batch that comes
    again gives the same table."""
    return Deltas(path, keys, every=every).sink()


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key, as a crash is recorded once for a scene and task (K1, K4)."""
    return events.dropDuplicates(keys)


def accepted(trials: DataFrame, quota: int, most: int) -> DataFrame:
    """Trials of a stream as long as their case needs more (K2): passed trials, numbered within the case, until ``quota`` have passed or ``most``
    were seen. ``trials`` has case_id, trial_id and passed; within a batch they are taken by trial_id."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, passed = state.get if state.exists else (0, 0)
        left = most - seen
        # Of a batch only the first trials that may still be seen are kept, a frame at a time.
        first = pd.DataFrame({"trial_id": [], "passed": []})
        for pdf in batches:
            part = pdf[["trial_id", "passed"]]
            first = (part if first.empty else pd.concat([first, part])).nsmallest(left, "trial_id") if left > 0 and passed < quota else first
        ok = first["passed"].fillna(False).astype(bool)
        before = passed + ok.cumsum() - ok
        first, ok, before = first[before < quota], ok[before < quota], before[before < quota]
        state.update((seen + len(first), passed + int(ok.sum())))
        yield pd.DataFrame({"case_id": key[0], "trial_id": first["trial_id"][ok].astype("int64"), "sample_id": before[ok].astype("int64")})

    return trials.groupBy("case_id").applyInPandasWithState(run, "case_id long, trial_id long, sample_id long", "seen long, passed long", "append", GroupStateTimeout.NoTimeout)


def fresh(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys were not done before (K3)."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drain what is there into a Parquet table beside ``checkpoint``, and return it as a DataFrame that reads the files, so that no
    rows go through the driver. Each batch is a version; of complete mode the last one counts, of other modes all. A batch that
    comes again overwrites its own."""
    spark, folder = stream.sparkSession, f"{checkpoint.rstrip('/')}-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    versions = sorted(int(x.getPath().getName()[2:]) for x in files.listStatus(path)) if files.exists(path) else []
    if mode == "complete":
        versions = versions[-1:]
    if not versions:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/v={v}" for v in versions])
