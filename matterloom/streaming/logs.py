"""Logs of scenes with one entry each, and tables kept up by a stream (K1, K4).

:func:`scene_log` emits a finish once a scene and a crash once a scene and task, from state that expires when a scene has been
finished for a while. :class:`Deltas` is the sink: each batch writes only its own rows, every few batches are compacted, and a batch
that comes again overwrites what it wrote, so each entry is there exactly once whatever is replayed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that processors with several variables and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "seed {seed}, kind string, task string, ts timestamp"


class SceneLog(StatefulProcessor):
    """A scene's finish and each task's first crash. A scene's state is a row and one for each crashed task; it goes when ``keep_ms`` of
    event time have passed since the scene was finished."""

    def __init__(self, final: str, done: str, crashed: str, keep_ms: int):
        self.final, self.done, self.crashed, self.keep_ms = final, done, crashed, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.finished = handle.getValueState("finished", "ts timestamp")
        self.crashes = handle.getMapState("crashes", "task string", "ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # The first of each in this batch, a frame at a time: a scene has few tasks, whatever its number of events.
        crashes: dict[str, pd.Timestamp] = {}
        finish = None
        for pdf in rows:
            first = pdf[pdf["state"] == self.crashed].groupby("task")["ts"].min()
            for task, ts in first.items():
                crashes[task] = min(ts, crashes.get(task, ts))
            ends = pdf.loc[(pdf["state"] == self.done) & (pdf["task"] == self.final), "ts"]
            if len(ends):
                finish = ends.min() if finish is None else min(finish, ends.min())
        out = []
        for task, ts in sorted(crashes.items()):
            if not self.crashes.containsKey((task,)):
                self.crashes.updateValue((task,), (ts.to_pydatetime(),))
                out.append((key[0], "crashed", task, ts))
        if finish is not None and not self.finished.exists():
            self.finished.update((finish.to_pydatetime(),))
            self.handle.registerTimer(int(finish.timestamp() * 1000) + self.keep_ms)
            out.append((key[0], "finished", self.final, finish))
        yield pd.DataFrame(out, columns=["seed", "kind", "task", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.finished.clear()
        self.crashes.clear()
        yield pd.DataFrame([], columns=["seed", "kind", "task", "ts"])

    def close(self) -> None:
        pass


def scene_log(events: DataFrame, final: str, done: str = "done", crashed: str = "crashed", late: str = "1 hour", keep_ms: int = 86_400_000) -> DataFrame:
    """(seed, kind, task, ts) of a stream of job events (seed, task, state, ts): ``finished`` once a scene, when its task ``final`` is
    ``done``, and ``crashed`` once a scene and task. Of several in one batch the first counts. Events later than ``late`` are left
    out, as Spark's watermark has it."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("seed", "task", "state", F.col("ts").cast("timestamp").alias("ts")).where("seed IS NOT NULL AND task IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    schema = SCHEMA.format(seed=events.schema["seed"].dataType.simpleString())
    return rows.groupBy("seed").transformWithStateInPandas(SceneLog(final, done, crashed, keep_ms), schema, "append", "EventTime")


class Deltas:
    """A table of rows by key, written by the batches of a stream: ``delta/n=<batch>`` are a batch's rows, ``base/n=<batch>`` the table after
    it. With ``first`` a key's first row stays (a log), else its last one counts (states)."""

    def __init__(self, path: str, keys: list[str], first: bool = False, every: int = 16):
        self.path, self.keys, self.first, self.every = path.rstrip("/"), keys, first, every

    def _folder(self, spark: SparkSession, *parts: str):
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path

    def _versions(self, spark: SparkSession, kind: str) -> list[int]:
        """Batches of a kind that were written whole."""
        files, path = self._folder(spark, kind)
        found = [int(x.getPath().getName()[2:]) for x in files.listStatus(path)] if files.exists(path) else []
        return sorted(n for n in found if files.exists(self._folder(spark, kind, f"n={n}", "_SUCCESS")[1]))

    def _read(self, spark: SparkSession, upto: int | None = None, base_below: int | None = None) -> DataFrame | None:
        bases = [n for n in self._versions(spark, "base") if base_below is None or n < base_below]
        base = bases[-1] if bases else -1
        deltas = [n for n in self._versions(spark, "delta") if n > base and (upto is None or n <= upto)]
        paths = [(base, f"{self.path}/base/n={base}")] * bool(bases) + [(n, f"{self.path}/delta/n={n}") for n in deltas]
        rows = None
        for n, path in paths:
            part = spark.read.parquet(path).withColumn("_n", F.lit(n).cast("long"))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return None
        others = [c for c in rows.columns if c not in (*self.keys, "_n")]
        pick = F.min_by if self.first else F.max_by
        if not others:
            return rows.select(*self.keys).distinct()
        return rows.groupBy(*self.keys).agg(pick(F.struct(*others), "_n").alias("_row")).select(*[c if c in self.keys else f"_row.{c}" for c in rows.columns if c != "_n"])

    def read(self, spark: SparkSession) -> DataFrame | None:
        """The table as it is; null before the first batch."""
        return self._read(spark)

    def sink(self):
        """For ``foreachBatch``: keys of a batch are told apart before (one row each), as stateful operators emit them."""

        def write(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            batch.write.mode("overwrite").parquet(f"{self.path}/delta/n={number}")
            if (number + 1) % self.every == 0:
                # From the base before, so that a batch that comes again makes the same base.
                whole = self._read(spark, upto=number, base_below=number)
                whole.write.mode("overwrite").parquet(f"{self.path}/base/n={number}")
                # What the base before was made of is needed no more; what this one was made of stays for a replay.
                for kind, most in (("delta", number - self.every), ("base", number - self.every - 1)):
                    for n in self._versions(spark, kind):
                        if n <= most:
                            files, path = self._folder(spark, kind, f"n={n}")
                            files.delete(path, True)

        return write
