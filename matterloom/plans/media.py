"""Boxes, palettes and streams over stand-in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import palette as colours
from ..operators import vision
from ..sources.shared import new_path
from ..streaming import jobs, logs
from . import query


# Every six values of a vector stand for a box: its low corner, and how far the high one is.
BOXES = """WITH b AS (SELECT vec_id, box::INT AS box, list_transform(embedding[6 * box + 1 : 6 * box + 3], lambda x: x::DOUBLE) AS l, list_transform(embedding[6 * box + 4 : 6 * box + 6], lambda x: abs(x::DOUBLE)) AS s FROM embeddings, range(10) AS r(box)),
  c AS (SELECT vec_id, box, list_transform(range(8), lambda i: l[1] + CASE WHEN i % 2 = 1 THEN s[1] ELSE 0 END) AS x, list_transform(range(8), lambda i: l[2] + CASE WHEN i // 2 % 2 = 1 THEN s[2] ELSE 0 END) AS y, list_transform(range(8), lambda i: l[3] + 0.3 + CASE WHEN i // 4 = 1 THEN s[3] ELSE 0 END) AS z FROM b),
  p AS (SELECT vec_id, box, list_transform(range(1, 9), lambda i: (100 * x[i] + 50 * z[i]) / z[i]) AS x, list_transform(range(1, 9), lambda i: (100 * y[i] + 50 * z[i]) / z[i]) AS y FROM c WHERE list_min(z) > 0)"""


def _boxes(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    pieces = t.embeddings.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.slice(e, k * 6 + 1, 6))).alias("box", "e"))
    low, size = F.slice("e", 1, 3), F.slice("e", 4, 3)
    eye = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    return pieces.select("vec_id", "box", low.alias("low"), F.zip_with(low, size, lambda a, b: a + F.abs(b)).alias("high"), F.lit([*eye[:11], 0.3, *eye[12:]]).alias("world"), F.lit(eye).alias("camera"), F.lit([100.0, 0.0, 50.0, 0.0, 100.0, 50.0, 0.0, 0.0, 1.0]).alias("matrix"))


@query(BOXES + " SELECT vec_id, box, round(list_min(x), 4) AS x_min, round(list_max(x), 4) AS x_max, round(list_min(y), 4) AS y_min, round(list_max(y), 4) AS y_max FROM p")
def range_cull_boxes(t):
    corners = vision.projected(_boxes(t), ["vec_id", "box"])
    return corners.groupBy("vec_id", "box").agg(*[F.round(f(c), 4).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


@query(BOXES + f""", f AS (SELECT vec_id, box, list_transform(x, lambda v: trunc(v)) AS x, list_transform(y, lambda v: trunc(v)) AS y, {vision.FACES} AS f, {vision.FRONT} AS g FROM p)
  SELECT vec_id, box, list_transform(list_filter(range(1, 7), lambda k: g[k] * ((x[f[k][2] + 1] - x[f[k][1] + 1]) * (y[f[k][3] + 1] - y[f[k][1] + 1]) - (y[f[k][2] + 1] - y[f[k][1] + 1]) * (x[f[k][3] + 1] - x[f[k][1] + 1])) < 0), lambda k: (k - 1)::INT) AS faces FROM f""")
def visible_faces(t):
    return vision.visible_faces(_boxes(t), ["vec_id", "box"])


@query()
def palette(t):
    pixels = t.embeddings.select("vec_id", F.slice("embedding", 1, 3).alias("hsv"))
    return colours.drawn(t.embeddings.select("vec_id"), "vec_id", colours.fit(pixels, "hsv", 3, 5, 20), 8)


def _streamed(t, name):
    # A pattern matches a table that is one file, as well as one that is a folder of files.
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.folder}/[{name[0]}]{name[1:]}.parquet")


@query("SELECT user_id, state, n FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n FROM events GROUP BY ALL)")
def stream_job_states(t):
    stream = jobs.latest_states(_streamed(t, "events"), ["user_id"], "event_type", ["ts", "event_id"], n=F.count("*"))
    return jobs.run_once(stream.withColumnRenamed("event_type", "state"), f"states_{uuid.uuid4().hex}", "complete", _checkpoint(t))


@query("""WITH t AS (SELECT user_id AS case_id, event_id AS trial_id, event_type IN ('click', 'purchase') AS passed FROM events), b AS (SELECT *, row_number() OVER w AS seen, coalesce(sum(passed::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sample_id FROM t WINDOW w AS (PARTITION BY case_id ORDER BY trial_id))
  SELECT case_id, trial_id, sample_id::BIGINT AS sample_id FROM b WHERE passed AND sample_id < 4 AND seen <= 12""")
def stream_quota(t):
    trials = _streamed(t, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("trial_id"), F.col("event_type").isin("click", "purchase").alias("passed"))
    return jobs.run_once(jobs.accepted(trials, 4, 12), f"quota_{uuid.uuid4().hex}", "append", _checkpoint(t))


def _checkpoint(t):
    return new_path(t.spark, "stream")


SCENES = "e AS (SELECT user_id AS seed, 'task' || event_id % 3 AS task, event_type AS state, ts FROM events)"


def _scene_events(t):
    return _streamed(t, "events").select(F.col("user_id").alias("seed"), F.concat(F.lit("task"), F.col("event_id") % 3).alias("task"), F.col("event_type").alias("state"), "ts")


@query(f"""WITH {SCENES} SELECT seed, 'crashed' AS kind, task, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM e WHERE state = 'error' GROUP BY ALL
  UNION ALL SELECT seed, 'finished', 'task2', strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') FROM e WHERE state = 'purchase' AND task = 'task2' GROUP BY ALL""")
def stream_scene_log(t):
    log = logs.Deltas(new_path(t.spark, "scene-log"), ["seed", "kind", "task"], first=True)
    stream = logs.scene_log(_scene_events(t), "task2", "purchase", "error")
    stream.writeStream.foreachBatch(log.sink()).option("checkpointLocation", _checkpoint(t)).trigger(availableNow=True).start().awaitTermination()
    # As a text, since the log's instants are of the session's time zone and the table's are of none.
    return log.read(t.spark).withColumn("ts", F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"WITH {SCENES} SELECT seed, task, arg_max(state, ts) AS state FROM e GROUP BY ALL")
def stream_upsert(t):
    table = logs.Deltas(new_path(t.spark, "job-states"), ["seed", "task"], every=1)
    stream = jobs.latest_states(_scene_events(t), ["seed", "task"], "state", ["ts"])
    stream.writeStream.outputMode("update").foreachBatch(table.sink()).option("checkpointLocation", _checkpoint(t)).trigger(availableNow=True).start().awaitTermination()
    return table.read(t.spark)


@query("""SELECT label, round(sum(hits) / sum(n) * 100, 6) AS percent FROM (SELECT label, unnest(embedding) > 0.1 AS hit, 1 AS n, hit::INT AS hits FROM embeddings) GROUP BY ALL""")
def tag_pixel_share(t):
    # A vector stands for a mask of 64 pixels.
    rows = t.embeddings.select("label", F.size(F.filter("embedding", lambda x: x > 0.1)).alias("hits"), F.size("embedding").alias("n"))
    return rows.groupBy("label").agg(F.round(F.sum("hits") / F.sum("n") * 100, 6).alias("percent"))
