"""As-of joins in parts, crash records, snapshots of searches, and boxes, against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from matterloom.functions import text as fx
from matterloom.operators import runs, search, vision
from matterloom.sources import corpus


def test_running_over_parts(spark):
    rng = random.Random(3)
    data = [(k, i, rng.choice([None, None, rng.randint(0, 9)]), rng.choice([None, rng.randint(0, 99)])) for k in ("a", "b", None) for i in range(50)]
    for upto in (0, -1):
        want = []
        for key in ("a", "b", None):
            mine = [r for r in data if r[0] == key]
            for n, (_, i, _, _) in enumerate(mine):
                seen = mine[: n + 1 + upto]
                last = [r[2] for r in seen if r[2] is not None]
                least = [r[3] for r in seen if r[3] is not None]
                want.append((key, i, last[-1] if last else None, min(least) if least else None))
        df = spark.createDataFrame(rng.sample(data, len(data)), "k string, i int, x int, y int")
        for part in (1, 4, 1000):
            got = runs.running(df, ["k"], ["i"], F.floor(F.col("i") / part), last={"last_x": F.col("x")}, least={"least_y": F.col("y")}, upto=upto)
            assert got.columns == ["k", "i", "x", "y", "last_x", "least_y"]
            assert sorted(((r.k, r.i, r.last_x, r.least_y) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert runs.running(df.limit(0), ["k"], ["i"], F.lit(0), last={"z": F.col("x")}).collect() == []


def test_crash_records_name_the_last_stage_and_node(spark):
    lines = ["[coarse] started", "on node01", "System is out of GPU memory", "[fine] started", "Error: Not freed memory blocks: 3", "Error: no mesh", "on node02", "Error: again", None]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)] + [("t", 0, "srun: error")], "seed string, line int, text string")
    read = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    for part in (1, 2, 100):
        out = runs.crash_records(df, ["seed"], ["line"], F.floor(F.col("line") / part), read(r"^\[(.+)\] started"), read(r"(node\d+)"), fx.crash_line(F.col("text")), F.col("line") > 5)
        assert sorted(map(tuple, out.collect())) == [("s", 2, "coarse", "node01", "Out of GPU memory", False), ("s", 5, "fine", "node01", "Error: no mesh", False), ("s", 7, "fine", "node02", "Error: again", True), ("t", 0, None, None, "srun error", False)]


def test_lines_of_logs_in_order(spark, tmp_path):
    text = "".join(f"line {k}\n" for k in range(3000))
    (tmp_path / "a.log").write_text(text)
    (tmp_path / "b.log").write_text("one\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = corpus.log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    mine = sorted((r.block, r.line, r.text) for r in got if r.path.endswith("a.log"))
    assert [x for _, _, x in mine] == text.split("\n")[:-1] and len({b for b, _, _ in mine}) > 3 and len(got) == 3001


def test_snapshots_over_parts(spark):
    rng = random.Random(8)
    steps = [(e, i, rng.choice([None, rng.random(), rng.random(), 2.0]), rng.choice([0.01, 0.5, 0.9, 0.9])) for e in ("a", "b") for i in range(47)]
    changed = {(e, i): {rng.choice("xyz"): rng.random() for _ in range(rng.randint(0, 2))} for e, i, _, _ in steps}
    changed[("a", -1)] = {"x": 0.0, "w": 1.0}
    want = []
    for example in ("a", "b"):
        current, best, state = 0.8, math.inf, dict(changed.get((example, -1), {}))
        best = current
        for _, i, m, u in [s for s in steps if s[0] == example]:
            shown = best
            if m is not None and (m < current or u < 0.05):
                current = m
                state.update(changed[example, i])
            if (i + 1) % 5 == 0:
                want.append((example, i, current, shown, dict(state) or None))
            best = min(best, current)
    flat = [(e, i, p, v) for (e, i), m in changed.items() for p, v in m.items()]
    df, moves = spark.createDataFrame(steps, "example string, it int, metric double, draw double"), spark.createDataFrame(flat, "example string, it int, param string, value double")
    for part in (2, 9, 1000):
        got = search.search_states(df, moves, 0.8, 5, part=part)
        assert sorted(((r.example, r.it, r.current, r.best, r.state) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_snapshots_of_steps_far_apart(spark):
    # Two steps whose numbers are three billion apart: one snapshot each, and none between.
    far = 3_000_000_000
    steps = spark.createDataFrame([("a", 19, 0.5, 0.9), ("a", far + 19, 0.4, 0.9), ("a", far + 20, 0.3, 0.9)], "example string, it long, metric double, draw double")
    moves = spark.createDataFrame([("a", 19, "x", 1.0), ("a", far + 19, "y", None), ("a", far + 20, "x", 2.0)], "example string, it long, param string, value double")
    got = search.search_states(steps, moves, 0.8, 20, part=512).collect()
    assert sorted((r.it, r.current, r.best, r.state) for r in got) == [(19, 0.5, 0.8, {"x": 1.0}), (far + 19, 0.4, 0.5, {"x": 1.0, "y": None})]


def test_faces_that_show_their_fronts(spark):
    eye = np.eye(4)
    matrix = [100.0, 0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0.0, 1.0]
    box = lambda x, y, z: ([x - 1.0, y - 1.0, z - 1.0], [x + 1.0, y + 1.0, z + 1.0])
    at = {"ahead": box(0, 0, 10), "right": box(6, 0, 10), "below": box(0, 6, 10), "behind": box(0, 0, -10), "around": box(0, 0, 0)}
    rows = [(k, *v, eye.reshape(-1).tolist(), eye.reshape(-1).tolist(), matrix) for k, v in at.items()] + [("none", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, low array<double>, high array<double>, world array<double>, camera array<double>, matrix array<double>")
    # A face shows if the camera, at the origin, is on its outer side: 0 and 1 are low and high in depth, 2 and 3 in y, 4 and 5 in x.
    assert {r.id: sorted(r.faces) for r in vision.visible_faces(df, ["id"]).collect()} == {"ahead": [0], "right": [0, 4], "below": [0, 2]}
    corners = vision.projected(df, ["id"]).where("id = 'right'").orderBy("corner").collect()
    assert [(round(c.x, 6), round(c.y, 6), c.depth) for c in corners[:2]] == [(round(500 / 9, 6), round(-100 / 9, 6), 9.0), (round(700 / 9, 6), round(-100 / 9, 6), 9.0)]
