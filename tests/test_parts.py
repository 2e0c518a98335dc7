"""Order-dependent passes over parts and percentiles by counts, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matterloom.operators import runs, search, stats


def test_gated_over_parts(spark):
    rng = random.Random(5)
    tasks = [(s, p, rng.choice([True, False, None]), rng.choice(["always", "prev_succeeded", "prev_failed", "prev_succeeded", None])) for s in (1, 2, None) for p in range(40)]
    want = []
    for scene in (1, 2, None):
        mine, last = [t for t in tasks if t[0] == scene], True
        for k, (_, p, ok, rule) in enumerate(mine):
            ran = rule == "always" or last == (rule == "prev_succeeded")
            last = bool(ok) if ran else last
            saved = k + 1 < len(mine) and (mine[k + 1][3] or "prev_failed") in ("prev_failed", "always")
            want.append((scene, p, ran, ran and not ok and not saved))
    df = spark.createDataFrame(rng.sample(tasks, len(tasks)), "s int, p int, ok boolean, rule string")
    for part in (1, 3, 1000):
        got = runs.gated(df, "s", "p", "ok", "rule", part=part)
        assert got.columns == ["s", "p", "ok", "rule", "ran", "fatal"]
        assert sorted(((r.s, r.p, r.ran, r.fatal) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert runs.gated(df.limit(0), "s", "p", "ok", "rule").count() == 0


def test_replay_over_parts(spark):
    rng = random.Random(6)
    steps = [(e, i, rng.choice([None, math.nan, math.inf, 3.0, rng.random(), rng.random()]), rng.choice([None, 0.01, 0.5, 0.9, 0.9, 0.9])) for e in ("a", "b", None) for i in range(40)]
    want = []
    for example in ("a", "b", None):
        current = math.inf
        for _, i, m, u in [s for s in steps if s[0] == example]:
            ok = m is not None and not math.isnan(m) and (m < current or (u is not None and u < 0.05))
            current = m if ok else current
            want.append((example, i, ok, current))
    df = spark.createDataFrame(rng.sample(steps, len(steps)), "example string, it int, metric double, draw double")
    for part in (1, 3, 1000):
        got = search.replay(df, part=part)
        assert got.columns == ["example", "it", "metric", "draw", "accepted", "current"]
        assert sorted(((r.example, r.it, r.accepted, r.current) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert search.replay(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 30_000])
def test_spread_is_exact(spark, n):
    rng = np.random.default_rng(n)
    values = {"many": np.round(rng.lognormal(0, 2, n), 3), "one": np.full(n, 2.5), None: rng.integers(0, 4, n).astype(float)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("none", None), ("many", None)]
    got = {r.k: r for r in stats.spread(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v").collect()}
    for k, vs in values.items():
        want = [np.median(vs), *np.percentile(vs, [90, 95, 99])]
        assert got[k].n == n and np.allclose([got[k].median, got[k].p90, got[k].p95, got[k].p99], want, atol=2e-6)
    assert got["none"].n == 0 and got["none"].median is None


def test_percentiles_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(stats, "EDGES", 1)
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = {r.k: r.half for r in stats.percentiles(df, ["k"], "v", {"half": 0.5}).collect()}
    assert got == {k: float(np.median(np.arange(k, 1000, 3))) for k in range(3)}
