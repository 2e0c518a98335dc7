import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matterloom.llm import mixing

from .helpers import frame, texts


def test_targets():
    assert mixing.targets([10, 100, 100]) == [30, pytest.approx(120), pytest.approx(60)]
    assert mixing.targets([100, 100, 100, 100]) == pytest.approx([2000 / 13, 800 / 13, 400 / 13, 2000 / 13])
    assert mixing.targets([0, 5]) == [0, 5] and mixing.targets([]) == [] and mixing.targets([0]) == [0]
    assert sum(mixing.targets([1, 2, 300, 4, 50])) == pytest.approx(357)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 120), st.sampled_from([8, 1 << 17]))
def test_knapsack_is_the_nearest_sum(pool, budget, exact):
    sizes, counts = np.array(list(pool)), np.array(list(pool.values()))
    sums = {sum(n * s for n, s in zip(c, sizes.tolist(), strict=True)) for c in itertools.product(*(range(x + 1) for x in counts))}
    take = mixing.fit(sizes, counts, budget, exact)
    assert (take >= 0).all() and (take <= counts).all()
    if exact > 1000:
        near = [s for s in sums if s <= 2 * budget] if budget < sizes @ counts else sums
        assert abs(int(take @ sizes) - budget) == min(abs(s - budget) for s in near)


def test_large_budgets_are_met_exactly():
    r = np.random.default_rng(2)
    sizes = np.unique(r.integers(20, 9000, 700))
    counts = r.integers(1, 400, len(sizes))
    for budget in (1, 19, 20, 77_777, 10_000_019, int(sizes @ counts) - 33):
        got = int(mixing.fit(sizes, counts, budget) @ sizes)
        assert abs(got - budget) <= (20 if budget < 50 or budget > 10**8 else 0), budget


def test_few_lengths_take_one_pass_each_and_no_length_is_preferred():
    for sizes in ([1, 9000], [2, 6, 10, 14, 9000]):
        sizes = np.array(sizes)
        began = time.perf_counter()
        take = mixing.fit(sizes, np.full(len(sizes), 200_000), 777_777_778)
        assert time.perf_counter() - began < 0.5 and abs(int(take @ sizes) - 777_777_778) <= 1
    sizes = np.arange(100, 9100)
    take = mixing.fit(sizes, np.ones(len(sizes), np.int64), int(0.3 * sizes.sum()))
    assert int(take @ sizes) == int(0.3 * sizes.sum())
    assert all(abs(x.mean() - 0.3) < 0.03 for x in np.array_split(take, 4))


def test_repeated_rows_meet_the_target(spark):
    rows = [(1, "a b c d e f g h i j", "a")] * 3000 + [(2, " ".join(["w"] * 20_000), "b"), (3, "w w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs, most=2).where("doc_id = 1").groupBy("target").agg({"taken": "sum", "doc_id": "count"}).first()
    assert got["count(doc_id)"] == 3000 and abs(got["sum(taken)"] - got.target) <= 10, got
    kept = mixing.mix(docs, keep=True, most=2)
    assert kept.columns == [*docs.columns, "copies"] and kept.count() == len(rows)


@pytest.mark.parametrize("broadcast", [0, mixing.BROADCAST])
def test_mix(spark, broadcast, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 8)
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.choice([1, 7, 7, 7, 20, 33, 150])), r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(900)]
    rows += [(2000 + i, t, "a") for i, t in enumerate(texts(10))] + [(5000, "w w", "b"), (5000, "w w", "b"), (None, "w w w", "z"), (None, None, "empty")]
    docs = spark.createDataFrame([(*x, "clash", 9) for x in rows], "doc_id long, text string, source string, size string, taken int")
    got = mixing.mix(docs, broadcast=broadcast).collect()
    assert len(got) == len(rows)
    assert sorted(got, key=str) == sorted(mixing.mix(docs.repartition(7), broadcast=broadcast).collect(), key=str)
    size = {(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows}
    assert {(x.doc_id, x.size) for x in got} == size
    whole = Counter()
    for _, t, s in rows:
        whole[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in whole if s is not None)) + [None]
    want = dict(zip(names, mixing.targets([whole[s] for s in names]), strict=True))
    taken = Counter()
    source = {i: s for i, _, s in rows if i is not None}
    for x in got:
        s = source[x.doc_id] if x.doc_id is not None else ("z" if x.size else "empty")
        taken[s] += x.taken
        assert x.source_size == whole[s] and x.target == pytest.approx(want[s])
        assert x.taken <= 3 * x.size and (x.size == 0 or x.taken % x.size == 0)
    for s in names:
        assert abs(taken[s] - want[s]) <= 4, (s, taken[s], want[s])
    kept = mixing.mix(docs, broadcast=broadcast, keep=True)
    assert kept.columns == [*docs.columns, "copies"] and kept.count() == len(rows)


def test_empty_table(spark):
    assert mixing.mix(frame(spark, ["a"]).limit(0)).collect() == []
