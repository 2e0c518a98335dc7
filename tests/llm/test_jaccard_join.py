import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from matterloom.llm import jaccard_join as j

from .helpers import frame, texts


def shingles(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, num=9, den=10):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        known = [x for x in ids[find(k)] if x is not None]
        out.append((i, len(sets[k]), min(known) if known else None))
    return sorted(out, key=repr)


def corpus(seed, families=14):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, i = [], 1000
    passage = r.choices(vocabulary, k=60)
    for f in range(families):
        base = r.choices(vocabulary, k=r.choice([3, 4, 8, 11, 12, 13, 20, 22, 24, 31, 40, 90, 200]))
        if f % 3 == 0:
            base = passage + base
        chain = base
        for _ in range(r.choice([2, 3, 12, 40])):
            words = list(chain if r.random() < 0.5 else base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                at = r.randrange(len(words))
                words[at : at + r.choice([0, 1])] = [r.choice(vocabulary)]
            chain = words
            rows.append((i, " ".join(words).upper() if r.random() < 0.2 else "  ".join(words)))
            i -= 1
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(j, "GROWTH", 2)
    rows = corpus(seed) + [(5000 + k, t) for k, t in enumerate(texts(8))] + [(None, "lone words of no id"), (None, "a a a"), (7, "a a a"), (7, "a a a")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5)
    got = sorted((tuple(x) for x in j.link_components(docs).collect()), key=repr)
    assert got == brute(rows)


def test_every_boundary_finds_every_link(spark, monkeypatch):
    rows = corpus(9, 8)
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows])
    want = brute(rows)
    for b in (1, 12, 22, 30):
        monkeypatch.setattr(j, "boundary", lambda *_, b=b: b)
        assert sorted((tuple(x) for x in j.link_components(docs).collect()), key=repr) == want


def test_empty_table(spark):
    assert j.link_components(frame(spark, ["a"]).limit(0)).collect() == []
    assert sorted(tuple(r) for r in j.link_components(frame(spark, [None, ""])).collect()) == [(0, 0, 0), (1, 0, 1)]


def test_sets_and_sizes():
    got = j.shingle_sets(pa.array(["a b c d", " A\tB  c\n", "x y", "y x", "xy", None, "", "a b c a b c"]))
    assert [len(s) for s in got] == [2, 1, 1, 1, 1, 0, 0, 3]
    assert got[1][0] in got[0] and len({s[0] for s in got[2:5]}) == 3
    for a in range(1, 60):
        for b in range(a, 60):
            least = next(o for o in range(200) if 10 * o >= 9 * (a + b - o))
            assert j.overlap(a, b, 9, 10) == least
            if least <= a:
                assert least in j.light_sizes(a, 9, 10) and least in j.light_sizes(b, 9, 10)
    data = np.sort(got[0] & j.MASK48)
    assert (j._unpack(data.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) == data).all()


def test_boundary_follows_cost():
    assert j.boundary({12: 1000}, 0.0, 9, 10) <= 12 < j.boundary({12: 1000}, 50.0, 9, 10)
    assert j.boundary({}, 0.0, 9, 10) == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 50)] + [(100, k) for k in range(101, 140)] + [(-5, 120), (60, 61)]
    got = {r.node: r.root for r in j.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 51)) and all(got[k] == -5 for k in range(100, 140)) and got[61] == 60


def test_popularity_of_subsets_is_that_of_their_rarest_member():
    r = np.random.default_rng(5)
    for n in (1, 4, 7):
        uses = r.integers(0, 5, n).astype(np.int32)
        sizes = list(range(max(1, n - 3), n + 1))
        want = [min(uses[k] for k in range(n) if k not in gone) for c in sizes for gone in combinations(range(n), n - c)]
        assert j.subset_popularity(uses, sizes).tolist() == want


def test_hot_buckets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(j, "MEMBERS", 3)
    rows = corpus(4, 8)
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    assert sorted((tuple(x) for x in j.link_components(docs).collect()), key=repr) == brute(rows)
    small = docs.selectExpr("cast(doc_id as smallint) as doc_id", "text")
    assert sorted((tuple(x) for x in j.link_components(small).collect()), key=repr) == brute(rows)
