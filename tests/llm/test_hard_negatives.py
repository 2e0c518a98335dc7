import numpy as np
import pytest
from pyspark.sql import functions as F

from matterloom.llm import hard_negatives as H
from matterloom.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "y") for i, v, k in rows], SCHEMA)


def brute(rows, positives=5, negatives=3, every=50):
    """Straight from the contract: (anchor, positive, rank, negative, positive's score, negative's score)."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and len(r[1]) and all(c is not None and np.isfinite(c) for c in r[1])]
    lengths = [len(r[1]) for r in rows]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n)) if rows else 0
    rows = [r for r in rows if len(r[1]) == d]
    x = np.floor(256 * np.array([np.float32(r[1]) for r in rows], np.float64)).astype(np.int64)
    out = []
    for at, (i, _, label) in enumerate(rows):
        if i % every:
            continue
        scores = (x @ x[at]).tolist()
        order = sorted((k for k in range(len(rows)) if k != at), key=lambda k: (-scores[k], rows[k][0], k))
        for p in [k for k in order if rows[k][2] == label][:positives]:
            fits = [k for k in order if rows[k][2] != label and 50 * scores[p] <= 100 * scores[k] <= 95 * scores[p]]
            out += [(i, rows[p][0], rank, rows[k][0], scores[p], scores[k]) for rank, k in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def clustered(n, d=8, clusters=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, d))
    return [(int(i), (centres[r.integers(clusters)] + 0.3 * r.standard_normal(d)).astype(np.float32).tolist(), int(r.integers(4))) for i in r.permutation(n)]


@pytest.mark.parametrize(("sample", "block", "stripe", "thinned"), [(H.SAMPLE, H.BLOCK, H.STRIPE, H.THINNED), (40, 30, 7, 3), (3, 16, 4, 4)])
def test_rows_against_brute_force(spark, monkeypatch, sample, block, stripe, thinned):
    for name, value in (("SAMPLE", sample), ("BLOCK", block), ("STRIPE", stripe), ("THINNED", thinned), ("LEAF", 4), ("FAN", 4)):
        monkeypatch.setattr(H, name, value)
    rows = clustered(600)
    # One vector a third of all rows, with several labels, and scores that tie.
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(300)]
    rows += [(2000 + i, [float(i % 2)] + [0.0] * 7, i % 2) for i in range(101)]
    rows += [(5000, None, 1), (5050, [1.0] * 7, 1), (5100, [float("nan")] * 8, 1), (5150, [None] * 8, 1), (5200, [1.0] * 8, None), (None, [1.0] * 8, 1), (5250, [], 1)]
    got = H.mine(frame(spark, rows).repartition(5), "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)
    assert found(got) == brute(rows)


def test_query_is_the_contract_on_a_whole_table(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table]
    assert found(op13_hard_negatives(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_few_rows_repeated_ids_and_empty_tables(spark):
    one = [(0, [1.0, 2.0], 1)]
    pair = [*one, (1, [1.0, 2.0], 1)]
    for rows in ([], one, pair, [*pair, (2, [0.9, 1.8], 2), (3, [-1.0, -2.0], 2), (4, [0.6, 1.1], 3)], [(0, [0.0, 0.0], 1), (50, [0.0, 0.0], 1), (7, [0.0, 0.0], 2)]):
        assert found(H.mine(frame(spark, rows), "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)) == brute(rows)
    twice = [*pair, *one, (2, [0.9, 1.8], 2), (2, [0.9, 1.8], 2)]
    got = found(H.mine(frame(spark, twice), "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0))
    assert got == brute(twice) and len(got) == 2 * 2 * 2


def test_large_entries_are_exact(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in r.integers(-(2**19), 2**19, 6)], i % 3) for i in range(200)]
    assert found(H.mine(frame(spark, rows), "vec_id", "embedding", "label", F.col("vec_id") % 20 == 0)) == brute(rows, every=20)


def test_no_leaf_with_a_fitting_row_is_left_out_and_many_others_are(monkeypatch):
    monkeypatch.setattr(H, "LEAF", 8)
    x = np.array([v for _, v, _ in clustered(3000)]) * 256
    tree = H.Tree(np.unique(np.floor(x[:800]), axis=0), float((np.floor(x) ** 2).sum(1).max()))
    x = np.floor(x)
    leaf = tree.place(x, widen=True)
    anchors = x[::60]
    scores = anchors @ x.T
    best = np.sort(scores, 1)[:, -10:]
    low, high = best[:, :1], best[:, -1:]
    left = tree.left(anchors, low, high)
    for a in range(len(anchors)):
        assert left[a, np.unique(leaf[(scores[a] >= low[a]) & (scores[a] <= high[a])])].all()
    assert left.mean() < 0.5
    assert not tree.left(anchors, high + 1, high).any()


def test_layout_shares_and_splits():
    first, parts, blocks = H.layout(np.array([3, 4, 0, 25, 2, 2, 9]), 10)
    assert (first.tolist(), parts.tolist(), blocks) == ([0, 0, 0, 1, 4, 4, 5], [1, 1, 1, 3, 1, 1, 1], 6)
    assert H.layout(np.zeros(1, np.int64), 10)[2] == 0
