import numpy as np
import pytest

from matterloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string"


def frame(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def matrix(values, seed=3):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


SPECTRA = {
    "falling": 0.8 ** np.arange(64),
    "equal": np.ones(40),
    "clusters": np.repeat([5.0, 3.0, 1.0], [14, 20, 10]) + 1e-13 * np.arange(44),
    "close pairs": np.repeat(np.arange(1, 25), 2) + np.tile([0, 1e-9], 24),
    "no rank": np.r_[np.linspace(1, 2, 7), np.zeros(25)],
    "far apart": np.r_[1e6, 10.0, np.linspace(1, 2, 38)],
    "tie at the last": np.r_[np.linspace(5, 9, 30), 2, 2, 2, 2, 1],
    "one": np.ones(1),
    "two": np.array([2.0, 1.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_components_are_the_largest_eigenpairs(name):
    a = matrix(SPECTRA[name])
    values, vectors = whitening.largest(a, 32)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    want = want[want > 4 * len(a) * np.finfo(float).eps * want[0]][:32]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-10, atol=1e-13 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12 * want[0]


def test_inertia_counts_what_is_below():
    for name, spectrum in SPECTRA.items():
        a = matrix(spectrum)
        shifts = np.array([-1.0, 0.51, 1.57, 2.53, 4.5, 1e7])
        assert whitening.inertia(*whitening.tridiagonal(a), shifts).tolist() == [int((spectrum < s).sum()) for s in shifts], name


def test_a_block_that_is_too_small_grows_until_none_is_missed():
    a = matrix(np.linspace(1, 2, 50))
    values, _ = whitening.feast(a, 0.9, 1.51, 25, nodes=2)
    assert np.allclose(values, np.linspace(1, 2, 50)[:25])
    with pytest.raises(ArithmeticError):
        whitening.feast(a, 0.9, 1.51, 26)


def brute(vectors, k):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), c @ axes / np.sqrt(e), e / np.trace(v)


def test_rows_against_brute_force(spark):
    r = np.random.default_rng(5)
    vectors = (r.standard_normal((400, 12)) @ r.standard_normal((12, 12)) / 4).astype(np.float32).tolist()
    vectors += [vectors[0]] * 200  # one vector a third of all rows
    bad = [None, [None, *vectors[0][1:]], [float("nan"), *vectors[0][1:]], [float("-inf"), *vectors[0][1:]], [], [1.0, 2.0]]
    got = whitening.whiten(frame(spark, vectors + bad).repartition(7), k=8)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.toPandas()
    n, deviation, white, explained = brute(vectors, 8)
    assert len(got) == n * 8 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    table = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    signs = np.sign((table * white).sum(0))
    assert np.abs(table - white * signs).max() < 1e-9
    assert (got.sort_values("vec_id").deviation.to_numpy().reshape(n, 8) == deviation[:, None]).all()
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)


def test_large_entries_stay_exact(spark):
    vectors = [[float(2**40 * i), float(i % 3), 1.0] for i in range(9)]
    got = whitening.whiten(frame(spark, vectors), k=3).toPandas()
    x = [[64 * int(c) + 1_000_000 for c in v] for v in vectors]
    want = [sum((9 * a - sum(y[j] for y in x)) ** 2 for j, a in enumerate(row)) for row in x]
    assert sorted(got.component.unique()) == [1]  # what the others vary is within rounding of the first
    assert got.sort_values("vec_id").deviation.isna().tolist() == [w >= 2**63 for w in want]
    small = whitening.whiten(frame(spark, [[float(2**20 * i), float(i % 3)] for i in range(9)]), k=2).toPandas()
    assert sorted(small.component.unique()) == [1, 2] and small.identity_error.max() < 1e-6


def test_degenerate_tables(spark):
    rows = frame(spark, [[1.0, 2.0], [1.0, 2.0], None], [None, None, 3])
    assert whitening.whiten(rows).collect() == []
    assert whitening.whiten(rows.limit(0)).collect() == []
    assert whitening.whiten(frame(spark, [None, []])).collect() == []
    two = whitening.whiten(frame(spark, [[0.0, 0.0], [0.0, 1.0], [0.0, 1.0]], [None, 5, 5])).toPandas()
    assert len(two) == 3 and set(two.component) == {1} and set(two.explained) == {1.0} and two.vec_id.isna().sum() == 1


def test_transform_keeps_the_columns(spark):
    rows = frame(spark, np.random.default_rng(1).standard_normal((50, 5)).tolist())
    rows, d = whitening.usable(rows, "embedding")
    model = whitening.fit(rows, "embedding", d, 3)
    out = whitening.transform(rows, model, "embedding").toPandas()
    assert list(out.columns) == ["vec_id", "embedding", "label", "n", "component", "whitened"]
    white = np.stack(out.whitened)
    assert np.allclose(white.T @ white / 50, np.eye(3), atol=1e-10)
