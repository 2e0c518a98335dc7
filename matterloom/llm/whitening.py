"""Whitening of embeddings by contour integration of the covariance's resolvent (FEAST).

Spark sums: the number of vectors and their exact sum, then the covariance of the centred vectors, one small matrix for each task.
What reaches the driver is one matrix of d x d numbers, whatever the number of rows. There:

* :func:`inertia` counts the eigenvalues below any number of shifts, by the signs of the pivots of the shifted tridiagonal form;
* bisection on these counts cuts the spectrum into intervals, at its widest gaps;
* in each interval :func:`feast` projects a block of vectors onto the wanted eigenspace: a quadrature over a circle through the
  interval's ends, each node a solve with the covariance shifted into the complex plane; Rayleigh-Ritz gives the components,
  which are the next block; it is repeated until the residuals are rounding;
* the number of components found in an interval must be the difference of the inertia counts at its ends, else the block grows.

Then one pass measures the whitened rows' covariance against the identity, and one writes the rows. Rows are never
shuffled; a hot label or a vector that a third of all rows share makes no difference.

Defined results: a row whose vector is null or holds a null, NaN or infinite entry takes no part, nor does one whose length is
not the commonest (of two equally common the longer). Entries beyond +-2^56 count as that. Repeated rows and null ids count
each. A direction without variance (an eigenvalue within rounding of 0) has no component, so a single row, or rows that are all
alike, give no rows, as does an empty table. A deviation that is no long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries (times SCALE) are held within this.
LARGE = 2.0**62
#: Nodes of the quadrature on half a circle, eigenvalues of an interval, and rounds.
NODES, MOST, ROUNDS = 8, 12, 30
#: Vectors of a batch that are worked on at once.
ROWS = 8192


class Whitening(NamedTuple):
    """``n`` vectors with the exact sums ``sums``; ``axes`` has a component a column, ``values`` their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix's tridiagonal form, by Householder reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        if not (size := np.linalg.norm(x)):
            continue
        x /= size
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        q = p - (x @ p) * x
        rest -= 2 * (np.outer(x, q) + np.outer(q, x))
        column = a[k + 1 :, k]
        column -= 2 * x * (x @ column)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues are below each shift: the negative pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny * 4
    count = np.zeros(len(shifts), np.int64)
    pivot = np.ones(len(shifts))
    with np.errstate(over="ignore"):
        for k, x in enumerate(diagonal):
            pivot = x - shifts - (off[k - 1] * off[k - 1] / pivot if k else 0.0)
            pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
            count += pivot < 0
    return count


def intervals(diagonal: np.ndarray, off: np.ndarray, k: int, most: int = MOST) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues between) from the top, which hold the ``k`` largest eigenvalues. Ends lie in the middle of gaps, the
    widest within reach; an interval holds more than ``most`` only where there is no gap."""
    d = len(diagonal)
    radius = np.abs(np.r_[0, off]) + np.abs(np.r_[off, 0])
    low, high = float((diagonal - radius).min()), float((diagonal + radius).max())
    margin = max(high - low, abs(high), abs(low)) * 1e-3 + np.finfo(float).tiny
    lows, highs = np.full(d, low - margin), np.full(d, high + margin)
    for _ in range(60):
        middle = (lows + highs) / 2
        above = inertia(diagonal, off, middle) <= np.arange(d)
        lows, highs = np.where(above, middle, lows), np.where(above, highs, middle)
    places = (lows + highs) / 2
    gaps = np.diff(places)
    wide = max(abs(high), abs(low)) * 1e-10
    out, top, edge = [], d, high + margin
    while top > 0 and d - top < k:
        # A cut at c leaves the eigenvalues from c on above it; behind the k-th largest no more are wanted.
        first = max(1, top - most)
        choices = [c for c in range(first, top) if gaps[c - 1] > wide] or [c for c in range(first - 1, 0, -1) if gaps[c - 1] > wide][:1]
        cut = max(choices, key=lambda c: gaps[c - 1], default=0)
        below = (places[cut - 1] + places[cut]) / 2 if cut else low - margin
        counts = inertia(diagonal, off, np.array([below, edge]))
        out.append((float(below), float(edge), int(counts[1] - counts[0])))
        top, edge = cut, below
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, nodes: int = NODES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between low and high, with unit eigenvectors as columns."""
    d, scale = len(a), max(np.abs(a).sum(1).max(), np.finfo(float).tiny)
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(1j * (np.pi / 2) * (1 - points))
    block = min(d, count + max(4, count // 2))
    draw = np.random.default_rng(seed)
    y = draw.standard_normal((d, block))
    eye = np.eye(d)
    for number in range(1, ROUNDS + 1):
        q = np.zeros_like(y)
        for turn, w in zip(turns, weights, strict=True):
            q += w / 2 * (radius * turn * np.linalg.solve((middle + radius * turn) * eye - a, y.astype(complex))).real
        q, _ = np.linalg.qr(q)
        values, inner = np.linalg.eigh(q.T @ a @ q)
        vectors = q @ inner
        inside = np.flatnonzero((values > low) & (values < high))
        residuals = np.linalg.norm(a @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
        good = inside[residuals <= 64 * np.finfo(float).eps * scale]
        if len(good) == count:
            return values[good], vectors[:, good]
        y = vectors
        if number % 6 == 0 and block < d:
            block = min(d, 2 * block)
            y = np.concatenate([vectors, draw.standard_normal((d, block - vectors.shape[1]))], 1)
    raise ArithmeticError(f"{len(good)} of {count} eigenvalues between {low} and {high} were found")


def largest(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, with unit eigenvectors as columns; those within rounding of 0
    and below are left out. A vector's largest entry is positive."""
    d = len(a)
    scale = float(np.abs(a).max(initial=0.0))
    if not d or not scale:
        return np.zeros(0), np.zeros((d, 0))
    a = (a + a.T) / (2 * scale)
    parts = intervals(*tridiagonal(a), min(k, d))
    found = [feast(a, low, high, count) for low, high, count in parts if count]
    # The parts' vectors are orthogonal up to rounding over their gaps; one more Rayleigh-Ritz step over all of them takes that away.
    q, _ = np.linalg.qr(np.concatenate([vectors for _, vectors in found], 1))
    values, inner = np.linalg.eigh(q.T @ a @ q)
    vectors = (q @ inner)[:, ::-1]
    values = np.einsum("ik,ij,jk->k", vectors, a, vectors)[:k]
    kept = values > 4 * d * np.finfo(float).eps * values[0]
    values, vectors = values[kept] * scale, vectors[:, :k][:, kept]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vectors are whole, and their length; 0 where there are none."""
    v = F.col(vector)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine))
    common = rows.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (rows.where(F.size(v) == common.d), int(common.d)) if common else (rows, 0)


def _longs(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch as longs floor(64 * c) + 1000000."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.clip(np.floor(SCALE * flat), -LARGE, LARGE).astype(np.int64) + SHIFT


def _from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where they hold it, else as Python's integers."""
    if n * max(int(x.max(initial=0)), -int(x.min(initial=0)), 1) < 2**62 and max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, _longs(batch.column("v"), d)


def sums(rows: DataFrame, vector: str, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _blocks(batches, d):
            n += len(x)
            part = x.sum(0).tolist() if len(x) * max(int(x.max(initial=0)), -int(x.min(initial=0)), 1) < 2**62 else x.astype(object).sum(0).tolist()
            total = [a + b for a, b in zip(total, part, strict=True)]
        if n:
            yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in total], pa.decimal128(38, 0))], ["i", "n", "s"])

    partial = rows.select(F.col(vector).alias("v")).mapInArrow(run, "i int, n long, s decimal(38, 0)")
    found = partial.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (int(found[0].n), [int(r.s) for r in found]) if found else (0, [0] * d)


def _products(rows: DataFrame, vector: str, d: int, k: int, make) -> np.ndarray:
    """The sum over all rows of make(x)' make(x), where ``make`` gives k numbers for each vector of a block."""
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((k, k)), False
        for _, x in _blocks(batches, d):
            y, any_row = make(x), True
            total += y.T @ y
        if any_row:
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    partial = rows.select(F.col(vector).alias("v")).mapInArrow(run, "i int, j int, v double")
    out = np.zeros((k, k))
    for r in partial.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def fit(rows: DataFrame, vector: str, d: int, k: int = COMPONENTS) -> Whitening:
    """Fit on all rows; each vector has ``d`` finite entries (:func:`usable`)."""
    n, total = sums(rows, vector, d) if d else (0, [])
    if not n:
        return Whitening(0, total, np.zeros((d, 0)), np.zeros(0), 0.0)
    covariance = _products(rows, vector, d, d, lambda x: (_from_mean(x, n, total) / n).astype(np.float64)) / n
    values, axes = largest(covariance, k)
    return Whitening(n, total, axes, values, float(np.trace(covariance)))


def _white(x: np.ndarray, model: Whitening) -> np.ndarray:
    return (_from_mean(x, model.n, model.sums) / model.n).astype(np.float64) @ model.axes / np.sqrt(model.values)


def identity_error(rows: DataFrame, vector: str, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured on all rows."""
    k = len(model.values)
    if not k:
        return 0.0
    # The last column of ones gives the sums that centre the whitened rows.
    whole = _products(rows, vector, len(model.sums), k + 1, lambda x: np.c_[_white(x, model), np.ones(len(x))]) / model.n
    centre = whole[:k, k]
    return float(np.abs(whole[:k, :k] - np.outer(centre, centre) - np.eye(k)).max())


def transform(rows: DataFrame, model: Whitening, vector: str, out: str = "whitened") -> DataFrame:
    """``rows`` with their whitened vectors, a number for each component."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(out).schema)
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                white = _white(_longs(batch.column(vector), d), model)
                lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], pa.array(white.reshape(-1)))
                yield pa.record_batch([*batch.columns, lists], [*batch.schema.names, out])

    return rows.drop(out).mapInArrow(run, f"{kinds}, `{out}` array<double>")


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``rows`` and component: vec_id, component (from 1), n, deviation, whitened, explained,
    identity_error."""
    rows, d = usable(rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v")), "v")
    model = fit(rows, "v", d, k)
    error = identity_error(rows, "v", model)
    explained = model.values / model.trace if model.trace else model.values
    count = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, d):
            off = _from_mean(x, model.n, model.sums)
            most = max(int(off.max(initial=0)), -int(off.min(initial=0)))
            exact = (off * off).sum(1) if off.dtype != object and d * most * most < 2**63 else [sum(v * v for v in row) for row in off.tolist()]
            deviation = pa.array([int(v) if v < 2**63 else None for v in exact], pa.int64())
            each = pa.array(np.repeat(np.arange(len(x)), count))
            size = len(each)
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, model.n, np.int64)),
                    deviation.take(each),
                    pa.array(_white(x, model).reshape(-1)),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(size, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    key_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema)
