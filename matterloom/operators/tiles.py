"""Which rows of pixels are nearly alike, counted exactly for whole blocks of rows at once: the NumPy side of near-duplicates.

Every pair of two blocks is looked at, in bounded memory. A value falls into a cell of a ``STEPS``-th of the threshold; for each pixel and
cell a bitmap holds the rows whose cell is at most ``STEPS`` away. The bitmaps of a row's pixels are added up with bit-sliced counters, 64 rows a
word, and only pairs that reach the bound are counted by their values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of a threshold's width, rows of a bitmap, bytes of a counter's planes, and values that are compared directly.
STEPS, COLUMNS, PLANE, DIRECT = 6, 8_192, 1 << 17, 1 << 20
#: What sums of doubles may be off by.
ROUNDING = 1e-9


def table(rows: pa.Table, name: str = "pixels") -> np.ndarray:
    """A column of arrays of one length as a matrix; missing numbers are NaN, which is near nothing."""
    column = rows.column(name).combine_chunks()
    return column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _cells(x: np.ndarray, threshold: float) -> np.ndarray:
    """Cells by their last byte: values within ``threshold`` are at most STEPS cells apart, also round the end."""
    return (np.floor(np.nan_to_num(x / ((threshold + ROUNDING) / STEPS), posinf=0, neginf=0)) % 256).astype(np.uint8)


def _added(arrays: Iterator[np.ndarray]) -> list[np.ndarray]:
    """The bits of the numbers of set bits, the lowest first."""
    levels: list[list[np.ndarray]] = [[]]

    def push(k: int, x: np.ndarray) -> None:
        if k == len(levels):
            levels.append([])
        levels[k].append(x)
        if len(levels[k]) == 3:
            a, b, c = levels[k]
            levels[k] = []
            u = a ^ b
            np.bitwise_and(a, b, out=a)
            s = u ^ c
            np.bitwise_and(u, c, out=u)
            np.bitwise_or(a, u, out=a)
            push(k, s)
            push(k + 1, a)

    for x in arrays:
        push(0, x)
    k = 0
    while k < len(levels):
        if len(levels[k]) == 2:
            a, b = levels[k]
            levels[k] = [a ^ b]
            push(k + 1, a & b)
        k += 1
    return [level[0] for level in levels if level]


def _reached(planes: list[np.ndarray], least: int) -> np.ndarray:
    """Bits of the numbers that are at least ``least``."""
    if least >> len(planes):
        return np.zeros_like(planes[0])
    more, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for k in reversed(range(len(planes))):
        if least >> k & 1:
            equal = equal & planes[k]
        else:
            more |= equal & planes[k]
            equal = equal & ~planes[k]
    return more | equal


def _candidates(a: np.ndarray, b: np.ndarray, threshold: float, least: int, channels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in a, place in b) that hold all those with ``least`` near pixels, in parts."""
    x, y = _cells(a, threshold), _cells(b, threshold)
    for start in range(0, len(y), COLUMNS):
        part = y[start : start + COLUMNS]
        words = -(-len(part) // 64)
        padded = np.zeros((words * 64, y.shape[1]), np.uint8)
        padded[: len(part)] = part
        valid = np.packbits(np.arange(words * 64) < len(part), bitorder="little").view(np.uint64)
        step = max(1, PLANE // (8 * words))
        # Many pixels would make the bitmaps large, so each is made when its turn comes, for as many rows of a as the planes may hold.
        rows = len(x) if x.shape[1] <= 256 else max(step, 1024)
        for first in range(0, len(x), rows):
            mine = x[first : first + rows]
            keep = x.shape[1] <= 256
            maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

            def bitmap(j: int, mine=mine, padded=padded, maps=maps, keep=keep) -> tuple[np.ndarray, np.ndarray]:
                if j not in maps:
                    known, at = np.unique(mine[:, j], return_inverse=True)
                    # Bytes wrap round, as the cells do.
                    near = (known[:, None] + np.uint8(STEPS) - padded[None, :, j]) <= 2 * STEPS
                    made = np.packbits(near, axis=1, bitorder="little").view(np.uint64), at.reshape(-1)
                    if not keep:
                        return made
                    maps[j] = made
                return maps[j]

            for low in range(0, len(mine), step):
                block = slice(low, min(low + step, len(mine)))

                def pixels(block=block, bitmap=bitmap) -> Iterator[np.ndarray]:
                    for p in range(x.shape[1] // channels):
                        bits, at = bitmap(p * channels)
                        whole = bits[at[block]]
                        for c in range(1, channels):
                            bits, at = bitmap(p * channels + c)
                            whole &= bits[at[block]]
                        yield whole

                hit = _reached(_added(pixels()), least) & valid
                r, w = np.nonzero(hit)
                if len(r):
                    bits = np.unpackbits(hit[r, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    k, bit = np.nonzero(bits)
                    yield first + low + r[k], start + w[k] * 64 + bit


def pairs(a: np.ndarray, b: np.ndarray, threshold: float, share: float, channels: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, near pixels) of the pairs of which more than ``share`` of the pixels differ by at most ``threshold`` in
    every channel, in parts."""
    n = a.shape[1] // channels
    if not n or not len(a) or not len(b):
        return
    a, b = a[:, : n * channels], b[:, : n * channels]
    least = max(0, int(np.floor(share * n - ROUNDING)))
    if len(a) * len(b) * a.shape[1] <= DIRECT or least == 0:
        step = max(1, DIRECT // (len(b) * a.shape[1]))
        found = ((i.reshape(-1) + k, j.reshape(-1)) for k in range(0, len(a), step) for i, j in [np.indices((min(step, len(a) - k), len(b)))])
    else:
        found = _candidates(a, b, threshold, least, channels)
    most = max(1, DIRECT // a.shape[1])
    with np.errstate(invalid="ignore"):
        for i, j in found:
            for k in range(0, len(i), most):
                p, q = i[k : k + most], j[k : k + most]
                near = (np.abs(a[p] - b[q]) <= threshold).reshape(len(p), n, channels)
                same = np.count_nonzero(near.all(2) if channels > 1 else near[..., 0], axis=1)
                good = same / n > share
                if good.any():
                    yield p[good], q[good], same[good]


def taken(x: np.ndarray, threshold: float, share: float, channels: int = 1, block: int = 256) -> np.ndarray:
    """Of rows in their order, which are nearly alike to no earlier one that is taken."""
    out = np.zeros(len(x), bool)
    for start in range(0, len(x), block):
        mine = x[start : start + block]
        free = np.ones(len(mine), bool)
        before = np.flatnonzero(out)
        for i, _, _ in pairs(mine, x[before], threshold, share, channels):
            free[i] = False
        places = np.flatnonzero(free)
        linked = np.zeros((len(places), len(places)), bool)
        for i, j, _ in pairs(mine[places], mine[places], threshold, share, channels):
            linked[i, j] = True
        for k, at in enumerate(places):
            if not (linked[k, :k] & out[start + places[:k]]).any():
                out[start + at] = True
    return out
