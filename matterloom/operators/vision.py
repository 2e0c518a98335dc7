"""Pixels: render checks, masks, boxes, noise, and structural similarity. Small NumPy helpers on Arrow batches reduce an image or
mask inside its task; only figures leave it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import asinh, ceil, cosh, tanh

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gates import DARK, FLAT, LIGHT

#: What a similarity may be off by.
ROUNDING = 1e-9


def mapped(rows: DataFrame, keys: list[str], schema: str, make: Callable[..., list[tuple]], columns: list[str]) -> DataFrame:
    """Rows of ``make(*columns)`` for each row, after its keys."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(*key, *made) for key, args in zip(zip(*(pdf[k] for k in keys), strict=True), zip(*(pdf[c] for c in columns), strict=True), strict=True) for made in make(*args)]
            yield pd.DataFrame(out, columns=names)

    return rows.select(*dict.fromkeys([*keys, *columns])).mapInPandas(run, f"{kinds}, {schema}")


def pixels(height: int, width: int, data: bytes) -> np.ndarray:
    """An image of the image source (rows of BGR or BGRA bytes) as RGB from 0 to 1, without alpha (A4)."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, -1)
    return (raw if raw.shape[2] == 1 else raw[..., 2::-1]) / 255.0


def render_figures(images: DataFrame, keys: list[str]) -> DataFrame:
    """Per image: the shares of dark and light pixels, the largest range of a channel, and the mean gray."""

    def make(height: int, width: int, data: bytes) -> list[tuple]:
        x = pixels(height, width, data)
        span = (x.max((0, 1)) - x.min((0, 1))).max()
        gray = x @ np.array([0.299, 0.587, 0.114]) if x.shape[2] == 3 else x[..., 0]
        return [(float((x.max(2) < DARK).mean()), float((x.min(2) > LIGHT).mean()), float(span), float(gray.mean()))]

    return mapped(images, keys, "dark double, light double, span double, gray double", make, ["height", "width", "data"])


def render_reason(share: float = 0.9):
    """The reason for which :func:`render_figures` reject an image; null if they don't."""
    black_or_white = (F.col("dark") > share) | (F.col("light") > share)
    return F.coalesce(F.when(black_or_white, "Rendered image is black or white"), F.when(F.col("span") < FLAT, "Rendered image is uniform"))


def histograms(masks: DataFrame, keys: list[str], kind: str = "<i4") -> DataFrame:
    """(keys, id, n): pixels of each id in a mask (D18, D19); a pixel never leaves its task."""

    def make(data: bytes) -> list[tuple]:
        ids, n = np.unique(np.frombuffer(data, kind), return_counts=True)
        return list(zip(ids.tolist(), n.tolist(), strict=True))

    return mapped(masks, keys, "id long, n long", make, ["data"])


def tag_shares(counted: DataFrame, tags: DataFrame, scene: str = "seed") -> DataFrame:
    """Percent of all pixels that hold each tag (D18); dotted tags count for each of their parts, absent ones get 0, pixels without an id are ``untagged``."""
    total = counted.agg(F.sum("n").alias("total"))
    parts = tags.select(scene, "id", F.explode(F.array_distinct(F.split("tag", r"\."))).alias("tag"))
    known = counted.where("id > 0").join(parts, [scene, "id"]).groupBy("tag").agg(F.sum("n").alias("n"))
    every = parts.select("tag").distinct().join(known, "tag", "left").na.fill(0, ["n"])
    none = counted.join(tags.select(scene, "id").distinct(), [scene, "id"], "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("untagged").alias("tag"), "n")
    return every.unionByName(none).crossJoin(F.broadcast(total)).select("tag", (100 * F.col("n") / F.col("total")).alias("percent"))


def boxes(tag_masks: DataFrame, keys: list[str], kind: str = "<i4") -> DataFrame:
    """(keys, object, instance, x_min, y_min, x_max, y_max) where a tag's mask is set (D20). ``tag_masks`` has the width, the tag's
    mask ``hit`` (a byte a pixel), and the ``objects`` and ``instances`` masks. Tiles of a frame are merged by min and max."""

    def make(width: int, hit: bytes, objects: bytes, instances: bytes) -> list[tuple]:
        where = np.flatnonzero(np.frombuffer(hit, np.uint8))
        if not len(where):
            return []
        y, x = where // width, where % width
        pair, at = np.unique(np.stack([np.frombuffer(objects, kind)[where], np.frombuffer(instances, kind)[where]], 1), axis=0, return_inverse=True)
        out = []
        for k, (o, i) in enumerate(pair.tolist()):
            mine = at.reshape(-1) == k
            out.append((o, i, int(x[mine].min()), int(y[mine].min()), int(x[mine].max()), int(y[mine].max())))
        return out

    found = mapped(tag_masks, keys, "object long, instance long, x_min long, y_min long, x_max long, y_max long", make, ["width", "hit", "objects", "instances"])
    return found.groupBy(*keys, "object", "instance").agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))


def _window(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    g = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return g / g.sum()


def _blur(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Separable convolution without padding; a side shorter than the window is left as it is."""
    for axis in (0, 1):
        if x.shape[axis] >= len(g):
            x = np.lib.stride_tricks.sliding_window_view(x, len(g), axis=axis) @ g
    return x


def ssim(x: np.ndarray, y: np.ndarray, span: float = 1.0, k: tuple[float, float] = (0.01, 0.03)) -> tuple[float, float]:
    """Structural similarity of two images (rows, columns, channels), and its contrast part, as means over channels (L3)."""
    g, (c1, c2) = _window(), ((k[0] * span) ** 2, (k[1] * span) ** 2)
    full, contrast = [], []
    for c in range(x.shape[2]):
        a, b = x[..., c].astype(np.float64), y[..., c].astype(np.float64)
        ma, mb = _blur(a, g), _blur(b, g)
        va, vb, ab = _blur(a * a, g) - ma * ma, _blur(b * b, g) - mb * mb, _blur(a * b, g) - ma * mb
        part = (2 * ab + c2) / (va + vb + c2)
        contrast.append(part.mean())
        full.append(((2 * ma * mb + c1) / (ma * ma + mb * mb + c1) * part).mean())
    return float(np.mean(full)), float(np.mean(contrast))


@cache
def _tangent(steps: int) -> tuple[float, float]:
    """Where the tangent of sech meets sech at the span (in 64ths), and its slope."""
    span, low, high = steps / 64, 0.0, asinh(1)
    for _ in range(50):
        t = (low + high) / 2
        low, high = (t, high) if -tanh(t) / cosh(t) > (1 / cosh(span) - 1 / cosh(t)) / (span - t) else (low, t)
    return low, (1 / cosh(span) - 1 / cosh(low)) / (span - low)


def _flat(x: np.ndarray, span: np.ndarray) -> np.ndarray:
    """A concave curve over sech on [0, span], at x: sech itself up to the point whose tangent meets sech at the span, then that tangent.
    The span is taken up to the next 64th, which only lifts the curve."""
    steps = np.ceil(span * 64).astype(np.int64)
    curved = steps > 64 * asinh(1)
    known, at = np.unique(np.where(curved, steps, 64), return_inverse=True)
    t, slope = np.array([_tangent(int(k)) for k in known]).T[:, at.reshape(-1)].reshape(2, *x.shape)
    return np.where(curved & (x > t), 1 / np.cosh(t) + (x - t) * slope, 1 / np.cosh(x))


def _reach(least: float, span: float) -> float:
    """How far apart means may be where the curve of :func:`_flat` is ``least`` or more."""
    low, high = 0.0, span
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if _flat(np.array([middle]), np.array([span]))[0] >= least else (low, middle)
    return high


def _log_maps(x: np.ndarray, span: float, k: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """asinh(mean / sqrt(c1)) and asinh(deviation / sqrt(c2)) of every window, a map a channel."""
    g, (c1, c2) = _window(), ((k[0] * span) ** 2, (k[1] * span) ** 2)
    means, deviations = [], []
    for c in range(x.shape[2]):
        a = x[..., c].astype(np.float64)
        m = _blur(a, g)
        means.append(np.arcsinh(m / np.sqrt(c1)))
        deviations.append(np.arcsinh(np.sqrt(np.maximum(0, _blur(a * a, g) - m * m)) / np.sqrt(c2)))
    return np.stack(means), np.stack(deviations)


def ssim_index(images: DataFrame, keys: list[str], span: float = 1.0, k: tuple[float, float] = (0.01, 0.03), grid: int = 4) -> DataFrame:
    """(keys, shape, mu, sigma, blocks): what :func:`ssim_bounds` needs of an image: the means of its log maps, and for each block of a
    grid its windows and the mean, least and largest value of either map."""

    def make(height: int, width: int, data: bytes) -> list[tuple]:
        x = pixels(height, width, data)
        maps = _log_maps(x, span, k)
        blocks: list[float] = []
        rows, columns = (np.array_split(np.arange(n), min(grid, n)) for n in maps[0].shape[1:])
        for c in range(x.shape[2]):
            for r in rows:
                for q in columns:
                    parts = [m[c, r[0] : r[-1] + 1, q[0] : q[-1] + 1] for m in maps]
                    blocks += [float(parts[0].size), *(float(f(p)) for p in parts for f in (np.mean, np.min, np.max))]
        return [(f"{height}x{width}x{x.shape[2]}", float(maps[0].mean()), float(maps[1].mean()), blocks)]

    return mapped(images, keys, "shape string, mu double, sigma double, blocks array<double>", make, ["height", "width", "data"])


def ssim_bounds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bounds of the structural similarity of pairs of images, from the blocks of :func:`ssim_index`, a pair a row.

    With a = sqrt(c) sinh(u) and b = sqrt(c) sinh(v), (2ab + c) / (a^2 + b^2 + c) = (1 - (cosh(u-v) - 1) / cosh(u+v)) / cosh(u-v), at
    most sech(u - v). That holds for the means and, by Cauchy and Schwarz, for the deviations of a window, and a
    window's similarity is at most the lesser. A block's mean of sech(u - v) is at most the concave curve over it at the
    difference of the block's means, and at most its value at the least difference of the block's ranges."""
    x, y = x.reshape(len(x), -1, 7), y.reshape(len(y), -1, 7)
    best = np.ones(x.shape[:2])
    for m in (1, 4):
        (a, a0, a1), (b, b0, b1) = ((z[..., m + k] for k in range(3)) for z in (x, y))
        means = np.abs(a - b)
        apart = np.maximum(0, np.maximum(a0 - b1, b0 - a1))
        best = np.minimum(best, np.minimum(1 / np.cosh(apart), _flat(means, np.maximum(means, np.maximum(a1 - b0, b1 - a0)))))
    return (x[..., 0] * best).sum(1) / x[..., 0].sum(1) + ROUNDING


def similar_pairs(candidates: DataFrame, references: DataFrame, key: str, least: float, span: float = 1.0, k: tuple[float, float] = (0.01, 0.03)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b) pairs of a candidate and a reference of the same shape that an index lets meet, those that the bound of :func:`ssim_bounds`
    leaves, and of these the ones whose structural similarity is at least ``least``, with ``ssim`` (L3, C5). Images have height,
    width and data.

    If the similarity is at least ``least``, the means of the images' log maps are no further apart than :func:`_reach`, so images meet
    where those are in the same cell or the next. Neither side is broadcast or collected; pixels are joined to pairs that the bound
    leaves, and compared there."""
    widths = [_reach(least - ROUNDING, float(np.arcsinh(top / (c * span)))) for top, c in ((span, k[0]), (span / 2, k[1]))]
    cell = [F.floor(F.col(c) / (w + ROUNDING)).alias(f"c{n}") for n, (c, w) in enumerate(zip(("mu", "sigma"), widths, strict=True))]
    a = ssim_index(candidates, [key], span, k).select(F.col(key).alias("a"), "shape", F.col("blocks").alias("x"), *cell)
    around = F.explode(F.array(*[F.struct((cell[0] + i).alias("c0"), (cell[1] + j).alias("c1")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = ssim_index(references, [key], span, k).select(F.col(key).alias("b"), "shape", F.col("blocks").alias("y"), around.alias("c")).select("b", "shape", "y", "c.*")
    met = a.join(b, ["shape", "c0", "c1"]).select("a", "b", "x", "y")

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # Pairs have the same shape, but a batch may hold several.
            for _, part in pdf.groupby(pdf["x"].map(len)):
                bounds = ssim_bounds(np.stack(part["x"].to_list()), np.stack(part["y"].to_list()))
                yield part[["a", "b"]].assign(bound=bounds)[bounds >= least]

    kind = met.schema["a"].dataType.simpleString()
    left = met.mapInPandas(bounded, f"a {kind}, b {kind}, bound double")
    image = lambda rows, name: rows.select(F.col(key).alias(name), F.struct("height", "width", "data").alias(f"image_{name}"))
    pairs = left.join(image(candidates, "a"), "a").join(image(references, "b"), "b")
    pairs = pairs.select("a", "b", *[F.col(f"image_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("height", "width", "data")])

    def compared(height_a, width_a, data_a, height_b, width_b, data_b) -> list[tuple]:
        value = ssim(pixels(height_a, width_a, data_a), pixels(height_b, width_b, data_b), span, k)[0]
        return [(value,)] if value >= least else []

    return met.select("a", "b"), left, mapped(pairs, ["a", "b"], "ssim double", compared, [f"{c}_{s}" for s in "ab" for c in ("height", "width", "data")])


def _blurs(x: np.ndarray, g: np.ndarray) -> np.ndarray:
    """:func:`_blur` of many small images at once (images, channels, rows, columns), by matrices."""
    for axis in (3, 2):
        n = x.shape[axis]
        if n >= len(g):
            band = np.zeros((n, n - len(g) + 1))
            for k in range(band.shape[1]):
                band[k : k + len(g), k] = g
            x = x @ band if axis == 3 else band.T @ x
    return x


def ssim_table(x: np.ndarray, y: np.ndarray, span: float = 1.0, k: tuple[float, float] = (0.01, 0.03), values: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first of x, place in y, similarities): :func:`ssim` of each of many small images (images, rows, columns, channels) with each of others,
    in parts of bounded size."""
    g, (c1, c2) = _window(), ((k[0] * span) ** 2, (k[1] * span) ** 2)
    x, y = (np.ascontiguousarray(z.transpose(0, 3, 1, 2), np.float64) for z in (x, y))
    mean_y = _blurs(y, g)
    var_y = _blurs(y * y, g) - mean_y * mean_y
    step = max(1, values // max(1, x[:1].size))
    for low in range(0, len(x), step):
        part = x[low : low + step]
        mean = _blurs(part, g)
        square = mean * mean
        var = _blurs(part * part, g) - square
        for j in range(len(y)):
            both = mean * mean_y[j]
            ab = _blurs(part * y[j], g) - both
            value = (2 * both + c1) / (square + mean_y[j] * mean_y[j] + c1) * ((2 * ab + c2) / (var + var_y[j] + c2))
            yield low, j, value.mean((2, 3)).mean(1)


def multi_ssim(x: np.ndarray, y: np.ndarray, span: float = 1.0, weights: tuple[float, ...] = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)) -> float:
    """SSIM over five scales, each half of the one before (L3). Negative parts count as 0."""
    out = 1.0
    for level, w in enumerate(weights):
        full, contrast = ssim(x, y, span)
        out *= max(0.0, full if level + 1 == len(weights) else contrast) ** w
        h, v = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
        x, y = ((z[:h, :v].reshape(h // 2, 2, v // 2, 2, -1)).mean((1, 3)) for z in (x, y))
    return out


def noise(x: np.ndarray) -> float:
    """Standard deviation of an image's noise, from the diagonal wavelet details: their median magnitude over 0.6745."""
    h, v = x.shape[0] // 2 * 2, x.shape[1] // 2 * 2
    z = x[:h, :v].astype(np.float64).reshape(h // 2, 2, v // 2, 2, -1)
    detail = (z[:, 0, :, 0] - z[:, 0, :, 1] - z[:, 1, :, 0] + z[:, 1, :, 1]) / 2
    return float(np.mean([np.median(np.abs(detail[..., c])) for c in range(detail.shape[2])]) / 0.6745)


def noise_ranking(images: DataFrame, scene: str, order: str, digits: int = 6) -> DataFrame:
    """(scene, order, sigma): the noise of each scene's first image, the noisiest first (D28, F6). Only first images' pixels are read."""
    first = images.groupBy(scene).agg(F.min(order).alias(order))
    kept = images.join(first, [scene, order], "left_semi")
    found = mapped(kept, [scene, order], "sigma double", lambda height, width, data: [(noise(pixels(height, width, data)),)], ["height", "width", "data"])
    return found.withColumn("sigma", F.round("sigma", digits)).orderBy(F.desc("sigma"), scene)


def depth_agreement(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Percent of structural similarity of two depth maps of a scene (D29); infinite depths count as 100."""

    def make(height: int, width: int, a: bytes, b: bytes) -> list[tuple]:
        maps = [np.frombuffer(m, "<f4").reshape(height, width, 1).copy() for m in (a, b)]
        for m in maps:
            m[~np.isfinite(m)] = 100
        span = max(float(m.max()) for m in maps) - min(float(m.min()) for m in maps)
        return [(100 * ssim(*maps, span=span or 1.0)[0],)]

    return mapped(pairs, keys, "percent double", make, ["height", "width", "a", "b"])


#: The first three corners of a box's six faces, and which way round each shows its front.
FACES = [[0, 1, 3], [4, 5, 7], [0, 1, 5], [2, 3, 7], [0, 2, 6], [1, 3, 7]]
FRONT = [-1, 1, 1, -1, -1, 1]


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Of each batch the instances in front of the camera, their corners in pixels, and the corners' depths."""
    for pdf in batches:
        pdf = pdf[pdf[["low", "high", "world", "camera", "matrix"]].notna().all(axis=1)]
        if pdf.empty:
            continue
        low, high = (np.stack(pdf[c].to_list()).astype(float) for c in ("low", "high"))
        bits = np.arange(8)[:, None] >> np.arange(3) & 1
        corners = np.where(bits == 1, high[:, None], low[:, None])
        square = lambda c, n: np.stack(pdf[c].to_list()).astype(float).reshape(-1, n, n)
        world, camera, matrix = square("world", 4), square("camera", 4), square("matrix", 3)
        at = np.concatenate([corners, np.ones((len(corners), 8, 1))], 2)
        flat = np.einsum("nij,njk,nkl,ncl->nci", matrix, camera[:, :3], world, at, optimize=True)
        depth = np.einsum("njk,nkl,ncl->ncj", camera[:, 2:3], world, at, optimize=True)[..., 0]
        front = (depth > 0).all(1)
        if not front.any():
            continue
        yield pdf[front], flat[front, :, :2] / flat[front, :, 2:], depth[front]


def projected(instances: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, corner, x, y, depth): the corners of 3-D boxes in the camera's pixels (H26). ``instances`` has low and high corners, a row-major
    4x4 matrix to the world, one to the camera, and the camera's 3x3 matrix. An instance with a corner behind the camera goes, as does
    one with something missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, xy, depth in _seen(batches):
            out = pdf[keys].loc[pdf.index.repeat(8)].reset_index(drop=True)
            yield out.assign(corner=np.tile(np.arange(8, dtype=np.int32), len(pdf)), x=xy[..., 0].reshape(-1), y=xy[..., 1].reshape(-1), depth=depth.reshape(-1))

    kinds = ", ".join(f"{k} {instances.schema[k].dataType.simpleString()}" for k in keys)
    return instances.select(*keys, "low", "high", "world", "camera", "matrix").mapInPandas(run, f"{kinds}, corner int, x double, y double, depth double")


def visible_faces(instances: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, faces): of the boxes that :func:`projected` shows, the faces that turn their fronts to the camera (H26): those whose corners, in
    whole pixels, go round the other way than they do seen from outside."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, xy, _ in _seen(batches):
            p = np.trunc(xy)[:, FACES]
            a, b = p[:, :, 1] - p[:, :, 0], p[:, :, 2] - p[:, :, 0]
            turned = (a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]) * FRONT < 0
            yield pdf[keys].assign(faces=[np.flatnonzero(t).astype(np.int32) for t in turned])

    kinds = ", ".join(f"{k} {instances.schema[k].dataType.simpleString()}" for k in keys)
    return instances.select(*keys, "low", "high", "world", "camera", "matrix").mapInPandas(run, f"{kinds}, faces array<int>")
