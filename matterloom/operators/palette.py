"""Colour palettes: mixtures of Gaussians over pixels, and draws from them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform


def fit(pixels: DataFrame, column: str, colors: int, seed: int, rounds: int = 50) -> list[dict]:
    """The mixture of one keyword's pixels (arrays of three): weight, mean, and the Cholesky factor of the covariance with 1e-5
    on its diagonal, heaviest first. Spark fits it; a few 3x3 matrices are factored here."""
    vectors = pixels.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = GaussianMixture(k=colors, seed=seed, maxIter=rounds).fit(vectors)
    parts = [(w, g.mean.toArray(), g.cov.toArray()) for w, g in zip(model.weights, model.gaussians, strict=True)]
    return [{"weight": float(w), "mean": m.tolist(), "factor": np.linalg.cholesky(c + 1e-5 * np.eye(3)).tolist()} for w, m, c in sorted(parts, key=lambda p: -p[0])]


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue from 0 to 1."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return [channel(5), channel(3), channel(1)]


def rgb_to_hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue, saturation and value from 0 to 1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span == 0, 0.0).when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return [hue / 6, F.when(top == 0, 0.0).otherwise(span / top), top]


def jittered(color: Column, reach: float, *keys: Column | str | int) -> Column:
    """A colour (array of three or four) moved in HSV (H24): the hue is drawn freely, the others within ``reach``, from 0 to 1."""
    h, s, v = rgb_to_hsv(*[F.element_at(color, k) for k in (1, 2, 3)])
    move = lambda x, name: F.least(F.greatest(x + (2 * uniform(*keys, F.lit(name)) - 1) * reach, F.lit(0.0)), F.lit(1.0))
    rgb = F.array(*hsv_to_rgb(uniform(*keys, F.lit("h")), move(s, "s"), move(v, "v")))
    return F.when(F.size(color) == 4, F.concat(rgb, F.array(move(F.element_at(color, 4), "a")))).otherwise(rgb)


def linear(x: Column) -> Column:
    """A channel of sRGB in linear light."""
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))


def drawn(rows: DataFrame, key: str, palette: list[dict], seed: int) -> DataFrame:
    """A colour for each row (I7): a component by weight, its mean and a clipped draw through its factor, the value kept from 0.1 to 0.9."""
    from .sampling import normal

    total = sum(p["weight"] for p in palette)
    ends = np.cumsum([p["weight"] for p in palette])
    draws = {f"_{n}": F.least(F.greatest(normal(seed, F.col(key), F.lit(n)), F.lit(-1.0)), F.lit(1.0)) for n in "xyz"}
    rows = rows.withColumns(draws).withColumn("_u", uniform(seed, F.col(key), F.lit("c")) * total)
    z = [F.col("_x"), F.col("_y"), F.col("_z")]
    mixed = [F.array(*[sum((z[j] * p["factor"][i][j] for j in range(i + 1)), F.lit(p["mean"][i])) for i in range(3)]) for p in palette]
    rows = rows.withColumn("_hsv", F.coalesce(*[F.when(F.col("_u") <= float(e), m) for e, m in zip(ends, mixed, strict=True)], mixed[-1])).drop("_x", "_y", "_z", "_u")
    h, s, v = (F.col("_hsv")[k] for k in range(3))
    rgb = hsv_to_rgb(F.pmod(h, F.lit(1.0)), F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(v, F.lit(0.1)), F.lit(0.9)))
    return rows.withColumn("color", F.array(*[linear(c) for c in rgb])).drop("_hsv")
