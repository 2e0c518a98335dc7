"""Exact, seeded splits and ranks without a single large partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import int_hash


def ranked(rows: DataFrame, order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Exact global rank from 0. ``bucket`` is a coarse number that rises with ``order``: its counts give the offsets (at
    most one row for each bucket meets in one task), and rows are ranked only within their bucket."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offset = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    offsets = counts.select("_bucket", offset.alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    # There are at most 65,536 buckets of a hash, so the offsets are small whatever the rows are.
    return rows.join(F.broadcast(offsets), "_bucket").withColumn(name, (F.col("_offset") + inside).cast("long")).drop("_bucket", "_offset")


def hash_ranked(rows: DataFrame, key: str, seed: int, name: str = "rank") -> DataFrame:
    """Rank of a seeded shuffle."""
    h = int_hash(seed, F.col(key))
    return ranked(rows.withColumn("_hash", h), [F.col("_hash"), F.col(key)], F.floor(F.col("_hash") / 65536), name).drop("_hash")


def protected_pick(rows: DataFrame, kind: str, member: str, seed: int) -> DataFrame:
    """One member of each type, by the least hash."""
    pairs = rows.select(kind, member).distinct()
    return pairs.groupBy(kind).agg(F.min_by(member, F.struct(int_hash(seed, F.col(kind), F.lit("/"), F.col(member)), F.col(member))).alias("picked"))


def sizes(n: int, ratios: tuple[float, float, float], protected: int = 0) -> tuple[int, int, int]:
    """Exact sizes of train, val and test; the ratios must sum to 1, and train must hold all that are protected."""
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must sum to 1")
    val, test = int(ratios[1] * n + 0.5), int(ratios[2] * n + 0.5)
    train = n - val - test
    if train < 0 or protected > train:
        raise ValueError(f"{protected} protected of {n} do not fit into a train split of {train}")
    return train, val, test


def split(rows: DataFrame, key: str, seed: int, ratios: tuple[float, float, float] = (0.9, 0.05, 0.05), protected: DataFrame | None = None) -> DataFrame:
    """``rows`` (one for each key) with ``split``: exact sizes, protected keys in train, the others by seeded rank."""
    n = rows.count()
    marked = rows.withColumn("_free", F.lit(True))
    kept = 0
    if protected is not None:
        names = protected.select(F.col(protected.columns[0]).alias(key)).distinct()
        kept = rows.join(names, key, "left_semi").count()
        marked = rows.join(names.withColumn("_kept", F.lit(True)), key, "left").withColumn("_free", F.col("_kept").isNull()).drop("_kept")
    train, val, _ = sizes(n, ratios, kept)
    free = hash_ranked(marked.where("_free"), key, seed, "_rank").withColumn("split", F.when(F.col("_rank") < train - kept, "train").when(F.col("_rank") < train - kept + val, "val").otherwise("test"))
    fixed = marked.where(~F.col("_free")).withColumn("split", F.lit("train"))
    return free.drop("_rank", "_free").unionByName(fixed.drop("_free"))


def with_generated(parts: DataFrame, generated: DataFrame, key: str, leaked: DataFrame | None = None) -> DataFrame:
    """A split, and generated materials in its training part alone, but for those that leak a held-out one (G1)."""
    added = generated if leaked is None else generated.join(leaked.select(key).distinct(), key, "left_anti")
    return parts.select(key, "split").unionByName(added.select(key, F.lit("train").alias("split")))


def length_batches(rows: DataFrame, key: str, length: str, seed: int, batch: int = 4, mega: int = 50) -> DataFrame:
    """Batches of similar length: a seeded shuffle is cut into groups of ``batch * mega``, each sorted by length, longest first."""
    ranked_rows = hash_ranked(rows, key, seed).withColumn("mega", F.floor(F.col("rank") / (batch * mega)))
    place = F.row_number().over(Window.partitionBy("mega").orderBy(F.desc(length), key)) - 1
    return ranked_rows.withColumn("batch", (F.col("mega") * mega + F.floor(place / batch)).cast("long"))
