"""Sampling and augmentation by hashes of explicit keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import int_hash, uniform
from .splits import hash_ranked


def pairs(items: DataFrame, key: str, cases: int, seed: int) -> DataFrame:
    """(case_id, first, second): two distinct items for each case (I2), by their seeded ranks. Without two items there is no case."""
    numbered = hash_ranked(items.select(key).distinct(), key, seed)
    n = numbered.count()
    if n < 2:
        return items.sparkSession.createDataFrame([], f"case_id long, first {items.schema[key].dataType.simpleString()}, second {items.schema[key].dataType.simpleString()}")
    i = int_hash(seed, F.lit("a"), F.col("case_id")) % n
    j = (i + 1 + int_hash(seed, F.lit("b"), F.col("case_id")) % (n - 1)) % n
    drawn = items.sparkSession.range(cases).withColumnRenamed("id", "case_id").select("case_id", i.alias("i"), j.alias("j"))
    one = numbered.select(F.col("rank").alias("i"), F.col(key).alias("first"))
    two = numbered.select(F.col("rank").alias("j"), F.col(key).alias("second"))
    return drawn.join(one, "i").join(two, "j").select("case_id", "first", "second")


def intervals(configs: DataFrame, name: str, weight: str) -> DataFrame:
    """Configurations, which are few, with the interval of cumulative weight that each holds: above ``lo``, up to ``hi``."""
    hi = F.sum(weight).over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    return configs.select(name, hi.alias("hi"), (hi - F.col(weight)).alias("lo"))


def by_weight(rows: DataFrame, configs: DataFrame, name: str, weight: str, draw: Column) -> DataFrame:
    """A configuration for each row, by a draw from [0, 1]."""
    total = configs.agg(F.sum(weight)).first()[0]
    at = rows.withColumn("_at", F.greatest(draw * total, F.lit(1e-12)))
    table = F.broadcast(intervals(configs, name, weight))
    return at.join(table, (F.col("_at") > F.col("lo")) & (F.col("_at") <= F.col("hi"))).drop("_at", "lo", "hi")


def round_robin(rows: DataFrame, configs: DataFrame, name: str, weight: str, index: str) -> DataFrame:
    """The configuration whose interval holds ``index mod total + 1``."""
    total = configs.agg(F.sum(weight)).first()[0]
    at = rows.withColumn("_at", F.col(index) % total + 1)
    table = F.broadcast(intervals(configs, name, weight))
    return at.join(table, (F.col("_at") > F.col("lo")) & (F.col("_at") <= F.col("hi"))).drop("_at", "lo", "hi")


def included(rows: DataFrame, seed: str, stage: str, chance: float) -> DataFrame:
    """Whether a stage runs in a scene, by the hash of both (I4)."""
    return rows.withColumn("runs", int_hash(F.col(seed), F.col(stage), 0) / 4294967295 <= chance)


def with_prerequisite(rows: DataFrame, seed: str, stage: str, prerequisite: str) -> DataFrame:
    """A stage whose prerequisite did not run in the same scene is skipped (I4)."""
    ran = rows.where("runs").select(seed, F.col(stage).alias(prerequisite)).distinct().withColumn("_ok", F.lit(True))
    joined = rows.join(ran, [seed, prerequisite], "left")
    return joined.withColumn("runs", F.col("runs") & (F.col(prerequisite).isNull() | F.coalesce("_ok", F.lit(False)))).drop("_ok")


def seeds(rows: DataFrame, index: str, start: int, end: int) -> DataFrame:
    """Hexadecimal seeds of an inclusive range."""
    return rows.where(F.col(index) <= end - start).withColumn("seed", F.lower(F.hex(F.col(index) + start)))


def subset(rows: DataFrame, group: str, key: str, seed: int, share: float = 0.1, least: int = 2) -> DataFrame:
    """A tenth of each group's rows, two at least, by hash."""
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(int_hash(seed, F.col(key)), key))
    n = F.count("*").over(w)
    return rows.withColumn("_r", rank).withColumn("_n", F.greatest(F.floor(n * share + 0.5), F.lit(least))).where("_r <= _n").drop("_r", "_n")


def normal(*keys: Column | str | int) -> Column:
    """A standard normal draw, by two hashes."""
    u, v = uniform(*keys, F.lit("u")), uniform(*keys, F.lit("v"))
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * v)


def varied(rows: DataFrame, variants: int, seed: int, key: str = "key", value: str = "value", default: str = "usual", confident: Column | None = None, part: float = 0.25, least: float = 0.05, odds: float = 0.2) -> DataFrame:
    """Parameter variations (I1). ``rows`` has a key, a value, its default, the range ``lo``/``hi``, and statistics ``n``, ``default_count``, ``mean``,
    ``std``. What is fixed stays: a range of one point, or always the default in 50 observations or more. A value at its default changes with
    chance ``odds``. With ``confident`` a value is drawn from the normal distribution of the statistics, else evenly around it."""
    drawn = rows.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    keys = (seed, F.col(key), F.lit("/"), F.col("variant"))
    fixed = (F.col("lo") == F.col("hi")) | ((F.col("n") >= 50) & (F.col("default_count") == F.col("n")))
    lazy = (F.col(value) == F.col(default)) & (uniform(*keys, F.lit("keep")) > odds)
    reach = F.greatest(F.abs(F.col(value)) * part, F.lit(least))
    even = F.col(value) + (2 * uniform(*keys, F.lit("move")) - 1) * reach
    wanted = even if confident is None else F.when(confident & (F.col("n") >= 20) & (F.col("std") <= 10), F.col("mean") + F.col("std") * normal(*keys)).otherwise(even)
    return drawn.withColumn("drawn", F.when(fixed | lazy, F.col(value)).otherwise(F.least(F.greatest(wanted, "lo"), "hi")))
