"""Statistics of parameters, types and signatures. Everything is aggregated partially before a shuffle; nothing collects observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch that narrows a percentile down: its ranks are wrong by a share of 1 / SKETCH at most.
SKETCH = 10_000
#: Groups whose bounds are broadcast at most; more are joined by shuffle.
EDGES = 10_000


def numeric_stats(rows: DataFrame, keys: list[str], value: str, default: float | Column, low: float, high: float, digits: int = 6) -> DataFrame:
    """Per key: count, observations at the default, outliers (outside the default range), range, mean, population deviation."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.count_if(v == default).alias("default_count"),
        F.count_if((v < low) | (v > high)).alias("outlier_count"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.round(F.avg(v), digits).alias("mean"),
        F.round(F.stddev_pop(v), digits).alias("std"),
    )


def vector_stats(rows: DataFrame, keys: list[str], vector: str, digits: int = 6) -> DataFrame:
    """Per key and component: count, range, mean, population deviation."""
    flat = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return flat.groupBy(*keys, "pos").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.round(F.avg("x"), digits).alias("mean"), F.round(F.stddev_pop("x"), digits).alias("std"))


def array_stats(rows: DataFrame, keys: list[str], array: str, digits: int = 6) -> DataFrame:
    """Per key, array length and position: count, mean, population deviation (D3)."""
    flat = rows.select(*keys, F.size(array).alias("length"), F.posexplode(array).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return flat.groupBy(*keys, "length", "pos").agg(F.count("x").alias("n"), F.round(F.avg("x"), digits).alias("mean"), F.round(F.stddev_pop("x"), digits).alias("std"))


def frequencies(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key and value: how often (D2), in long form; :func:`as_map` folds it."""
    return rows.groupBy(*keys, value).agg(F.count("*").alias("n"))


def as_map(counted: DataFrame, keys: list[str], value: str) -> DataFrame:
    return counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("freq"))


def with_defaults(signatures: DataFrame, observed: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """Every signature row with its observed value, else its default (C3); ``implied`` tells which."""
    joined = signatures.join(observed, keys, "left")
    return joined.withColumn("implied", F.col(value).isNull()).withColumn(value, F.coalesce(value, default))


def coverage(rows: DataFrame, kind: str, member: str) -> DataFrame:
    """Per type: its distinct members, counted and listed in order."""
    return rows.select(kind, member).distinct().groupBy(kind).agg(F.count("*").alias("members"), F.array_sort(F.collect_list(member)).alias("ids"))


def conflicts(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Keys with more than one distinct signature."""
    marked = rows.select(key, F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint")).distinct()
    return marked.groupBy(key).agg(F.count("*").alias("signatures")).where("signatures > 1")


def suffixed(rows: DataFrame, key: str, parts: list[str], order: str) -> DataFrame:
    """Distinct signatures of each key, numbered by where they were first seen: the first has no suffix, others _001, _002, ...."""
    first = rows.groupBy(key, *parts).agg(F.min(order).alias("first_seen"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("first_seen")) - 1
    return first.withColumn("registered", F.when(n == 0, F.col(key)).otherwise(F.concat(F.col(key), F.format_string("_%03d", n))))


def group_sizes(members: DataFrame, group: str, subgroup: str) -> DataFrame:
    """Per group: nodes, nodes with one level of subgroups in their place, and the subgroups in order."""
    own = members.groupBy(group).agg(F.count("*").alias("size"))
    inner = members.where(F.col(subgroup).isNotNull()).join(own.select(F.col(group).alias(subgroup), F.col("size").alias("inner")), subgroup)
    inner = inner.groupBy(group).agg(F.sum(F.col("inner") - 1).alias("more"), F.array_sort(F.collect_set(subgroup)).alias("subgroups"))
    return own.join(inner, group, "left").select(group, "size", (F.col("size") + F.coalesce("more", F.lit(0))).alias("full_size"), F.coalesce("subgroups", F.array().cast("array<string>")).alias("subgroups"))


def percentiles(rows: DataFrame, keys: list[str], value: str, levels: dict[str, float], digits: int = 6) -> DataFrame:
    """Per key: exact percentiles with linear interpolation, one column for each of ``levels``; null without a value.

    A sketch gives for each level two values between which it must lie; values below are only counted, and those between
    are counted by value and ranked. So a group of a third of all rows sends a few thousandths of them, not all."""
    v, n = F.col(value), F.count(value)
    sketch = lambda p: F.percentile_approx(value, F.lit(min(1.0, max(0.0, p))), SKETCH)
    few = n < SKETCH
    least, most = F.min(value), F.max(value)
    bounds = [F.struct(F.lit(name).alias("level"), (F.lit(p) * (n - 1)).alias("at"), F.when(few, least).otherwise(sketch(p - 2 / SKETCH)).alias("low"), F.when(few, most).otherwise(sketch(p + 2 / SKETCH)).alias("high")) for name, p in levels.items()]
    edges = rows.groupBy(*keys).agg(F.array(*bounds).alias("_edges"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    small = edges.limit(EDGES + 1).count() <= EDGES
    met = rows.select(*keys, value).where(v.isNotNull()).alias("r").join((F.broadcast(edges) if small else edges).alias("e"), same)
    met = met.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col(f"r.{value}").alias("v"), F.explode("e._edges").alias("x")).where("v <= x.high")
    # What is below a level's bounds counts at one null value, which sorts first.
    counted = met.select(*keys, "x.level", "x.at", F.when(F.col("v") >= F.col("x.low"), F.col("v")).alias("v")).groupBy(*keys, "level", "at", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "level", "at").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", upto)
    pick = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v").cast("double")))
    found = placed.groupBy(*keys, "level", "at").agg(pick(F.floor("at")).alias("a"), pick(F.ceil("at")).alias("b"))
    mixed = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return found.groupBy(*keys).agg(*[F.round(F.max(F.when(F.col("level") == name, mixed)), digits).alias(name) for name in levels])


def spread(rows: DataFrame, keys: list[str], value: str, digits: int = 6) -> DataFrame:
    """Mean, least, median and high percentiles, with linear interpolation."""
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.min(value), digits).alias("least")).alias("o")
    names = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    levels = percentiles(rows, keys, value, names, digits).alias("l")
    both = out.join(levels, [F.col(f"o.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys], "left")
    return both.select(*[F.col(f"o.{k}").alias(k) for k in keys], "n", "mean", "least", *names)
