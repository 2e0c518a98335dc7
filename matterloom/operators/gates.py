"""Quality gates: ordered checks of which the first that fails gives the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of render checks.
DARK, LIGHT, SHARE, FLAT, SMALL, SHRINK = 0.01, 0.99, 0.9, 0.05, 12_000, 0.4
TOKENS = 2048


def first_failure(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check whose condition (of failing) holds; null if none does."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for failed, reason in checks])


def rejected(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that pass, and those that don't with their ``reason``."""
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def summary(marked: DataFrame) -> DataFrame:
    """Rejections by reason, with their share of all (D8); passing rows are under ``passed``."""
    counted = marked.groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("reason", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def by_source(rows: DataFrame, source: str, generated: bool | None) -> DataFrame:
    """All rows, only generated ones, or only others (B1)."""
    return rows if generated is None else rows.where(F.col(source).startswith("mat_llm") == generated)


def token_count(text: Column) -> Column:
    """The built-in count of code tokens: words, and single other characters that are no white space."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def templated(code: Column, prompt: str = "Write a program for this material.") -> Column:
    return F.concat(F.lit(prompt), F.lit("\n```python\n"), code, F.lit("\n```"))


def too_small(length: Column, original: Column | None = None, least: int = SMALL) -> Column:
    """A file below the least size; a variation also below a share of its original's."""
    floor = F.lit(least) if original is None else F.greatest(F.lit(least), (original * SHRINK).cast("long"))
    return length < floor


def unsupported(nodes: DataFrame, members: DataFrame, denied: list[str], material: str = "mat_name", kind: str = "type", group: str = "group_type", levels: int = 3) -> DataFrame:
    """Materials that use a denied node type, by themselves or inside a group, to the given nesting.
    ``members`` has (group, type, subgroup)."""
    bad = members.where(F.col(kind).isin(denied)).select(group).distinct()
    for _ in range(levels):
        outer = members.join(bad.select(F.col(group).alias("subgroup")), "subgroup", "left_semi").select(group)
        bad = bad.union(outer).distinct()
    direct = nodes.where(F.col(kind).isin(denied)).select(material)
    return direct.union(nodes.join(bad, group, "left_semi").select(material)).distinct()


def oversized(nodes: DataFrame, material: str = "mat_name", limit: int = 30) -> DataFrame:
    return nodes.groupBy(material).agg(F.count("*").alias("n")).where(F.col("n") > limit)
