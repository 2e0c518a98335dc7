"""Seeded draws: every random choice is a hash of explicit keys, so it does not depend on partitions and reruns agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967295


def int_hash(*parts: Column | str | int) -> Column:
    """The md5 of the concatenated parts as a number, modulo 2^32 - 1. That is the sum of its four 32-bit words, modulo the same."""
    text = F.concat(*[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    words = [F.conv(F.substring(F.md5(text), k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25)]
    return (words[0] + words[1] + words[2] + words[3]) % SPAN


def uniform(*parts: Column | str | int) -> Column:
    """A draw from [0, 1]."""
    return int_hash(*parts) / SPAN


def int_hash_sql(text: str) -> str:
    """:func:`int_hash` of a text expression, for DuckDB."""
    return "((" + " + ".join(f"('0x' || substr(md5({text}), {k}, 8))::BIGINT" for k in (1, 9, 17, 25)) + f") % {SPAN})"
