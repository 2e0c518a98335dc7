"""Sharding by a permutation-filled lookup table: every shard has an order of preference over the slots of a
prime-sized table; shards take turns, each claiming the first free slot in its order, until the table is full. A key
goes to slot ``hash mod size``; the broadcast table gives its shard in constant time. When a shard goes, only a small
part of the other shards' slots changes hands.

The table's size is a parameter and does not depend on the data: filling it is a fixed number of steps, done once
when the plan is made. Placement is a column expression and a broadcast hash join, without Python on the executors;
it shuffles nothing, and a hot source or group of copies spreads by its doc_ids.

Defined results: a null key is hashed as the empty string; equal keys share a shard; an empty table gives an empty
result; columns named ``slot`` or ``shard`` are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:02d}" for i in range(24))
SIZE = 4099


def key_hash(key: Column) -> Column:
    """The first 32 bits of the md5 of a key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> list[int]:
    """The number of the shard in each slot. Shard i prefers slots ``(offset + j * skip) mod size`` for j = 0, 1, ..."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is not a prime")
    if not 0 < len(shards) <= size:
        raise ValueError("there must be a shard, and a slot for each")
    at = [_hash(f"offset:{s}") % size for s in shards]
    skip = [_hash(f"skip:{s}") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot, shard), one row for each slot."""
    quoted = ", ".join("'{}'".format(s.replace("\\", "\\\\").replace("'", "\\'")) for s in shards)
    numbers = ",".join(map(str, fill(shards, size)))
    return spark.sql(f"SELECT pos AS slot, element_at(array({quoted}), CAST(n AS INT) + 1) AS shard FROM (SELECT posexplode(split('{numbers}', ',')) AS (pos, n))")


def place(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``."""
    rows = rows.drop("slot", "shard").withColumn("slot", (key_hash(F.col(key)) % size).cast("int"))
    table = F.broadcast(lookup(rows.sparkSession, shards, size))
    return rows.join(table, "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")


def place_sql(table: str, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> str:
    """The same placement as DuckDB SQL that fills the table by a recursive query, one turn a step."""
    names = ", ".join("'" + s.replace("'", "''") + "'" for s in shards)
    return f"""
    WITH RECURSIVE shards AS (SELECT generate_subscripts([{names}], 1) - 1 AS i, unnest([{names}]) AS shard),
    prefs AS (SELECT i, shard, ('0x' || substr(md5('offset:' || shard), 1, 8))::BIGINT % {size} AS off,
                     ('0x' || substr(md5('skip:' || shard), 1, 8))::BIGINT % ({size} - 1) + 1 AS skip FROM shards),
    turns(t, slot, i, free) AS (
      SELECT 0, off, i, [k <> off FOR k IN range({size})] FROM prefs WHERE i = 0
      UNION ALL
      SELECT t + 1, s, i, [free[k + 1] AND k <> s FOR k IN range({size})] FROM (
        SELECT t, p.i, free, [(off + j * skip) % {size} FOR j IN range({size}) IF free[(off + j * skip) % {size} + 1]][1] AS s
        FROM turns JOIN prefs p ON p.i = (t + 1) % {len(shards)} WHERE t + 1 < {size}))
    SELECT d.{key}, turns.slot::INT AS slot, shard FROM {table} d
    JOIN turns ON turns.slot = ('0x' || substr(md5(coalesce(d.{key}::VARCHAR, '')), 1, 8))::BIGINT % {size} JOIN shards USING (i)"""
