"""Seeded draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import int_hash_sql, uniform
from ..operators import sampling
from . import query

WEIGHTS = "c(config, weight) AS (VALUES ('forest', 2), ('river', 1), ('shore', 4)), k AS (SELECT config, weight, sum(weight) OVER (ORDER BY config) AS hi FROM c), i AS (SELECT config, hi - weight AS lo, hi FROM k)"


def _configs(t):
    return t.spark.sql("SELECT * FROM VALUES ('forest', 2), ('river', 1), ('shore', 4) AS c(config, weight)")


@query(f"WITH {WEIGHTS}, d AS (SELECT event_id, greatest({int_hash_sql("'13' || event_id")} / 4294967295 * 7, 1e-12) AS x FROM events) SELECT event_id, config FROM d JOIN i ON x > lo AND x <= hi")
def weighted_config(t):
    return sampling.by_weight(t.events.select("event_id"), _configs(t), "config", "weight", uniform(13, F.col("event_id")))


@query(f"WITH {WEIGHTS} SELECT event_id, config FROM events JOIN i ON event_id % 7 + 1 > lo AND event_id % 7 + 1 <= hi")
def roundrobin_config(t):
    return sampling.round_robin(t.events.select("event_id"), _configs(t), "config", "weight", "event_id")


@query(f"""WITH s AS (SELECT o_orderkey, 'stage' || n AS stage, CASE WHEN n > 0 THEN 'stage' || (n - 1) END AS needs, {int_hash_sql("o_orderkey || 'stage' || n || '0'")} / 4294967295 <= 0.6 AS own FROM orders, range(3) r(n))
  SELECT a.o_orderkey, a.stage, a.own AND (a.needs IS NULL OR b.own) AS runs FROM s a LEFT JOIN s b ON b.o_orderkey = a.o_orderkey AND b.stage = a.needs""")
def stage_inclusion(t):
    rows = t.orders.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    rows = rows.select("o_orderkey", F.concat(F.lit("stage"), "n").alias("stage"), F.when(F.col("n") > 0, F.concat(F.lit("stage"), F.col("n") - 1)).alias("needs"))
    return sampling.with_prerequisite(sampling.included(rows, "o_orderkey", "stage", 0.6), "o_orderkey", "stage", "needs").drop("needs")


@query(f"""WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY {int_hash_sql("'21' || c_custkey")}, c_custkey) - 1 AS rank, count(*) OVER () AS n FROM customer),
  d AS (SELECT c AS case_id, {int_hash_sql("'21a' || c")} AS a, {int_hash_sql("'21b' || c")} AS b FROM range(500) r(c)),
  x AS (SELECT case_id, a % n AS i, (a % n + 1 + b % (n - 1)) % n AS j FROM d, (SELECT count(*) AS n FROM customer))
  SELECT case_id, p.c_custkey AS first, q.c_custkey AS second FROM x JOIN n p ON p.rank = i JOIN n q ON q.rank = j""")
def pair_sample(t):
    return sampling.pairs(t.customer, "c_custkey", 500, 21)


@query(f"""SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {int_hash_sql("'2' || p_partkey")}, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r <= greatest(floor(0.1 * n + 0.5), 2)""")
def param_subset(t):
    return sampling.subset(t.part.select("p_brand", "p_partkey"), "p_brand", "p_partkey", 2)


@query("SELECT event_id, lower(to_hex(event_id + 255)) AS seed FROM events WHERE event_id <= 4745")
def seed_range(t):
    return sampling.seeds(t.events.select("event_id"), "event_id", 255, 5000)


@query(f"""WITH s AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount = 0) AS default_count, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY ALL),
  v AS (SELECT l_orderkey || ':' || l_linenumber AS key, l_discount AS value, variant, lo, hi, n, default_count FROM lineitem JOIN s USING (l_returnflag), range(2) r(variant)),
  u AS (SELECT *, {int_hash_sql("'6' || key || '/' || variant || 'keep'")} / 4294967295 AS k, {int_hash_sql("'6' || key || '/' || variant || 'move'")} / 4294967295 AS m FROM v)
  SELECT key, variant, round(CASE WHEN lo = hi OR (n >= 50 AND default_count = n) OR (value = 0 AND k > 0.2) THEN value ELSE least(greatest(value + (2 * m - 1) * greatest(abs(value) * 0.25, 0.05), lo), hi) END, 6) AS drawn FROM u""")
def param_variation(t):
    known = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") == 0).alias("default_count"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), F.avg("l_discount").alias("mean"), F.stddev_pop("l_discount").alias("std"))
    key = F.concat("l_orderkey", F.lit(":"), "l_linenumber")
    rows = t.lineitem.select(key.alias("key"), F.col("l_discount").alias("value"), F.lit(0.0).alias("usual"), "l_returnflag").join(known, "l_returnflag")
    return sampling.varied(rows, 2, 6).select("key", F.col("variant").cast("long").alias("variant"), F.round("drawn", 6).alias("drawn"))
