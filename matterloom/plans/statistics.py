"""Parameter statistics, coverage, signatures and splits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import int_hash_sql
from ..operators import splits, stats
from . import query


@query("""SELECT l_returnflag, l_linestatus, count(l_discount) AS n, count(*) FILTER (WHERE l_discount = 0) AS default_count,
  count(*) FILTER (WHERE l_discount < 0.01 OR l_discount > 0.09) AS outlier_count, min(l_discount) AS lo, max(l_discount) AS hi,
  round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std FROM lineitem GROUP BY ALL""")
def param_stats_numeric(t):
    return stats.numeric_stats(t.lineitem, ["l_returnflag", "l_linestatus"], "l_discount", 0.0, 0.01, 0.09)


@query("""SELECT label, (pos - 1)::INT AS pos, count(x) AS n, min(x) AS lo, max(x) AS hi, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
  FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL""")
def param_stats_vector(t):
    return stats.vector_stats(t.embeddings, ["label"], "embedding")


@query(r"""WITH a AS (SELECT lang, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS v FROM documents)
  SELECT lang, length::INT AS length, (pos - 1)::INT AS pos, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
  FROM (SELECT lang, len(v) AS length, generate_subscripts(v, 1) AS pos, unnest(v)::DOUBLE AS x FROM a) GROUP BY ALL""")
def param_stats_by_length(t):
    lengths = F.transform(F.split("text", "\n", -1), lambda x: F.length(x))
    return stats.array_stats(t.documents.select("lang", lengths.alias("v")), ["lang"], "v")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def param_freq(t):
    return stats.frequencies(t.orders, ["o_orderstatus"], "o_orderpriority")


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE q IS NULL) AS implied_count, round(avg(coalesce(q, 1.0)), 6) AS mean
  FROM part LEFT JOIN (SELECT l_partkey, l_quantity AS q FROM lineitem WHERE l_quantity <> 1.0 AND l_returnflag = 'R') ON l_partkey = p_partkey GROUP BY ALL""")
def implied_defaults(t):
    # Sparse observations: only values that differ from the default are stored, and linked ones are left out.
    seen = t.lineitem.where("l_quantity <> 1.0 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("q"))
    whole = stats.with_defaults(t.part.select("p_partkey", "p_brand", F.lit(1.0).alias("usual")), seen, ["p_partkey"], "q", "usual")
    return whole.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if("implied").alias("implied_count"), F.round(F.avg("q"), 6).alias("mean"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS members, list_sort(list(DISTINCT l_suppkey)) AS ids FROM lineitem GROUP BY ALL")
def type_coverage(t):
    return stats.coverage(t.lineitem, "l_returnflag", "l_suppkey")


@query(f"""SELECT l_linenumber, arg_min(l_suppkey, (h, l_suppkey)) AS picked FROM (SELECT DISTINCT l_linenumber, l_suppkey,
  {int_hash_sql("'7' || l_linenumber || '/' || l_suppkey")} AS h FROM lineitem) GROUP BY ALL""")
def protected_pick(t):
    return splits.protected_pick(t.lineitem, "l_linenumber", "l_suppkey", 7)


SPLIT = f"""WITH p AS (SELECT min_by(c_custkey, (h, c_custkey)) AS c_custkey FROM (SELECT c_mktsegment, c_custkey, {int_hash_sql("'5' || c_mktsegment || '/' || c_custkey")} AS h FROM customer) GROUP BY c_mktsegment),
  n AS (SELECT count(*) AS n, floor(0.05 * count(*) + 0.5)::BIGINT AS v FROM customer), k AS (SELECT count(*) AS k FROM p),
  f AS (SELECT c_custkey, row_number() OVER (ORDER BY {int_hash_sql("'3' || c_custkey")}, c_custkey) - 1 AS r FROM customer WHERE c_custkey NOT IN (FROM p)),
  s AS (SELECT c_custkey, CASE WHEN r < n - 2 * v - k THEN 'train' WHEN r < n - v - k THEN 'val' ELSE 'test' END AS split FROM f, n, k UNION ALL SELECT c_custkey, 'train' FROM p)"""


@query(SPLIT + " SELECT c_custkey, split FROM s")
def split_exact(t):
    kept = splits.protected_pick(t.customer, "c_mktsegment", "c_custkey", 5).select("picked")
    return splits.split(t.customer.select("c_custkey"), "c_custkey", 3, protected=kept)


@query(SPLIT + " SELECT split, count(DISTINCT s.c_custkey) AS materials, count(o_orderkey) AS samples FROM s LEFT JOIN orders ON o_custkey = s.c_custkey GROUP BY ALL")
def split_summary(t):
    parts = split_exact(t)
    return parts.join(t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "left").groupBy("split").agg(F.countDistinct("c_custkey").alias("materials"), F.count("o_orderkey").alias("samples"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def uncategorized(t):
    return t.customer.select("c_custkey", "c_name").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_brand, count(*) AS signatures FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part) GROUP BY p_brand HAVING count(*) > 1")
def signature_conflicts(t):
    return stats.conflicts(t.part, "p_brand", ["p_type", "p_size"])


@query("""SELECT p_brand, p_type, first_seen, CASE WHEN n = 0 THEN p_brand ELSE p_brand || printf('_%03d', n) END AS registered
  FROM (SELECT p_brand, p_type, min(p_partkey) AS first_seen, row_number() OVER (PARTITION BY p_brand ORDER BY min(p_partkey)) - 1 AS n FROM part GROUP BY p_brand, p_type)""")
def signature_suffix(t):
    return stats.suffixed(t.part, "p_brand", ["p_type"], "p_partkey")


@query("""WITH own AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, CASE WHEN l_partkey % 7 = 0 THEN l_partkey END AS sub FROM lineitem),
  i AS (SELECT m.l_orderkey, sum(own.size - 1)::BIGINT AS more FROM m JOIN own ON own.l_orderkey = m.sub GROUP BY ALL)
  SELECT l_orderkey, size, (size + coalesce(more, 0))::BIGINT AS full_size FROM own LEFT JOIN i USING (l_orderkey)""")
def group_sizes(t):
    members = t.lineitem.select("l_orderkey", F.when(F.col("l_partkey") % 7 == 0, F.col("l_partkey")).alias("sub"))
    return stats.group_sizes(members, "l_orderkey", "sub").drop("subgroups")


@query(f"""SELECT page_id, rank, rank // 500 AS chunk FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS rank FROM pages)""")
def page_chunks(t):
    # Buckets of consecutive ids rise with the order, so ranks are exact within them.
    return splits.ranked(t.pages.select("page_id"), [F.col("page_id")], F.floor(F.col("page_id") / 4096)).select("page_id", "rank", F.floor(F.col("rank") / 500).alias("chunk"))
