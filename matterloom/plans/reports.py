"""Costs, inventories, memory and polygons over formatted lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from . import query


@query("SELECT user_id, sum(event_id % 900)::BIGINT AS tokens_in, sum(event_id % 70)::BIGINT AS tokens_out, round(sum(event_id % 900) * 1.5e-7 + sum(event_id % 70) * 6e-7, 9) AS cost FROM events GROUP BY ALL")
def token_costs(t):
    return reports.token_costs(t.events.select("user_id", (F.col("event_id") % 900).alias("i"), (F.col("event_id") % 70).alias("o")), "user_id", "i", "o")


@query("SELECT event_type AS gpu, 'part' || user_id % 4 AS \"partition\", sum(event_id % 8 + 1)::BIGINT AS units FROM events GROUP BY ALL")
def gpu_inventory(t):
    line = F.format_string("node%d part%d gpu:%s:%d(IDX:0-3)", "user_id", F.col("user_id") % 4, "event_type", F.col("event_id") % 8 + 1)
    return reports.hardware(t.events.select(line.alias("line")), "line")[0]


@query("""WITH m AS (SELECT event_id AS job_id, user_id AS seed, 'job_' || event_type || '_' || event_id % 3 AS name, CASE WHEN event_id % 4 = 0 THEN -1.0 ELSE event_id / 1e3 END AS peak_gb FROM events WHERE user_id % 2 = 0),
  s(step) AS (VALUES ('click'), ('view'), ('w_1')) SELECT step, count(peak_gb) AS n, round(avg(peak_gb), 6) AS mean, round(min(peak_gb), 6) AS least, round(quantile_cont(peak_gb, 0.5), 6) AS median, round(quantile_cont(peak_gb, 0.9), 6) AS p90, round(quantile_cont(peak_gb, 0.95), 6) AS p95, round(quantile_cont(peak_gb, 0.99), 6) AS p99
  FROM m JOIN s ON contains(name, step) GROUP BY ALL""")
def step_memory(t):
    jobs = t.events.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("seed"), F.concat(F.lit("job_"), "event_type", F.lit("_"), F.col("event_id") % 3).alias("name"))
    memory = t.events.where("event_id % 4 <> 0").select(F.col("event_id").alias("job_id"), F.concat("event_id", F.lit("M")).alias("size"))
    finished = t.events.where("user_id % 2 = 0").select(F.col("user_id").alias("seed"))
    return reports.memory_by_step(reports.job_memory(jobs, memory, finished), t.spark.sql("SELECT * FROM VALUES ('click'), ('view'), ('w_1') AS s(step)"))


@query("""WITH l AS (SELECT o_orderkey, replace(CASE WHEN o_orderkey % 2 = 0 THEN format('x Faces:{:,}Tris:{:,} y', o_orderkey * 1000 + 7, o_orderkey * 2000) ELSE 'none' END || CASE WHEN o_orderkey % 3 = 0 THEN format('Faces:{:,}Tris:{:,}', o_orderkey, o_custkey) ELSE 'Faces:Tris:5' END, ',', '') AS text FROM orders),
  p AS (SELECT o_orderkey, regexp_extract_all(text, 'Faces:[0-9]+Tris:[0-9]+') AS found FROM l), q AS (SELECT o_orderkey, unnest(found) AS f, generate_subscripts(found, 1) - 1 AS pos FROM p)
  SELECT o_orderkey, pos, regexp_extract(f, 'Faces:([0-9]+)', 1)::BIGINT AS faces, regexp_extract(f, 'Tris:([0-9]+)', 1)::BIGINT AS triangles FROM q""")
def polygon_counts(t):
    n = lambda c: F.format_number(c, 0)
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x Faces:"), n(F.col("o_orderkey") * 1000 + 7), F.lit("Tris:"), n(F.col("o_orderkey") * 2000), F.lit(" y"))).otherwise("none")
    text = F.concat(text, F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Faces:"), n(F.col("o_orderkey")), F.lit("Tris:"), n(F.col("o_custkey")))).otherwise("Faces:Tris:5"))
    return reports.polygons(t.orders.select("o_orderkey", text.alias("text")), "o_orderkey", "text")


@query("SELECT count(*) AS finished, count(*) >= 0.8 * 200 AS enough FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')")
def completion_gate(t):
    return reports.completion(t.events.where("event_type = 'purchase'").select("user_id").distinct(), 200)


@query("SELECT c_name, c_custkey FROM customer WHERE regexp_full_match(c_name, 'Customer#0*[1-9]+') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY c_name LIMIT 25")
def predicted_examples(t):
    predictions = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).join(t.customer, "c_custkey").select("c_name")
    return reports.with_predictions(t.customer.select("c_name", "c_custkey"), predictions, "c_name", "Customer#0*[1-9]+", 25)


@query("""WITH o AS (SELECT doc_id, text || CASE WHEN lang = 'en' THEN 'Error: Python: x ' ELSE 'ok ' END || CASE WHEN n_chars % 4 = 0 THEN 'Unsupported node type ' ELSE '' END || text || CASE WHEN n_chars % 9 = 0 THEN 'Oversized node graph' ELSE '' END AS output FROM documents)
  SELECT doc_id FROM o WHERE contains(output, 'Error: Python:') AND NOT contains(output, 'Unsupported node type') AND NOT contains(output, 'Oversized node graph')""")
def unexpected_errors(t):
    n = F.col("n_chars")
    out = F.concat("text", F.when(F.col("lang") == "en", "Error: Python: x ").otherwise("ok "), F.when(n % 4 == 0, "Unsupported node type ").otherwise(""), "text", F.when(n % 9 == 0, "Oversized node graph").otherwise(""))
    return reports.unexpected(t.documents.select("doc_id", out.alias("output")), "output").select("doc_id")


@query("""SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / 64, 6) AS l1, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2))), 6) AS l2
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def pair_distances(t):
    a = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(reports.distance(F.col("a"), F.col("b")), 6).alias("l1"), F.round(reports.distance(F.col("a"), F.col("b"), "l2"), 6).alias("l2"))
