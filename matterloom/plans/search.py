"""Search, best of N and cached results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import int_hash_sql, uniform
from ..operators import search
from . import query

SCORES = """s AS (SELECT q.vec_id AS query, c.vec_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)"""


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5")
def topk_search(t):
    return search.top_k(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 5)


@query("SELECT user_id, arg_min(event_id, (value, event_id)) AS event_id, min(value) AS value FROM events GROUP BY ALL")
def best_of_n(t):
    return search.best_of(t.events, "user_id", "event_id", "value")


@query(r"""WITH h AS (SELECT 'q' || page_id % 50 AS query, page_id // 50 AS rank, CASE WHEN page_id % 3 = 0 THEN 0.0 ELSE page_id / 1000 END AS score,
    substr(sha256(CASE WHEN page_id % 4 = 0 THEN 'q' || page_id % 50 || '::rank=' || page_id // 50 ELSE regexp_extract(url, '^[a-z]+://[^/]+') END), 1, 16) AS key FROM pages),
  o AS (SELECT key FROM h WHERE rank = 0) SELECT key, min(query) AS query, arg_min(rank, (query, rank)) AS rank, arg_min(score, (query, rank)) AS score FROM h WHERE key NOT IN (FROM o) GROUP BY ALL""")
def search_cache_upsert(t):
    host = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    score = F.when(F.col("page_id") % 3 != 0, F.col("page_id") / 1000)
    none = F.lit(None).cast("string")
    result = F.struct(score.alias("score"), F.when(F.col("page_id") % 4 != 0, host).otherwise(none).alias("remote_script_path"), none.alias("remote_image_path"), "page_id")
    responses = t.pages.groupBy(F.concat(F.lit("q"), F.col("page_id") % 50).alias("query")).agg(F.array_sort(F.collect_list(F.struct("page_id", result.alias("r")))).alias("rows"))
    found = search.hits(responses.select("query", F.transform("rows", lambda x: x["r"]).alias("results")))
    return search.cache_new(found, found.where("rank = 0"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS example, event_id AS it, value AS metric, {int_hash_sql("'4' || user_id || '/' || event_id")} / 4294967295 AS draw, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events),
  g(example, it, metric, draw, pos, accepted, current) AS (SELECT example, it, metric, draw, pos, true, metric FROM e WHERE pos = 1
    UNION ALL SELECT e.example, e.it, e.metric, e.draw, e.pos, e.metric < g.current OR e.draw < 0.05, CASE WHEN e.metric < g.current OR e.draw < 0.05 THEN e.metric ELSE g.current END FROM g JOIN e ON e.example = g.example AND e.pos = g.pos + 1)
  SELECT example, it, metric, draw, accepted, current FROM g""")
def accept_replay(t):
    rows = t.events.select(F.col("user_id").alias("example"), F.col("event_id").alias("it"), F.col("value").alias("metric"), uniform(4, F.col("user_id"), F.lit("/"), F.col("event_id")).alias("draw"))
    return search.replay(rows)
