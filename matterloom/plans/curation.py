"""Gates, leak filters and near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, gates, vision
from . import query
from .scenes import _bytes

REASON = r"""SELECT d.doc_id, source, CASE WHEN quality IS NULL THEN 'Analysis result not found' WHEN contains(text, '|') THEN 'Code contains image texture'
  WHEN len(regexp_extract_all('Write a program for this material.' || chr(10) || '```python' || chr(10) || text || chr(10) || '```', '[\pL\pN_]+|[^\pL\pN_\s]')) > 2048 THEN 'Code too long'
  WHEN n_chars < 600 THEN 'Rendered image file size too small' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)"""


def _gated(t):
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    # Unicode words, as the SQL counts them.
    tokens = F.regexp_count(gates.templated(F.col("text")), F.lit(r"[\pL\pN_]+|[^\pL\pN_\s]"))
    reason = gates.first_failure(
        (F.col("quality").isNull(), "Analysis result not found"),
        (F.col("text").contains("|"), "Code contains image texture"),
        (tokens > gates.TOKENS, "Code too long"),
        (gates.too_small(F.col("n_chars"), least=600), "Rendered image file size too small"),
    )
    return rows.withColumn("reason", reason)


@query(f"SELECT doc_id, reason FROM ({REASON}) WHERE reason IS NOT NULL")
def gate_cascade(t):
    return _gated(t).where("reason IS NOT NULL").select("doc_id", "reason")


@query(f"SELECT coalesce(reason, 'passed') AS reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM ({REASON}) GROUP BY ALL")
def reject_summary(t):
    return gates.summary(_gated(t))


@query("SELECT source, lang, count(*) AS n FROM documents WHERE source NOT LIKE 'mat_llm%' GROUP BY ALL")
def source_filter(t):
    return gates.by_source(t.documents, "source", False).groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 6")
def oversized_graphs(t):
    return gates.oversized(t.lineitem, "l_orderkey", 6)


@query("""SELECT c.vec_id, arg_min(r.vec_id, (d, r.vec_id)) AS nearest, round(min(d), 6) AS distance FROM embeddings c, embeddings r, LATERAL (SELECT list_sum(list_transform(range(1, 65), lambda i: abs(c.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE))) / 64 AS d)
  WHERE c.vec_id % 10 <> 0 AND r.vec_id % 10 = 0 AND d <= 0.115 GROUP BY ALL""")
def leak_filter(t):
    rows = t.embeddings.select("vec_id", "embedding")
    return dedup.leaks(rows.where("vec_id % 10 <> 0"), rows.where("vec_id % 10 = 0"), "vec_id", "embedding", 0.115)


# A vector stands for an image of one row of 64 gray pixels, whose brightness and contrast depend on the id.
LEAKS = f"""WITH i AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE * CASE vec_id % 2 WHEN 0 THEN 0.2 ELSE 0.05 END + CASE vec_id % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.8 END) * 255))) / 255) AS v FROM embeddings),
  w AS (SELECT {vision._window().tolist()} AS g), b AS (SELECT vec_id, e, v, list_transform(range(0, 54), lambda o: list_dot_product(g, v[o + 1 : o + 11])) AS m, list_transform(range(0, 54), lambda o: list_dot_product(g, list_transform(v[o + 1 : o + 11], lambda x: x * x))) AS q FROM i, w),
  s AS (SELECT c.vec_id, r.vec_id AS ref, c.e AS ce, r.e AS re, list_sum(list_transform(range(1, 55), lambda o: (2 * c.m[o] * r.m[o] + 0.0001) / (c.m[o] ** 2 + r.m[o] ** 2 + 0.0001) * (2 * (list_dot_product(g, list_transform(range(0, 11), lambda k: c.v[o + k] * r.v[o + k])) - c.m[o] * r.m[o]) + 0.0009) / (c.q[o] - c.m[o] ** 2 + r.q[o] - r.m[o] ** 2 + 0.0009))) / 54 AS ssim
    FROM b c, b r, w WHERE c.vec_id % 10 <> 0 AND r.vec_id % 10 = 0),
  d AS (SELECT vec_id, ref, list_sum(list_transform(range(1, 65), lambda o: abs(ce[o] - re[o]))) / 64 AS d FROM s WHERE ssim >= 0.55)
  SELECT vec_id, arg_min(ref, (d, ref)) AS nearest, round(min(d), 6) AS distance, count(*) AS similar FROM d GROUP BY ALL HAVING min(d) <= 0.12"""


@query(LEAKS)
def leak_filter_images(t):
    k = F.col("vec_id")
    scale, shift = F.when(k % 2 == 0, 0.2).otherwise(0.05), F.when(k % 3 == 0, 0.2).when(k % 3 == 1, 0.5).otherwise(0.8)
    grays = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") * scale + shift) * 255))))
    images = t.embeddings.select("vec_id", "embedding", F.lit(1).alias("height"), F.lit(64).alias("width"), _bytes(grays, 1).alias("data"))
    return dedup.image_leaks(images.where("vec_id % 10 <> 0"), images.where("vec_id % 10 = 0"), "vec_id", "embedding", 0.55, 0.12)


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\pL+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '\pL+') AS w FROM benchmark),
  s AS (SELECT DISTINCT doc_id, list_aggregate(w[i : i + 7], 'string_agg', ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
  r AS (SELECT DISTINCT item_id, list_aggregate(w[i : i + 7], 'string_agg', ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i))
  SELECT doc_id, count(DISTINCT g) AS shared, count(DISTINCT item_id) AS items FROM s JOIN r USING (g) GROUP BY ALL""")
def leak_filter_text(t):
    return dedup.text_leaks(t.documents, t.benchmark, 8)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v, vec_id % 97 AS cost, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings),
  links AS MATERIALIZED (SELECT a, b, same, cost FROM (SELECT a.id AS a, b.id AS b, a.cost, (SELECT count(*) FROM (SELECT unnest(a.v) AS x, unnest(b.v) AS y) WHERE abs(x - y) <= 0.06) AS same FROM e a JOIN e b ON a.id < b.id) WHERE same / 64 > 0.5),
  g(pos, kept) AS (SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL SELECT e.pos, CASE WHEN m.best IS NULL THEN list_append(kept, e.id) WHEN e.cost < m.best_cost THEN list_append(list_filter(kept, lambda x: x <> m.best), e.id) ELSE kept END
    FROM g JOIN e ON e.pos = g.pos + 1, LATERAL (SELECT arg_min(a, (-same, a)) AS best, arg_min(links.cost, (-same, a)) AS best_cost FROM links WHERE b = e.id AND list_contains(kept, a)) m)
  SELECT unnest(kept) AS id FROM g WHERE pos = (SELECT count(*) FROM e)""")
def dedup_greedy(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("pixels"), (F.col("vec_id") % 97).alias("cost"))
    return dedup.greedy(rows, threshold=0.06, share=0.5)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT label AS case_id, vec_id AS trial_id, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 11 = 0 THEN 'No code block found' WHEN vec_id % 13 = 0 THEN 'Rendered image file size too small' END AS before, CASE WHEN vec_id % 7 = 0 THEN 'Code too long' END AS after, vec_id % 50 = 0 AS truth, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings),
  links AS MATERIALIZED (SELECT a.trial_id AS a, b.trial_id AS b, a.truth FROM e a JOIN e b ON a.case_id = b.case_id AND (a.truth OR a.trial_id < b.trial_id) AND NOT b.truth WHERE (SELECT count(*) FROM (SELECT unnest(a.v) AS x, unnest(b.v) AS y) WHERE abs(x - y) <= 0.06) / 64 > 0.4),
  g(pos, kept, trial_id, reason) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::VARCHAR
    UNION ALL SELECT pos, CASE WHEN reason IS NULL AND NOT truth THEN list_append(kept, trial_id) ELSE kept END, trial_id, CASE WHEN truth THEN 'truth' ELSE reason END
    FROM (SELECT e.pos, kept, e.trial_id, truth, coalesce(before, CASE WHEN EXISTS (FROM links WHERE b = e.trial_id AND (links.truth OR list_contains(kept, a))) THEN 'Duplicate image detected' END, after) AS reason FROM g JOIN e ON e.pos = g.pos + 1))
  SELECT case_id, g.trial_id, g.reason FROM g JOIN e USING (trial_id) WHERE NOT truth""")
def generated_cascade(t):
    k = F.col("vec_id")
    rows = t.embeddings.select(F.col("label").alias("case_id"), k.alias("trial_id"), F.col("embedding").alias("pixels"))
    n = F.col("trial_id")
    before = gates.first_failure((n % 11 == 0, "No code block found"), (n % 13 == 0, "Rendered image file size too small"))
    return dedup.cascade(rows.where("trial_id % 50 <> 0"), rows.where("trial_id % 50 = 0"), before, gates.first_failure((n % 7 == 0, "Code too long")), 0.06, 0.4)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT label AS case_id, vec_id AS trial_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS pos FROM embeddings),
  links AS MATERIALIZED (SELECT a.trial_id AS a, b.trial_id AS b FROM e a JOIN e b ON a.case_id = b.case_id AND a.trial_id < b.trial_id WHERE (SELECT count(*) FROM (SELECT unnest(a.v) AS x, unnest(b.v) AS y) WHERE abs(x - y) <= 0.06) / 64 > 0.4),
  g(pos, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT e.pos, CASE WHEN EXISTS (FROM links WHERE b = e.trial_id AND list_contains(kept, a)) THEN kept ELSE list_append(kept, e.trial_id) END FROM g JOIN e ON e.pos = g.pos + 1)
  SELECT label AS case_id, vec_id AS trial_id FROM embeddings WHERE vec_id IN (SELECT unnest(kept) FROM g WHERE pos = (SELECT count(*) FROM e))""")
def accepted_renders(t):
    return dedup.accept_new(t.embeddings.select(F.col("label").alias("case_id"), F.col("vec_id").alias("trial_id"), F.col("embedding").alias("pixels")), 0.06, 0.4)
