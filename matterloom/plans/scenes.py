"""Images, masks, tags, logs, values and names of scenes over stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import gates, graph, program, reports, splits, vision
from ..sources import corpus
from ..streaming import jobs
from . import query
from .statistics import SPLIT, split_exact

# A vector stands for an image of 8 x 8 gray pixels: every fourth is black, every fourth white, and every fourth nearly uniform.
GRAYS = """g AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE * CASE vec_id % 4 WHEN 2 THEN 0.05 WHEN 3 THEN 1.0 ELSE 0.0 END + CASE vec_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.2 END) * 255))) / 255) AS v FROM embeddings),
  f AS (SELECT vec_id, len(list_filter(v, lambda x: x < 0.01)) / 64 AS dark, len(list_filter(v, lambda x: x > 0.99)) / 64 AS light, list_max(v) - list_min(v) AS span, list_sum(v) / 64 AS gray FROM g)"""


def _bytes(values, width: int):
    """Numbers from 0 to 255 as little-endian integers of ``width`` bytes."""
    return F.unhex(F.array_join(F.transform(values, lambda x: F.concat(F.lpad(F.hex(x.cast("long")), 2, "0"), F.lit("00" * (width - 1)))), ""))


@query(f"""WITH {GRAYS} SELECT vec_id, round(dark, 6) AS dark, round(light, 6) AS light, round(span, 6) AS span, round(gray, 6) AS gray,
  CASE WHEN dark > 0.9 OR light > 0.9 THEN 'Rendered image is black or white' WHEN span < 0.05 THEN 'Rendered image is uniform' END AS reason, gray * 100 < 5 AS is_dark FROM f""")
def render_gates(t):
    k = F.col("vec_id") % 4
    scale, shift = F.when(k == 2, 0.05).when(k == 3, 1.0).otherwise(0.0), F.when(k == 0, 0.0).when(k == 1, 1.0).otherwise(0.2)
    grays = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") * scale + shift) * 255))))
    images = t.embeddings.select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), _bytes(grays, 1).alias("data"))
    figures = vision.render_figures(images, ["vec_id"])
    shown = [F.round(c, 6).alias(c) for c in ("dark", "light", "span", "gray")]
    return figures.select("vec_id", *shown, vision.render_reason().alias("reason"), reports.is_dark(F.col("gray")).alias("is_dark"))


# A vector stands for a mask of 8 x 8 ids from 0 to 9; its label is the scene. Ids of a scene have dotted tags.
MASKS = """m AS (SELECT vec_id, label AS seed, generate_subscripts(embedding, 1) - 1 AS px, greatest(0, least(9, floor(unnest(embedding)::DOUBLE * 10) + 4))::BIGINT AS id FROM embeddings),
  tags AS (SELECT DISTINCT label AS seed, id, tag FROM embeddings, (VALUES (1, 'tree.leaf'), (2, 'rock'), (3, 'tree.bark'), (4, 'tree.leaf.tree'), (9, 'sky.far')) AS v(id, tag) WHERE (label + id) % 5 <> 0)"""
TAGS = "VALUES (1, 'tree.leaf'), (2, 'rock'), (3, 'tree.bark'), (4, 'tree.leaf.tree'), (9, 'sky.far') AS v(id, tag)"


def _ids():
    return F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(9), F.floor(x.cast("double") * 10) + 4)))


def _tags(t):
    return t.embeddings.select(F.col("label").alias("seed")).distinct().join(F.broadcast(t.spark.sql(f"SELECT CAST(id AS long) AS id, tag FROM {TAGS}")), (F.col("seed") + F.col("id")) % 5 != 0)


def _counted(t):
    return vision.histograms(t.embeddings.select(F.col("label").alias("seed"), F.col("vec_id").alias("frame"), _bytes(_ids(), 4).alias("data")), ["seed", "frame"])


@query(f"""WITH {MASKS}, p AS (SELECT DISTINCT seed, id, unnest(string_split(tag, '.')) AS tag FROM tags), k AS (SELECT tag, count(*) AS n FROM m JOIN p USING (seed, id) WHERE id > 0 GROUP BY ALL),
  e AS (SELECT DISTINCT p.tag, coalesce(n, 0) AS n FROM p LEFT JOIN k USING (tag) UNION ALL SELECT 'untagged', count(*) FROM m WHERE (seed, id) NOT IN (SELECT (seed, id) FROM tags))
  SELECT tag, round(100 * n / (SELECT count(*) FROM m), 6) AS percent FROM e""")
def mask_tag_shares(t):
    return vision.tag_shares(_counted(t), _tags(t)).select("tag", F.round("percent", 6).alias("percent"))


@query(f"""WITH {MASKS}, o AS (SELECT seed, id, split_part(tag, '.', 1) AS cls FROM tags) SELECT cls, round(100 * count(*) / (SELECT count(*) FROM m), 6) AS percent FROM m JOIN o USING (seed, id) GROUP BY ALL""")
def mask_class_shares(t):
    objects = _tags(t).select("seed", "id", F.concat(F.lit("x:"), F.split_part("tag", F.lit("."), F.lit(1)), F.lit(".001(12)")).alias("name"))
    return reports.class_shares(_counted(t), objects)


@query(f"WITH {MASKS} SELECT DISTINCT seed, vec_id AS frame, unnest(string_split(tag, '.')) AS tag FROM m JOIN tags USING (seed, id) WHERE id > 0")
def mask_tags_seen(t):
    return reports.tags_seen(_counted(t), _tags(t))


@query(f"WITH {MASKS} SELECT seed, id FROM tags WHERE list_contains(string_split(tag, '.'), 'tree')")
def ids_with_tag(t):
    return reports.ids_with_tag(_tags(t), "tree")


@query(f"""WITH {MASKS} SELECT vec_id, id % 3 AS object, id AS instance, min(px % 8) AS x_min, min(px // 8) AS y_min, max(px % 8) AS x_max, max(px // 8) AS y_max FROM m WHERE id > 4 GROUP BY ALL""")
def tag_boxes(t):
    ids = _ids()
    hit = F.transform(ids, lambda x: F.when(x > 4, 1).otherwise(0))
    rows = t.embeddings.select("vec_id", F.lit(8).alias("width"), _bytes(hit, 1).alias("hit"), _bytes(F.transform(ids, lambda x: x % 3), 4).alias("objects"), _bytes(ids, 4).alias("instances"))
    return vision.boxes(rows, ["vec_id"])


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL), m AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
  SELECT l_orderkey AS object_index, l_linenumber::INT AS instance_id, q FROM i JOIN m USING (l_orderkey, l_linenumber)""")
def seen_instances(t):
    each = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    key = [F.lit(1).alias("seed"), F.lit(0).alias("frame"), F.col("l_orderkey").alias("object_index")]
    matrices = F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber").cast("int"), F.array("q"))))
    objects = each.groupBy("l_orderkey").agg(matrices.alias("model_matrices")).select(*key, "model_matrices")
    masks = t.lineitem.where("l_returnflag = 'R'").select(*key, F.col("l_linenumber").cast("int").alias("instance_id")).distinct()
    return reports.seen_instances(objects, masks).select("object_index", "instance_id", F.col("matrix")[0].alias("q"))


GROUPS = """n AS (SELECT l_orderkey AS mat_name, 'T' || l_partkey % 60 AS type, 'G' || l_suppkey % 40 AS group_type FROM lineitem), g AS (SELECT 'G' || s_suppkey % 40 AS group_type, 'T' || s_suppkey * 7 % 53 AS type, 'G' || (s_suppkey * 3 + 1) % 40 AS subgroup FROM supplier)"""


@query(f"""WITH {GROUPS}, b0 AS (SELECT group_type FROM g WHERE type IN ('T7', 'T11')), b1 AS (FROM b0 UNION SELECT group_type FROM g WHERE subgroup IN (FROM b0)), b2 AS (FROM b1 UNION SELECT group_type FROM g WHERE subgroup IN (FROM b1)), b3 AS (FROM b2 UNION SELECT group_type FROM g WHERE subgroup IN (FROM b2))
  SELECT DISTINCT mat_name FROM n WHERE type IN ('T7', 'T11') OR group_type IN (FROM b3)""")
def unsupported_types(t):
    name = lambda p, c: F.concat(F.lit(p), c)
    nodes = t.lineitem.select(F.col("l_orderkey").alias("mat_name"), name("T", F.col("l_partkey") % 60).alias("type"), name("G", F.col("l_suppkey") % 40).alias("group_type"))
    s = F.col("s_suppkey")
    members = t.supplier.select(name("G", s % 40).alias("group_type"), name("T", s * 7 % 53).alias("type"), name("G", (s * 3 + 1) % 40).alias("subgroup"))
    return gates.unsupported(nodes, members, ["T7", "T11"])


LOGS = """l AS (SELECT '/runs/' || CASE o_orderkey % 3 WHEN 0 THEN 'coarse' WHEN 1 THEN 'coarse_fine' ELSE 'other' END || '_' || o_orderkey || '.err' AS path,
  'x [a b] finished in 0:0' || o_orderkey % 10 || ':07.25' || chr(10) || '[c] finished in ' || o_orderkey % 4 || ' days, 1:00:00' || chr(10) || '[d] finished in 0:00:00.9' || chr(10) || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '[MAIN TOTAL] finished in 2:00:00' END AS text FROM orders)"""


@query(f"""WITH {LOGS}, s AS (SELECT path, CASE WHEN contains(path, '/coarse_fine') THEN 'coarse_f' ELSE 'coarse' END AS step, text FROM l WHERE contains(text, '[MAIN TOTAL] finished in') AND contains(path, '/coarse')),
  t AS (SELECT path, step, unnest(regexp_extract_all(text, '\\[[^\\]\\n]+\\] finished in (?:\\d+ days?, )?\\d+:\\d\\d:\\d\\d')) AS f FROM s),
  u AS (SELECT path, step, regexp_extract(f, '\\[([^\\]]+)\\] finished in (?:(\\d+) days?, )?(\\d+):(\\d\\d):(\\d\\d)', ['name', 'd', 'h', 'm', 's']) AS p FROM t),
  v AS (SELECT path, step, p.name AS name, coalesce(TRY_CAST(p.d AS BIGINT), 0) * 86400 + p.h::BIGINT * 3600 + p.m::BIGINT * 60 + p.s::BIGINT AS seconds FROM u) FROM v WHERE name <> 'MAIN TOTAL' AND seconds >= 1""".replace("\\\\", "\\"))
def log_times(t):
    k = F.col("o_orderkey")
    path = F.concat(F.lit("/runs/"), F.when(k % 3 == 0, "coarse").when(k % 3 == 1, "coarse_fine").otherwise("other"), F.lit("_"), k, F.lit(".err"))
    text = F.concat(F.lit("x [a b] finished in 0:0"), k % 10, F.lit(":07.25\n[c] finished in "), k % 4, F.lit(" days, 1:00:00\n[d] finished in 0:00:00.9\n"), F.when(k % 5 == 0, "").otherwise("[MAIN TOTAL] finished in 2:00:00"))
    steps = t.spark.sql("SELECT * FROM VALUES (0, 'coarse_f'), (1, 'coarse') AS s(pos, step)")
    return corpus.log_times(t.orders.select(path.alias("path"), text.alias("text")), steps)


@query("""WITH r AS (SELECT vec_id, list_transform(embedding[1 : 6 + vec_id % 3], lambda x: floor(x::DOUBLE * 10) / 10) AS v, list_transform(embedding[9 : 15], lambda x: floor(x::DOUBLE * 10) / 10) AS d FROM embeddings), s AS (SELECT vec_id, d, unnest(v) AS stop, generate_subscripts(v, 1) - 1 AS pos FROM r)
  SELECT vec_id, pos, stop, CASE WHEN pos >= len(d) THEN 'appended' ELSE 'changed' END AS change FROM s WHERE pos >= len(d) OR stop <> d[pos + 1]""")
def ramp_changes(t):
    tenth = lambda a: F.transform(a, lambda x: F.floor(x.cast("double") * 10) / 10)
    rows = t.embeddings.select("vec_id", tenth(F.slice("embedding", F.lit(1), (6 + F.col("vec_id") % 3).cast("int"))).alias("v"), tenth(F.slice("embedding", 9, 7)).alias("d"))
    return program.ramp_changes(rows, "vec_id", "v", "d")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE * 3) AS v FROM embeddings)
  SELECT vec_id, round(v[1], 6) AS f2v, round(greatest(0, least(1, v[1])), 6) AS f2c, 1.0::DOUBLE AS f2c_a, round((v[1] + v[2] + v[3]) / 3, 6) AS v2f, round(greatest(0, least(1, v[2])), 6) AS v2c, round((v[1] + v[2] + v[3]) / 3, 6) AS c2f, round(v[3], 6) AS c2v FROM e""")
def socket_conversion(t):
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 3)
    get = lambda a, b, k: graph.converted(F.slice(v, 1, {"float": 1, "vector": 3, "color": 4}[a]), a, b)[k]
    plans = {"f2v": ("float", "vector", 2), "f2c": ("float", "color", 1), "f2c_a": ("float", "color", 3), "v2f": ("vector", "float", 0), "v2c": ("vector", "color", 1), "c2f": ("color", "float", 0), "c2v": ("color", "vector", 2)}
    return t.embeddings.select("vec_id", *[F.round(get(*x), 6).alias(name) for name, x in plans.items()])


@query(r"""WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE * 40) AS v FROM embeddings), s AS (SELECT vec_id, v, list_transform(v, lambda x: power(10.0, 2 - greatest(floor(log10(abs(x))), -1))) AS p FROM e)
  SELECT vec_id, '[' || list_aggregate(list_transform(v, lambda x, i: (trunc(x * p[i] + CASE WHEN x >= 0 THEN 0.5 ELSE -0.5 END) / p[i])::VARCHAR), 'string_agg', ', ') || ']' AS list, '''it\''s ' || vec_id || '''' AS quoted, CASE WHEN v[1] > 0 THEN 'True' ELSE 'False' END AS flag FROM s""")
def literal_texts(t):
    rows = t.embeddings.select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 40).alias("v"))
    return rows.select("vec_id", fx.literal_text(F.col("v"), "array").alias("list"), fx.literal_text(F.concat(F.lit("it's "), "vec_id"), "string").alias("quoted"), fx.literal_text(F.col("v")[0] > 0, "boolean").alias("flag"))


@query(r"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || 'Factory(' || p_partkey || ').spawn_' || p_type || '(' || p_size || ')' END AS name FROM part), r AS (SELECT p_partkey, name, regexp_extract(name, '^(.*)\((\d+)\)\.spawn_(.*)\((\d+)\)$', ['cls', 'seed', 'kind', 'instance']) AS m FROM n)
  SELECT p_partkey, m.cls AS cls, m.seed::BIGINT AS seed, m.kind AS kind, m.instance::BIGINT AS instance, split_part(split_part(split_part('a:b:' || name, '(', 1), ':', -1), '.', 1) AS class_name FROM r WHERE m.seed <> ''""")
def asset_names(t):
    made = F.concat("p_name", F.lit("Factory("), "p_partkey", F.lit(").spawn_"), "p_type", F.lit("("), "p_size", F.lit(")"))
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(made).alias("name"))
    parsed = rows.select("p_partkey", fx.asset_name(F.col("name")).alias("a"), fx.class_name(F.concat(F.lit("a:b:"), "name")).alias("class_name"))
    return parsed.where("a IS NOT NULL").select("p_partkey", "a.*", "class_name")


@query(r"""WITH a AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN '```python' || chr(10) || text || chr(10) || '```' ELSE text END AS answer FROM conversations), f AS (SELECT conv_id, turn, text, answer, 'import bpy' || chr(10) || 'def shader_material(): ' || text AS code FROM a)
  SELECT conv_id, turn, regexp_replace(trim(answer, '`'), '^python[^\n]*\n', '') AS bare, '```python' || chr(10) || 'import bpy' || chr(10) || chr(10) || trim(replace(replace(code, 'import bpy', ''), 'shader_material', 'shader_material_1'), ' ') || chr(10) || chr(10) || trim(replace(replace(answer, 'import bpy', ''), 'shader_material', 'shader_material_2'), ' ') || chr(10) || '```' AS prompt,
  nullif(regexp_extract('x Error: Python: ' || text || ' Blender quit', '(?s)(Error: Python:.*?)Blender quit', 1), '') AS error FROM f""")
def pair_prompts(t):
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```python\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    rows = t.conversations.select("conv_id", "turn", "text", answer.alias("answer"), F.concat(F.lit("import bpy\ndef shader_material(): "), "text").alias("code"))
    error = fx.tool_error(F.concat(F.lit("x Error: Python: "), "text", F.lit(" Blender quit")))
    return rows.select("conv_id", "turn", fx.bare_answer(F.col("answer")).alias("bare"), fx.pair_prompt(F.col("code"), F.col("answer")).alias("prompt"), error.alias("error"))


@query("""WITH n AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS slots FROM lineitem GROUP BY ALL), k AS (SELECT min(type) AS replacement, slots FROM (SELECT 'K' || l_orderkey % 9 AS type, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS slots FROM lineitem WHERE l_orderkey % 50 = 0 GROUP BY l_orderkey) GROUP BY slots)
  SELECT l_orderkey, replacement FROM n LEFT JOIN k USING (slots)""")
def replaced_nodes(t):
    nodes = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("slots"))
    known = nodes.where("l_orderkey % 50 = 0").select(F.concat(F.lit("K"), F.col("l_orderkey") % 9).alias("type"), "slots")
    return graph.replaced(nodes, known).select("l_orderkey", "replacement")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resumed_rows(t):
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return jobs.fresh(t.orders.select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


@query(SPLIT + """ SELECT c_custkey, split FROM s UNION ALL SELECT s_suppkey + 1000000000, 'train' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 7)""")
def split_with_generated(t):
    generated = t.supplier.select((F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"))
    leaked = t.lineitem.where("l_quantity = 50 AND l_linenumber = 7").select((F.col("l_suppkey") + 1_000_000_000).alias("c_custkey"))
    return splits.with_generated(split_exact(t), generated, "c_custkey", leaked)
