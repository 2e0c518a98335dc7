"""Names, colours, noise, depth and slots over stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.hashing import int_hash_sql
from ..operators import graph, palette, vision
from . import query
from .scenes import _bytes

NAMES = "n AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'NodeGroup' WHEN 1 THEN 'NodeGroup.00' || s_suppkey % 7 WHEN 2 THEN 'NodeGroups' ELSE s_name END AS name, lower(s_name) || '__an_' || repeat('x', s_suppkey % 30) || '_end' AS stem FROM supplier)"


@query(rf"""WITH {NAMES}, i AS (SELECT *, trim(regexp_replace(regexp_replace(name, '[^\pL\pN_]+', '_', 'g'), '_+', '_', 'g'), '_') AS id, array_to_string(list_filter(string_split(stem, '_'), lambda p: p <> '' AND length(p) <= 20), '_') AS short FROM n)
  SELECT s_suppkey, CASE WHEN id = 'NodeGroup' OR starts_with(id, 'NodeGroup_') THEN short || substr(id, 10) ELSE id END AS name FROM i""")
def group_names(t):
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "NodeGroup").when(k % 4 == 1, F.concat(F.lit("NodeGroup.00"), k % 7)).when(k % 4 == 2, "NodeGroups").otherwise(F.col("s_name"))
    stem = F.concat(F.lower("s_name"), F.lit("__an_"), F.repeat(F.lit("x"), (k % 30).cast("int")), F.lit("_end"))
    return t.supplier.select("s_suppkey", fx.group_name(name, stem).alias("name"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'Error: Python: step ' || event_id || ' ' WHEN event_id % 3 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'Code' WHEN 1 THEN 'Rendered image' WHEN 2 THEN 'Analysis result' ELSE format('File {}m{}.blend{}', chr(39), event_id, chr(39)) END || ' not found' END AS reason FROM events""")
def tool_failures(t):
    k = F.col("event_id")
    output = F.when(F.col("event_type") == "error", F.concat(F.lit("started Error: Python: step "), k, F.lit(" Blender quit"))).otherwise("done Blender quit")
    path = F.concat(F.lit("m"), k, F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".jpg").when(k % 4 == 2, ".json").otherwise(".blend"))
    return t.events.select("event_id", fx.tool_failure(output, path, k % 3 != 0).alias("reason"))


def _draw(name: str) -> str:
    return int_hash_sql(f"'9' || k || '{name}'") + " / 4294967295"


def _moved(name: str) -> str:
    return f"(2 * ({_draw(name)}) - 1) * 0.5"


def _channel(n: int) -> str:
    at = f"(({n} + hue * 6) - 6 * floor(({n} + hue * 6) / 6))"
    return f"round(val - val * sat * greatest(0, least({at}, 4 - {at}, 1)), 6)"


@query(f"""WITH c AS (SELECT c_custkey AS k, c_custkey % 11 / 10 AS r, c_custkey % 7 / 6 AS g, c_custkey % 5 / 4 AS b, c_custkey % 3 / 2 AS a FROM customer), m AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM c),
  j AS (SELECT k, {_draw('h')} AS hue, least(greatest(CASE WHEN top = 0 THEN 0 ELSE span / top END + {_moved('s')}, 0), 1) AS sat, least(greatest(top + {_moved('v')}, 0), 1) AS val, round(least(greatest(a + {_moved('a')}, 0), 1), 6) AS alpha FROM m)
  SELECT k, [{_channel(5)}, {_channel(3)}, {_channel(1)}, alpha] AS color FROM j""")
def jittered_colors(t):
    k = F.col("c_custkey")
    color = F.array(k % 11 / 10, k % 7 / 6, k % 5 / 4, k % 3 / 2)
    moved = palette.jittered(color, 0.5, 9, k)
    return t.customer.select(k.alias("k"), F.transform(moved, lambda x: F.round(x, 6)).alias("color"))


@query("""WITH f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY ALL), g AS (SELECT label, vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 0.5) * 255))) / 255) AS v FROM embeddings JOIN f USING (label, vec_id)),
  d AS (SELECT label, vec_id, list_transform(range(16), lambda i: abs(v[16 * (i // 4) + 2 * (i % 4) + 1] - v[16 * (i // 4) + 2 * (i % 4) + 2] - v[16 * (i // 4) + 2 * (i % 4) + 9] + v[16 * (i // 4) + 2 * (i % 4) + 10]) / 2) AS d FROM g)
  SELECT label, vec_id, round(list_median(d) / 0.6745, 6) AS sigma FROM d""")
def noise_ranking(t):
    grays = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255))))
    images = t.embeddings.select("label", "vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), _bytes(grays, 1).alias("data"))
    return vision.noise_ranking(images, "label", "vec_id")


DEPTHS = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: [0, 1, 2, 100][floor(abs(x::DOUBLE) * 16)::BIGINT % 4 + 1]::DOUBLE) AS v FROM embeddings), w AS (SELECT {vision._window().tolist()} AS g),
  p AS (SELECT a.vec_id, a.v AS x, b.v AS y, greatest(list_max(a.v), list_max(b.v)) - least(list_min(a.v), list_min(b.v)) AS span FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
  q AS (SELECT *, CASE WHEN span = 0 THEN 1 ELSE span END AS s FROM p),
  m AS (SELECT vec_id, (0.01 * s) ** 2 AS c1, (0.03 * s) ** 2 AS c2, list_transform(range(0, 54), lambda o: [list_dot_product(g, x[o + 1 : o + 11]), list_dot_product(g, y[o + 1 : o + 11]), list_dot_product(g, list_transform(x[o + 1 : o + 11], lambda z: z * z)), list_dot_product(g, list_transform(y[o + 1 : o + 11], lambda z: z * z)), list_dot_product(g, list_transform(range(1, 12), lambda k: x[o + k] * y[o + k]))]) AS m FROM q, w)
  SELECT vec_id, round(100 * list_sum(list_transform(m, lambda t: (2 * t[1] * t[2] + c1) / (t[1] ** 2 + t[2] ** 2 + c1) * (2 * (t[5] - t[1] * t[2]) + c2) / (t[3] - t[1] ** 2 + t[4] - t[2] ** 2 + c2))) / 54, 4) AS percent FROM m"""


@query(DEPTHS)
def depth_agreement(t):
    # Numbers 0, 1, 2 and infinity as four-byte floats.
    hexes = F.array(*map(F.lit, ("00000000", "0000803F", "00000040", "0000807F")))
    levels = F.transform("embedding", lambda x: F.element_at(hexes, (F.floor(F.abs(x.cast("double")) * 16) % 4 + 1).cast("int")))
    maps = t.embeddings.select("vec_id", F.unhex(F.array_join(levels, "")).alias("data"))
    both = maps.where("vec_id % 2 = 0").withColumnRenamed("data", "a").join(maps.select((F.col("vec_id") - 1).alias("vec_id"), F.col("data").alias("b")), "vec_id")
    return vision.depth_agreement(both.select("vec_id", F.lit(1).alias("height"), F.lit(64).alias("width"), "a", "b"), ["vec_id"]).withColumn("percent", F.round("percent", 4))


@query("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'MixRGB' END AS replacement FROM customer), p AS (SELECT c_custkey, unnest(['Factor_Float', 'A_Color', 'B_Color', 'A_Vector']) AS slot FROM customer)
  SELECT c_custkey, CASE WHEN replacement IS NULL THEN slot ELSE CASE slot WHEN 'Factor_Float' THEN 'Fac' WHEN 'A_Color' THEN 'Color1' WHEN 'B_Color' THEN 'Color2' END END AS slot FROM n JOIN p USING (c_custkey) WHERE replacement IS NULL OR slot <> 'A_Vector'""")
def renamed_slots(t):
    nodes = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "MixRGB").alias("replacement"))
    params = t.customer.select("c_custkey", F.explode(F.array(*map(F.lit, ("Factor_Float", "A_Color", "B_Color", "A_Vector")))).alias("slot"))
    names = t.spark.createDataFrame([("MixRGB", "Factor_Float", "Fac"), ("MixRGB", "A_Color", "Color1"), ("MixRGB", "B_Color", "Color2")], "replacement string, slot string, new_slot string")
    return graph.slots_renamed(params, nodes, names, ["c_custkey"], "slot")
