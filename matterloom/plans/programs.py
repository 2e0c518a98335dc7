"""Names, literals, responses, program texts and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import graph, program
from . import query


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace('  ' || p_name || '--' || p_type || ' (α) ' || p_brand, '[^\pL\pN_]+', '_', 'g'), '_+', '_', 'g'), '_') AS name FROM part""")
def identifier_names(t):
    return t.part.select("p_partkey", fx.identifier(F.concat(F.lit("  "), "p_name", F.lit("--"), "p_type", F.lit(" (α) "), "p_brand")).alias("name"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN v = 0 THEN 0.0 ELSE trunc(v * p + CASE WHEN v >= 0 THEN 0.5 ELSE -0.5 END) / p END AS shown FROM (SELECT *, power(10.0, 2 - greatest(floor(log10(abs(v))), -1)) AS p FROM
  (SELECT l_orderkey, l_linenumber, l_extendedprice * (l_discount - 0.05) / 7 AS v FROM lineitem) WHERE v <> 0)""")
def literal_format(t):
    v = F.col("l_extendedprice") * (F.col("l_discount") - 0.05) / 7
    return t.lineitem.withColumn("v", v).where("v <> 0").select("l_orderkey", "l_linenumber", fx.literal(F.col("v")).alias("shown"))


@query("SELECT o_orderkey, replace(o_orderpriority || '-' || o_orderstatus || '-' || o_orderkey, ' ', '_') AS id FROM orders")
def example_ids(t):
    return t.orders.select("o_orderkey", fx.example_id(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("id"))


@query("""SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN printf('%.2fK', n / 1e3) WHEN n < 1000000000 THEN printf('%.2fM', n / 1e6) ELSE printf('%.2fG', n / 1e9) END AS shown FROM (SELECT o_orderkey, (o_orderkey * o_orderkey + 1)::BIGINT AS n FROM orders)""")
def short_counts(t):
    return t.orders.select("o_orderkey", fx.short_count((F.col("o_orderkey") * F.col("o_orderkey") + 1).cast("long")).alias("shown"))


FENCED = "CASE conv_id % 4 WHEN 0 THEN text WHEN 1 THEN 'Sure: ```python' || chr(10) || 'def shader_material(m):' || chr(10) || text || chr(10) || '``` done' WHEN 2 THEN '```python' || chr(10) || text ELSE 'x ```' || text || '``` y ``` z' END"


def _fenced(t):
    k, text, nl = F.col("conv_id") % 4, F.col("text"), F.lit("\n")
    out = F.when(k == 0, text).when(k == 1, F.concat(F.lit("Sure: ```python"), nl, F.lit("def shader_material(m):"), nl, text, nl, F.lit("``` done")))
    out = out.when(k == 2, F.concat(F.lit("```python"), nl, text)).otherwise(F.concat(F.lit("x ```"), text, F.lit("``` y ``` z")))
    return t.conversations.select("conv_id", "turn", out.alias("response"))


SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"""WITH r AS (SELECT conv_id, turn, regexp_replace({FENCED}, '^{SPACE}|{SPACE}$', '', 'g') AS r FROM conversations)
  SELECT conv_id, turn, split_part(regexp_replace(CASE WHEN contains(r, '```') THEN substr(r, strpos(r, '```') + 3) ELSE r END, '^python', ''), '```', 1) AS code FROM r""")
def extract_code(t):
    return _fenced(t).select("conv_id", "turn", fx.extract_code(F.col("response")).alias("code"))


@query(f"""WITH r AS (SELECT conv_id, turn, {FENCED} AS r FROM conversations)
  SELECT conv_id, turn, CASE WHEN NOT regexp_matches(r, '```python[^\\n]*\\n') THEN 'No code block found' WHEN NOT contains(regexp_extract(r, '```python[^\\n]*\\n((?s:.*?))(```|\\z)', 1), 'def shader_material(') THEN 'Function not defined' END AS reason FROM r""")
def response_gate(t):
    return _fenced(t).select("conv_id", "turn", fx.response_reason(F.col("response")).alias("reason"))


KINDS = "image/png image/jpeg image/jpg image/webp image/bmp image/tiff image/gif text/html".split()


@query(f"""WITH l AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN url ELSE 'data:' || {KINDS}[page_id % 9] || ';base64,' || base64(encode(html)) END AS link FROM pages), d AS (SELECT page_id, link, regexp_extract(link, '^data:([^;,]+);base64,', 1) AS mime FROM l)
  SELECT page_id, CASE WHEN mime = '' THEN NULL WHEN mime IN ('image/jpeg', 'image/jpg') THEN '.jpg' WHEN mime IN ('image/png', 'image/webp', 'image/bmp', 'image/tiff') THEN '.' || split_part(mime, '/', 2) ELSE '.bin' END AS extension,
  CASE WHEN mime <> '' THEN octet_length(from_base64(split_part(link, ',', 2))) END AS size, CASE WHEN mime <> '' THEN md5(decode(from_base64(split_part(link, ',', 2)))) END AS digest FROM d""")
def data_url_decode(t):
    mime = F.element_at(F.array(*map(F.lit, KINDS)), F.when(F.col("page_id") % 9 > 0, (F.col("page_id") % 9).cast("int")).otherwise(1))
    link = F.when(F.col("page_id") % 9 == 0, F.col("url")).otherwise(F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(F.encode("html", "utf-8"))))
    got = t.pages.select("page_id", fx.data_url(link).alias("d"))
    return got.select("page_id", "d.extension", F.octet_length("d.data").cast("long").alias("size"), F.md5("d.data").alias("digest"))


def _programs(t):
    # Statements of three kinds, and the lines of the document's whole text as comments; the links come first, so that the sections have to be put in order.
    n = F.col("doc_id")
    a, b = F.concat(F.lit("n"), n), F.concat(F.lit("m"), n)
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("  links.new("), a, F.lit(".outputs[0], "), b, F.lit(".inputs["), n % 5, F.lit("])")),
        F.lit(""),
        F.concat(a, F.lit(" = nodes.new('Type_"), "lang", F.lit("')")),
        F.concat(b, F.lit(" = nodes.new('Group')")),
        F.concat(b, F.lit(".inputs[1].default_value = "), "n_chars"),
        F.concat(b, F.lit(".node_tree = node_groups['"), "source", F.lit("']")),
        F.concat(F.lit("# "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n# "))),
    )
    return t.documents.select("doc_id", text.alias("code"))


@query("""SELECT doc_id, UNNEST([
  {'pos': 0, 'kind': 'link', 'a': 'n' || doc_id, 'b': '0', 'c': 'm' || doc_id, 'd': (doc_id % 5)::VARCHAR}, {'pos': 2, 'kind': 'node', 'a': 'n' || doc_id, 'b': 'Type_' || lang, 'c': NULL, 'd': NULL}, {'pos': 3, 'kind': 'node', 'a': 'm' || doc_id, 'b': 'Group', 'c': NULL, 'd': NULL},
  {'pos': 4, 'kind': 'param', 'a': 'm' || doc_id, 'b': '1', 'c': n_chars::VARCHAR, 'd': NULL}, {'pos': 5, 'kind': 'other', 'a': NULL, 'b': NULL, 'c': NULL, 'd': NULL}]::STRUCT(pos BIGINT, kind VARCHAR, a VARCHAR, b VARCHAR, c VARCHAR, d VARCHAR)[], max_depth := 2) FROM documents
  UNION ALL SELECT doc_id, 5 + unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)), 'other', NULL, NULL, NULL, NULL FROM documents""")
def program_rows(t):
    return program.rows(_programs(t), "doc_id", "code")


@query("""SELECT doc_id, concat_ws(chr(10), 'n' || doc_id || ' = nodes.new(''Type_' || lang || ''')', 'm' || doc_id || ' = nodes.new(''Group'')', 'm' || doc_id || '.inputs[1].default_value = ' || n_chars, 'links.new(n' || doc_id || '.outputs[0], m' || doc_id || '.inputs[' || doc_id % 5 || '])') AS code FROM documents""")
def program_roundtrip(t):
    return program.programs(program.rows(_programs(t), "doc_id", "code"), "doc_id")


@query("""WITH p AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all('m' || doc_id || '.node_tree = node_groups[''' || source || ''']' || chr(10) || coalesce(text, ''), 'node_groups\\[''([^'']+)''\\]', 1))) AS "group" FROM documents) SELECT "group", count(*) AS programs FROM p GROUP BY ALL""")
def group_references(t):
    return program.group_references(_programs(t), "doc_id", "code").groupBy("group").agg(F.count("*").alias("programs"))


LINKS = "l AS (SELECT DISTINCT l_orderkey, l_suppkey AS from_node, l_linenumber AS from_slot, l_partkey % 100 AS to_node, l_linenumber AS to_slot FROM lineitem WHERE l_suppkey <> l_partkey % 100)"


def _links(t):
    links = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("from_node"), F.col("l_linenumber").alias("from_slot"), (F.col("l_partkey") % 100).alias("to_node"), F.col("l_linenumber").alias("to_slot"))
    return links.where("from_node <> to_node").distinct()


# A node's place in the order by depth is its least path of input slots and sources from the root: the paths of all nodes, least first.
@query(f"""WITH RECURSIVE {LINKS}, r AS (SELECT l_orderkey, max(to_node) AS root FROM l GROUP BY ALL), c(l_orderkey, node, path, nodes) AS (SELECT l_orderkey, root, []::BIGINT[], [root] FROM r
    UNION SELECT l.l_orderkey, from_node, path || [to_slot::BIGINT, from_node], nodes || [from_node] FROM l JOIN c ON l.l_orderkey = c.l_orderkey AND to_node = node WHERE NOT list_contains(nodes, from_node))
  SELECT l_orderkey, node, row_number() OVER (PARTITION BY l_orderkey ORDER BY path) - 1 AS pos FROM (SELECT l_orderkey, node, min(path) AS path FROM c GROUP BY ALL)""")
def reachable_order(t):
    links = _links(t)
    roots = links.groupBy("l_orderkey").agg(F.max("to_node").alias("root"))
    return graph.ordered(links.join(roots, "l_orderkey"), "l_orderkey", "root")


@query(f"""WITH RECURSIVE {LINKS}, r AS (SELECT l_orderkey, max(to_node) AS root FROM l GROUP BY ALL), c(l_orderkey, node, depth) AS (SELECT l_orderkey, root, 0 FROM r
    UNION SELECT l.l_orderkey, from_node, depth + 1 FROM l JOIN c ON l.l_orderkey = c.l_orderkey AND to_node = node WHERE depth < 60)
  SELECT l_orderkey, depth, count(*) AS n FROM (SELECT l_orderkey, node, min(depth) AS depth FROM c GROUP BY ALL) GROUP BY ALL""")
def breadth_levels(t):
    """Nodes by depth, from the breadth-first order (J2): a node is one deeper than the first of its users in that order."""
    links = _links(t)
    roots = links.groupBy("l_orderkey").agg(F.max("to_node").alias("root"))
    order = graph.ordered(links.join(roots, "l_orderkey"), "l_orderkey", "root", "bfs")
    back = graph.ordered(links.join(roots, "l_orderkey"), "l_orderkey", "root", "reversed").withColumnRenamed("pos", "back")
    last = order.groupBy("l_orderkey").agg(F.max("pos").alias("last"))
    placed = order.join(back, ["l_orderkey", "node"]).join(last, "l_orderkey").where(F.col("pos") + F.col("back") == F.col("last")).select("l_orderkey", "node", "pos")
    user = links.join(placed.select("l_orderkey", F.col("node").alias("to_node"), F.col("pos").alias("at")), ["l_orderkey", "to_node"])
    first = placed.join(user.groupBy("l_orderkey", F.col("from_node").alias("node")).agg(F.min("at").alias("user")), ["l_orderkey", "node"], "left").withColumn("user", F.when(F.col("pos") > 0, F.col("user")))
    depth = first.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "user"))), lambda x: F.coalesce(x["user"], F.lit(-1))).alias("users"))
    # A graph has at most a few hundred nodes, so its depths are one array.
    levels = F.aggregate("users", F.array().cast("array<int>"), lambda d, u: F.concat(d, F.array(F.when(u < 0, 0).otherwise(F.get(d, u.cast("int")) + 1))))
    return depth.select("l_orderkey", F.explode(levels).alias("depth")).groupBy("l_orderkey", "depth").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {LINKS}, p AS (SELECT l_orderkey, from_node, from_slot, to_node, to_slot FROM l WHERE from_node % 4 <> 0 UNION SELECT p.l_orderkey, p.from_node, p.from_slot, l.to_node, l.to_slot FROM p JOIN l ON l.l_orderkey = p.l_orderkey AND l.from_node = p.to_node WHERE p.to_node % 4 = 0)
  SELECT l_orderkey, from_node, from_slot, to_node, to_slot FROM p WHERE to_node % 4 <> 0 AND from_node <> to_node""")
def reroute_contract(t):
    links = _links(t)
    through = links.select("l_orderkey", F.col("from_node").alias("node")).union(links.select("l_orderkey", "to_node")).where("node % 4 = 0").distinct()
    return graph.contracted(links, through, "l_orderkey")


@query(f"WITH {LINKS} SELECT l_orderkey, to_node AS node, to_slot AS slot, from_node / 10 AS value FROM l WHERE from_node % 3 = 0")
def constant_fold(t):
    links = _links(t)
    constants = links.where("from_node % 3 = 0").select("l_orderkey", F.col("from_node").alias("node"), (F.col("from_node") / 10).alias("value")).distinct()
    return graph.folded(links, constants, "l_orderkey")[1]


def _as_sql(value: str, kind: str, target: str) -> str:
    """A value as another kind has it, in SQL; null if they do not fit."""
    unit = lambda x: f"least(greatest({x}, 0.0), 1.0)"
    mean = f"[({value}[1] + {value}[2] + {value}[3]) / 3]"
    table = {
        ("float", "vector"): f"[{value}[1], {value}[1], {value}[1]]",
        ("float", "color"): f"[{', '.join([unit(value + '[1]')] * 3)}, 1.0]",
        ("vector", "float"): mean,
        ("vector", "color"): f"[{', '.join(unit(f'{value}[{k}]') for k in (1, 2, 3))}, 1.0]",
        ("color", "float"): mean,
        ("color", "vector"): f"{value}[1:3]",
    }
    return "CASE " + " ".join(f"WHEN {kind} = '{a}' AND {target} = '{b}' THEN {x}" for (a, b), x in table.items()) + f" WHEN {kind} = {target} THEN {value} END"


FOLDS = f"""WITH RECURSIVE {LINKS}, k AS (SELECT *, CASE to_slot WHEN 1 THEN 'float' WHEN 2 THEN 'vector' WHEN 3 THEN 'color' WHEN 4 THEN 'shader' ELSE 'string' END AS to_kind, CASE WHEN to_node % 4 = 0 THEN CASE to_node % 3 WHEN 0 THEN 'float' WHEN 1 THEN 'vector' ELSE 'color' END END AS via FROM l),
  s(l_orderkey, origin, node, value, kind) AS (SELECT DISTINCT l_orderkey, from_node, from_node, [from_node / 50 - 0.3]::DOUBLE[], 'float' FROM l WHERE from_node % 3 = 0 AND from_node % 4 <> 0
    UNION SELECT k.l_orderkey, s.origin, k.to_node, ({_as_sql('s.value', 's.kind', 'k.via')})::DOUBLE[], k.via FROM s JOIN k ON k.l_orderkey = s.l_orderkey AND k.from_node = s.node WHERE k.via IS NOT NULL),
  e AS (SELECT k.l_orderkey, origin, k.to_node, k.to_slot, k.to_kind, s.kind, ({_as_sql('s.value', 's.kind', 'k.to_kind')})::DOUBLE[] AS value FROM s JOIN k ON k.l_orderkey = s.l_orderkey AND k.from_node = s.node WHERE k.via IS NULL)"""


@query(FOLDS + f""" SELECT DISTINCT l_orderkey, to_node AS node, to_slot AS slot, list_transform(value, lambda x: round(x, 6)) AS value FROM e WHERE value IS NOT NULL
  UNION ALL SELECT DISTINCT e.l_orderkey, -1 - origin, 0, list_transform({_as_sql('s.value', "'float'", "'color'")}, lambda x: round(x, 6)) FROM e JOIN s USING (l_orderkey, origin) WHERE to_kind = 'shader' AND s.node = origin""")
def constant_fold_typed(t):
    to = F.col("to_slot")
    kind = F.when(to == 1, "float").when(to == 2, "vector").when(to == 3, "color").when(to == 4, "shader").otherwise("string")
    links = _links(t).withColumn("to_kind", kind)
    ends = lambda c: links.select("l_orderkey", F.col(c).alias("node"))
    number = F.col("node") / 50 - 0.3
    constants = ends("from_node").where("node % 3 = 0 AND node % 4 <> 0").distinct().select("l_orderkey", "node", F.array(number.cast("double")).alias("value"), F.lit("float").alias("kind"))
    passing = ends("to_node").where("node % 4 = 0").distinct().withColumn("kind", F.when(F.col("node") % 3 == 0, "float").when(F.col("node") % 3 == 1, "vector").otherwise("color"))
    params = graph.folded_typed(links, constants, passing, "l_orderkey")[1]
    return params.withColumn("value", F.transform("value", lambda x: F.round(x, 6)))
