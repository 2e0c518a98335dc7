"""Folders of a corpus and of scenes, written from the tables and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs
from ..sources import corpus, files
from ..sources.shared import new_path
from . import query


def _written(t, rows) -> str:
    """A new folder with the files of (path, content)."""
    root = new_path(t.spark, "files")
    files.write_files(rows.select("path", F.col("content").cast("binary").alias("content")), root)
    return root


@query("""WITH v AS (SELECT s_suppkey AS supp, s_name, unnest([0, 1, 2]) AS k FROM supplier), n AS (SELECT *, CASE k WHEN 0 THEN 'blender' ELSE 'var_0000' || k END AS data_name FROM v)
  SELECT 's' || supp % 5 || '/m' || supp AS mat_name, data_name, s_name || ' ' || data_name AS code FROM n WHERE (supp + k) % 4 <> 0""")
def read_programs(t):
    key = F.col("s_suppkey")
    names = F.posexplode(F.array(*[F.lit(x) for x in ("blender", "var_00001", "var_00002")]))
    rows = t.supplier.select("s_suppkey", "s_name", names.alias("k", "data_name"))
    path = F.concat(F.lit("s"), key % 5, F.lit("/m"), key, F.lit("/"), "data_name")
    code = rows.select(F.concat(path, F.lit("_full.py")).alias("path"), F.concat_ws(" ", "s_name", "data_name").alias("content"))
    renders = rows.where((key + F.col("k")) % 4 != 0).select(F.concat(path, F.lit("_render.jpg")).alias("path"), F.lit("jpg").alias("content"))
    return corpus.programs(t.spark, _written(t, code.unionByName(renders))).select("mat_name", "data_name", "code")


@query("""SELECT CASE WHEN s % 3 = 0 THEN 'mat_llm_' || s % 2 || '/m' || s ELSE 'src' || s % 2 || '/m' || s END AS mat_name, (row_number() OVER (PARTITION BY s ORDER BY p_partkey) - 1)::INT AS node_pos, 'T' || p_size % 7 AS type, p_partkey AS value FROM (SELECT *, p_partkey % 40 AS s FROM part)""")
def read_analyses(t):
    s = F.col("p_partkey") % 40
    node = F.struct(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("T"), F.col("p_size") % 7).alias("type"), F.array().cast("array<int>").alias("linked_input"), F.array(F.struct(F.lit(0).alias("id"), F.lit("x").alias("name"), F.col("p_partkey").alias("value"))).alias("params"))
    listed = t.part.groupBy(s.alias("s")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", node.alias("n")))).alias("nodes"))
    content = F.to_json(F.transform("nodes", lambda x: x["n"]))
    generated = F.concat(F.lit("mat_llm_"), F.col("s") % 2, F.lit("/m"), "s", F.lit("/analysis_result.json"))
    own = F.concat(F.lit("src"), F.col("s") % 2, F.lit("/m"), "s", F.lit(".json"))
    root = _written(t, listed.select(F.when(F.col("s") % 3 == 0, generated).otherwise(own).alias("path"), content.alias("content")))
    return corpus.analyses(t.spark, root).select("mat_name", "node_pos", "type", F.try_variant_get(F.get("params", 0)["value"], "$", "bigint").alias("value"))


@query("SELECT DISTINCT CASE c_custkey % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, 's' || c_nationkey || '/m' || c_custkey % 7 AS mat_name FROM customer")
def read_splits(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k.cast("string").alias("id"), F.concat(F.lit("s"), "c_nationkey", F.lit("/m"), k % 7, F.lit("/"), k, F.lit(".jpg")).alias("image"), F.when(k % 10 == 0, "val").when(k % 10 == 1, "test").otherwise("train").alias("split"))
    root = new_path(t.spark, "splits")
    corpus.write_splits(rows, root)
    return corpus.split_materials(t.spark, root)


@query("SELECT file_path, reason, row_number() OVER (ORDER BY file_path) - 1 AS line FROM (SELECT 'm' || lpad(doc_id::VARCHAR, 8, '0') || '.py' AS file_path, 'Too long, \"' || n_chars || '\"' AS reason FROM documents WHERE n_chars > 2000)")
def write_reject_log(t):
    rows = t.documents.where("n_chars > 2000").select(F.format_string("m%08d.py", "doc_id").alias("file_path"), F.concat(F.lit('Too long, "'), "n_chars", F.lit('"')).alias("reason"))
    root = new_path(t.spark, "log")
    corpus.write_log(rows, root, "file_path")
    # Files and lines are in the log's order, so the place of a line is the order that it was written in.
    lines = t.spark.read.csv(root, header=True).select("file_path", "reason", F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id()).alias("at"))
    place = lines.groupBy().agg(F.array_sort(F.collect_list(F.struct("at", "file_path", "reason"))).alias("l")).select(F.posexplode("l").alias("line", "x"))
    return place.select("x.file_path", "x.reason", F.col("line").cast("long").alias("line"))


@query("SELECT c_custkey::VARCHAR AS seed, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE ['base.gin', c_mktsegment] END AS configs FROM customer")
def read_scenes(t):
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("seed"), F.lit("False").alias("all_done"), F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("base.gin"), "c_mktsegment")).alias("configs"))
    root = new_path(t.spark, "scenes")
    corpus.write_scenes(rows, root)
    return corpus.scenes(t.spark, root).select("seed", "configs")


@query("""WITH e AS (SELECT user_id::VARCHAR AS seed, CASE WHEN event_id % 2 = 0 THEN 'coarse' ELSE 'fine' END AS phase, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) - 1 AS r, event_type AS name, event_type <> 'error' AS ran, floor(value)::BIGINT AS mem FROM events),
  d AS (SELECT *, mem - lag(mem) OVER (PARTITION BY seed, phase ORDER BY r) AS delta FROM e WHERE ran)
  SELECT name, count(*) AS n, round(avg(delta), 6) AS mean, min(delta) AS least, round(quantile_cont(delta, 0.5), 6) AS median, round(quantile_cont(delta, 0.9), 6) AS p90, round(quantile_cont(delta, 0.95), 6) AS p95, round(quantile_cont(delta, 0.99), 6) AS p99 FROM d WHERE delta <> 0 GROUP BY ALL""")
def stage_memory(t):
    """Files of stage runs, and the deltas of memory by stage."""
    from ..operators import stats

    phase = F.when(F.col("event_id") % 2 == 0, "coarse").otherwise("fine")
    of = t.events.groupBy("user_id", phase.alias("phase")).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", F.floor("value").alias("mem")))).alias("runs"))
    line = F.transform("runs", lambda x, i: F.concat_ws(",", i, x["event_type"], F.when(x["event_type"] != "error", "True").otherwise("False"), x["mem"], i, i))
    content = F.concat(F.lit(",name,ran,mem_at_finish,obj_count,instance_count\n"), F.array_join(line, "\n"), F.lit("\n"))
    root = _written(t, of.select(F.concat("user_id", F.lit("/pipeline_"), "phase", F.lit(".csv")).alias("path"), content.alias("content")))
    deltas = runs.deltas(corpus.stage_runs(t.spark, root), ["seed", "phase"], "row_idx", "mem_at_finish", "ran")
    return stats.spread(deltas, ["name"], "delta").orderBy(F.desc("mean"), "name")


@query("""SELECT 'coarse' AS step, 'stage_' || event_id % 4 AS name, event_id % 3000 AS seconds, count(*) AS n FROM events WHERE user_id % 3 <> 0 AND event_id % 3000 >= 1 GROUP BY ALL""")
def read_logs(t):
    took = lambda s: F.format_string("%d:%02d:%02d.250", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    of = t.events.groupBy("user_id").agg(F.collect_list(F.concat(F.lit("[times] [INFO] | [stage_"), F.col("event_id") % 4, F.lit("] finished in "), took(F.col("event_id") % 3000))).alias("lines"))
    total = F.when(F.col("user_id") % 3 != 0, "[MAIN TOTAL] finished in 1 day, 0:00:01").otherwise("stopped")
    root = _written(t, of.select(F.concat(F.lit("coarse_"), "user_id", F.lit(".log")).alias("path"), F.concat(F.array_join("lines", "\n"), F.lit("\n"), total, F.lit("\n")).alias("content")))
    steps = t.spark.createDataFrame([(0, "coarse"), (1, "fine")], "pos int, step string")
    return corpus.log_times(corpus.logs(t.spark, root), steps).groupBy("step", "name", "seconds").agg(F.count("*").alias("n"))


@query("SELECT s_nationkey::VARCHAR AS seed, 'Depth' AS type, 'npy' AS ext, '00' AS rig, lpad((s_suppkey % 2)::VARCHAR, 2, '0') AS subcam, lpad(s_suppkey::VARCHAR, 6, '0') AS frame, s_name AS path FROM supplier WHERE s_nationkey IN (3, 4, 5)")
def read_index(t):
    frames = lambda c: F.map_from_entries(F.filter("f", lambda x: x["cam"] == c)["e"])
    rows = t.supplier.groupBy("s_nationkey").agg(F.collect_list(F.struct((F.col("s_suppkey") % 2).cast("int").alias("cam"), F.struct(F.format_string("%06d", "s_suppkey").alias("k"), F.col("s_name").alias("v")).alias("e"))).alias("f"))
    cams = F.create_map(F.lit("00"), F.create_map(F.lit("00"), frames(0), F.lit("01"), frames(1)))
    depth = F.to_json(F.create_map(F.lit("npy"), cams))
    content = F.concat(F.lit('{"Depth": '), depth, F.lit(', "Mask Tags": {"0001": "tags.json"}}'))
    root = _written(t, rows.select(F.concat("s_nationkey", F.lit("/summary.json")).alias("path"), content.alias("content")))
    return files.scene_files(t.spark, root, "index", group=4).where(F.col("seed").isin("3", "4", "5"))


@query("""WITH m AS (SELECT label, vec_id, floor(abs(unnest(embedding)::DOUBLE) * 8)::BIGINT AS id FROM embeddings), c AS (SELECT label, vec_id, id, count(*) AS n FROM m GROUP BY ALL)
  SELECT label::VARCHAR AS seed, id, sum(n)::BIGINT AS n, count(*) AS files FROM c GROUP BY ALL""")
def read_masks(t):
    # The head of a stored array of 8 x 8 four-byte numbers, and their bytes.
    head = b"\x93NUMPY\x01\x00v\x00" + b"{'descr': '<i4', 'fortran_order': False, 'shape': (8, 8), }".ljust(117) + b"\n"
    number = F.transform("embedding", lambda x: F.concat(F.lpad(F.hex(F.floor(F.abs(x.cast("double")) * 8)), 2, "0"), F.lit("000000")))
    rows = t.embeddings.select(F.concat("label", F.lit("/frames/mask_"), "vec_id", F.lit(".npy")).alias("path"), F.concat(F.lit(bytearray(head)), F.unhex(F.array_join(number, ""))).alias("content"))
    masks = files.scene_files(t.spark, _written(t, rows), "masks", "seed", "ids", "counts", group=3)
    flat = masks.select("seed", F.explode(F.arrays_zip("ids", "counts")).alias("x"))
    return flat.groupBy("seed", F.col("x.ids").alias("id")).agg(F.sum("x.counts").alias("n"), F.count("*").alias("files"))


@query("""WITH w AS (SELECT c_nationkey AS case_id, c_custkey % 30 AS gen_id FROM customer), s AS (SELECT DISTINCT case_id, gen_id FROM w WHERE gen_id % 4 = 1),
  r AS (SELECT unnest([{'a': 'full.py', 'b': 'blender_full.py'}, {'a': 'render.jpg', 'b': 'transpiled_render.jpg'}, {'a': 'analysis.json', 'b': 'analysis_result.json'}]) AS r)
  SELECT printf('case_%05d_gen_%02d', case_id, gen_id) AS key, r.r.b AS file, printf('case_%05d/gen_%02d_', case_id, gen_id) || r.r.a AS source FROM s, r""")
def promote_generated(t):
    """Files of selected items, renamed (A13): the selection is a file whose line is the case and whose words are the items."""
    gens = t.customer.select(F.col("c_nationkey").alias("case_id"), (F.col("c_custkey") % 30).alias("gen_id")).distinct()
    made = gens.select(F.explode(F.array(*[F.concat(F.format_string("case_%05d/gen_%02d_", "case_id", "gen_id"), F.lit(x)) for x in corpus.ROLES])).alias("path"), F.lit("x").alias("content"))
    root = _written(t, made)
    chosen = gens.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("gen_id") % 4 == 1, F.col("gen_id").cast("string")))), " ").alias("value"))
    lines = t.spark.range(25).select(F.col("id").alias("case_id")).join(chosen, "case_id", "left").select(F.col("case_id").alias("pos"), F.coalesce("value", F.lit("")).alias("value"))
    return corpus.promoted(corpus.generated(t.spark, root), corpus.selected(lines)).select("key", "file", "source")


@query("SELECT printf('case_%05d_gen_%02d', c_nationkey, c_custkey % 30) AS key, count(DISTINCT c_custkey % 30) AS n FROM customer GROUP BY ALL")
def promote_all(t):
    """All items of a folder (A13), without a selection."""
    made = t.customer.select(F.format_string("case_%05d/gen_%02d_full.py", "c_nationkey", F.col("c_custkey") % 30).alias("path"), F.lit("x").alias("content")).distinct()
    return corpus.promoted(corpus.generated(t.spark, _written(t, made))).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id::VARCHAR AS seed, 'task' || event_id % 3 AS task FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0")
def finished_tasks(t):
    rows = t.events.where("event_type = 'purchase'").select("user_id", (F.col("event_id") % 3).alias("k")).distinct()
    # Scenes without a folder of logs have no markers.
    folder = F.when(F.col("user_id") % 5 == 0, "other").otherwise("logs")
    root = _written(t, rows.select(F.concat("user_id", F.lit("/"), folder, F.lit("/FINISH_task"), "k").alias("path"), F.lit("").alias("content")))
    return corpus.finished_tasks(t.spark, root)
