"""Readers and writers of corpus folders, analyses, renders, logs, scene tables and masks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import contents, located, scene_files, shown, tree

#: File names of programs, and of the renders beside them.
PROGRAM = r"([^/]+/[^/]+)/(blender|var_\d{5})_full\.py$"
RENDER = r"([^/]+/[^/]+)/(blender|var_\d{5})_render\.jpg$"
NODES = "array<struct<name: string, type: string, group_type: string, linked_input: array<int>, params: array<struct<id: int, name: string, value: variant>>>>"
STAGES = "row_idx int, name string, ran boolean, mem_at_finish bigint, obj_count bigint, instance_count bigint"


def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.select("*", F.regexp_extract("path", pattern, 1).alias("mat_name"), F.regexp_extract("path", pattern, 2).alias("data_name")).where("mat_name <> ''")


def listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Path and length of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "length")


def programs(spark: SparkSession, root: str, variations: bool = True, generated: bool | None = None) -> DataFrame:
    """(mat_name, data_name, code, render_path): programs that have a render (A1, C2); materials without any are not there.

    Files are listed and read by the tasks (:func:`.files.tree`), as there may be millions. On a file system that only Spark knows, its
    reader lists them on the driver."""
    try:
        located(root)
    except (ValueError, OSError):
        code = _named(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_full.py").load(root).select("path", "content"), PROGRAM)
        renders = _named(listing(spark, root, "*_render.jpg"), RENDER)
    else:
        paths = tree(spark, root)
        # Paths are shown as Spark's readers show them.
        code, renders = contents(_named(paths, PROGRAM), root), _named(paths, RENDER).withColumn("path", F.concat(F.lit(shown(root)), "path"))
    code = code.select("mat_name", "data_name", F.decode("content", "utf-8").alias("code"))
    if not variations:
        code = code.where("data_name = 'blender'")
    if generated is not None:
        code = code.where(F.col("mat_name").startswith("mat_llm") == generated)
    renders = renders.select("mat_name", "data_name", F.col("path").alias("render_path"))
    return code.join(renders, ["mat_name", "data_name"])


def material_of(path: Column, by_folder: tuple[str, ...] = ("mat_llm",)) -> Column:
    """A material's name from its analysis path: the folder for sources that begin with one of the given names (generated ones, and
    procedural ones where the corpus has them), else the file's stem (A2)."""
    source = F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1)
    inside = F.regexp_extract(path, r"([^/]+/[^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+/[^/]+)$", 1), r"\.[^.]+$", "")
    return F.coalesce(*[F.when(source.startswith(name), inside) for name in by_folder], stem)


def analyses(spark: SparkSession, root: str) -> DataFrame:
    """The nodes of every material, in order (A2): one JSON array a file."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    nodes = text.select(material_of(F.col("path")).alias("mat_name"), F.posexplode(F.from_json("value", NODES)).alias("node_pos", "n"))
    return nodes.select("mat_name", "node_pos", "n.*")


def signatures(spark: SparkSession, root: str) -> DataFrame:
    """(sig_key, category, pos, name, dtype, default, min, max, enum) of the signature files below a folder (A3): ``<type>.json``, and
    ``node_groups/<group>.json``. An attribute's ``value`` is its default."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    slot = "array<struct<name: string, type: string, default: variant, value: variant, min: double, max: double, enum: array<string>>>"
    parsed = text.select(F.regexp_extract("path", r"((?:node_groups/)?[^/]+)\.json$", 1).alias("sig_key"), F.from_json("value", f"struct<input: {slot}, output: {slot}, attr: {slot}>").alias("sig"))
    parts = [parsed.select("sig_key", F.lit(c).alias("category"), F.posexplode(f"sig.{c}").alias("pos", "s")) for c in ("input", "output", "attr")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    default = F.when(F.col("category") == "attr", F.col("s.value")).otherwise(F.col("s.default"))
    return rows.select("sig_key", "category", "pos", F.col("s.name").alias("name"), F.col("s.type").alias("dtype"), default.alias("default"), "s.min", "s.max", "s.enum")


def with_ranges(signatures: DataFrame, ranges: DataFrame) -> DataFrame:
    """Signatures with supplementary ranges laid over them (A3). ``ranges`` has sig_key, name and JSON text: two numbers are a range, strings
    are the allowed values, and ``"unused"`` is the range from 0 to 0."""
    numbers, words = F.from_json("text", "array<double>"), F.from_json("text", "array<string>")
    unused, listed = F.col("text") == '"unused"', F.col("text").rlike(r'^\s*\[\s*"')
    over = ranges.select("sig_key", "name", F.when(unused, 0.0).when(~listed, numbers[0]).alias("_min"), F.when(unused, 0.0).when(~listed, numbers[1]).alias("_max"), F.when(listed, words).alias("_enum"))
    joined = signatures.join(F.broadcast(over), ["sig_key", "name"], "left")
    return joined.withColumns({"min": F.coalesce("_min", "min"), "max": F.coalesce("_max", "max"), "enum": F.coalesce("_enum", "enum")}).drop("_min", "_max", "_enum")


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, height, width, data) of the image source; rows are BGR bytes (A4)."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root).select("image.origin", "image.height", "image.width", "image.data")


def split_materials(spark: SparkSession, folder: str) -> DataFrame:
    """(split, mat_name) of packaged splits (A5)."""
    rows = spark.read.json(folder)
    return rows.select("split", F.regexp_extract("image", "^(.*)/[^/]*$", 1).alias("mat_name")).distinct()


def write_splits(examples: DataFrame, folder: str) -> None:
    """Packaged examples, one folder a split; empty splits have none."""
    examples.write.mode("overwrite").partitionBy("split").json(folder)


def write_log(rows: DataFrame, folder: str, *order: str) -> None:
    """A log as CSV with a header, in order."""
    rows.orderBy(*order).write.mode("overwrite").csv(folder, header=True)


def scenes(spark: SparkSession, path: str) -> DataFrame:
    """The scene table; ``configs`` is a list literal."""
    return spark.read.csv(path, header=True).withColumn("configs", F.from_json(F.translate("configs", "'", '"'), "array<string>"))


def write_scenes(rows: DataFrame, folder: str) -> None:
    listed = F.concat(F.lit("['"), F.array_join("configs", "', '"), F.lit("']"))
    rows.withColumn("configs", F.when(F.size("configs") == 0, "[]").otherwise(listed)).write.mode("overwrite").csv(folder, header=True)


def stage_runs(spark: SparkSession, root: str) -> DataFrame:
    """Stage runs of every scene and phase, in run order (A9): files ``<seed>/pipeline_<phase>.csv``."""
    rows = spark.read.schema(STAGES).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "pipeline_*.csv").csv(root)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(path, r"([^/]+)/pipeline_[^/]+\.csv$", 1).alias("seed"), F.regexp_extract(path, r"pipeline_([^/]+)\.csv$", 1).alias("phase"), "*")


def logs(spark: SparkSession, root: str, glob: str = "*.log") -> DataFrame:
    """(path, text) of whole log files (A10)."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def log_lines(spark: SparkSession, root: str, glob: str = "*.log") -> DataFrame:
    """(path, block, line, text): the lines of logs that may be long, which are split (A10). ``block`` is where a line's part of the file
    begins, and ``line`` rises within it, so (block, line) is the order of a log, and ``block`` its parts."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def log_times(texts: DataFrame, steps: DataFrame) -> DataFrame:
    """(path, step, name, seconds): times in logs that were finished (B17): a log belongs to the first step that begins its name; the total
    and stages under a second are left out. ``steps`` is the short table (pos, step)."""
    from ..functions.text import seconds

    stem = F.regexp_extract("path", r"([^/]+)\.[^/.]*$", 1)
    done = texts.where(F.col("text").contains("[MAIN TOTAL] finished in")).withColumn("stem", stem)
    of = done.join(F.broadcast(steps), F.col("stem").startswith(F.col("step"))).groupBy("path").agg(F.min_by("step", "pos").alias("step"), F.first("text").alias("text"))
    pattern = F.lit(r"\[([^\]\n]+)\] finished in ((?:\d+ days?, )?\d+:\d\d:\d\d(?:\.\d+)?)")
    pairs = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(1)).alias("name"), F.regexp_extract_all("text", pattern, F.lit(2)).alias("time"))
    rows = of.select("path", "step", F.explode(pairs).alias("t")).select("path", "step", F.col("t.name").alias("name"), seconds(F.col("t.time")).alias("seconds"))
    return rows.where("name <> 'MAIN TOTAL' AND seconds >= 1")


def file_index(texts: DataFrame, text: str = "value") -> DataFrame:
    """(type, ext, rig, subcam, frame, path) of a five-level index."""
    kind = "string"
    for _ in range(5):
        kind = f"map<string, {kind}>"
    rows = texts.select(F.from_json(text, kind).alias("v0"))
    names = ["type", "ext", "rig", "subcam", "frame"]
    for k, name in enumerate(names):
        rows = rows.select(*names[:k], F.explode(f"v{k}").alias(name, f"v{k + 1}"))
    return rows.withColumnRenamed("v5", "path")


def mask_histograms(spark: SparkSession, root: str, glob: str = "*.npy") -> DataFrame:
    """(path, id, n): pixels of each id in every stored array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                ids, n = np.unique(np.load(io.BytesIO(content)), return_counts=True)
                yield pd.DataFrame({"path": path, "id": ids.astype(np.int64), "n": n})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", "content").mapInPandas(run, "path string, id long, n long")


def selected(lines: DataFrame) -> DataFrame:
    """(case_id, gen_id, key) of a selection: the line's number is the case, its words are the items (A13). ``lines`` has pos and value."""
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    rows = lines.select(F.col("pos").alias("case_id"), F.explode(words).alias("gen_id")).withColumn("gen_id", F.col("gen_id").cast("int"))
    return rows.withColumn("key", F.format_string("case_%05d_gen_%02d", "case_id", "gen_id"))


#: The endings of a generated item's files, and their names in the corpus.
ROLES = {"full.py": "blender_full.py", "render.jpg": "transpiled_render.jpg", "analysis.json": "analysis_result.json"}


def generated(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, gen_id, role, source): the files of generated items, ``case_<case>/gen_<item>_<role>``."""
    pattern = r"(case_(\d+)/gen_(\d+)_(.+))$"
    part = lambda k: F.regexp_extract("path", pattern, k)
    files = listing(spark, root, "gen_*").where(F.col("path").rlike(pattern))
    return files.select(part(2).cast("int").alias("case_id"), part(3).cast("int").alias("gen_id"), part(4).alias("role"), part(1).alias("source"))


def promoted(files: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(case_id, gen_id, key, file, source): the files of generated items under their names in the corpus (A13): all items that have a
    program, or the ``chosen`` ones. A file of another role is none of the corpus."""
    items = files.where("role = 'full.py'").select("case_id", "gen_id") if chosen is None else chosen.select("case_id", "gen_id")
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    rows = files.join(items.distinct(), ["case_id", "gen_id"], "left_semi").withColumn("file", F.try_element_at(names, F.col("role")))
    return rows.where("file IS NOT NULL").select("case_id", "gen_id", F.format_string("case_%05d_gen_%02d", "case_id", "gen_id").alias("key"), "file", "source")


def finished_tasks(spark: SparkSession, root: str) -> DataFrame:
    """(seed, task) of completion markers (A16): ``<seed>/logs/FINISH_<task>``, empty files, listed by the tasks."""
    return scene_files(spark, root, "markers")
