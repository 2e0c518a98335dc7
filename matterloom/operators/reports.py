"""Reports over runs, masks and schedulers that join small tables to large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import class_name, memory_gb
from .stats import spread

#: Prices of one token, in and out.
PRICE_IN, PRICE_OUT = 1.5e-7, 6e-7


def is_dark(gray: Column, percent: float = 5.0) -> Column:
    """A mean gray (0 to 1) below a percentage of white."""
    return gray * 100 < percent


def completion(finished: DataFrame, requested: int, share: float = 0.8) -> DataFrame:
    """How many scenes were finished, and whether they are enough."""
    return finished.agg(F.count("*").alias("finished")).select("finished", (F.col("finished") >= share * requested).alias("enough"))


def with_predictions(examples: DataFrame, predictions: DataFrame, name: str, pattern: str, first: int) -> DataFrame:
    """The first examples, by name, whose whole name matches and that have a prediction."""
    return examples.where(F.col(name).rlike(f"^(?:{pattern})$")).join(predictions, name, "left_semi").orderBy(name).limit(first)


def unexpected(outputs: DataFrame, text: str) -> DataFrame:
    """Outputs with a Python error that is none of the two that are expected."""
    t = F.col(text)
    return outputs.where(t.contains("Error: Python:") & ~t.contains("Unsupported node type") & ~t.contains("Oversized node graph"))


def seen_instances(objects: DataFrame, masks: DataFrame) -> DataFrame:
    """Instances of objects that occur in their frame's masks (C7). ``objects`` has model_matrices by instance; ``masks`` has the
    distinct (seed, frame, object_index, instance_id) that a mask holds."""
    rows = objects.select("seed", "frame", "object_index", F.explode("model_matrices").alias("instance_id", "matrix"))
    return rows.join(masks, ["seed", "frame", "object_index", "instance_id"], "left_semi")


def ids_with_tag(tags: DataFrame, wanted: str) -> DataFrame:
    """(seed, id) of mask ids whose dotted tag holds the wanted one."""
    return tags.where(F.array_contains(F.split("tag", r"\."), wanted)).select("seed", "id")


def tags_seen(counted: DataFrame, tags: DataFrame) -> DataFrame:
    """(seed, frame, tag) in a frame (D21), from its histogram."""
    present = counted.where("id > 0 AND n > 0").select("seed", "frame", "id")
    return present.join(tags, ["seed", "id"]).select("seed", "frame", F.explode(F.split("tag", r"\.")).alias("tag")).distinct()


def class_shares(counted: DataFrame, objects: DataFrame) -> DataFrame:
    """Percent of all pixels of each object class (D19). ``counted`` is the histogram of object masks, ``objects`` has (seed, id, name)."""
    named = counted.join(objects.select("seed", "id", class_name(F.col("name")).alias("cls")), ["seed", "id"])
    total = counted.agg(F.sum("n").alias("total"))
    return named.groupBy("cls").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select("cls", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def job_memory(jobs: DataFrame, memory: DataFrame, finished: DataFrame) -> DataFrame:
    """Jobs of finished scenes with their peak memory in GB, -1 where it is not known (C9). ``memory`` has (job_id, size) as text."""
    kept = jobs.join(finished, "seed", "left_semi").join(memory.groupBy("job_id").agg(F.max(memory_gb(F.col("size"))).alias("peak_gb")), "job_id", "left")
    return kept.withColumn("peak_gb", F.coalesce("peak_gb", F.lit(-1.0)))


def memory_by_step(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Spread of peak memory by step; a job belongs to each step that its name holds (D17). ``steps`` is a short list."""
    return spread(jobs.join(F.broadcast(steps), F.col("name").contains(F.col("step"))), ["step"], "peak_gb")


def polygons(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, faces, triangles) of every count in a log (D16); thousands may have commas."""
    plain = F.replace(F.col(text), F.lit(","), F.lit(""))
    pattern = F.lit(r"Faces:([0-9]+)Tris:([0-9]+)")
    pairs = F.arrays_zip(F.regexp_extract_all(plain, pattern, F.lit(1)).alias("faces"), F.regexp_extract_all(plain, pattern, F.lit(2)).alias("triangles"))
    rows = texts.select(key, F.posexplode(pairs).alias("pos", "p"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), F.col("p.faces").cast("long").alias("faces"), F.col("p.triangles").cast("long").alias("triangles"))


def token_costs(usage: DataFrame, key: str, tokens_in: str, tokens_out: str, digits: int = 9) -> DataFrame:
    """Token sums and what they cost."""
    sums = usage.groupBy(key).agg(F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))
    return sums.withColumn("cost", F.round(F.col("tokens_in") * PRICE_IN + F.col("tokens_out") * PRICE_OUT, digits))


def hardware(lines: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    """From lines of ``node partition gpu:model:count``: units by model and partition, and the nodes that have a model."""
    pattern = r"^(\S+) +(\S+) +gpu:([^:]+):(\d+)"
    get = lambda k: F.regexp_extract(line, pattern, k)
    rows = lines.where(F.col(line).rlike(pattern)).select(get(1).alias("node"), get(2).alias("partition"), get(3).alias("gpu"), get(4).cast("long").alias("units"))
    return rows.groupBy("gpu", "partition").agg(F.sum("units").alias("units")), rows.groupBy("gpu").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def distance(a: Column, b: Column, kind: str = "l1") -> Column:
    """A metric of two descriptor arrays (L2): mean absolute, Euclidean, or cosine distance."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x - y).alias("d"), (x * y).alias("p"), (x * x).alias("q"), (y * y).alias("r")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, z: s + f(z))
    if kind == "l2":
        return F.sqrt(total(lambda z: z["d"] * z["d"]))
    if kind == "cosine":
        return 1 - total(lambda z: z["p"]) / F.sqrt(total(lambda z: z["q"]) * total(lambda z: z["r"]))
    return total(lambda z: F.abs(z["d"])) / F.size(a)
