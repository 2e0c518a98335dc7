"""The corpus pipeline: quality rules, toxicity, near-duplicate removal, mixing, and byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. A driver writes each stage's
result as Parquet and reads it again for the next; :func:`run` does so in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matterloom.llm import byte_bpe, jaccard_join, mixing, quality_rules, toxicity
from matterloom.llm.common import drop, with_rows, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Keys of rows (8 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that many documents of their source share, and keep the length
    of what is left in ``n_chars``."""
    kept = quality_rules.apply_rules(docs, clean=True).where("kept")
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model, keep=True).where("predicted = 0").select(*COLUMNS)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents stays: that with the smallest doc_id, or any where none has one. Documents
    link at a similarity of 0.8 of their five-word shingles. Rows are told by keys of their own, so different texts stay
    whatever their doc_ids are; a text without words is like nothing else and stays."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    keyed = written(docs.mapInArrow(with_rows, f"{schema}, _row long"), "rows")
    linked = jaccard_join.link_components(keyed, doc_id="_row", n=5, num=4, den=5).select(F.col("doc_id").alias("_row"), "component_id")
    linked = written(keyed.select("_row", "doc_id").join(linked, "_row"), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row")).alias("first")
    stays = linked.groupBy("component_id").agg(first).select("first._row")
    goes = written(linked.select("_row").join(stays, "_row", "left_anti"), "goes")
    drop(linked)
    return keyed.join(F.broadcast(goes) if goes.count() <= BROADCAST else goes, "_row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as often as the mix takes them; those that it does not take go."""
    mixed = mixing.mix(docs, keep=True)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mix: doc_id, n_tokens, and the digests of its ids and of what they decode to."""
    return byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: Learned scores and the fitted mix can't be written as SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
