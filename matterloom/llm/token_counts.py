"""Token counts: count the pieces of each distinct pre-token once, join them to per-document pre-token
frequencies, and add up. No ids are materialised.

Pieces of this vocabulary hold the space mark only at their front and never hold a line break, so a text
(with the space that the library puts before it) falls apart before each run of spaces and before each line
break, and the parts are encoded independently of one another.

Plan: one pass counts in how many documents each pre-token occurs (map-side sums, then a shuffle by pre-token
with one row per task and pre-token). Every distinct pre-token is then encoded once. The ``HOT`` most widespread
pre-tokens, a fixed number, are broadcast and joined inside the second pass; the others leave it as
(document, pre-token, frequency) rows and meet their counts in a shuffle join, in which no key is frequent
because the frequent ones were taken out before.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows and repeated or null doc_ids
give one result row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keys, slices, strings, utf8, written

#: Pre-tokens that are broadcast: a fixed number, whatever the input.
HOT = 1 << 17
#: Distinct pre-tokens that a task holds before it sends on what it has counted.
HELD = 250_000
PRETOKEN = re.compile(r"\n[^ \n]*| +[^ \n]*")


def pretokens(text: str) -> list[str]:
    """Parts of ``text`` that the library encodes independently; each begins with spaces or a line break."""
    return PRETOKEN.findall(" " + text.replace("▁", " ")) if text else []


def piece_counts(model, parts: list[str]) -> list[int]:
    """Pieces of each pre-token. The library puts a space before what it encodes, which stands for the first
    space of a part; after a line break that space is one piece too many, and a lone space is one piece."""
    bare = [p[1:] if p[0] == " " else p for p in parts]
    counts = [len(x) for x in model.encode(bare, num_threads=1)]
    return [1 if p == " " else n - (p[0] == "\n") for p, n in zip(parts, counts, strict=True)]


def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pretoken, documents): in how many documents each pre-token occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pretoken", "documents"])
            held.clear()
            return out

        for batch in slices(batches, text):
            for t in strings(batch.column(text)):
                held.update(set(pretokens(t)))
                if len(held) > HELD:
                    yield send()
        if held:
            yield send()

    return docs.select(text).mapInArrow(count, "pretoken string, documents long").groupBy("pretoken").agg(F.sum("documents").alias("documents"))


def count_pieces(distinct: DataFrame, model_path: str) -> DataFrame:
    """Adds ``pieces`` to a table of distinct pre-tokens; each is encoded once."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _load(model_path)
        for batch in slices(batches, "pretoken", rows=20_000):
            n = piece_counts(model, batch.column("pretoken").to_pylist())
            yield pa.record_batch([batch.column("pretoken"), batch.column("documents"), pa.array(n, pa.int64())], ["pretoken", "documents", "pieces"])

    return distinct.mapInArrow(pieces, "pretoken string, documents long, pieces long")


def hottest(counted: DataFrame, most: int = HOT) -> dict[str, int]:
    """Pieces of at most ``most`` of the most widespread pre-tokens. The threshold comes from a histogram of at
    most 65,536 steps; all pre-tokens at or above it fit, so nothing depends on ties."""
    steps = counted.groupBy(F.least("documents", F.lit(65_535)).alias("d")).agg(F.count("*").alias("n")).collect()
    steps = sorted((r.d, r.n) for r in steps)[::-1]
    total = np.cumsum([n for _, n in steps])
    fit = int(np.searchsorted(total, most, side="right"))
    if not fit:
        return {}
    rows = counted.where(F.col("documents") >= steps[fit - 1][0]).select("pretoken", "pieces").collect()
    return {r.pretoken: r.pieces for r in rows}


def count_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 4096, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    spark = docs.sparkSession
    counted = written(count_pieces(document_frequencies(docs, text), model_path), "pieces")
    known = spark.sparkContext.broadcast(hottest(counted, hot))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys = known.value, row_keys()
        for batch in slices(batches, "text"):
            sizes = [len(x) for x in utf8(batch.column("text"))]
            row, key, times, first = [], [], [], []
            for i, t in enumerate(strings(batch.column("text"))):
                rid, sure = next(keys), 0
                at = len(key)
                row.append(rid), key.append(f"#{rid}"), times.append(0), first.append(i)
                for p, n in Counter(pretokens(t)).items():
                    if (pieces := table.get(p)) is None:
                        row.append(rid), key.append(p), times.append(n), first.append(None)
                    else:
                        sure += n * pieces
                times[at] = sure
            pick = pa.array(first, pa.int64())
            yield pa.record_batch(
                [pa.array(row, pa.int64()), pa.array(key, pa.string()), pa.array(times, pa.int64()), batch.column("doc_id").take(pick), pa.array(sizes, pa.int64()).take(pick)],
                ["row", "pretoken", "times", "doc_id", "n_bytes"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(split, f"row long, pretoken string, times long, doc_id {id_type}, n_bytes long")
    # A document's own row has a key that no pre-token can have; it keeps what the broadcast part came to.
    joined = rows.join(counted.select("pretoken", "pieces"), "pretoken", "left")
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("times") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
