"""Quality rules: lines that many documents of a host share go, and a document of which too little is left is rejected.

Lines are normalised (ASCII letters lowered, digits made 0, white space collapsed) and hashed together with their host.
For every host and line the distinct documents are counted; exact copies of a document count once, because a document is
told by a digest of its raw text. Documents that differ in anything, be it a number, are distinct. Lines above
``LIMIT`` documents are removed everywhere on that host.

Plan: one pass sends (line, document) hashes, distinct first within a task and then by shuffle, so that a line that
a third of all documents hold is reduced before it is dealt out, and counted by partial sums. If the frequent lines
number at most ``BROADCAST``, the second pass is a map over the documents with their hashes broadcast. Beyond that they
are joined by shuffle: the most widespread ones, fixed in number, are still broadcast, so that no key of the join is hot.

Defined results: null or empty text has no words and fails the base rule; a null host is a host of its own; repeated
rows and null doc_ids keep one result row each; an empty table gives an empty result; columns whose names clash with
results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, strings, with_rows, written

#: A line is removed where more distinct documents of a host than this have it.
LIMIT = 20
#: A document is rejected if less than this share of its words is left.
LEFT = 0.3
MIN_WORDS = 50
MAX_REPEATED = 50
#: Frequent lines (8 bytes each) that are broadcast at most.
BROADCAST = 1 << 18

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")


def line_words(line: bytes) -> list[bytes]:
    return line.translate(_PLAIN).split()


def line_hash(host: str | None, words: list[bytes]) -> int:
    """60 bits of the md5 of host and normalised line."""
    head = b"n\n" if host is None else b"s" + host.encode() + b"\n"
    return int(hashlib.md5(head + b" ".join(words)).hexdigest()[:15], 16)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    v = len(seen)
    if v < 2_000_000:
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].reshape(-1)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum())


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                dup += 1
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def document_hash(text: bytes) -> int:
    """The digest of a document's raw text, as a signed 64-bit number."""
    return int.from_bytes(hashlib.md5(text).digest()[:8], "little", signed=True)


def line_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(line, documents): distinct documents of each host's line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", rows=5000):
            lines, told = [], []
            for t, h in zip(strings(batch.column("text")), batch.column("host").to_pylist(), strict=True):
                raw = t.encode()
                own = {line_hash(h, w) for x in raw.split(b"\n") if (w := line_words(x))}
                lines.extend(own)
                told.extend([document_hash(raw)] * len(own))
            yield pa.record_batch([pa.array(lines, pa.int64()), pa.array(told, pa.int64())], ["line", "document"])

    pairs = docs.select(F.col(text).alias("text"), F.col(host).alias("host")).mapInArrow(run, "line long, document long").distinct()
    return pairs.groupBy("line").agg(F.count("*").alias("documents"))


def _hot(frequent: DataFrame, most: int) -> list[int]:
    """Hashes of the most widespread lines, at most ``most``; those of one number of documents go together."""
    steps = frequent.groupBy(F.least("documents", F.lit(65_535)).alias("d")).agg(F.count("*").alias("n")).collect()
    steps = sorted(((r.d, r.n) for r in steps), reverse=True)
    total, least = 0, None
    for d, n in steps:
        total += n
        if total > most:
            break
        least = d
    return [] if least is None else [r.line for r in frequent.where(F.col("documents") >= least).select("line").collect()]


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: int = LIMIT, left: float = LEFT, broadcast: int = BROADCAST, clean: bool = False) -> DataFrame:
    """One row per document: doc_id, the base figures, base_failed, n_removed (words in removed lines), and kept.
    With ``clean``, the other columns of ``docs`` stay and ``text`` is without its removed lines."""
    spark = docs.sparkSession
    frequent = written(line_documents(docs, text, host).where(F.col("documents") > limit), "lines")
    hot = spark.sparkContext.broadcast(frozenset(_hot(frequent, broadcast)))
    whole = len(hot.value) == frequent.count()
    results = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed"]
    kinds = [f"{c} long" for c in results]

    def figures(batch: pa.RecordBatch, more: list[frozenset[int]] | None) -> tuple[list[tuple], list[str]]:
        gone, rows, texts = hot.value, [], []
        for i, (t, h) in enumerate(zip(strings(batch.column(text)), batch.column(host).to_pylist(), strict=True)):
            lines = t.encode().split(b"\n")
            stay, removed = [], 0
            for x in lines:
                words = line_words(x)
                if words and ((key := line_hash(h, words)) in gone or more is not None and key in more[i]):
                    removed += len(words)
                else:
                    stay.append(x)
            rows.append((*base(t), removed))
            texts.append(b"\n".join(stay).decode() if removed else t)
        return rows, texts

    keep = docs.drop(*results, "base_failed", "kept") if clean else docs.select(*dict.fromkeys([doc_id, text, host]))
    names = keep.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            more = None
            if "_gone" in batch.schema.names:
                more = [frozenset(x or ()) for x in batch.column("_gone").to_pylist()]
            rows, texts = figures(batch, more)
            columns = {c: batch.column(c) for c in names}
            columns[text] = pa.array(texts, pa.string()).cast(batch.schema.field(text).type)
            columns |= {c: pa.array(x, pa.int64()) for c, x in zip(results, zip(*rows, strict=True), strict=True)}
            yield pa.record_batch(list(columns.values()), list(columns))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema] + kinds)
    if whole:
        measured = keep.mapInArrow(finish, schema)
    else:
        # The frequent lines outside the broadcast ones meet the documents' lines by shuffle, then the documents.
        keyed = written(keep.mapInArrow(with_rows, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in keep.schema)}, _row long"), "rows")

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text):
                row, line = [], []
                for t, h, r in zip(strings(batch.column(text)), batch.column(host).to_pylist(), batch.column("_row").to_pylist(), strict=True):
                    own = {line_hash(h, w) for x in t.encode().split(b"\n") if (w := line_words(x))} - hot.value
                    line.extend(own)
                    row.extend([r] * len(own))
                yield pa.record_batch([pa.array(row, pa.int64()), pa.array(line, pa.int64())], ["_row", "line"])

        gone = keyed.select(*dict.fromkeys([text, host]), "_row").mapInArrow(lines, "_row long, line long").join(frequent.select("line"), "line")
        gone = gone.groupBy("_row").agg(F.collect_list("line").alias("_gone"))
        measured = keyed.join(gone, "_row", "left").drop("_row").mapInArrow(finish, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    measured = measured.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed") >= left * F.col("n_words")))
    return measured if clean else measured.select(F.col(doc_id).alias("doc_id"), *results, "base_failed", "kept")


def rules_sql(table: str = "documents", limit: int = LIMIT, left: float = LEFT) -> str:
    """The same figures as DuckDB SQL."""
    word = "[^\\x20\\x09-\\x0D]+"
    plain = "trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS host FROM {table}),
    w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT r, regexp_extract_all(text, '{word}') AS ws FROM d)),
    win AS (SELECT r, i, w || chr(10) || lead(w) OVER o || chr(10) || lead(w, 2) OVER o AS k FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win WHERE k IS NOT NULL) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
    ln AS (SELECT r, host, md5(text) AS document, unnest(string_split(text, chr(10))) AS line FROM d),
    lines AS (SELECT r, document, line, len(regexp_extract_all(line, '{word}')) AS n, ('0x' || substr(md5(host || chr(10) || {plain}), 1, 15))::BIGINT AS h FROM ln WHERE regexp_matches(line, '{word}')),
    told AS (SELECT DISTINCT h, document FROM lines),
    often AS (SELECT h FROM told GROUP BY h HAVING count(*) > {limit}),
    dup AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, (coalesce(sum(n) FILTER (WHERE h IN (FROM often)), 0))::BIGINT AS n_removed FROM lines GROUP BY r),
    m AS (SELECT d.doc_id, len(regexp_extract_all(text, '{word}'))::BIGINT AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed
      FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND n_words - n_removed >= {left} * n_words AS kept FROM b"""
