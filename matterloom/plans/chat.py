"""Chat examples and batches over the conversations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..functions.hashing import int_hash_sql
from ..operators import chat, splits
from . import query


def _whole(t):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    return t.conversations.groupBy("conv_id").agg(turns.alias("messages"))


@query(r"""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' END AS role, CASE WHEN role = 'user' THEN 2 ELSE 1 END AS parts, trim(text, ' ') AS content FROM conversations""")
def chat_convert(t):
    who = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt", "system", "system")))
    value = F.when(F.col("role") == "user", F.concat(F.lit("<image>\n"), "text")).otherwise(F.col("text"))
    one = t.conversations.select("conv_id", "turn", chat.converted(F.array(F.struct(who[F.col("role")].alias("from"), value.alias("value"))))[0].alias("m"))
    return one.select("conv_id", "turn", "m.role", F.size("m.content").alias("parts"), F.col("m.content")[0]["text"].alias("content"))


@query("""WITH u AS (SELECT conv_id, min(turn) AS first FROM conversations WHERE role = 'user' GROUP BY ALL)
  SELECT conv_id, turn, role, CASE WHEN turn = first THEN 'Write it.' ELSE text END AS text FROM conversations LEFT JOIN u USING (conv_id)""")
def zero_shot(t):
    changed = _whole(t).select("conv_id", F.posexplode(chat.with_prompt(F.col("messages"), "Write it.")).alias("k", "m"), "messages")
    return changed.select("conv_id", F.col("messages")[F.col("k")]["turn"].alias("turn"), "m.role", "m.text")


WORDS = r"len(list_filter(regexp_split_to_array(text, '[\s\x0b\x85\xa0\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]+'), lambda w: w <> ''))"


@query(f"SELECT conv_id, sum({WORDS})::BIGINT AS words FROM conversations GROUP BY ALL")
def conv_lengths(t):
    return _whole(t).select("conv_id", chat.word_length(F.transform("messages", lambda m: m["text"])).cast("long").alias("words"))


BATCHES = f"""WITH l AS (SELECT conv_id, sum({WORDS})::BIGINT AS words FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY {int_hash_sql("'9' || conv_id")}, conv_id) - 1 AS rank FROM l),
  m AS (SELECT *, rank // 40 AS mega FROM r), b AS (SELECT *, mega * 10 + (row_number() OVER (PARTITION BY mega ORDER BY words DESC, conv_id) - 1) // 4 AS batch FROM m)"""


@query(BATCHES + " SELECT conv_id, words, rank, mega, batch FROM b")
def length_batches(t):
    return splits.length_batches(conv_lengths(t), "conv_id", "words", 9, batch=4, mega=10)


@query(BATCHES + " SELECT conv_id, batch, max(words) OVER (PARTITION BY batch) AS width, words - 1 > 120 AS too_long FROM b")
def batch_padding(t):
    rows = length_batches(t).withColumn("ids", F.array_repeat(F.lit(7), F.col("words").cast("int")))
    return chat.padded(rows, "batch", "ids", 0, 120).select("conv_id", "batch", F.size("padded").cast("long").alias("width"), "too_long")


@query(r"""WITH w AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM conversations)
  SELECT conv_id, turn, list_sum(list_transform(ids, lambda x, i: CASE WHEN i <= 3 OR x = 0 THEN -100 ELSE x END))::BIGINT AS total, len(list_filter(ids, lambda x, i: i <= 3 OR x = 0)) AS masked FROM w""")
def label_mask(t):
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    rows = t.conversations.select("conv_id", "turn", chat.labels(ids, F.lit(3)).alias("labels"))
    return rows.select("conv_id", "turn", F.aggregate("labels", F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("masked"))


@query("""SELECT replace(source || '-' || lang || ' ' || doc_id || '-var_00001', ' ', '_') AS id, '```python' || chr(10) || text || chr(10) || '```' AS answer FROM documents""")
def chat_examples(t):
    data_id = fx.example_id(F.col("source"), F.concat("lang", F.lit(" "), "doc_id"), F.lit("var_00001"))
    made = t.documents.select(chat.example(data_id, F.lit("x.jpg"), F.lit("Write it"), F.col("text")).alias("e"))
    return made.select("e.id", F.col("e.conversations")[1]["value"].alias("answer"))
