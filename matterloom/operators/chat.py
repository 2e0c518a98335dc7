"""Chat examples: conversion, prompts, lengths, labels and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Role names of the two forms.
ROLES = {"human": "user", "gpt": "assistant", "system": "system"}


def example(data_id: Column, image: Column, prompt: Column, code: Column) -> Column:
    """A chat record of one question about an image and its answer in a fenced block."""
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.struct(data_id.alias("id"), image.alias("image"), F.array(turn("human", F.concat(F.lit("<image>\n"), prompt)), turn("gpt", F.concat(F.lit("```python\n"), code, F.lit("\n```")))).alias("conversations"))


def converted(conversations: Column) -> Column:
    """The role/content form of ``from``/``value`` messages: image marks become parts of their own, texts are trimmed (H19). An unknown role gives null in its place."""
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def one(m: Column) -> Column:
        text = F.trim(F.regexp_replace(m["value"], "<image>\n?", ""))
        content = F.when(m["value"].contains("<image>"), F.array(part("text", text), part("image", F.lit(None).cast("string")))).otherwise(F.array(part("text", text)))
        return F.struct(F.try_element_at(table, m["from"]).alias("role"), content.alias("content"))

    return F.transform(conversations, one)


def with_prompt(messages: Column, prompt: str) -> Column:
    """The first user message's text replaced by a prompt (H20); messages are structs of role and text."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), F.lit("user")) - 1
    return F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == first, F.lit(prompt)).otherwise(m["text"]).alias("text")))


def word_length(texts: Column) -> Column:
    """White-space words over all texts of a conversation."""
    words = lambda t: F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    return F.aggregate(texts, F.lit(0), lambda n, t: n + words(t))


def labels(ids: Column, prompt: Column, pad: int = 0, ignored: int = -100) -> Column:
    """Training labels: ids with the prompt and padding masked."""
    return F.transform(ids, lambda x, i: F.when((i < prompt) | (x == pad), F.lit(ignored)).otherwise(x))


def padded(rows: DataFrame, batch: str, ids: str, pad: int = 0, longest: int = 5120) -> DataFrame:
    """Ids of a batch padded to its longest, and whether a row is too long."""
    width = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return rows.withColumn("padded", F.concat(ids, F.array_repeat(F.lit(pad), width - F.size(ids)))).withColumn("too_long", F.size(ids) - 1 > longest)
