"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target in words. Whole passes over a source are taken as often as they fit; what remains is a
budget below the source's size. Documents are counted by exact length, and a plan says how many documents of each
length the budget takes: each length's share of all but a small part of it, and for that part
a bounded-knapsack dynamic program over lengths and their remaining counts, which comes as near the budget as it can.
The documents themselves are the seeded ones: in each length, those with the least hash of seed, doc_id and text, and of
a number for rows in which both are the same.

Plan: sizes and hashes are written once, without the texts, and counted by (source, length) with partial sums, so
that a hot source or length is reduced before it is dealt out. The plan of a source is made from its histogram of
lengths, in one task for each source. Which documents of a length are taken is settled by a cut through their hashes,
without a large group: a second histogram counts slices of the hash that hold about ``SLICE`` documents each, and
only the slice on the border is looked into. The decisions (one row for each length of a source) go to the documents by
broadcast if they are at most ``BROADCAST``, else by a join that adaptive execution can split.

Defined results: null or empty text has size 0 and is never taken; a null source is the last one; repeated rows keep
one result row each, and any of those with the same doc_id and text may be the ones taken; an empty table gives an empty result; a source of size 0 has
target 0; columns whose names clash with results are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_rows, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
SEED = 17
#: Documents that a slice of the hash should hold.
SLICE = 256
#: Words that the dynamic program is left at least.
ROOM = 4096
#: The dynamic program is given budgets up to this; what is above it is filled before.
EXACT = 1 << 17
#: Rows of a table of decisions that is broadcast at most.
BROADCAST = 200_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MAX_COPIES) -> list[float]:
    """Targets of sources in their order: ``share`` of all sizes by weight, at most ``most`` times a source's size, the
    excess dealt out by weight among the others until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, rest, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        full = [i for i in sorted(open_) if rest * w[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * w[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
            open_.discard(i)
        rest -= sum(out[i] for i in full)
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """How many documents of each length to take so that their sizes come to ``budget``, or as near as can be. Every
    length gets its share of the budget, rounded so that neighbouring lengths make up for each other, but for a small
    part that the dynamic program fills exactly. Of more than half of all, what stays out is fitted instead."""
    take = np.zeros(len(lengths), np.int64)
    counts = np.where(lengths > 0, counts, 0)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts
    if 2 * budget > total:
        return counts - fit(lengths, counts, total - budget, exact)
    usual = int(lengths[np.searchsorted(np.cumsum(lengths * counts), total * 0.95)])  # 95 % of all words are in texts no longer
    room = min(budget, exact // 2, max(ROOM, 2 * usual))
    order = np.argsort(lengths, kind="stable")
    shares = np.cumsum(counts[order].astype(float)) * ((budget - room) / total)
    take[order] = np.diff(np.floor(shares + 0.5), prepend=0).astype(np.int64)
    take = np.minimum(take, counts)
    rest = budget - int((lengths * take).sum())
    while rest < 0:  # very long texts that were rounded up
        have = np.flatnonzero(take)
        enough = have[lengths[have] >= -rest]
        i = enough[np.argmin(lengths[enough])] if len(enough) else have[np.argmax(lengths[have])]
        take[i] -= 1
        rest += int(lengths[i])
    for i in order[::-1]:  # or down
        if rest <= 2 * room:
            break
        more = min(int(counts[i] - take[i]), max(0, rest - room) // int(lengths[i]) if lengths[i] else 0)
        take[i] += more
        rest -= more * int(lengths[i])
    left = counts - take
    # First from a few times each length's share of the rest, so that no length fills it alone; from all of them if that misses.
    few = np.minimum(left, np.ceil(4 * left * (rest / max(1, int((lengths * left).sum())))).astype(np.int64) + 1)
    more = knapsack(lengths, few, rest, exact)
    if int((lengths * more).sum()) != rest:
        more = knapsack(lengths, left, rest, exact)
    return take + more


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """Bounded knapsack over sums up to a little above ``budget``: the nearest reachable sum, lower at a tie. One pass for
    each length: a sum is reached if, in steps of the length, a sum reached before is at most as many steps below it as
    there are documents. Lengths come in a seeded order, until the budget or the nearest sum that there can be is met."""
    take = np.zeros(len(lengths), np.int64)
    usable = np.flatnonzero((lengths > 0) & (counts > 0))
    if budget <= 0 or not len(usable):
        return take
    top = budget + min(budget, exact)  # a sum above the budget may be nearer
    first = np.full(top + 1, -1, np.int32)  # the length that first reached a sum
    steps = np.zeros(top + 1, np.int32)  # and how many of it that took
    reached = np.zeros(top + 1, bool)
    reached[0] = True
    unit = int(np.gcd.reduce(lengths[usable]))
    nearest = (2 * budget + unit - 1) // (2 * unit) * unit
    nearest -= unit if nearest > top else 0
    for i in usable[np.argsort((lengths[usable] * 0x9E3779B1) & 0xFFFFFFFF, kind="stable")]:
        size, left = int(lengths[i]), int(counts[i])
        if size > top:
            continue
        rows = -(-(top + 1) // size)
        grid = np.zeros(rows * size, bool)
        grid[: top + 1] = reached
        grid = grid.reshape(rows, size)
        row = np.arange(rows, dtype=np.int32)[:, None]
        gap = row - np.maximum.accumulate(np.where(grid, row, np.int32(-(2**30))), axis=0)
        new = (~grid & (gap <= left)).reshape(-1)[: top + 1]
        first[new] = i
        steps[new] = gap.reshape(-1)[: top + 1][new]
        reached |= new
        if reached[nearest]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.argmin(np.abs(sums - budget) * 2 + (sums > budget))])
    while at > 0:
        i, n = first[at], int(steps[at])
        take[i] += n
        at -= n * int(lengths[i])
    return take


def _near(table: DataFrame, most: int) -> DataFrame:
    """A hint to broadcast a table that has been counted and is small."""
    return F.broadcast(table) if table.count() <= most else table


def _told_apart(docs: DataFrame, doc_id: str, text: str, seed: int, broadcast: int) -> DataFrame:
    """``docs``, with a column ``_copy`` that numbers rows of the same doc_id and text, if there are such. The numbers come
    from counts for each task of the table, so rows that are all alike never meet in one task."""
    told = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text)).alias("_told")
    again = written(docs.select(told).groupBy("_told").agg(F.count("*").alias("n")).where("n > 1").select("_told"), "again")
    if again.isEmpty():
        return docs
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    keyed = written(docs.mapInArrow(with_rows, f"{schema}, _row long"), "rows")
    rows = keyed.select(told, "_row", F.shiftright("_row", 40).alias("_task")).join(_near(again, broadcast), "_told")
    tasks = rows.groupBy("_told", "_task").agg(F.count("*").alias("n"))
    before = (F.sum("n").over(Window.partitionBy("_told").orderBy("_task")) - F.col("n")).alias("before")
    number = F.row_number().over(Window.partitionBy("_told", "_task").orderBy("_row")) - 1
    copies = rows.withColumn("number", number).join(tasks.select("_told", "_task", before), ["_told", "_task"])
    copies = written(copies.select("_row", (F.col("before") + F.col("number")).alias("_copy")).where("_copy > 0"), "copies")
    return keyed.join(_near(copies, broadcast), "_row", "left").drop("_row")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MAX_COPIES, seed: int = SEED, broadcast: int = BROADCAST, keep: bool = False
) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted). With ``keep``, the columns of ``docs``, and
    ``copies``, how often the mix takes the document."""
    docs = _told_apart(docs, doc_id, text, seed, broadcast)
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    hashed = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text))
    if "_copy" in docs.columns:
        hashed = F.when(F.col("_copy") > 0, F.xxhash64(hashed, "_copy")).otherwise(hashed)
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), words.alias("_size"), key.alias("_key"), F.col(source).alias("_source"), hashed.alias("_hash")), "sizes")

    by_length = written(sized.groupBy("_key", "_size").agg(F.count("*").alias("_n"), F.max("_source").alias("_source")), "lengths")
    by_source = by_length.groupBy("_key").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"), F.max("_source").alias("_source"))

    def aim(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [None if pd.isna(x) else x for x in pdf["_source"]]
        order = sorted(range(len(pdf)), key=lambda i: (names[i] is None, names[i] or ""))
        got = targets([int(pdf["source_size"][i]) for i in order], weights, share, most)
        return pd.DataFrame({"_key": [pdf["_key"][i] for i in order], "source_size": [pdf["source_size"][i] for i in order], "target": got})

    # One row for each source: their shares depend on one another.
    aimed = by_source.groupBy().applyInPandas(aim, "_key string, source_size long, target double")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_size", ignore_index=True)
        whole, target = int(pdf["source_size"][0]), float(pdf["target"][0])
        passes = min(most, int(target // whole)) if whole else 0
        extra = np.zeros(len(pdf), np.int64)
        if passes < most and whole:
            extra = fit(pdf["_size"].to_numpy(np.int64), pdf["_n"].to_numpy(np.int64), round(target) - passes * whole)
        return pdf.assign(_passes=passes, _extra=extra)[["_key", "_size", "_n", "source_size", "target", "_passes", "_extra"]]

    chosen = by_length.drop("_source").join(aimed, "_key").groupBy("_key").applyInPandas(choose, "_key string, _size long, _n long, source_size long, target double, _passes int, _extra long")
    plan = written(chosen.withColumn("_slices", F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("_n") / SLICE, F.lit(1.0))))).cast("long")), "plan")

    # Lengths of which some documents but not all are taken: find the slice on the border, and the hash in it.
    on = ["_key", "_size"]
    slice_ = F.pmod(F.shiftright("_hash", 20), F.col("_slices"))
    partly = plan.where((F.col("_extra") > 0) & (F.col("_extra") < F.col("_n"))).select(*on, "_extra", "_slices")
    some = sized.select(*on, "_hash").join(_near(partly, broadcast), on).withColumn("_slice", slice_)
    counts = some.groupBy(*on, "_slice").agg(F.count("*").alias("_in"), F.max("_extra").alias("_extra"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*on).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_part", F.col("_extra") - before)
    border = written(counts.where((F.col("_part") > 0) & (F.col("_part") <= F.col("_in"))).select(*on, F.col("_slice").alias("_border"), "_part"), "border")
    inside = some.join(_near(border, broadcast), on).where("_slice = _border")
    cuts = inside.groupBy(*on).agg(F.max("_border").alias("_border"), F.element_at(F.array_sort(F.collect_list("_hash")), F.max("_part").cast("int")).alias("_cut"))
    decided = written(plan.join(cuts, on, "left"), "decided")

    taken = F.when(F.col("_extra") == F.col("_n"), 1).when((slice_ < F.col("_border")) | ((slice_ == F.col("_border")) & (F.col("_hash") <= F.col("_cut"))), 1).otherwise(0)
    copies = F.when(F.col("_size") > 0, F.col("_passes") + taken).otherwise(0).cast("int")
    if keep:
        names = [c for c in docs.columns if c not in ("copies", "_copy")]
        rows = docs.select(*names, words.alias("_size"), key.alias("_key"), hashed.alias("_hash"))
        return rows.join(_near(decided, broadcast), on).select(*names, copies.alias("copies"))
    rows = sized.join(_near(decided, broadcast), on)
    return rows.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies).alias("taken"))
