"""Leak filters and greedy near-duplicate removal."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..sources.shared import drop, written
from . import tiles, vision
from .vision import similar_pairs

#: References that are broadcast at most; more go in blocks of this size, each against all candidates.
BLOCK = 50_000
#: Pairs of one tile, and values that are compared at once.
PAIRS = 1 << 20
#: What sums of doubles may be off by.
ROUNDING = 1e-9
#: Bytes of an image that is compared in blocks.
SMALL = 4_096
#: Weight of the wave of thrice the speed, and what (1 - cos u + THIRD * (1 - cos 3u)) / u is at most.
THIRD, STEEPEST = 0.15, 0.7754
#: Held-out grams that are broadcast at most.
GRAMS = 1_000_000
#: Bytes of a block of pixels at most; rows beyond which blocks are smaller, for as many tasks; blocks that this makes at most.
BYTES, FEW, SPREAD = 16 << 20, 1_024, 8
#: Pairs that are gone through in one task at most.
TAIL = 200_000
#: Trials of a case that are settled in one task at most, and at least if there are few; tasks that small cases share.
BATCH, LEAST, BUCKETS = 4_096, 512, 256


def _nearest(mine: np.ndarray, table: np.ndarray, ids: np.ndarray, limit: float, waves: tuple[float, float, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``mine`` the least mean absolute difference to a row of ``table`` if it is at most ``limit`` (else infinity), and the
    place of the row that has it, by the least id.

    Waves bound a difference from below: height * (1 - cos(u) + THIRD * (1 - cos(3 u))) with u = speed * d is at most |d| for all d. Their
    sum over a pair's values is a matrix product of cosines and sines. Only pairs whose bound reaches the least difference found so far are counted by their values."""
    speed, height, theirs = waves
    size = mine.shape[1]
    best, place = np.full(len(mine), np.inf), np.zeros(len(mine), np.int64)
    own = _waves(mine, speed, theirs.dtype)
    # What the products may be off by.
    slack = 2 * size * (4 * size + 16) * float(np.finfo(theirs.dtype).eps) + ROUNDING * size
    start, width = 0, 64
    while start < len(table):
        end = min(len(table), start + width)
        step = max(1, PAIRS // (end - start))
        for low in range(0, len(mine), step):
            # In sums of cosines, of which those count that are at least so much.
            least = (1 + THIRD) * size - np.minimum(best[low : low + step], limit) * (1 + ROUNDING) * size / height - slack
            r, c = np.nonzero(own[low : low + step] @ theirs[start:end].T >= least.astype(theirs.dtype)[:, None])
            r, c = r + low, c + start
            for k in range(0, len(r), max(1, PAIRS // size)):
                p, q = r[k : k + max(1, PAIRS // size)], c[k : k + max(1, PAIRS // size)]
                apart = np.abs(table[q] - mine[p]).mean(1)
                good = apart <= np.minimum(best[p], limit)
                p, q, apart = p[good], q[good], apart[good]
                order = np.lexsort((ids[q], apart, p))
                p, q, apart = p[order], q[order], apart[order]
                first = np.flatnonzero(np.diff(p, prepend=-1))
                p, q, apart = p[first], q[first], apart[first]
                better = (apart < best[p]) | (ids[q] < ids[place[p]])
                best[p[better]], place[p[better]] = apart[better], q[better]
        # The first narrow tiles find bounds, which leave little of the wider ones.
        start, width = end, min(2 * width, 8_192)
    return best, place


def _waves(x: np.ndarray, speed: float, kind: np.dtype) -> np.ndarray:
    u = speed * x
    return np.concatenate([np.cos(u), np.sin(u), THIRD**0.5 * np.cos(3 * u), THIRD**0.5 * np.sin(3 * u)], axis=1).astype(kind)


def _speed(table: np.ndarray) -> tuple[float, float]:
    """The speed of the waves that suits how far apart rows are, and their height: the most that keeps them below |d|, by their
    steepest line through 0."""
    apart = float(np.sqrt(2 * np.nanmean(np.nanvar(table, axis=0)))) if table.size else 0.0
    speed = 1.55 / apart if np.isfinite(apart) and apart > 0 else 1.0
    return speed, 1 / (STEEPEST * speed)


def leaks(candidates: DataFrame, references: DataFrame, key: str, vector: str, limit: float) -> DataFrame:
    """Candidates whose mean absolute difference to a held-out reference is at most ``limit``, with the nearest one (C5). The
    held-out references are the stated query set: they are broadcast in blocks, and every candidate is held against all of them in tiles
    (see :func:`_nearest`)."""
    n = references.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for k in range(blocks):
        block = references if blocks == 1 else references.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
        rows = [r for r in block.select(key, vector).collect() if r[1] is not None]
        kept = candidates.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)))

        def nearest(batches: Iterator[pd.DataFrame], kept=kept) -> Iterator[pd.DataFrame]:
            ids, table = kept.value
            ids, waves = pd.Series(ids).to_numpy(), None
            for pdf in batches:
                pdf = pdf[pdf[vector].notna()]
                if not len(ids) or not len(pdf):
                    continue
                if waves is None:
                    speed, height = _speed(table)
                    waves = speed, height, _waves(table, speed, np.dtype(np.float32 if table.shape[1] <= 1024 else np.float64))
                mine = np.stack([np.asarray(v, np.float64) for v in pdf[vector]])
                best, place = _nearest(mine, table, ids, limit, waves)
                hit = np.isfinite(best)
                yield pd.DataFrame({key: pdf[key].to_numpy()[hit], "nearest": ids[place[hit]], "distance": best[hit]})

        kind = candidates.schema[key].dataType.simpleString()
        hits = candidates.select(key, vector).mapInPandas(nearest, f"{key} {kind}, nearest {kind}, distance double")
        out = hits if out is None else out.unionByName(hits)
    if blocks > 1:
        out = out.groupBy(key).agg(F.min_by("nearest", F.struct("distance", "nearest")).alias("nearest"), F.min("distance").alias("distance"))
    return out.withColumn("distance", F.round("distance", 6))


def image_leaks(candidates: DataFrame, references: DataFrame, key: str, vector: str, similarity: float, limit: float) -> DataFrame:
    """Candidates that leak a held-out reference (C5): of the references whose structural similarity is at least ``similarity``, the
    nearest by the mean absolute difference of ``vector`` (a perceptual descriptor) is within ``limit``; with that reference, its
    distance, and how many references are similar. Images have height, width and data; a null vector is near nothing."""
    small = F.length("data") <= SMALL
    out = _small_leaks(candidates.where(small), references.where(small), key, vector, similarity)
    if candidates.where(~small).take(1) and references.where(~small).take(1):
        similar = similar_pairs(candidates.where(~small), references.where(~small), key, similarity)[2]
        of = lambda rows, name, v: rows.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias(v))
        pairs = similar.join(of(candidates, "a", "v"), "a").join(of(references, "b", "w"), "b")
        apart = F.aggregate(F.zip_with("v", "w", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("v")
        out = out.unionByName(pairs.select(F.col("a").alias(key), F.col("b").alias("nearest"), apart.alias("distance"), F.lit(1).cast("long").alias("similar")))
    nearest = out.groupBy(key).agg(
        F.min_by("nearest", F.when(F.col("distance").isNotNull(), F.struct("distance", "nearest"))).alias("nearest"), F.round(F.min("distance"), 6).alias("distance"), F.sum("similar").alias("similar"), F.min("distance").alias("_exact")
    )
    return nearest.where(F.col("_exact") <= limit).drop("_exact")


def _small_leaks(candidates: DataFrame, references: DataFrame, key: str, vector: str, similarity: float) -> DataFrame:
    """(key, nearest, distance, similar) of images of few pixels, a row for each block of references that has similar ones. To
    compare such images costs no more than a bound does, so blocks of either side meet, and all their pairs are compared at once in a task."""
    kind = candidates.schema[key].dataType
    image = lambda rows, ref: rows.select(F.col(key).alias("id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "data", F.length("data").alias("n"), F.col(vector).cast("array<double>").alias("v"), F.lit(ref).alias("_ref"))
    mine, theirs, shape = image(candidates, False), image(references, True), ["height", "width", "n"]
    sizes = mine.groupBy(*shape).agg(F.count("*").alias("_rows")).join(theirs.groupBy(*shape).agg(F.count("*").alias("_held")), shape)
    blocks = sizes.select(*shape, _parts(F.col("_rows"), F.col("n"), 1).alias("_i"), _parts(F.col("_held"), F.col("n"), 1).alias("_j"))
    own = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = mine.join(F.broadcast(blocks), shape).withColumns({"i": own("_i"), "j": every("_j")}).drop("_i", "_j")
    right = theirs.join(F.broadcast(blocks), shape).withColumns({"i": every("_i"), "j": own("_j")}).drop("_i", "_j")

    def compared(tile: pa.Table) -> pa.Table:
        ids, ref = tile["id"].combine_chunks(), tile["_ref"].to_numpy()
        height, width = tile["height"][0].as_py(), tile["width"][0].as_py()
        images = np.stack([vision.pixels(height, width, x) for x in tile["data"].to_pylist()])
        vectors = [None if v is None else np.array([np.nan if z is None else z for z in v], np.float64) for v in tile["v"].to_pylist()]
        lengths = np.array([-1 if v is None else len(v) for v in vectors])
        values = np.full((len(vectors), max(1, lengths.max())), 0.0)
        for at, v in enumerate(vectors):
            if v is not None:
                values[at, : len(v)] = v
        a, b = np.flatnonzero(~ref), np.flatnonzero(ref)
        # By the order of ids, so that of equal distances the least id is the first found.
        b = b[pc.sort_indices(ids.take(pa.array(b))).to_numpy()]
        similar, best, place = np.zeros(len(a), np.int64), np.full(len(a), np.inf), np.zeros(len(a), np.int64)
        for low, j, value in vision.ssim_table(images[a], images[b]):
            at = low + np.flatnonzero(value >= similarity)
            similar[at] += 1
            at = at[lengths[a[at]] == lengths[b[j]]] if lengths[b[j]] > 0 else at[:0]
            apart = np.abs(values[a[at]] - values[b[j]]).sum(1) / lengths[b[j]]
            at, apart = at[apart < best[at]], apart[apart < best[at]]
            best[at], place[at] = apart, b[j]
        hit, known = similar > 0, np.isfinite(best)
        nearest = ids.take(pa.array(place[hit], mask=~known[hit]))
        return pa.table({key: ids.take(pa.array(a[hit])), "nearest": nearest, "distance": pa.array(best[hit], mask=~known[hit]), "similar": similar[hit]})

    out = StructType([StructField(key, kind), StructField("nearest", kind), StructField("distance", DoubleType()), StructField("similar", LongType())])
    return left.unionByName(right).groupBy(*shape, "i", "j").applyInArrow(compared, out)


def text_leaks(documents: DataFrame, held_out: DataFrame, n: int) -> DataFrame:
    """Documents that share word n-grams with held-out items: how many grams, and items (C5 on texts). Words are runs of letters of any
    alphabet, in lower case; grams are 64-bit hashes, so a broadcast of ``GRAMS`` is some 24 MB. The held-out grams are broadcast up to ``GRAMS``, so of the documents only grams that hit leave a task; beyond that both sides are shuffled."""

    def grams(rows: DataFrame, key: str) -> DataFrame:
        words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
        rows = rows.select(key, words.alias("w")).where(F.size("w") >= n)
        return rows.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " ")))).alias("g"))

    items = grams(held_out, "item_id").distinct()
    few = items.limit(GRAMS + 1).count() <= GRAMS
    hits = grams(documents, "doc_id").join(F.broadcast(items) if few else items, "g")
    return hits.groupBy("doc_id").agg(F.countDistinct("g").alias("shared"), F.countDistinct("item_id").alias("items"))


def _whole(rows: DataFrame, channels: int) -> DataFrame:
    """``rows`` with the number of their pixels, and the values of whole pixels as doubles; rows without a pixel are left out."""
    pixels, n = F.col("pixels").cast("array<double>"), F.floor(F.size("pixels") / channels).cast("int")
    return rows.where(F.size("pixels") >= channels).withColumns({"n": n, "pixels": F.slice(pixels, F.lit(1), n * channels) if channels > 1 else pixels})


def _parts(rows: Column, n: Column, channels: int) -> Column:
    """Into how many blocks so many rows of ``n`` pixels go: of ``BYTES`` at most, and several if there are more than ``FEW``."""
    return F.greatest(F.ceil(rows * n * (8 * channels) / BYTES), F.least(F.ceil(rows / FEW), F.lit(SPREAD))).cast("int")


def pixel_pairs(rows: DataFrame, threshold: float, share: float, channels: int = 1) -> DataFrame:
    """(a, b, same): rows a < b of which more than ``share`` of the pixels differ by at most ``threshold`` in every channel, and how many
    do (C6).

    Rows of one number of pixels are dealt into blocks by a hash, and each two blocks are a tile, whose pairs are all counted in one
    task (see :mod:`.tiles`). A row is sent once to each block; blocks are bounded by bytes."""
    whole = _whole(rows.select("id", "pixels"), channels)
    blocks = whole.groupBy("n").agg(F.count("*").alias("_rows")).select("n", _parts(F.col("_rows"), F.col("n"), channels).alias("_blocks"))
    whole = whole.join(F.broadcast(blocks), "n").withColumn("k", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = whole.select("id", "pixels", "n", "k", other.alias("o")).select("id", "pixels", "n", "k", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"))
    kind = rows.schema["id"].dataType

    def compared(tile: pa.Table) -> pa.Table:
        i, j, k = tile["i"][0].as_py(), tile["j"][0].as_py(), tile["k"].to_numpy()
        x, ids = tiles.table(tile), tile["id"].combine_chunks()
        left, right = np.flatnonzero(k == i), np.flatnonzero(k == j)
        found = [(left[p], right[q], same) for p, q, same in tiles.pairs(x[left], x[right], threshold, share, channels)]
        a, b, same = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
        if i == j:
            a, b, same = a[a < b], b[a < b], same[a < b]
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "same": pa.array(same, pa.int32())})

    out = StructType([StructField("a", kind), StructField("b", kind), StructField("same", IntegerType())])
    found = dealt.groupBy("n", "i", "j").applyInArrow(compared, out)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "same")


def greedy(rows: DataFrame, threshold: float, share: float, channels: int = 1) -> DataFrame:
    """The ids that stay (E6): in id order, a row whose most similar kept row is a duplicate replaces it if its ``cost`` is less, else
    goes; equal similarities mean the earlier one. ``cost`` is a number, a missing one counts as the largest."""
    pairs = pixel_pairs(rows, threshold, share, channels)
    stays = settled(rows.select("id", F.coalesce(F.col("cost").cast("double"), F.lit(float("inf"))).alias("cost")), pairs)
    return stays.where("stays").select("id")


def settled(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, stays, replaced_by): the outcome of taking ``rows`` (id, cost) one after the other, each held against the rows before it that
    are kept and linked to it by ``pairs`` (a < b, same); see :func:`greedy`.

    Settled by joins over the pairs, in rounds, without a group of linked rows in one task. Of an undecided row k and an earlier
    linked row b: b *may* be kept when k comes unless it went or was replaced before k; it *is* for sure if besides no cheaper
    row between them, linked to b, may still replace it. So k is in, if all that may be kept are dearer; out, if one is kept for
    sure and none that may be kept is dearer; and all is known, also which row it replaces, once each that may be kept is for
    sure. What is known is taken out of the pairs, and each round is written. The least undecided row is always settled, so
    it ends; a round settles all rows whose earlier links are, so rounds are as many as the longest chain of rows that hang on
    each other, not as rows. Chains are long where few pairs are left, so at most ``TAIL`` of them are gone through in turn instead."""
    cost = rows.select("id", "cost")
    pairs = pairs.join(cost.toDF("a", "cost_a"), "a").join(cost.toDF("b", "cost_b"), "b")
    live = written(pairs, "pairs")
    linked = live.select(F.col("b").alias("id")).unionByName(live.select(F.col("a").alias("id"))).distinct()
    # kept: whether the row got in (null: not known yet); known: whether it is also known which row it replaced.
    states = written(linked.select("id", F.lit(None).cast("boolean").alias("kept"), F.lit(False).alias("known"), F.lit(None).cast(rows.schema["id"].dataType).alias("gone")), "states")
    while True:
        if live.count() <= TAIL:
            after = _in_turn(live, states)
            drop(states)
            states = after
            break
        # The first row that may yet replace b: cheaper, and its own replacement not known.
        open_rows = states.where("NOT known").select(F.col("id").alias("b"))
        waits = live.where("cost_b < cost_a").join(open_rows, "b").groupBy("a").agg(F.min("b").alias("wait"))
        before = states.select(F.col("id").alias("a"), "kept", "gone").join(waits, "a", "left")
        may = live.join(before, "a").where("coalesce(kept, true) AND (gone IS NULL OR gone > b)")
        may = may.withColumn("sure", F.coalesce(F.col("kept"), F.lit(False)) & (F.col("wait").isNull() | (F.col("wait") >= F.col("b"))))
        best = F.min_by(F.struct("a", "cost_a"), F.struct((-F.col("same")).alias("s"), "a"))
        of = may.groupBy(F.col("b").alias("id")).agg(
            F.every("sure").alias("all_sure"),
            F.some("sure").alias("some_sure"),
            F.every(F.col("cost_a") > F.col("cost_b")).alias("dearer"),
            F.every(F.col("cost_a") <= F.col("cost_b")).alias("cheaper"),
            best.alias("best"),
            F.first("cost_b").alias("cost_b"),
        )
        met = states.join(of, "id", "left")
        alone = F.col("best").isNull()
        replaces = F.col("all_sure") & (F.col("best.cost_a") > F.col("cost_b"))
        kept = F.when(alone | F.col("dearer"), True).when(F.col("some_sure") & F.col("cheaper"), False).when(F.col("all_sure"), replaces)
        known = alone | F.col("all_sure") | (F.col("some_sure") & F.col("cheaper"))
        met = met.select("id", F.coalesce("kept", kept).alias("kept"), (F.col("known") | F.coalesce(known, F.lit(False))).alias("known"), "gone", F.when(~F.col("known") & replaces, F.col("best.a")).alias("replaced"))
        met = written(met, "met")
        gone = met.where("replaced IS NOT NULL").groupBy(F.col("replaced").alias("id")).agg(F.min("id").alias("by"))
        after = written(met.join(gone, "id", "left").select("id", "kept", "known", F.least("gone", "by").alias("gone")), "states")
        drop(states, met)
        states = after
        if not states.where("NOT known").take(1):
            break
        # Pairs whose later row is settled tell no more; nor do those whose earlier row is out, or gone before the later came.
        done = states.where("known").select(F.col("id").alias("b"))
        out = states.where("NOT kept OR gone IS NOT NULL").select(F.col("id").alias("a"), F.when(F.col("kept"), F.col("gone")).alias("until"))
        left = live.join(done, "b", "left_anti").join(out, "a", "left").join(states.where("NOT kept").select(F.col("id").alias("a")), "a", "left_anti").where("until IS NULL OR until > b").drop("until")
        fewer = written(left, "pairs")
        drop(live)
        live = fewer
    drop(live)
    return rows.select("id").join(states, "id", "left").select("id", (F.coalesce("kept", F.lit(True)) & F.col("gone").isNull()).alias("stays"), F.col("gone").alias("replaced_by"))


def _in_turn(live: DataFrame, states: DataFrame) -> DataFrame:
    """``states`` with what the remaining pairs settle: rows that are not known yet, one after the other, against those that are kept then."""
    kind = states.schema["id"].dataType

    def turns(rest: pa.Table) -> pa.Table:
        columns = [rest[c].to_pylist() for c in ("b", "a", "same", "cost_a", "cost_b", "kept", "known", "gone")]
        kept, gone, undecided, found = {}, {}, {}, []
        for b, a, same, cost_a, cost_b, is_kept, is_known, until in zip(*columns, strict=True):
            kept[a], gone[a] = bool(is_kept) and is_known, until
            undecided.setdefault(b, (cost_b, []))[1].append((-same, a, cost_a))
            if not is_known:
                # A row without an earlier link that is left stays in, and replaces none.
                undecided.setdefault(a, (cost_a, []))
        for b in sorted(undecided):
            cost, earlier = undecided[b]
            here = [x for x in earlier if kept[x[1]] and (gone[x[1]] is None or gone[x[1]] > b)]
            best = min(here, default=None, key=lambda x: x[:2])
            kept[b] = best is None or cost < best[2]
            if best is not None and kept[b]:
                gone[best[1]] = b
            found.append(b)
        ids = list({**dict.fromkeys(found), **dict.fromkeys(kept)})
        return pa.table({"id": pa.array(ids, rest.schema.field("a").type), "_kept": pa.array([kept[x] if x in undecided else None for x in ids], pa.bool_()), "_gone": pa.array([gone.get(x) for x in ids], rest.schema.field("a").type)})

    rest = live.join(states.select(F.col("id").alias("a"), "kept", "known", "gone"), "a")
    settled_rows = rest.groupBy(F.lit(0).alias("_all")).applyInArrow(turns, StructType([StructField("id", kind), StructField("_kept", BooleanType()), StructField("_gone", kind)]))
    met = states.join(settled_rows, "id", "left")
    # A row that none of the remaining pairs names as the later one stays in, unless it is known.
    kept = F.coalesce("_kept", F.when(F.col("known"), F.col("kept")).otherwise(True))
    return written(met.select("id", kept.alias("kept"), F.lit(True).alias("known"), F.least("gone", "_gone").alias("gone")), "states")


def accept_new(trials: DataFrame, threshold: float, share: float, channels: int = 1) -> DataFrame:
    """(case_id, trial_id): within each case, trials in order that are no near-duplicate of an accepted one (E5)."""
    passed = cascade(trials, None, F.lit(None).cast("string"), F.lit(None).cast("string"), threshold, share, channels)
    return passed.where("reason IS NULL").select("case_id", "trial_id")


#: Fixed value: the reason of a duplicate.
DUPLICATE = "Duplicate image detected"


def cascade(trials: DataFrame, truths: DataFrame | None, before: Column, after: Column, threshold: float, share: float, channels: int = 1) -> DataFrame:
    """(case_id, trial_id, reason): the first gate that a generated program fails (B16), null if it is accepted. ``before`` and ``after`` are the
    reasons of the gates before and behind the one on duplicates, null where they pass. A trial is a duplicate if its pixels are
    nearly those of one of its case's ``truths`` (case_id, pixels), or of an *accepted* trial of its case with a smaller number; one that
    fails any gate stands in nobody's way.

    Only trials that pass the gates before are compared. First all are held against the truths. Those that may be accepted are then
    settled in rounds: each case's next batch (a bounded number of trials) is gone through in order in one task, and the trials behind it are held
    against what the batch accepted. A duplicate goes with its round, so what is kept in between is bounded by the trials, not by the pairs of
    like ones; rounds are as many as the batches of what is left of the largest case."""
    marked = trials.withColumns({"_before": before, "_after": after, "_number": F.col("trial_id").cast("long")})
    free = _whole(marked.where("_before IS NULL AND case_id IS NOT NULL").select("case_id", F.col("_number").alias("trial_id"), "pixels", F.col("_after").isNull().alias("may")), channels)
    free = written(free, "free")
    keys, near = ["case_id", "trial_id"], lambda rows, held: _held(rows, held, threshold, share, channels)
    out = []
    if truths is not None:
        # Before all trials; copies of a truth tell no more.
        real = _whole(truths.where("case_id IS NOT NULL").select("case_id", F.lit(None).cast("long").alias("trial_id"), "pixels"), channels).distinct()
        out.append(written(near(free, real), "like-truth"))
    left = free.where("may").drop("may")
    left, accepted = written(left.join(out[0], keys, "left_anti") if out else left, "left"), []
    size = max(LEAST, min(BATCH, left.count() // 64))
    while left.take(1):
        # The number up to which a case's batch goes: the greatest of the halves, quarters and so on that hold few enough.
        halves = [0.5**k for k in range(1, 31)]
        cuts = left.groupBy("case_id").agg(F.count("*").alias("_n"), F.max("n").alias("_most"), F.max("trial_id").alias("_last"), F.percentile_approx("trial_id", halves, 10_000).alias("_halves"))
        most = F.greatest(F.lit(64), F.least(F.lit(size), F.floor(BYTES / (F.col("_most") * (8 * channels)))))
        cut = F.when(F.col("_n") <= most, F.col("_last")).otherwise(F.element_at("_halves", F.least(F.ceil(F.log2(F.col("_n") / most)), F.lit(30)).cast("int")))
        cuts = written(cuts.select("case_id", cut.alias("_cut")), "cuts")
        met = left.join(cuts, "case_id")
        batch = met.where(F.col("trial_id") <= F.col("_cut")).drop("_cut")
        new = written(_settled_batch(batch, threshold, share, channels), "accepted")
        behind = written(met.where(F.col("trial_id") > F.col("_cut")).drop("_cut"), "behind")
        rest = written(behind.join(near(behind, new), keys, "left_anti"), "left")
        accepted.append(new)
        drop(left, behind, cuts)
        left = rest
    drop(left)
    chosen = reduce(DataFrame.unionByName, accepted) if accepted else free.drop("may").limit(0)
    # Those that fail a gate behind are held against all that were accepted; those that may be accepted and were not are duplicates.
    twice = near(free.where("NOT may"), chosen).unionByName(free.where("may").select(*keys).join(chosen.select(*keys), keys, "left_anti"))
    twice = reduce(DataFrame.unionByName, [twice, *out]).distinct().select("case_id", F.col("trial_id").alias("_number"), F.lit(DUPLICATE).alias("_twice"))
    return marked.join(twice, ["case_id", "_number"], "left").select("case_id", "trial_id", F.coalesce("_before", "_twice", "_after").alias("reason"))


def _by_case(tile: pa.Table) -> Iterator[np.ndarray]:
    """The places of the rows of each case and number of pixels in a table that may hold several."""
    codes = tile["case_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    _, at = np.unique(np.stack([codes, tile["n"].to_numpy()]), axis=1, return_inverse=True)
    order = np.argsort(at.reshape(-1), kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(at.reshape(-1)[order])) + 1)


def _settled_batch(batch: DataFrame, threshold: float, share: float, channels: int) -> DataFrame:
    """Of each case's trials, taken in order, those that are near no earlier one that was taken."""
    columns = batch.columns

    def settled_cases(tile: pa.Table) -> pa.Table:
        numbers, kept = tile["trial_id"].to_numpy(), []
        for rows in _by_case(tile):
            rows = rows[np.argsort(numbers[rows], kind="stable")]
            kept.append(rows[tiles.taken(tiles.table(tile.take(pa.array(rows))), threshold, share, channels)])
        return tile.take(pa.array(np.concatenate(kept))).select(columns)

    group = F.pmod(F.xxhash64("case_id"), F.lit(BUCKETS))
    return batch.withColumn("_group", group).groupBy("_group").applyInArrow(settled_cases, batch.schema)


def _held(rows: DataFrame, held: DataFrame, threshold: float, share: float, channels: int) -> DataFrame:
    """(case_id, trial_id) of the rows that are near one of ``held`` of their case with a smaller number, or with none.

    Either side is dealt into blocks of bounded size within a case and number of pixels; a row meets each block of the other side
    in one task. Small cases share tasks."""
    keys, kind = ["case_id", "n"], rows.schema["case_id"].dataType
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows")).join(held.groupBy(*keys).agg(F.count("*").alias("_held")), keys)
    blocks = sizes.select(*keys, _parts(F.col("_rows"), F.col("n"), channels).alias("_i"), _parts(F.col("_held"), F.col("n"), channels).alias("_j"))

    def dealt(side: DataFrame, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64("trial_id", F.slice("pixels", 1, 8)), F.col(mine)).cast("int")
        meets = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        whole = F.xxhash64(*keys)
        group = F.when((F.col(mine) == 1) & (F.col(other) == 1), F.pmod(whole, F.lit(BUCKETS))).otherwise(whole)
        met = side.select(*keys, "trial_id", "pixels").join(blocks, keys).withColumns({"_own": own, "_group": group, "_ref": F.lit(mine == "_j")}).withColumn("_meets", meets)
        place = [F.col("_own").alias("i"), F.col("_meets").alias("j")] if mine == "_i" else [F.col("_meets").alias("i"), F.col("_own").alias("j")]
        return met.select("_group", *place, "_ref", *keys, "trial_id", "pixels")

    def compared(tile: pa.Table) -> pa.Table:
        ref, found = tile["_ref"].to_numpy(), []
        numbers = tile["trial_id"].cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
        for mine in _by_case(tile):
            left, right = mine[~ref[mine]], mine[ref[mine]]
            if len(left) and len(right):
                x = tiles.table(tile.take(pa.array(np.concatenate([left, right]))))
                hit = np.zeros(len(left), bool)
                for p, q, _ in tiles.pairs(x[: len(left)], x[len(left) :], threshold, share, channels):
                    hit[p[numbers[right[q]] < numbers[left[p]]]] = True
                found.append(left[hit])
        return tile.take(pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))).select(["case_id", "trial_id"])

    both = dealt(rows, "_i", "_j").unionByName(dealt(held, "_j", "_i"))
    out = StructType([StructField("case_id", kind), StructField("trial_id", LongType())])
    return both.groupBy("_group", "i", "j").applyInArrow(compared, out).distinct()
