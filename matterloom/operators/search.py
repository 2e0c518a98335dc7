"""Similarity search, cached results, best-of-N and logged searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_key
from .runs import running

#: Steps (a range of their numbers) of a search that one task goes through; longer searches go in parts.
PART = 65_536
#: Queries of one block; a block is broadcast to all tasks.
BLOCK = 20_000
#: Scores of one tile, and rows of one batch that a task gives out.
TILE, OUT = 1 << 20, 100_000


def top_k(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, digits: int = 6) -> DataFrame:
    """(query, key, score, rank): the ``k`` most similar rows by cosine (C10, F5); ties by key, after rounding. Each task keeps
    ``k`` rows a query of all its batches, and those are merged. Scores are made in tiles of ``TILE`` at most, and of a tile only those that
    reach a query's worst kept one are looked at, so memory is that of a tile and of what is kept."""
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    kind = corpus.schema[key].dataType.simpleString()
    out = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        rows = [r for r in block.select(key, vector).collect() if r[1] is not None]
        table = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
        kept = corpus.sparkSession.sparkContext.broadcast(([r[0] for r in rows], table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)))

        def search(batches: Iterator[pd.DataFrame], kept=kept) -> Iterator[pd.DataFrame]:
            ids, unit = kept.value
            ids, most = pd.Series(ids).to_numpy(), k + 1
            best = np.full((len(ids), most), -np.inf)
            keys, seen = None, 0
            for pdf in batches:
                pdf = pdf[pdf[vector].notna()]
                if not len(ids) or not len(pdf):
                    continue
                mine = np.stack([np.asarray(v, np.float64) for v in pdf[vector]])
                mine /= np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-12)
                fresh = pdf[key].to_numpy()
                if keys is None:
                    keys, got = np.repeat(fresh[:1], best.size).reshape(best.shape), np.zeros(best.shape, bool)
                start = 0
                while start < len(mine):
                    # As many rows as were seen before: the first tiles set bounds, which leave little of the wider ones.
                    width = max(most, min(seen, TILE // 64))
                    step = max(1, TILE // width)
                    part, part_keys = mine[start : start + width], fresh[start : start + width]
                    start, seen = start + width, seen + width
                    for low in range(0, len(ids), step):
                        rows = slice(low, low + step)
                        scores = unit[rows] @ part.T
                        # Scores that may reach the worst kept one once rounded.
                        r, c = np.nonzero(scores >= best[rows, -1:] - 10.0**-digits)
                        if not len(r):
                            continue
                        value = np.round(scores[r, c], digits)
                        filled = got[rows]
                        held_r, held_c = np.nonzero(filled)
                        all_r = np.concatenate([held_r, r])
                        all_s = np.concatenate([best[rows][held_r, held_c], value])
                        all_k = np.concatenate([keys[rows][held_r, held_c], part_keys[c]])
                        order = np.lexsort((all_k, -all_s, all_r))
                        all_r, all_s, all_k = all_r[order], all_s[order], all_k[order]
                        # The place of each within its query, of which the first are kept.
                        place = np.arange(len(all_r)) - np.searchsorted(all_r, all_r)
                        first = place < most
                        best[low + all_r[first], place[first]], keys[low + all_r[first], place[first]], got[low + all_r[first], place[first]] = all_s[first], all_k[first], True
            if keys is not None:
                r, c = np.nonzero(got)
                for low in range(0, len(r), OUT):
                    p, q = r[low : low + OUT], c[low : low + OUT]
                    yield pd.DataFrame({"query": ids[p], key: keys[p, q], "score": best[p, q]})

        hits = corpus.select(key, vector).mapInPandas(search, f"query {kind}, {key} {kind}, score double")
        out = hits if out is None else out.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return out.where(F.col("query") != F.col(key)).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def best_of(predictions: DataFrame, example: str, name: str, metric: str) -> DataFrame:
    """The prediction with the least metric of each example; ties to the first name."""
    return predictions.groupBy(example).agg(F.min_by(name, F.struct(metric, name)).alias(name), F.min(metric).alias(metric))


def hits(responses: DataFrame, query: str = "query", results: str = "results") -> DataFrame:
    """A row for each result of a response (A14), with its rank from 0, defaults for what is missing, and its cache key."""
    rows = responses.select(query, F.posexplode(results).alias("rank", "r"))
    script, image = F.col("r.remote_script_path"), F.col("r.remote_image_path")
    return rows.select(query, F.col("rank").cast("long").alias("rank"), F.coalesce("r.score", F.lit(0.0)).alias("score"), content_key(script, image, F.col(query), F.col("rank")).alias("key"))


def cache_new(found: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Hits whose key is not stored yet, one for each key: that of the least query and rank."""
    fresh = found.join(stored.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct("query", "rank", "score"), F.struct("query", "rank")).alias("h")).select(key, "h.query", "h.rank", "h.score")


def _walk(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``now`` and ``before``: the least metric since the last forced step, with and without the step itself."""
    steps = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_run", F.sum(F.col("_forced").cast("long")).over(steps.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run").orderBy(*order)
    least = lambda end: F.min("_metric").over(run.rowsBetween(Window.unboundedPreceding, end))
    return rows.withColumns({"_now": least(0), "_before": least(-1)})


def replay(proposals: DataFrame, chance: float = 0.05, part: int = PART) -> DataFrame:
    """Accept/reject along each search (E11): a proposal is accepted if its metric is below the current one, or by its logged
    draw; ``current`` is the metric afterwards, infinity before any is accepted. One without a metric is never accepted, one
    without a draw not by chance. ``it`` is a number of its own for each step of a search.

    A step accepted by its draw sets the current metric, any other lowers it at most, so it is the least since the last
    such step. Searches are cut into parts by ``it``, and a part begins with what those before it leave."""
    metric = F.when(~F.isnan("metric"), F.col("metric")).cast("double")
    forced = F.coalesce(F.col("draw") < chance, F.lit(False)) & metric.isNotNull()
    rows = proposals.withColumns({"_part": F.floor(F.col("it") / part), "_kind": F.lit(1), "_metric": metric, "_forced": forced})
    keys, order = ["example", "_part"], ["_kind", "it"]
    ends = _walk(rows.select(*keys, *order, "_metric", "_forced"), keys, order).groupBy(*keys).agg(F.max_by("_now", "it").alias("_metric"), (F.max("_run") > 0).alias("_forced"))
    parts = Window.partitionBy("example").orderBy("_part")
    left = _walk(ends, ["example"], ["_part"]).select(*keys, F.lag("_now").over(parts).alias("_metric"), F.lit(False).alias("_forced"), F.lit(0).alias("_kind"))
    walked = _walk(rows.unionByName(left, allowMissingColumns=True), keys, order).where("_kind = 1")
    least = lambda name: F.coalesce(name, F.lit(float("inf")))
    accepted = F.col("_forced") | F.coalesce(F.col("_metric") < least("_before"), F.lit(False))
    return walked.withColumns({"accepted": accepted, "current": least("_now")}).select(*proposals.columns, "accepted", "current")


def search_states(proposals: DataFrame, changes: DataFrame, initial: float, every: int, chance: float = 0.05, part: int = PART) -> DataFrame:
    """Snapshots of a search every so many steps (E10): (example, it, current, best, state) where ``it + 1`` is a multiple of ``every``:
    the metric after the step, the best one before it, and the last accepted value of each parameter. ``proposals`` are those of
    :func:`replay`; ``changes`` has example, it, param and value, those of a step below 0 being what the search began with.

    A snapshot takes each parameter's last accepted value as of its step, so work and rows are those of the changes and of the snapshots
    that are there, however far apart the numbers of steps are. Long searches go in parts."""
    start = proposals.select("example").distinct().select("example", F.lit(-1).cast(proposals.schema["it"].dataType).alias("it"), F.lit(initial).alias("metric"), F.lit(0.0).alias("draw"))
    taken = replay(proposals.select("example", "it", "metric", "draw").unionByName(start), chance, part)
    taken = running(taken, ["example"], ["it"], F.floor(F.col("it") / part), least={"best": F.col("current")}, upto=-1)
    shots = taken.where((F.col("it") >= 0) & ((F.col("it") + 1) % every == 0)).select("example", "it", "current", "best")
    kept = changes.join(taken.where("accepted AND it >= 0").select("example", "it"), ["example", "it"], "left_semi").unionByName(changes.where("it < 0"))
    # A value is kept as a struct, since a null one is a value too.
    moves = kept.select("example", "param", "it", F.lit(0).alias("_shot"), F.struct("value").alias("_value"))
    asked = kept.select("example", "param").distinct().join(shots.select("example", "it"), "example").withColumn("_shot", F.lit(1))
    rows = moves.unionByName(asked, allowMissingColumns=True)
    stands = running(rows, ["example", "param"], ["it", "_shot"], F.floor(F.col("it") / part), last={"last": F.col("_value")}).where("_shot = 1 AND last IS NOT NULL")
    states = stands.groupBy("example", "it").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("param", F.col("last.value").alias("value"))))).alias("state"))
    return shots.join(states, ["example", "it"], "left")
