"""Hard negatives by a GNAT-style multiway hyperplane tree, exact.

An anchor's positives are the rows of its label with the highest inner products; its hard negatives for a positive are the rows of
other labels whose inner product is highest within a window below the positive's.

**As distances.** A row x of norm at most M gets one more entry, sqrt(M^2 - |x|^2), an anchor gets 0 there. Then
distance(a, x)^2 = |a|^2 + M^2 - 2 <a, x>, so a window of inner products is an annulus around the anchor.

**The tree.** Split points are drawn from a sample of about ``SAMPLE`` rows (a bound, whatever the table's size); a node has up to
``FAN`` of them, each row goes to the nearest, level by level. Every row of the table is placed, and for every split point the
range of its distances to *each sibling's* subtree is kept, by partial minima and maxima. For an anchor, a subtree goes if for
some split point the range of distances that its rows can have to the anchor misses the annuli of all that the anchor asks.

**The search.** Small leaves that are neighbours share a block, a large one (or the copies of one vector) is dealt over several by
a hash of the row, so blocks have about ``BLOCK`` rows. An anchor is sent to the blocks of the leaves that are left, together with
the other anchors of its stripe (about ``STRIPE``); a task compares a block with a stripe by exact matrix products and keeps for each
request the few best. What the sample holds already bounds the k-th best from below, which makes the annuli thin. On tables
much larger than the sample a first round over every 64th block, or 4,096th and so on, makes them thinner; the last round meets all.

Nothing but the sample, the tree and its ranges is broadcast, all bounded by ``SAMPLE``. Anchors are a stated query set: they grow
with the table, and each meets whole blocks only where the tree can't tell.

Defined results: a row whose id, label or vector is null, whose vector holds a null, NaN or infinite entry, or whose length is not
the commonest (of two equally common the longer) takes no part. Labels are integers. Entries are held within the bound that keeps
inner products in a long (2^28 for 64 entries). Rows of equal id count each; equal scores of equal ids come in the order of the
table. An anchor without positives, or a positive without negatives, gives no rows; an empty table gives none. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_keys, written
from .whitening import usable

SCALE = 256
#: Rows that split points and first bounds come from, about.
SAMPLE = 8192
#: Split points of a node, sample rows of a leaf at most, and levels at most.
FAN, LEAF, LEVELS = 16, 32, 4
#: Rows of a block and anchors of a stripe, about.
BLOCK, STRIPE = 4096, 8192
#: Each round but the last meets one in this many of the next round's blocks.
THINNED = 64
#: Anchors that are compared with a block at once.
ROWS = 128
#: What distances may be off by, as a share of the largest norm.
SLACK = 1e-6

LEAST, MOST = -(2**63), 2**63 - 1


class Tree:
    """Split points, and the ranges of their distances to their siblings' subtrees."""

    def __init__(self, points: np.ndarray, largest: float):
        """``points`` are distinct sample rows (floats); ``largest`` is the largest squared norm of the table."""
        self.square = largest
        self.splits: list[np.ndarray] = []
        #: Per node and split point: the next node, or -1 - leaf.
        self.below: list[np.ndarray] = []
        self.leaves = 0
        if len(points):
            self._grow(points, 0)
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.splits]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.splits]

    def _grow(self, points: np.ndarray, level: int) -> int:
        if len(points) <= (LEAF if level else 1) or level >= LEVELS:
            self.leaves += 1
            return -self.leaves
        number = len(self.splits)
        # Each split point is the one furthest from those before it; the first is furthest from the mean.
        chosen = [int(self._apart(points, points.mean(0, keepdims=True)).argmax())]
        far = self._apart(points, points[chosen])[:, 0]
        while len(chosen) < FAN and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, self._apart(points, points[chosen[-1:]])[:, 0])
            far[chosen] = 0
        self.splits.append(points[chosen])
        self.below.append(np.zeros(len(chosen), np.int64))
        at = self._apart(points, self.splits[number]).argmin(1)
        for k in range(len(chosen)):
            self.below[number][k] = self._grow(points[at == k], level + 1)
        return number

    def _apart(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Distances of rows to points, both with their further entry."""
        square = lambda y: np.einsum("ij,ij->i", y, y)
        more = lambda y: np.sqrt(np.maximum(0, self.square - square(y)))
        plain = square(x)[:, None] + square(points) - 2 * (x @ points.T)
        return np.sqrt(np.maximum(0, plain + (more(x)[:, None] - more(points)) ** 2))

    def place(self, x: np.ndarray, widen: bool = False) -> np.ndarray:
        """The leaf of each row; with ``widen``, the ranges take them in."""
        leaf = np.zeros(len(x), np.int64)
        waiting = [(0, np.arange(len(x)))] if self.splits and len(x) else []
        while waiting:
            node, rows = waiting.pop()
            apart = self._apart(x[rows], self.splits[node])
            at = apart.argmin(1)
            for k in np.unique(at):
                mine = at == k
                if widen:
                    self.low[node][:, k] = np.minimum(self.low[node][:, k], apart[mine].min(0))
                    self.high[node][:, k] = np.maximum(self.high[node][:, k], apart[mine].max(0))
                below = self.below[node][k]
                if below < 0:
                    leaf[rows[mine]] = -1 - below
                else:
                    waiting.append((below, rows[mine]))
        return leaf

    def left(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(anchor, leaf): whether a leaf may hold a row whose inner product lies in one of the anchor's windows. ``low`` and ``high``
        have a window a column; an empty one has low > high."""
        out = np.zeros((len(anchors), max(1, self.leaves)), bool)
        if not self.splits:
            out[:] = (low <= high).any(1)[:, None]
            return out
        slack = SLACK * np.sqrt(self.square)
        base = np.einsum("ij,ij->i", anchors, anchors) + self.square
        far = np.sqrt(np.maximum(0, base[:, None] - 2 * low)) + slack
        near = np.sqrt(np.maximum(0, base[:, None] - 2 * high)) - slack
        asked = low <= high
        waiting = [(0, np.flatnonzero(asked.any(1)))]
        while waiting:
            node, rows = waiting.pop()
            to = np.sqrt(np.maximum(0, base[rows, None] - 2 * (anchors[rows] @ self.splits[node].T)))
            for k, below in enumerate(self.below[node]):
                least = np.maximum(0, np.maximum(to - self.high[node][:, k], self.low[node][:, k] - to)).max(1)
                most = (to + self.high[node][:, k]).min(1)
                stays = (asked[rows] & (least[:, None] <= far[rows]) & (most[:, None] >= near[rows])).any(1)
                if not np.isfinite(self.low[node][0, k]) or not stays.any():
                    continue
                if below < 0:
                    out[rows[stays], -1 - below] = True
                else:
                    waiting.append((below, rows[stays]))
        return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Packed vectors of integers as floats."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, d).astype(np.float64)


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs; floats hold them where ``exact``."""
    if exact:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _packed(rows: DataFrame, key: str, vector: str, label: str, anchor: Column) -> tuple[DataFrame, int]:
    """(row, id, label, anchor, v): usable rows with a number each and their integers packed, written."""
    rows, d = usable(rows.select(F.col(key).alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("v")).where("id IS NOT NULL AND label IS NOT NULL"), "v")
    most = min(isqrt(2**62 // max(1, d)), 2**31 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = row_keys()
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            raw = np.clip(np.floor(SCALE * flat), -most, most).astype("<i4").tobytes()
            packed = pa.array([raw[4 * d * k : 4 * d * (k + 1)] for k in range(batch.num_rows)], pa.binary())
            numbers = pa.array([next(keys) for _ in range(batch.num_rows)], pa.int64())
            yield pa.record_batch([numbers, batch.column("id"), batch.column("label"), batch.column("anchor"), packed], ["row", "id", "label", "anchor", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"row long, id {kind}, label long, anchor boolean, v binary"), "vectors"), d


def _extent(rows: DataFrame, d: int) -> tuple[int, int, float, float]:
    """Rows, anchors, the largest squared norm and the largest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), d)
                yield pa.record_batch([pa.array([len(x)]), pa.array([sum(batch.column("anchor").to_pylist())], pa.int64()), pa.array([float(np.einsum("ij,ij->i", x, x).max())]), pa.array([float(np.abs(x).max())])], ["n", "anchors", "square", "entry"])

    r = rows.select("anchor", "v").mapInArrow(run, "n long, anchors long, square double, entry double").agg(F.sum("n"), F.sum("anchors"), F.max("square"), F.max("entry")).first()
    return (r[0], r[1], r[2], r[3]) if r[0] else (0, 0, 0.0, 0.0)


def _with_ranges(rows: DataFrame, tree: Tree, d: int) -> tuple[Tree, np.ndarray]:
    """The tree with the ranges of all rows, and the rows of each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(max(1, tree.leaves), np.int64)
        for batch in batches:
            counts += np.bincount(tree.place(_matrix(batch.column("v"), d), widen=True), minlength=len(counts))
        some = np.flatnonzero(counts)
        columns = [[-1] * len(some), some.tolist(), [0] * len(some), [0.0] * len(some), [0.0] * len(some), counts[some].tolist()]
        for node, (low, high) in enumerate(zip(tree.low, tree.high, strict=True)):
            i, j = np.nonzero(np.isfinite(low))
            for column, values in zip(columns, ([node] * len(i), i.tolist(), j.tolist(), low[i, j].tolist(), high[i, j].tolist(), [0] * len(i)), strict=True):
                column.extend(values)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "i", "j", "low", "high", "n"])

    parts = rows.select("v").mapInArrow(run, "node int, i int, j int, low double, high double, n long")
    counts = np.zeros(max(1, tree.leaves), np.int64)
    for r in parts.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        if r.node < 0:
            counts[r.i] = r.n
        else:
            tree.low[r.node][r.i, r.j], tree.high[r.node][r.i, r.j] = r.low, r.high
    return tree, counts


def layout(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each leaf its first block and its number of blocks, and the number of all: leaves share a block up to ``size`` rows, a
    larger one has blocks of its own."""
    first, parts, block, inside = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for leaf, n in enumerate(counts.tolist()):
        if inside and inside + n > size:
            block, inside = block + 1, 0
        first[leaf], parts[leaf] = block, max(1, -(-n // size))
        if parts[leaf] > 1:
            block, inside = block + int(parts[leaf]), 0
        else:
            inside += n
    return first, parts, block + (inside > 0)


def _best(asks: pa.Table, rows: pa.Table, d: int, k: int, same: bool, exact: bool) -> pa.Table:
    """For each request the ``k`` best rows of a block: (row, slot, score, hit, hit_row)."""
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
    vectors, labels, numbers = _matrix(rows.column("v"), d), rows.column("label").to_numpy(), rows.column("row").to_numpy()
    ids = rows.column("id").combine_chunks()
    low, high = (np.array(asks.column(c).to_pylist(), np.int64) for c in ("low", "high"))
    own, mine = asks.column("row").to_numpy(), asks.column("label").to_numpy()
    anchors = _matrix(asks.column("v"), d)
    out = [(np.zeros(0, np.int64),) * 4]
    for at in range(0, len(own), ROWS):
        to = slice(at, at + ROWS)
        scores = _scores(anchors[to], vectors, exact)
        fits = (mine[to, None] == labels) == same
        if same:
            fits &= own[to, None] != numbers
        for slot in range(low.shape[1]):
            a, x = np.nonzero(fits & (scores >= low[to, slot, None]) & (scores <= high[to, slot, None]))
            if len(a):
                found = scores[a, x]
                order = np.lexsort((x, -found, a))
                a, x, found = a[order], x[order], found[order]
                kept = np.arange(len(a)) - np.searchsorted(a, a) < k
                out.append((own[to][a[kept]], np.full(kept.sum(), slot), found[kept], x[kept]))
    row, slot, score, x = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"row": row, "slot": pa.array(slot, pa.int32()), "score": score, "hit": ids.take(pa.array(x)), "hit_row": numbers[x]})


class Search:
    """The placed rows and the tree, ready for requests."""

    def __init__(self, rows: DataFrame, d: int):
        self.d = d
        self.n, self.anchors, square, entry = _extent(rows, d)
        self.exact = d * entry * entry < 2**53
        # By the row's number, so that copies of one vector are drawn like other rows.
        drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / max(1, self.n)) * (1 << 40))).select("row", "label", "v").collect()
        self.known = (np.array([r.row for r in drawn], np.int64), np.array([r.label for r in drawn], np.int64), np.frombuffer(b"".join(bytes(r.v) for r in drawn), "<i4").reshape(-1, max(1, d)).astype(np.float64))
        points = np.unique(self.known[2], axis=0)
        self.tree, counts = _with_ranges(rows, Tree(points, square), d)
        self.first, self.parts, self.blocks = layout(counts, BLOCK)
        self.stripes = max(1, -(-self.anchors // STRIPE))
        self.rounds = 0
        while self.n > SAMPLE * THINNED ** (self.rounds + 1):
            self.rounds += 1
        self.rows = self._placed(rows)

    def _placed(self, rows: DataFrame) -> DataFrame:
        tree, d, first, parts = self.tree, self.d, self.first, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = tree.place(_matrix(batch.column("v"), d))
                block = first[leaf] + batch.column("spread").to_numpy() % parts[leaf]
                yield pa.record_batch([*(batch.column(c) for c in ("row", "id", "label", "v")), pa.array(block, pa.int64())], ["row", "id", "label", "v", "block"])

        kind = rows.schema["id"].dataType.simpleString()
        spread = rows.select("row", "id", "label", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 40)).alias("spread"))
        return written(spread.mapInArrow(run, f"row long, id {kind}, label long, v binary, block long"), "placed")

    def _sent(self, asks: DataFrame, k: int, same: bool, thinned: int) -> DataFrame:
        """Each anchor's row once for each block that may hold what it asks, its windows cut by what the sample holds."""
        tree, d, exact, first, parts = self.tree, self.d, self.exact, self.first, self.parts
        rows, labels, known = self.known
        chosen = np.arange(self.blocks) % thinned == 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    x = _matrix(batch.column("v"), d)
                    low, high = (np.array(batch.column(c).to_pylist(), np.int64).reshape(len(x), -1) for c in ("low", "high"))
                    scores = _scores(x, known, exact)
                    fits = ((batch.column("label").to_numpy()[:, None] == labels) == same) & (batch.column("row").to_numpy()[:, None] != rows)
                    for slot in range(low.shape[1]) if scores.shape[1] >= k else ():
                        inside = np.where(fits & (scores >= low[:, slot, None]) & (scores <= high[:, slot, None]), scores, LEAST)
                        low[:, slot] = np.maximum(low[:, slot], np.partition(inside, -k, axis=1)[:, -k])
                    leaves = tree.left(x, low.astype(np.float64), high.astype(np.float64))
                    a, leaf = np.nonzero(leaves)
                    # Leaves come in the order of their blocks, so an anchor's blocks rise and a shared one repeats at once.
                    ends = np.cumsum(parts[leaf])
                    block = np.repeat(first[leaf] - ends + parts[leaf], parts[leaf]) + np.arange(ends[-1] if len(ends) else 0)
                    a = np.repeat(a, parts[leaf])
                    kept = (np.diff(block, prepend=-1) != 0) | (np.diff(a, prepend=-1) != 0)
                    kept &= chosen[block]
                    each = pa.array(a[kept])
                    lists = [pa.array(c.tolist(), pa.list_(pa.int64())) for c in (low, high)]
                    yield pa.record_batch([pa.array(block[kept]), *(batch.column(c).take(each) for c in ("row", "label", "v")), *(c.take(each) for c in lists)], ["block", "row", "label", "v", "low", "high"])

        sent = asks.select("row", "label", "v", "low", "high").mapInArrow(run, "block long, row long, label long, v binary, low array<long>, high array<long>")
        return sent.withColumn("stripe", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(self.stripes)).cast("int"))

    def _round(self, asks: DataFrame, k: int, same: bool, thinned: int) -> DataFrame:
        d, exact = self.d, self.exact
        kind = self.rows.schema["id"].dataType.simpleString()

        def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
            if not asked.num_rows or not rows.num_rows:
                return pa.table({"row": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "hit": rows.column("id").slice(0, 0), "hit_row": pa.array([], pa.int64())})
            return _best(asked, rows, d, k, same, exact)

        met = self.rows.where(F.col("block") % thinned == 0).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(self.stripes - 1))))
        hits = self._sent(asks, k, same, thinned).groupBy("block", "stripe").cogroup(met.groupBy("block", "stripe")).applyInArrow(run, f"row long, slot int, score long, hit {kind}, hit_row long")
        order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "hit", "hit_row")
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def best(self, asks: DataFrame, k: int, same: bool) -> DataFrame:
        """(row, slot, rank, score, hit, hit_row): for each request the ``k`` best rows. ``asks`` has row, label, v and windows ``low``,
        ``high`` of inner products, both ends included, one a slot; rows have the anchor's label, or another."""
        for thinned in [THINNED**r for r in range(self.rounds, 0, -1)]:
            last = self._round(asks, k, same, thinned).where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_found"))
            low = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("_found", i), F.lit(LEAST))))
            asks = written(asks.join(last, "row", "left").withColumn("low", low).drop("_found"), "asks")
        return self._round(asks, k, same, 1)


def mine(rows: DataFrame, key: str, vector: str, label: str, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for the rows that are an ``anchor`` and each of
    their ``positives`` first positives, the ``negatives`` first rows of other labels whose score is from ``least`` to ``most``
    percent of the positive's."""
    packed, d = _packed(rows, key, vector, label, anchor)
    search = Search(packed, d)
    everything = [F.array(F.lit(x).cast("long")) for x in (LEAST, MOST)]
    asks = packed.where("anchor").select("row", "id", "label", "v", everything[0].alias("low"), everything[1].alias("high"))
    near = written(search.best(asks, positives, True).select("row", (F.col("rank") - 1).alias("slot"), F.col("hit").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Percentages of a long, in whole numbers that hold them.
    score = F.col("positive_score").cast("decimal(38, 0)")
    low = F.ceil(score * least / 100).cast("long")
    high = F.floor(score * most / 100).cast("long")
    windows = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", low.alias("low"), high.alias("high")))).alias("w"))
    # Anchors with fewer positives have empty windows in the slots that are left.
    filled = lambda c, empty: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at(f"w.{c}", i), F.lit(empty).cast("long")))
    asks = written(asks.select("row", "label", "v").join(windows, "row").select("row", "label", "v", filled("low", 1).alias("low"), filled("high", 0).alias("high")), "windows")
    found = search.best(asks, negatives, False).select("row", "slot", "rank", F.col("hit").alias("negative_id"), F.col("score").alias("negative_score"))
    named = packed.where("anchor").select("row", F.col("id").alias("anchor_id"))
    return found.join(near, ["row", "slot"]).join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
