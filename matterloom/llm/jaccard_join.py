"""N-gram Jaccard join: a size-aware heavy-light join of sets of word shingles, down to linked components.

Documents with the same set are one node, so copies are never expanded. Small (light) sets enumerate their subsets of
the fixed sizes that a linked partner must share; large (heavy) sets go into inverted lists by their rarest shingles (as
many as a linked partner cannot all miss). Sets near the boundary do both ways. The boundary is the size from which
the lists of a set cost less than its subsets: rows of subsets against rows of lists times the estimated length of a list.

What shares a subset or list is a bucket. Signatures are made once and dealt out once, by bucket; buckets that are
estimated to be hot are dealt out in parts by a hash of the node, and later joins do so with every bucket of more than
``MEMBERS``. A bucket's members are compared with a few hubs in each round, never all with all:
first with its most central member (that with most of its signatures shared), then with 8, 64, ... members by hash.
Members that are already in one component are not compared any more, nor those whose distances to the first hub differ
by more than a link allows (Jaccard distance is a metric), nor those that can't be linked if the bucket's shingle is
the first that they share: what stands before it in either list is then lost to their intersection. A bucket ends when it is one component or all members have
been hubs, so no link between components is lost. A pair is first held against the bound that the sets' counts by hash
range give their intersection; whole sets are sent and intersected only where that bound allows a link. A hub's set is
sent once for each ``MEMBERS`` nodes that meet it, and a node's set once for each pair.

Rarity is an estimate (buckets that are frequent within a task), the same for all tasks; it decides order, hence
cost, and never the result. Shingles are 64-bit hashes, a node is the 64-bit digest of its set, and sets travel with
48 bits a shingle, one copy for each task and node at most: two different shingles of a pair of sets fall together with
a chance of about their number squared / 2^49, which can move a similarity by one shingle.

Written tables are dropped as soon as nothing reads them any more.

Defined results: null or empty text, or text without words, has an empty set and is linked with nothing; fewer than
``n`` words are one shingle; repeated rows are linked through their equal sets; a component's id is its smallest doc_id
that is not null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop, give_back, slices, written

CELLS = 22  # bits of the table that estimates how frequent a shingle is
LARGEST_LIGHT = 30
GROWTH = 8
#: Nodes whose numbers are broadcast at most, to pick out their sets.
BROADCAST = 1_000_000
#: Members of a bucket, or nodes of a hub, that go to one task together.
MEMBERS = 256
#: Bytes of text that are made into sets at a time; the sets and their signatures take many times as much.
TEXT = 2 << 20
MASK48 = np.uint64((1 << 48) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, n: int = 3) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    full = np.array([bool(w) for w in words], bool)
    index = coded.indices.to_numpy()
    counts = np.diff(lists.offsets.to_numpy())
    if len(index):
        has = full[index]
        before = np.r_[0, np.cumsum(has)]
        ends = before[np.cumsum(counts)]
        hashes = table[index[has]]
    else:
        ends, hashes = np.zeros(len(counts), np.int64), np.zeros(0, np.uint64)
    m = max(len(hashes) - n + 1, 0)
    rolled = np.zeros(m, np.uint64)
    for k in range(n):
        rolled = _mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m] + np.uint64(k + 1))
    out, at = [], 0
    for end in ends.tolist():
        if end == at:
            out.append(np.zeros(0, np.uint64))
        elif end - at < n:
            short = np.uint64(end - at + 100)
            for h in hashes[at:end]:
                short = _mixed(np.array([short], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.unique(rolled[at : end - n + 1]))
        at = end
    return out


def node(shingles: np.ndarray) -> int:
    """The digest of a set, as a signed 64-bit number."""
    return int.from_bytes(hashlib.md5(shingles.tobytes()).digest()[:8], "little", signed=True)


def overlap(a: int, b: int, num: int, den: int) -> int:
    """The least intersection of linked sets of sizes ``a`` and ``b``: num / den of the union at least."""
    return -(-num * (a + b) // (num + den))


def light_sizes(size: int, num: int, den: int) -> list[int]:
    """Sizes of the subsets that a set of ``size`` must share with some linked partner."""
    return sorted({c for t in range(-(-num * size // den), den * size // num + 1) if (c := overlap(size, t, num, den)) <= min(size, t)})


def subsets(shingles: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Signatures of all subsets of the given sizes; a subset's is made of the sum of its members, so it takes one subtraction for each left out."""
    total = _mixed(shingles)
    n, out = len(shingles), []
    for c in sizes:
        gone = [list(x) for x in combinations(range(n), n - c)]
        sums = total.sum() - (total[np.array(gone, np.int64)].sum(1) if n > c else np.zeros(1, np.uint64))
        out.append(_mixed(sums + np.uint64(c)))
    return np.concatenate(out)


def boundary(sizes: dict[int, int], list_length: float, num: int, den: int) -> int:
    """The size below which sets are light: the one of least total cost. Sets that link across it are in lists too."""

    def cost(b: int) -> float:
        light = sum(n * sum(comb(s, c) for c in light_sizes(s, num, den)) for s, n in sizes.items() if s < b)
        heavy = sum(n * (s - -(-num * s // den) + 1) for s, n in sizes.items() if s >= -(-num * b // den))
        return light + heavy * (1 + list_length)

    return min(range(1, LARGEST_LIGHT + 1), key=cost)


def counts_by_range(shingles: np.ndarray) -> bytes:
    """How many shingles lie in each of equal ranges of the hash, about eight in one, as one byte for each range."""
    bits = max(3, (len(shingles) // 6).bit_length())
    while True:
        counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        bits += 1


def most_shared(a: bytes, b: bytes) -> int:
    """An upper bound of the intersection of two sets, from their counts by range."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    least = min(len(x), len(y))
    return int(np.minimum(x.reshape(least, -1).sum(1, np.int64), y.reshape(least, -1).sum(1, np.int64)).sum())


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (doc_id, size, node, ranges), and rows (cell, uses) of cells that are frequent within a task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS, np.int32)
        names = ["doc_id", "size", "node", "ranges", "cell", "uses"]
        for batch in slices(batches, "text", rows=4000, size=TEXT):
            sets = shingle_sets(batch.column("text"), n)
            found, times = np.unique((np.concatenate(sets) >> np.uint64(64 - CELLS)).astype(np.int32), return_counts=True)
            cells[found] += times.astype(np.int32)
            nothing = pa.nulls(len(sets), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node(s) if len(s) else None for s in sets], pa.int64()), pa.array([counts_by_range(s) for s in sets], pa.binary()), nothing, nothing], names)
        often = np.flatnonzero(cells >= max(6, 4 * cells.mean()))
        nothing = pa.nulls(len(often), pa.int64())
        yield pa.record_batch([pa.nulls(len(often), kind), nothing, nothing, pa.nulls(len(often), pa.binary()), pa.array(often, pa.int64()), pa.array(cells[often].astype(np.int64), pa.int64())], names)

    return docs.mapInArrow(run, f"doc_id {id_type}, size long, node long, ranges binary, cell long, uses long")


def subset_popularity(uses: np.ndarray, sizes: list[int]) -> np.ndarray:
    """For each of :func:`subsets`, in the same order, the least of its members' uses."""
    n, out = len(uses), []
    order = np.argsort(uses, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    for c in sizes:
        gone = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
        # The least use that is left is that of the first rank that is not left out.
        first = np.cumprod(np.sort(rank[gone], 1) == np.arange(n - c), axis=1).sum(1)
        out.append(uses[order[first]])
    return np.concatenate(out)


def _signatures(docs: DataFrame, n: int, uses: np.ndarray, bound: int, hot: int, num: int, den: int) -> DataFrame:
    """(bucket, node, place, parts): subsets of light sets, and list heads of heavy ones. ``place`` holds the set's size and,
    in its low half, the head's place in the set's order (0 for a subset). ``parts`` is above 1 for buckets of more than ``hot`` estimated
    uses, and the same for all members of a bucket. A task gives each node once."""
    order = docs.sparkSession.sparkContext.broadcast(uses)
    near = -(-num * bound // den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches, "text", rows=2000, size=TEXT):
            buckets, nodes, places, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

            def add(found: np.ndarray, me: int, place: np.ndarray, uses: np.ndarray) -> None:
                buckets.append(found.view(np.int64))  # noqa: B023
                nodes.append(np.full(len(found), me, np.int64))  # noqa: B023
                places.append(place)  # noqa: B023
                often.append(uses)  # noqa: B023

            for s in shingle_sets(batch.column("text"), n):
                if not len(s) or (me := node(s)) in done:
                    continue
                done.add(me)
                use = order.value[(s >> np.uint64(64 - CELLS)).astype(np.int64)]
                size = len(s) << 32
                if len(s) < bound:
                    sizes = light_sizes(len(s), num, den)
                    found = subsets(s, sizes)
                    add(found, me, np.full(len(found), size, np.int64), subset_popularity(use, sizes))
                if len(s) >= near:
                    rare = np.lexsort((s, use))[: len(s) - -(-num * len(s) // den) + 1]
                    add(s[rare], me, size + np.arange(len(rare)), use[rare])
            uses_ = np.concatenate(often)
            parts = np.where(uses_ > hot, -(-uses_ // MEMBERS), 1).astype(np.int32)
            yield pa.record_batch([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(places)), pa.array(parts)], ["bucket", "node", "place", "parts"])

    return docs.select("text").mapInArrow(run, "bucket long, node long, place long, parts int")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, shingles): 48 bits of each; a task gives each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches, "text", rows=2000, size=TEXT):
            nodes, data = [], []
            for s in shingle_sets(batch.column("text"), n):
                if len(s) and (me := node(s)) not in done:
                    done.add(me)
                    nodes.append(me)
                    data.append(np.sort(s & MASK48).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(data, pa.binary())], ["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).reshape(-1)


def _among(table: DataFrame, column: str, ids: DataFrame, count: int) -> DataFrame:
    """The rows of ``table`` whose ``column`` is among the ``count`` ids; these are broadcast if they are few enough."""
    ids = ids.select(F.col(ids.columns[0]).alias(column))
    return table.join(F.broadcast(ids) if count <= BROADCAST else ids, column, "left_semi")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (hub, node) with their sizes and ``most``, the upper bound that their counts by range give what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [most_shared(a, b) for a, b in zip(batch.column("hub_ranges").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            names = ["hub", "node", "size", "hub_size"]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(most, pa.int64())], [*names, "most"])

    pairs = written(pairs, "pairs")
    ids = written(pairs.select("node").union(pairs.select("hub")).distinct(), "met")
    nodes = _among(nodes, "node", ids, ids.count())
    both = pairs.join(nodes, "node").join(nodes.select(F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("ranges").alias("hub_ranges")), "hub")
    bounded = written(both.select("hub", "node", "size", "hub_size", "ranges", "hub_ranges").mapInArrow(run, "hub long, node long, size long, hub_size long, most long"), "bounded")
    drop(pairs, ids)
    return bounded


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with ``shared``, the size of the intersection of their whole sets. The nodes that meet a hub follow its
    set, in parts of about ``MEMBERS``, so that no row holds more than one set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, hub = ["hub", "node", "size", "hub_size"], np.zeros(0, np.uint64)
        for batch in batches:
            at, shared = [], []
            for k, (is_node, data) in enumerate(zip(batch.column("is_node").to_pylist(), batch.column("shingles"), strict=True)):
                mine = _unpack(data.as_py())
                if not is_node:
                    hub = mine
                    continue
                both = np.concatenate([hub, mine])
                both.sort()
                at.append(k)
                shared.append(int((both[1:] == both[:-1]).sum()))
            rows = batch.select(names).take(pa.array(at, pa.int64()))
            yield pa.record_batch([*rows.columns, pa.array(shared, pa.int64())], [*names, "shared"])
        give_back()

    hubs = written(pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "met-hubs")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    ids = written(pairs.select("node").distinct(), "met")
    nodes = pairs.join(hubs, "hub").select("hub", "node", "size", "hub_size", part).join(_among(sets, "node", ids, ids.count()), "node").withColumn("is_node", F.lit(True))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("node", "size", "hub_size")]
    own = _among(sets, "node", hubs, hubs.count()).withColumnRenamed("node", "hub").join(hubs, "hub")
    own = own.select("hub", *nothing, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "shingles", F.lit(False).alias("is_node"))
    # Few pairs are dealt without a number of partitions, so that adaptive execution merges the many small ones of a late round.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = (tasks,) if pairs.count() > tasks * MEMBERS else ()
    dealt = nodes.unionByName(own).repartition(*many, "hub", "part").sortWithinPartitions("hub", "part", "is_node")
    return dealt.select("hub", "node", "size", "hub_size", "is_node", "shingles").mapInArrow(run, "hub long, node long, size long, hub_size long, shared long")


def _sets_of(pairs: DataFrame, docs: DataFrame, members: DataFrame, n: int, have: DataFrame | None) -> DataFrame:
    """``have`` and the sets of those nodes of ``pairs`` that it lacks, made from one document of each (and those without
    a doc_id). The doc_ids are broadcast if they are few enough, so that no other text moves."""
    wanted = pairs.select("node").union(pairs.select("hub")).distinct()
    if have is not None:
        wanted = wanted.join(have.select("node"), "node", "left_anti")
    wanted = written(members.join(wanted, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "wanted")
    count = wanted.count()
    if not count and have is not None:
        return have
    some = _among(docs, "doc_id", wanted.select("doc_id").where("doc_id IS NOT NULL").distinct(), count)
    if not wanted.where("doc_id IS NULL").isEmpty():
        some = some.unionByName(docs.where("doc_id IS NULL"))
    found = _among(_sets(some, n), "node", wanted.select("node"), count).groupBy("node").agg(F.first("shingles").alias("shingles"))
    found = written(found, "sets", "uncompressed")
    return found if have is None else have.unionByName(found)


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, root): the least node of each node's component, by large-star and small-star steps until nothing changes."""
    edges = written(edges.select(F.col("a"), F.col("b")), label)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: every edge points from the larger to the smaller node.
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("s"), "m").select(F.col("s.x").alias("a"), F.col("m").alias("b"))
        last, edges = edges, written(small.where("a <> b").distinct(), label)
        drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _parted(per_bucket: DataFrame) -> DataFrame:
    """Rows of one or few for each bucket, once for each part of the bucket."""
    return per_bucket.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _with_part(members: DataFrame) -> DataFrame:
    return members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; sets link at a Jaccard similarity of ``num / den``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    first = written(_first_pass(docs, n), "documents")
    members = first.where("cell IS NULL").select("doc_id", "size", "node")
    nodes = first.where("node IS NOT NULL").groupBy("node").agg(F.first("size").alias("size"), F.first("ranges").alias("ranges"))
    nodes = written(nodes, "nodes")

    uses = np.zeros(1 << CELLS, np.int32)  # its size is fixed, whatever the input
    often = first.where("cell IS NOT NULL").groupBy("cell").agg(F.least(F.sum("uses"), F.lit(2**31 - 1)).alias("uses")).toArrow()
    uses[often.column("cell").to_numpy()] = often.column("uses").to_numpy()
    histogram = {r["size"]: r.n for r in nodes.where(F.col("size") <= 2 * LARGEST_LIGHT).groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = nodes.agg(F.sum("size")).first()[0] or 0
    bound = boundary(histogram, float((uses.astype(float) ** 2).sum() / max(total, 1)), num, den)

    rows = nodes.agg(F.sum(F.least("size", F.lit(4 * LARGEST_LIGHT)) * F.lit((den - num) / den) + 1)).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = max(MEMBERS, int(rows / tasks / 4))

    # The one shuffle of all signatures: those alone in their bucket go, and so do second rows of a node.
    raw = _with_part(_signatures(docs, n, uses, bound, hot, num, den))
    order = Window.partitionBy("bucket", "part").orderBy("node")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    raw = raw.withColumns({"here": F.count("*").over(group), "lo": F.first("node").over(group), "hi": F.last("node").over(group), "before": F.lag("node").over(order)})
    shared = raw.where("(parts > 1 OR lo <> hi) AND (before IS NULL OR before <> node)")
    parts = F.when(F.col("parts") > 1, F.col("parts")).otherwise(F.ceil(F.col("here") / MEMBERS)).cast("int").alias("parts")
    size, pos = F.shiftright("place", 32).alias("size"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos")
    shared = shared.select("bucket", "node", size, pos, parts)
    buckets = written(shared.withColumn("central", F.count("*").over(Window.partitionBy("node")) / F.col("size")), "buckets")

    # In every round hubs meet their bucket's members: first its most central member does.
    top = F.max(F.struct("central", F.col("size").alias("hub_size"), F.col("node").alias("hub"), F.col("pos").alias("hub_pos"))).alias("top")
    tops = buckets.groupBy("bucket").agg(top, F.count("*").alias("m"), F.max("parts").alias("parts")).where("m > 1").select("bucket", "top.hub", "top.hub_size", "top.hub_pos", "m", "parts")
    least = F.ceil((num * (F.col("size") + F.col("hub_size"))) / (num + den))
    # Sizes allow a link, and so do the places of the bucket's shingle, should it be the first that they share.
    compatible = (den * F.least("size", "hub_size") >= num * F.greatest("size", "hub_size")) & (F.col("hub") != F.col("node"))
    fits = compatible & (F.least(F.col("size") - F.col("pos"), F.col("hub_size") - F.col("hub_pos")) >= least)
    linked = (num + den) * F.col("shared") >= num * (F.col("size") + F.col("hub_size"))
    possible = (num + den) * F.col("most") >= num * (F.col("size") + F.col("hub_size"))
    apart = lambda shared: 1 - F.col(shared) / (F.col("size") + F.col("hub_size") - F.col(shared))
    # A bucket of two is done once they have met.
    met = written(_with_part(buckets.drop("central")).join(_parted(tops), ["bucket", "part"]).withColumn("fits", fits).where("fits OR m > 2"), "members")
    drop(buckets)
    bounded = _bounded(met.where("fits").select("hub", "node").distinct(), nodes)
    pairs = bounded.where(possible)
    sets = _sets_of(pairs, docs, members, n, None)
    seen = written(_compare(pairs, sets).select("hub", "node", apart("shared").alias("near"), apart("shared").alias("far"), linked.alias("linked")), "compared")
    roots = components(seen.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    # Each member's distance to its bucket's first hub lies between near and far: by comparison, by bound, or by the sizes.
    known = seen.drop("linked").unionByName(bounded.where(~possible).select("hub", "node", apart("most").alias("near"), F.lit(1.0).alias("far")))
    active = _open(met.where("m > 2").drop("fits", "part"), roots).join(known, ["hub", "node"], "left")
    self_ = F.col("hub") == F.col("node")
    near = F.when(self_, 0.0).otherwise(F.coalesce("near", 1 - F.least("size", "hub_size") / F.greatest("size", "hub_size")))
    far = F.when(self_, 0.0).otherwise(F.coalesce("far", F.lit(1.0)))
    # Members whose share of the hash lies below high / m become hubs; those below low / m have been.
    turn = F.pmod(F.xxhash64("bucket", "node"), F.lit(1 << 30)) * F.col("m") / (1 << 30)
    active = active.select("bucket", "node", "pos", "size", "m", "parts", "root", near.alias("near"), far.alias("far"), turn.alias("turn"))

    low, high, last = 0.0, float(GROWTH), (met, bounded, seen)
    while True:
        active = written(active, "active")
        drop(*last)
        if active.isEmpty():
            break
        hubs = active.where((F.col("turn") >= low) & (F.col("turn") < high)).select("bucket", "parts", *[F.col(c).alias(f"hub_{c}" if c != "node" else "hub") for c in ("node", "pos", "size", "root", "near", "far")])
        reach = (den - num) / den + 1e-9
        out = (F.col("near") - F.col("hub_far") > reach) | (F.col("hub_near") - F.col("far") > reach)
        pairs = _with_part(active).join(_parted(hubs), ["bucket", "part"]).where(fits & (F.col("root") != F.col("hub_root")) & ~out)
        bounded = _bounded(pairs.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")).distinct(), nodes)
        pairs = bounded.where(possible)
        if not pairs.isEmpty():
            sets = _sets_of(pairs, docs, members, n, sets)
            found = written(_compare(pairs, sets).where(linked).select(F.col("hub").alias("a"), F.col("node").alias("b")), "links")
            if not found.isEmpty():
                roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
        # A bucket with as many members as hubs had their turn is done; so is one that is a single component.
        last = (active, bounded)
        active = _open(active.where(F.col("m") > high).drop("root"), roots)
        low, high = high, high * GROWTH
    drop(nodes)
    whole = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Written, so that the join below has no aggregation in its stage and adaptive execution can split a large component.
    ids = written(whole.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    return whole.join(ids, "root", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _open(active: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with their components' roots, of buckets that are not one component yet."""
    active = active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    state = active.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("parts").alias("parts")).where("lo <> hi").select("bucket", "parts")
    return _with_part(active).join(_parted(state), ["bucket", "part"]).drop("part")
