"""Small graphs, one for each material: orders, pass-through nodes, constants and value conversion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import written


def ordered(links: DataFrame, material: str, root: str, order: str = "pre") -> DataFrame:
    """(material, node, pos): nodes reachable from each material's root against the links' direction, by input slot: depth-first
    before (``pre``) or after (``post``) their inputs, breadth-first (``bfs``), or breadth-first reversed (``reversed``). ``links`` has the material, ``from_node``,
    ``to_node``, ``to_slot`` and the column ``root``. A graph has a few hundred nodes at most, so one is walked in a task."""

    def walk(start, sources, targets) -> list:
        inputs: dict = {}
        for a, b in zip(sources, targets, strict=True):
            inputs.setdefault(b, []).append(a)
        seen, out = set(), []
        if order in ("bfs", "reversed"):
            out.append(start)
            seen.add(start)
            for n in out:
                fresh = [m for m in dict.fromkeys(inputs.get(n, [])) if m not in seen]
                seen.update(fresh)
                out.extend(fresh)
            return out[::-1] if order == "reversed" else out
        stack = [(start, False)]
        while stack:
            n, done = stack.pop()
            if done:
                out.append(n)
            elif n not in seen:
                seen.add(n)
                if order == "pre":
                    out.append(n)
                else:
                    stack.append((n, True))
                stack.extend((m, False) for m in reversed(inputs.get(n, [])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by material; one that goes on in the next batch waits for its other rows.
        held: tuple | None = None
        names = [material, "node", "pos"]

        def emit(parts: list[tuple]) -> pa.RecordBatch:
            found = [(m, walk(r, s, t)) for m, r, s, t in parts]
            sizes = [len(x) for _, x in found]
            keys = pa.array([m for m, n in zip((m for m, _ in found), sizes, strict=True) for _ in range(n)], kinds[material])
            return pa.record_batch([keys, pa.array([n for _, x in found for n in x], kinds["from_node"]), pa.array([k for n in sizes for k in range(n)], pa.int64())], names)

        for batch in batches:
            parts = []
            for m, r, a, b in zip(*(batch.column(c).to_pylist() for c in (material, root, "from_node", "to_node")), strict=True):
                if held is None or held[0] != m:
                    if held is not None:
                        parts.append(held)
                    held = (m, r, [], [])
                held[2].append(a)
                held[3].append(b)
            yield emit(parts)
        if held is not None:
            yield emit([held])

    kinds = {f.name: to_arrow_type(f.dataType) for f in links.schema}
    types = {f.name: f.dataType.simpleString() for f in links.schema}
    near = links.where(F.col(material).isNotNull()).repartition(material).sortWithinPartitions(material, "to_node", "to_slot", "from_node")
    return near.select(material, root, "from_node", "to_node").mapInArrow(run, f"{material} {types[material]}, node {types['from_node']}, pos long")


def _marked(links: DataFrame, nodes: DataFrame, material: str, end: str, flag: str, *more: str) -> DataFrame:
    """``links`` with ``flag``: whether the node at an end is one of ``nodes``."""
    known = nodes.select(material, F.col("node").alias(end), *more, F.lit(True).alias(flag))
    return links.join(known, [material, end], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def contracted(links: DataFrame, passing: DataFrame, material: str) -> DataFrame:
    """Links with pass-through nodes taken out: each source meets each target (J3). ``passing`` has (material, node).

    Links that touch no pass-through node stay as they are, and are read once. From each other source only what has reached a
    pass-through node goes on, a hop a round, until nothing new is reached; so a round moves the frontier and the links out of
    pass-through nodes, and rounds are as many as the longest chain."""
    through = passing.select(material, "node").distinct()
    columns = [material, "from_node", "from_slot", "to_node", "to_slot"]
    marked = written(_marked(_marked(links.select(*columns), through, material, "from_node", "_from"), through, material, "to_node", "_to"), "links")
    out = marked.where("NOT _from AND NOT _to").select(*columns)
    hops = marked.where("_from").select(material, F.col("from_node").alias("_mid"), F.col("to_node").alias("_next"), F.col("to_slot").alias("_slot"), F.col("_to").alias("_on"))
    at = [material, "from_node", "from_slot", "_mid"]
    frontier = written(marked.where("NOT _from AND _to").select(material, "from_node", "from_slot", F.col("to_node").alias("_mid")).distinct(), "frontier")
    seen = frontier
    while frontier.take(1):
        step = frontier.join(hops, [material, "_mid"])
        ends = written(step.where("NOT _on").select(material, "from_node", "from_slot", F.col("_next").alias("to_node"), F.col("_slot").alias("to_slot")).distinct(), "ends")
        out = out.unionByName(ends.where("from_node <> to_node"))
        frontier = written(step.where("_on").select(material, "from_node", "from_slot", F.col("_next").alias("_mid")).distinct().join(seen, at, "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return out.distinct()


def folded(links: DataFrame, constants: DataFrame, material: str) -> tuple[DataFrame, DataFrame]:
    """Links without those from constant nodes, and the parameter rows (material, node, slot, value) that take their place."""
    known = constants.select(material, F.col("node").alias("from_node"), "value")
    params = links.join(known, [material, "from_node"]).select(material, F.col("to_node").alias("node"), F.col("to_slot").alias("slot"), "value")
    return links.join(known, [material, "from_node"], "left_anti"), params


def folded_typed(links: DataFrame, constants: DataFrame, passing: DataFrame, material: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Constants folded into the sockets that they feed, as these sockets have them (J4): the links that are left, the parameter rows
    (material, node, slot, value), and what does not fit (material, node, slot, kind, to_kind).

    ``links`` has ``to_kind``, what its target socket takes: float, vector, color or shader. ``constants`` has (material, node, value, kind),
    the value an array of numbers; ``passing`` has (material, node, kind): such a node hands a value on as its own kind. Constants go
    hop by hop, a round each, until none goes on. A shader can't be set, so a constant that feeds one becomes an emission node,
    one for each constant: its number is -1 - the constant's, which no other node has and every task gives alike; its colour (slot 0)
    is the constant's."""
    through = passing.select(material, "node", F.col("kind").alias("_as"))
    marked = written(_marked(links, through, material, "to_node", "_on", "_as"), "links")
    start = constants.select(material, F.col("node").alias("_origin"), F.col("node").alias("from_node"), "value", "kind")
    at = [material, "_origin", "from_node", "value", "kind"]
    frontier = written(start, "frontier")
    seen, reached = frontier, None
    while frontier.take(1):
        step = written(frontier.join(marked, [material, "from_node"]), "step")
        reached = step.where("NOT _on") if reached is None else reached.unionByName(step.where("NOT _on"))
        lost = step.where("_on").withColumn("value", convert("kind", "_as"))
        reached = reached.unionByName(lost.where("value IS NULL").withColumn("to_kind", F.col("_as")))
        frontier = written(lost.where("value IS NOT NULL").select(material, "_origin", F.col("to_node").alias("from_node"), "value", F.col("_as").alias("kind")).distinct().join(seen, at, "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    left = links.join(seen.select(material, "from_node").distinct(), [material, "from_node"], "left_anti")
    if reached is None:
        return left, links.select(material, F.col("to_node").alias("node"), F.col("to_slot").alias("slot"), F.array().cast("array<double>").alias("value")).limit(0), links.select(material, F.col("to_node").alias("node"), F.col("to_slot").alias("slot"), F.lit("").alias("kind"), "to_kind").limit(0)
    shaders = reached.where("to_kind = 'shader' AND NOT _on")
    others = reached.where("to_kind <> 'shader' OR _on").withColumn("_set", F.when(~F.col("_on"), convert("kind", "to_kind")))
    target = [material, F.col("to_node").alias("node"), F.col("to_slot").alias("slot")]
    params = others.where("_set IS NOT NULL").select(*target, F.col("_set").alias("value")).distinct()
    wrong = others.where("_set IS NULL").select(*target, "kind", "to_kind").distinct()
    number = -1 - F.col("_origin")
    own = start.join(shaders.select(material, "_origin").distinct(), [material, "_origin"], "left_semi")
    params = params.unionByName(own.select(material, number.alias("node"), F.lit(0).cast(links.schema["to_slot"].dataType).alias("slot"), convert("kind", F.lit("color")).alias("value")))
    lit = shaders.select(material, number.alias("from_node"), F.lit(0).cast(links.schema["from_slot"].dataType).alias("from_slot"), "to_node", "to_slot", "to_kind").distinct()
    return left.select(*lit.columns).unionByName(lit), params, wrong


def slots_renamed(rows: DataFrame, nodes: DataFrame, names: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """Parameters or link ends of replaced nodes under the slots of their new types (J5): ``nodes`` has the keys and ``replacement``, ``names``
    the small table (replacement, slot, new_slot). Rows of slots that the new type does not have go; those of other nodes stay."""
    of = nodes.where("replacement IS NOT NULL").select(*keys, "replacement")
    met = rows.join(of, keys, "left").join(F.broadcast(names.withColumnRenamed("slot", slot)), ["replacement", slot], "left")
    return met.where("replacement IS NULL OR new_slot IS NOT NULL").withColumn(slot, F.coalesce("new_slot", slot)).select(*rows.columns)


KINDS = ("float", "vector", "color")


def convert(kind: str, target: str | Column) -> Column:
    """The column ``value`` of the kind in one column as that of another has it (H25); null if they do not fit."""
    target = F.col(target) if isinstance(target, str) else target
    return F.coalesce(*[F.when((F.col(kind) == a) & (target == b), converted(F.col("value"), a, b)) for a in KINDS for b in KINDS])


def replaced(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Undefined nodes, with the known type whose ordered slots are the same (J5); null where none is. ``known`` is the small table (type, slots)."""
    return nodes.join(F.broadcast(known.groupBy("slots").agg(F.min("type").alias("replacement"))), "slots", "left")


def converted(value: Column, source: str, target: str) -> Column:
    """A socket's value, an array of numbers, as another kind has it: float, vector or color (H25). Null if they do not fit."""
    first = F.element_at(value, 1)
    rgb = F.slice(value, 1, 3)
    mean = F.aggregate(rgb, F.lit(0.0), lambda s, x: s + x) / F.size(rgb)
    clipped = F.transform(rgb, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    one = F.least(F.greatest(first, F.lit(0.0)), F.lit(1.0))
    table = {
        ("float", "vector"): F.array_repeat(first, 3),
        ("float", "color"): F.concat(F.array_repeat(one, 3), F.array(F.lit(1.0))),
        ("vector", "float"): F.array(mean),
        ("vector", "color"): F.concat(clipped, F.array(F.lit(1.0))),
        ("color", "float"): F.array(mean),
        ("color", "vector"): rgb,
    }
    return value if source == target else table.get((source, target), F.lit(None).cast("array<double>"))
