"""Typed parameters: the differences of a node from its type's signature (B9), nodes joined to signatures with hot types split (C1), and
observations and statistics of parameters (C3, D1-D4).

Values are VARIANTs whose type depends on the parameter: numbers, vectors, strings, flags, colour ramps and curves. They are compared by
value, not as text: 1 equals 1.0. A ramp or curve falls apart into its fields; stops and points are lists of vectors.

Signatures are rows of (sig_key, category, pos, name, dtype, default, min, max, enum), categories being input, output and attr. A type
has tens of slots, so a type's slots are one array, and a node meets them in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

#: Types that are broadcast at most; more are joined by shuffle.
TYPES = 20_000
#: Nodes of a type that one task takes; a type with more is dealt over several.
HOT = 200_000
#: Types whose outputs are parameters, the group type, the bound of a range, and what a ramp's texts may be.
VALUES = ("ShaderNodeValue", "ShaderNodeRGB")
GROUP = "ShaderNodeGroup"
BOUND = 1e4
RAMP = {"mode": ["RGB", "HSV", "HSL"], "interp": ["EASE", "CARDINAL", "LINEAR", "B_SPLINE", "CONSTANT"], "hue_interp": ["NEAR", "FAR", "CW", "CCW"]}


def sig_key(kind: Column, group: Column) -> Column:
    """The key of a node's signature: its type, or its group's."""
    return F.when(kind == GROUP, F.concat(F.lit("node_groups/"), group)).otherwise(kind)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, whatever the number of times it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def typed(value: Column) -> Column:
    """A value by its type; null for no value. Whole numbers and others are alike, and -0 is 0."""
    plain = lambda x: x + F.lit(0.0)

    def read(kind: Column) -> Column:
        get = lambda k, t: F.when(kind == k, F.try_variant_get(value, "$", t))
        vec, pts = get("vec", "array<double>"), get("pts", "array<array<double>>")
        parts = {"num": plain(get("num", "double")), "text": get("text", "string"), "flag": get("flag", "boolean"), "vec": F.transform(vec, plain), "pts": F.transform(pts, lambda p: F.transform(p, plain))}
        # With its names as arguments, since aliases get lost inside a lambda.
        return F.when(kind.isNotNull(), F.named_struct(F.lit("kind"), kind, *[x for n, c in parts.items() for x in (F.lit(n), c)]))

    return _once(_once(F.schema_of_variant(value), _kind), read)


def _kind(schema: Column) -> Column:
    return (
        F.when(schema.isNull() | (schema == "VOID"), None)
        .when(schema == "STRING", "text")
        .when(schema == "BOOLEAN", "flag")
        .when(schema.startswith("ARRAY<ARRAY"), "pts")
        .when(schema.startswith("ARRAY"), "vec")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("num")
    )


def fields(value: Column) -> Column:
    """The fields of a value: those of a ramp or curve, else one without a name."""
    one = lambda name: F.named_struct(F.lit("field"), F.lit(name), F.lit("value"), F.try_variant_get(value, f"$.{name}", "variant"))
    curves = F.coalesce(F.try_variant_get(value, "$.curves", "array<variant>"), F.array().cast("array<variant>"))
    curve = F.concat(F.array(one("use_clip")), F.transform(curves, lambda c, i: F.named_struct(F.lit("field"), F.concat(F.lit("curves_"), i), F.lit("value"), c)))

    def read(schema: Column) -> Column:
        is_object = schema.startswith("OBJECT")
        return (
            F.when(is_object & schema.contains("elements:"), F.array(*[one(n) for n in (*RAMP, "elements")]))
            .when(is_object, curve)
            .otherwise(F.array(F.named_struct(F.lit("field"), F.lit(""), F.lit("value"), value)))
        )

    return _once(F.schema_of_variant(value), read)


def _whole(value: Column) -> Column:
    return F.transform(fields(value), lambda f: F.named_struct(F.lit("field"), f["field"], F.lit("v"), typed(f["value"])))


def same(a: Column, b: Column) -> Column:
    """Whether two values are equal by type and value; none equals none."""
    return _whole(a).eqNullSafe(_whole(b))


def slots(signatures: DataFrame) -> DataFrame:
    """(sig_key, slots): a type's parameters, numbered over its inputs, the outputs of value nodes, and the attributes that all but groups
    have, with the range or the words that their values should keep to."""
    value_node, group = F.col("sig_key").isin(*VALUES), F.col("sig_key").startswith("node_groups/")
    counted = signatures.groupBy("sig_key").agg(F.count_if(F.col("category") == "input").alias("_in"), F.count_if(F.col("category") == "output").alias("_out"))
    rows = signatures.join(counted, "sig_key").where((F.col("category") == "input") | ((F.col("category") == "output") & value_node) | ((F.col("category") == "attr") & ~group))
    number = F.when(F.col("category") == "input", 0).when(F.col("category") == "output", F.col("_in")).otherwise(F.col("_in") + F.when(value_node, F.col("_out")).otherwise(0)) + F.col("pos")
    attr, dtype = F.col("category") == "attr", F.col("dtype")
    ranged = F.when(attr, F.col("enum").isNull() & (F.col("min").isNotNull() | F.col("max").isNotNull()) & dtype.isin("float", "int")).otherwise(dtype != "String")
    colour = ~attr & dtype.startswith("Color")
    low, high = (F.when(ranged, F.coalesce(F.col(c), F.when(colour, F.lit(unit)).otherwise(F.lit(bound)))) for c, unit, bound in (("min", 0.0, -BOUND), ("max", 1.0, BOUND)))
    words = F.when(attr & (dtype == "str"), F.col("enum"))
    # The default's fields are read here, once a type, and not once a node.
    slot = F.struct(number.cast("int").alias("id"), "category", "name", "dtype", "default", _whole(F.col("default")).alias("usual"), low.alias("low"), high.alias("high"), words.alias("words"))
    listed = rows.groupBy("sig_key").agg(F.collect_list(slot).alias("slots"))
    # In the order of their numbers, so that a number is a place.
    place = F.sequence(F.lit(0), F.array_max(F.transform("slots", lambda x: x["id"])))
    return listed.select("sig_key", F.transform(place, lambda k: F.get(F.filter("slots", lambda x: x["id"] == k), 0)).alias("slots"))


def with_slots(nodes: DataFrame, types: DataFrame, hot: int = HOT, how: str = "inner") -> DataFrame:
    """``nodes`` (with sig_key) joined to the slots of their types (C1). Few types are broadcast; else both sides are shuffled, and nodes
    of a type with more than ``hot`` of them are dealt over several copies of its row."""
    if types.limit(TYPES + 1).count() <= TYPES:
        return nodes.join(F.broadcast(types), "sig_key", how)
    # At most one type for each ``hot`` nodes, so this is small.
    parts = nodes.groupBy("sig_key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("sig_key", F.ceil(F.col("n") / hot).cast("int").alias("_parts"))
    # By a hash of the node's own columns, so that a task that runs again deals its rows alike.
    plain = [f.name for f in nodes.schema if isinstance(f.dataType, (StringType, IntegralType))]
    spread = F.coalesce(F.pmod(F.xxhash64(*plain), F.col("_parts")).cast("int"), F.lit(0))
    left = nodes.join(F.broadcast(parts), "sig_key", "left").withColumn("_part", spread).drop("_parts")
    right = types.join(F.broadcast(parts), "sig_key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, ["sig_key", "_part"], how).drop("_part")


def without_signature(nodes: DataFrame, signatures: DataFrame) -> DataFrame:
    """Nodes whose type has no signature, with the reason."""
    kept = nodes.withColumn("sig_key", sig_key(F.col("type"), F.col("group_type"))).join(signatures.select("sig_key").distinct(), "sig_key", "left_anti")
    return kept.withColumn("reason", F.concat(F.lit("Node type signature not found for '"), F.coalesce("sig_key", F.lit("")), F.lit("'")))


def analysed(nodes: DataFrame, signatures: DataFrame, hot: int = HOT) -> DataFrame:
    """Nodes with their ``linked_input`` and the ``params`` that differ from their types' defaults (B9). ``nodes`` has type, group_type and
    the whole ``state``: an array of (category, pos, name, linked, value). Linked inputs are only listed; other slots are held against the
    signature by number. Where a name is not the signature's, ``problem`` says so."""
    value_node = F.col("type").isin(*VALUES)
    of_kind = lambda c: F.size(F.filter("state", lambda s: s["category"] == c))
    keyed = nodes.withColumn("sig_key", sig_key(F.col("type"), F.col("group_type"))).withColumns({"_in": of_kind("input"), "_out": F.when(value_node, of_kind("output")).otherwise(0)})
    met = with_slots(keyed, slots(signatures), hot)
    number = lambda s: s["pos"] + F.when(s["category"] == "input", 0).when(s["category"] == "output", F.col("_in")).otherwise(F.col("_in") + F.col("_out"))
    of = lambda s: F.get("slots", number(s).cast("int"))
    seen = F.filter("state", lambda s: (s["category"] == "input") | ((s["category"] == "output") & value_node) | ((s["category"] == "attr") & (F.col("type") != GROUP)))
    free = F.filter(seen, lambda s: ~((s["category"] == "input") & F.coalesce(s["linked"], F.lit(False))))
    linked = F.transform(F.filter("state", lambda s: (s["category"] == "input") & F.coalesce(s["linked"], F.lit(False))), lambda s: s["pos"])
    held = F.transform(free, lambda s: F.named_struct(F.lit("id"), number(s).cast("int"), F.lit("given"), s["name"], F.lit("name"), of(s)["name"], F.lit("value"), s["value"], F.lit("same"), _whole(s["value"]).eqNullSafe(of(s)["usual"])))
    wrong = F.filter("_held", lambda h: ~h["given"].eqNullSafe(h["name"]))
    problem = F.when(F.size(wrong) > 0, F.concat(F.lit("Slot name mismatch: '"), F.get(wrong, 0)["given"], F.lit("' != '"), F.coalesce(F.get(wrong, 0)["name"], F.lit("")), F.lit("'")))
    params = F.transform(F.filter("_held", lambda h: ~h["same"]), lambda h: F.named_struct(F.lit("id"), h["id"], F.lit("name"), h["name"], F.lit("value"), h["value"]))
    out = met.withColumn("_held", held).withColumns({"linked_input": linked, "params": params, "problem": problem})
    return out.select(*[c for c in nodes.columns if c != "state"], "linked_input", "params", "problem")


def observations(nodes: DataFrame, signatures: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """Every observation of a parameter (C3): (keys, sig_key, id, name, field, value, implied, is_default, outlier). ``nodes`` has type,
    group_type, linked_input and params, those that differ from the default; the others are implied. Linked slots are left out, and
    those without a default. Only recorded values can be outliers: a component outside the range, or a word that is not listed."""
    keyed = nodes.withColumn("sig_key", sig_key(F.col("type"), F.col("group_type"))).select(*keys, "sig_key", "linked_input", "params")
    met = with_slots(keyed, slots(signatures), hot).withColumn("s", F.explode("slots")).drop("slots")
    met = met.where(~F.array_contains("linked_input", F.col("s.id")) & ((F.col("s.category") == "attr") | (F.schema_of_variant("s.default") != "VOID")))
    given = F.get(F.filter("params", lambda p: p["id"] == F.col("s.id")), 0)["value"]
    met = met.select(*keys, "sig_key", "s", given.alias("given")).withColumn("implied", F.col("given").isNull())
    met = met.withColumn("f", F.explode(F.when(F.col("implied"), F.col("s.usual")).otherwise(_whole(F.col("given")))))
    met = met.withColumns({"value": F.col("f.v"), "own": F.get(F.filter("s.usual", lambda u: u["field"] == F.col("f.field")), 0)["v"]})
    name, ends = F.col("f.field"), F.col("own.pts")
    curve = name.startswith("curves_")
    low = F.when(curve, F.get(F.get(ends, 0), 0)).when(name == "elements", 0.0).otherwise(F.col("s.low"))
    high = F.when(curve, F.get(F.get(ends, F.size(ends) - 1), 0)).when(name == "elements", 1.0).otherwise(F.col("s.high"))
    words = F.coalesce(*[F.when(name == n, F.array(*map(F.lit, w))) for n, w in RAMP.items()], F.when(name == "", F.col("s.words")))
    numbers = components(F.col("value"))
    outside = F.coalesce(F.exists(numbers, lambda x: (x < F.col("low")) | (x > F.col("high"))), F.lit(False)) | F.coalesce(~F.array_contains("words", F.col("value.text")), F.lit(False))
    out = met.withColumns({"low": low, "high": high, "words": words})
    out = out.withColumns({"is_default": F.col("value").eqNullSafe(F.col("own")), "outlier": ~F.col("implied") & outside})
    return out.select(*keys, "sig_key", F.col("s.id").alias("id"), F.col("s.name").alias("name"), name.alias("field"), "value", "implied", "is_default", "outlier")


def components(value: Column) -> Column:
    """The numbers of a typed value, one after the other; null for words and flags."""
    return F.when(value["kind"] == "num", F.array(value["num"])).when(value["kind"] == "vec", value["vec"]).when(value["kind"] == "pts", F.flatten(value["pts"]))


def counters(observed: DataFrame, digits: int = 6, weight: str | None = None) -> DataFrame:
    """Per parameter: observations, those at the default, outliers, and the range over all components (D1, D4). With ``weight``, a row stands
    for so many observations."""
    numbers = components(F.col("value"))
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    count = lambda which: F.sum(F.when(which, times).otherwise(0))
    return observed.groupBy("sig_key", "id", "name", "field").agg(
        F.sum(times).alias("n"), count(F.col("is_default")).alias("default_count"), count(F.col("outlier")).alias("outlier_count"), F.round(F.min(F.array_min(numbers)), digits).alias("lo"), F.round(F.max(F.array_max(numbers)), digits).alias("hi")
    )


def moments(observed: DataFrame, digits: int = 6) -> DataFrame:
    """Per parameter, number of stops or points (0 for numbers and vectors) and component: observations, mean, population deviation
    (D1, D3)."""
    length = F.when(F.col("value.kind") == "pts", F.size("value.pts")).otherwise(0)
    flat = observed.select("sig_key", "id", "field", length.alias("length"), F.posexplode(components(F.col("value"))).alias("pos", "x"))
    return flat.groupBy("sig_key", "id", "field", "length", "pos").agg(F.count("*").alias("n"), F.round(F.avg("x"), digits).alias("mean"), F.round(F.stddev_pop("x"), digits).alias("std"))


def categories(observed: DataFrame) -> DataFrame:
    """Per parameter and word or flag: how often."""
    word = F.coalesce("value.text", F.col("value.flag").cast("string"))
    return observed.select("sig_key", "id", "field", word.alias("word")).where("word IS NOT NULL").groupBy("sig_key", "id", "field", "word").agg(F.count("*").alias("n"))


def with_unseen(counted: DataFrame, signatures: DataFrame) -> DataFrame:
    """:func:`counters` with the parameters of seen types that no node left free, which count as one observation of the default."""
    every = slots(signatures).join(counted.select("sig_key").distinct(), "sig_key", "left_semi").select("sig_key", F.explode("slots").alias("s"))
    every = every.where((F.col("s.category") == "attr") | (F.schema_of_variant("s.default") != "VOID"))
    every = every.select("sig_key", F.col("s.id").alias("id"), F.col("s.name").alias("name"), F.explode("s.usual").alias("f")).withColumn("v", F.col("f.v"))
    numbers = components(F.col("v"))
    one = every.select("sig_key", "id", "name", F.col("f.field").alias("field"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("default_count"), F.lit(0).cast("long").alias("outlier_count"), F.array_min(numbers).alias("lo"), F.array_max(numbers).alias("hi"))
    return counted.unionByName(one.join(counted, ["sig_key", "id", "name", "field"], "left_anti"))
