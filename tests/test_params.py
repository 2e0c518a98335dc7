import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from matterloom.operators import params
from matterloom.plans import params as plan
from matterloom.sources import corpus

from .conftest import SF

NODE = "mat_name string, node_pos int, type string, group_type string, linked_input array<int>, json string"
SIG = "sig_key string, category string, pos int, name string, dtype string, json string, min double, max double, enum array<string>"


def nodes(spark, rows):
    made = F.from_json("json", "array<struct<id: int, name: string, value: variant>>")
    return spark.createDataFrame(rows, NODE).withColumn("params", made)


def signatures(spark, rows):
    return spark.createDataFrame(rows, SIG).withColumn("default", F.parse_json("json")).drop("json")


BASE = [("TypeNum", "input", 0, "Scale", "FloatFactor", "1.0", 0.0, 10.0, None), ("TypeNum", "input", 1, "Detail", "Float", "2.0", None, None, None)]


@pytest.mark.parametrize("types", [params.TYPES, 0])
def test_statistics_of_the_fixture(spark, monkeypatch, types):
    monkeypatch.setattr(params, "TYPES", types)
    rows = [("s/a", 0, "TypeNum", None, [1], '[{"id": 0, "name": "Scale", "value": 5.0}]'), ("s/b", 0, "TypeNum", None, [], "[]"), ("s/c", 0, "TypeNum", None, [], '[{"id": 0, "name": "Scale", "value": 12.0}, {"id": 1, "name": "Detail", "value": 2}]'), ("s/c", 1, "ShaderNodeGroup", "G1", [], "[]")]
    sig = signatures(spark, BASE)
    seen = params.observations(nodes(spark, rows), sig, ["mat_name", "node_pos"], hot=1)
    got = {r.id: r for r in params.counters(seen).collect()}
    assert [(r.n, r.default_count, r.outlier_count, r.lo, r.hi) for r in (got[0], got[1])] == [(3, 1, 1, 1.0, 12.0), (2, 2, 0, 2.0, 2.0)]
    assert {r.id: (r["mean"], r["std"]) for r in params.moments(seen).collect()} == {0: (6.0, 4.546061), 1: (2.0, 0.0)}
    assert [(r.mat_name, r.node_pos, r.reason) for r in params.without_signature(nodes(spark, rows), sig).collect()] == [("s/c", 1, "Node type signature not found for 'node_groups/G1'")]


def test_values_are_equal_by_type_and_value(spark):
    pairs = [("1", "1.0", True), ("1", "1.5", False), ("[1, 2.0]", "[1.0, 2]", True), ("[1, 2]", "[1, 2, 3]", False), ('"1"', "1", False), ("true", "true", True), ("true", "false", False), ("-0.0", "0", True), ("null", "null", True), ("null", "0", False)]
    ramp = {"mode": "RGB", "interp": "LINEAR", "hue_interp": "NEAR", "elements": [[0, 0, 0, 0, 1], [1, 1, 1, 1, 1]]}
    curve = {"use_clip": True, "curves": [[[0, 0], [1, 1]], [[0, 0.5], [1, 1]]]}
    pairs += [(json.dumps(ramp), json.dumps({**ramp, "elements": [[0.0, 0, 0, 0, 1], [1.0, 1, 1, 1, 1]]}), True), (json.dumps(ramp), json.dumps({**ramp, "mode": "HSV"}), False), (json.dumps(ramp), json.dumps({**ramp, "elements": ramp["elements"][:1]}), False)]
    pairs += [(json.dumps(curve), json.dumps(curve).replace("1]", "1.0]"), True), (json.dumps(curve), json.dumps({**curve, "curves": curve["curves"][:1]}), False), (json.dumps(curve), json.dumps(ramp), False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = df.select("a", "b", "want", params.same(F.parse_json("a"), F.parse_json("b")).alias("same")).collect()
    assert all(r.want == r.same for r in got), [r for r in got if r.want != r.same]


def test_slots_are_numbered_over_inputs_outputs_and_attributes(spark):
    rows = [*BASE, ("TypeNum", "output", 0, "Out", "Float", None, None, None, None), ("TypeNum", "attr", 0, "mode", "str", '"A"', None, None, ["A", "B"])]
    rows += [("ShaderNodeRGB", "output", 0, "Color", "Color", "[0, 0, 0, 1]", None, None, None), ("ShaderNodeRGB", "attr", 0, "flag", "bool", "true", None, None, None), ("node_groups/G", "input", 0, "x", "Float", "0", None, None, None), ("node_groups/G", "attr", 0, "y", "str", '"a"', None, None, None)]
    got = {(r.sig_key, r.id): (r.name, r.low, r.high, r.words) for r in params.slots(signatures(spark, rows)).select("sig_key", F.explode("slots").alias("s")).select("sig_key", "s.*").collect()}
    assert got == {
        ("TypeNum", 0): ("Scale", 0.0, 10.0, None), ("TypeNum", 1): ("Detail", -1e4, 1e4, None), ("TypeNum", 2): ("mode", None, None, ["A", "B"]),
        ("ShaderNodeRGB", 0): ("Color", 0.0, 1.0, None), ("ShaderNodeRGB", 1): ("flag", None, None, None), ("node_groups/G", 0): ("x", -1e4, 1e4, None),
    }


def test_analysis_records_differences_and_names_mismatches(spark):
    state = "array<struct<category: string, pos: int, name: string, linked: boolean, value: variant>>"
    slots = lambda *v: json.dumps([{"category": c, "pos": p, "name": n, "linked": k, "value": x} for c, p, n, k, x in v])
    rows = [
        ("a", "TypeNum", None, slots(("input", 0, "Scale", False, 1), ("input", 1, "Detail", True, 9))),
        ("b", "TypeNum", None, slots(("input", 0, "Scale", False, 3), ("input", 1, "Detail", None, 2))),
        ("c", "TypeNum", None, slots(("input", 0, "Size", False, 1), ("input", 1, "Detail", False, 2))),
        ("d", "Unknown", None, slots(("input", 0, "Size", False, 1))),
    ]
    df = spark.createDataFrame(rows, "mat_name string, type string, group_type string, json string").withColumn("state", F.from_json("json", state)).drop("json")
    got = {r.mat_name: r for r in params.analysed(df, signatures(spark, BASE)).select("mat_name", "linked_input", F.transform("params", lambda p: F.struct(p["id"], p["name"], F.to_json(p["value"]))).alias("p"), "problem").collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert (got["a"].linked_input, got["a"].p, got["a"].problem) == ([1], [], None)
    assert [tuple(p) for p in got["b"].p] == [(0, "Scale", "3")] and got["b"].problem is None
    assert got["c"].problem == "Slot name mismatch: 'Size' != 'Scale'"


def test_groups_of_fields_outliers_and_unseen_parameters(spark):
    curve = {"use_clip": False, "curves": [[[0, 0], [1, 1]]]}
    sig = signatures(spark, [*BASE, ("TypeNum", "attr", 0, "curve", "CurveMapping", json.dumps(curve), None, None, None), ("TypeNum", "attr", 1, "n", "int", "3", 1.0, None, None), ("TypeNum", "attr", 2, "mode", "str", '"A"', None, None, ["A", "B"])])
    made = [{"id": 2, "name": "curve", "value": {"use_clip": True, "curves": [[[0, 0], [0.5, 1.25], [1, 1]]]}}, {"id": 3, "name": "n", "value": 0}, {"id": 4, "name": "mode", "value": "C"}]
    rows = [("m", 0, "TypeNum", None, [0], json.dumps(made)), ("m", 1, "TypeNum", None, [0], "[]")]
    seen = params.observations(nodes(spark, rows), sig, ["mat_name", "node_pos"])
    counted = params.with_unseen(params.counters(seen), sig)
    got = {(r.id, r.field): (r.n, r.default_count, r.outlier_count, r.lo, r.hi) for r in counted.collect()}
    assert got == {(0, ""): (1, 1, 0, 1.0, 1.0), (1, ""): (2, 2, 0, 2.0, 2.0), (2, "use_clip"): (2, 1, 0, None, None), (2, "curves_0"): (2, 1, 1, 0.0, 1.25), (3, ""): (2, 1, 1, 0.0, 3.0), (4, ""): (2, 1, 1, None, None)}
    assert {(r.length, r.pos): r.n for r in params.moments(seen).where("field = 'curves_0'").collect()} == {**{(3, k): 1 for k in range(6)}, **{(2, k): 1 for k in range(4)}}
    assert sorted((r.field, r.word, r.n) for r in params.categories(seen).where("id = 2").collect()) == [("use_clip", "false", 1), ("use_clip", "true", 1)]


def test_signature_files(spark, tmp_path):
    (tmp_path / "node_groups").mkdir()
    (tmp_path / "TypeNum.json").write_text(json.dumps({"type": "TypeNum", "name": "TypeNum", "input": [{"name": "Scale", "type": "Float", "default": 1.0, "min": 0, "max": 10}], "output": [], "attr": [{"name": "mode", "type": "str", "value": "A", "enum": ["A", "B"]}]}))
    (tmp_path / "node_groups/G1.json").write_text(json.dumps({"type": "ShaderNodeGroup", "name": "G1", "input": [{"name": "x", "type": "Shader"}], "output": [{"name": "y", "type": "Float"}]}))
    got = corpus.signatures(spark, str(tmp_path)).select("sig_key", "category", "name", F.to_json("default").alias("d"), "min", "enum").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("TypeNum", "input", "Scale", "1", 0.0, None), ("TypeNum", "attr", "mode", '"A"', None, ["A", "B"]), ("node_groups/G1", "input", "x", None, None, None), ("node_groups/G1", "output", "y", None, None, None)], key=repr)


def test_nodes_alike_are_analysed_once(spark, monkeypatch):
    one = spark.read.parquet(f"{SF}/lineitem.parquet").limit(300)
    analysed, counted = [], []
    monkeypatch.setattr(params, "analysed", lambda nodes, *a, f=params.analysed: [f(nodes, *a), analysed.append(nodes.count())][0])
    for times in (1, 4):
        tables = SimpleNamespace(spark=spark, lineitem=one.crossJoin(spark.range(times)).drop("id"))
        counted.append({(r.sig_key, r.id, r.field): (r.n, r.default_count, r.outlier_count, r.lo, r.hi) for r in plan.param_counters(tables).collect()})
    assert analysed[0] == analysed[1] <= 300 and counted[0]
    assert counted[1] == {k: (4 * n, 4 * usual, 4 * out, lo, hi) for k, (n, usual, out, lo, hi) in counted[0].items()}
