import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from matterloom.operators import chat, dedup, gates, graph, program, runs, sampling, search, splits, stats, tiles, trials, vision


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_numeric_statistics(spark):
    seen = spark.createDataFrame([("TypeNum", 0, 1.0), ("TypeNum", 0, 5.0), ("TypeNum", 0, 12.0), ("TypeNum", 1, 2.0), ("TypeNum", 1, 2.0)], "key string, pos int, v double")
    got = {r.pos: r for r in stats.numeric_stats(seen, ["key", "pos"], "v", F.when(F.col("pos") == 0, 1.0).otherwise(2.0), 0, 10).collect()}
    assert (got[0].n, got[0].default_count, got[0].outlier_count, got[0].lo, got[0].hi, got[0]["mean"], got[0]["std"]) == (3, 1, 1, 1.0, 12.0, 6.0, 4.546061)
    assert (got[1].n, got[1].default_count, got[1].outlier_count, got[1]["std"]) == (2, 2, 0, 0.0)
    assert stats.as_map(stats.frequencies(seen, ["key"], "v"), ["key"], "v").first().freq[2.0] == 2


@pytest.mark.parametrize("n,want", [(10, (8, 1, 1)), (101, (91, 5, 5)), (4, (4, 0, 0))])
def test_split_sizes(spark, n, want):
    out = splits.split(spark.range(n), "id", 3)
    count = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert (count.get("train", 0), count.get("val", 0), count.get("test", 0)) == want == splits.sizes(n, (0.9, 0.05, 0.05))
    assert rows(out, "id", "split") == rows(splits.split(spark.range(n).repartition(5), "id", 3), "id", "split")


def test_split_protects_and_raises(spark):
    kept = spark.range(5)
    out = splits.split(spark.range(40), "id", 1, protected=kept)
    assert out.where("id < 5 AND split <> 'train'").count() == 0 and out.count() == 40
    with pytest.raises(ValueError):
        splits.sizes(4, (0.5, 0.25, 0.25), 3)
    with pytest.raises(ValueError):
        splits.sizes(4, (0.5, 0.5, 0.5))


def test_trials(spark):
    t = spark.createDataFrame([(1, k, x == "T") for k, x in enumerate("FTFTTF")], "case_id int, trial_id int, passed boolean")
    assert [r.trial_id for r in trials.within_quota(t, "case_id", "trial_id", "passed", 2, 6).orderBy("trial_id").collect()] == [0, 1, 2, 3]
    assert rows(trials.renumbered(t.where("trial_id < 4"), "case_id", "trial_id", "passed"), "trial_id", "sample_id") == [(1, 0), (3, 1)]
    long = spark.createDataFrame([(c, k, k < c) for c in (1, 2) for k in range(25)], "case_id int, trial_id int, passed boolean")
    assert [r.case_id for r in trials.abandoned(long, "case_id", "trial_id", "passed", 10, 50).collect()] == [1]


def test_gates(spark):
    reason = gates.first_failure((F.col("id") == 1, "one"), (F.col("id") > 0, "more"), (F.lit(None).cast("boolean"), "null"))
    good, bad = gates.rejected(spark.range(3), reason)
    assert rows(good, "id") == [(0,)] and rows(bad, "id", "reason") == [(1, "one"), (2, "more")]
    small = spark.createDataFrame([(11_999, None), (12_000, None), (13_000, 40_000), (16_000, 40_000)], "n long, o long")
    assert [r.s for r in small.select(gates.too_small(F.col("n"), F.coalesce("o", F.lit(0))).alias("s")).collect()] == [True, False, True, False]
    nodes = spark.createDataFrame([("a", "T1", None), ("b", "G", "g2"), ("c", "Bad", None)], "mat_name string, type string, group_type string")
    members = spark.createDataFrame([("g1", "Bad", None), ("g2", "G", "g1")], "group_type string, type string, subgroup string")
    assert rows(gates.unsupported(nodes, members, ["Bad"]), "mat_name") == [("b",), ("c",)]


def test_stage_deltas(spark):
    s = spark.createDataFrame([("s", 0, "terrain", True, 100), ("s", 1, "trees", False, 100), ("s", 2, "rocks", True, 140), ("s", 3, "grass", True, 140)], "seed string, row_idx int, name string, ran boolean, mem long")
    assert rows(runs.deltas(s, ["seed"], "row_idx", "mem", "ran"), "name", "delta") == [("rocks", 40)]


def test_gating(spark):
    t = spark.createDataFrame([("s", 0, False, "always"), ("s", 1, True, "prev_failed"), ("s", 2, True, "prev_failed"), ("s", 3, False, "prev_succeeded"), ("s", 4, True, "prev_succeeded")], "seed string, pos int, ok boolean, rule string")
    assert rows(runs.gated(t, "seed", "pos", "ok", "rule"), "pos", "ran", "fatal") == [(0, True, False), (1, True, False), (2, False, False), (3, True, True), (4, False, False)]


def test_states(spark):
    jobs = spark.createDataFrame([("a", "coarse", "running"), ("b", "coarse_0", "running"), ("b", "render", "crashed"), ("c", "x", "not queued")], "seed string, task string, state string")
    assert rows(runs.state_counts(jobs, "state", "task", "not queued"), "state", "task", "n") == [("crashed", "render", 1), ("crashed", "total", 1), ("running", "coarse", 2), ("running", "total", 2)]


def test_chat(spark):
    c = spark.createDataFrame([Row(conversations=[Row(**{"from": "human", "value": "<image>\nWrite it"}), Row(**{"from": "gpt", "value": " x "}), Row(**{"from": "bot", "value": "y"})])])
    got = c.select(chat.converted(F.col("conversations")).alias("m")).first().m
    assert [x.role for x in got] == ["user", "assistant", None] and [p.type for p in got[0].content] == ["text", "image"]
    assert got[0].content[0].text == "Write it" and got[1].content[0].text == "x"
    ids = spark.range(1).select(chat.labels(F.array(*map(F.lit, (1, 2, 3, 4, 0))), F.lit(2)).alias("l"), chat.word_length(F.array(F.lit("a  b\nc"), F.lit(""))).alias("n")).first()
    assert ids.l == [-100, -100, 3, 4, -100] and ids.n == 3


def test_weights(spark):
    configs = spark.createDataFrame([("forest", 2), ("river", 1)], "config string, weight int")
    got = sampling.round_robin(spark.range(4), configs, "config", "weight", "id").orderBy("id").collect()
    assert [r.config for r in got] == ["forest", "forest", "river", "forest"]
    assert sampling.seeds(spark.range(3), "id", 255, 256).orderBy("id").collect()[1].seed == "100" and sampling.seeds(spark.range(3), "id", 255, 256).count() == 2


def test_graphs(spark):
    links = [("mix", 0, "out", 0), ("noise", 0, "mix", 0), ("r", 0, "mix", 1), ("r2", 0, "r", 0), ("rgb", 0, "r2", 0)]
    df = spark.createDataFrame([("m", *x) for x in links] + [("k", "a", 0, "z", 0), ("k", "z", 0, "a", 0)], "mat_name string, from_node string, from_slot int, to_node string, to_slot int")
    roots = df.withColumn("root", F.when(F.col("mat_name") == "m", "out").otherwise("z"))
    order = lambda kind: [r.node for r in graph.ordered(roots, "mat_name", "root", kind).where("mat_name = 'm'").orderBy("pos").collect()]
    assert order("pre") == ["out", "mix", "noise", "r", "r2", "rgb"] and order("post") == ["noise", "rgb", "r2", "r", "mix", "out"]
    assert order("bfs") == ["out", "mix", "noise", "r", "r2", "rgb"] == order("reversed")[::-1]
    passing = spark.createDataFrame([("m", "r"), ("m", "r2")], "mat_name string, node string")
    left = graph.contracted(df.where("mat_name = 'm'"), passing, "mat_name")
    assert rows(left, "from_node", "to_node", "to_slot") == [("mix", "out", 0), ("noise", "mix", 0), ("rgb", "mix", 1)]
    rest, params = graph.folded(left, spark.createDataFrame([("m", "rgb", 0.5)], "mat_name string, node string, value double"), "mat_name")
    assert rest.count() == 2 and rows(params, "node", "slot", "value") == [("mix", 1, 0.5)]
    convert = lambda v, a, b: spark.range(1).select(graph.converted(F.array(*map(F.lit, v)), a, b).alias("v")).first().v
    assert convert([2.0], "float", "color") == [1.0, 1.0, 1.0, 1.0] and convert([1.0, 2.0, 3.0], "vector", "float") == [2.0]
    assert convert([0.1, 0.2, 0.3, 1.0], "color", "vector") == [0.1, 0.2, 0.3] and convert([1.0], "float", "shader") is None


def test_programs(spark):
    code = "a = nodes.new('T')\n\nb = nodes.new('U')\nb.inputs[2].default_value = [1, 2]\nlinks.new(a.outputs[0], b.inputs[1])"
    df = spark.createDataFrame([(1, code)], "id int, code string")
    parsed = program.rows(df, "id", "code")
    assert program.programs(parsed, "id").first().code == code.replace("\n\n", "\n")
    assert [r.kind for r in parsed.orderBy("pos").collect()] == ["node", "node", "param", "link"]
    spark.udtf.register("program_rows", program.ProgramRows)
    df.createOrReplaceTempView("program_texts")
    table = spark.sql("SELECT p.* FROM program_texts, LATERAL program_rows(code) p")
    assert rows(table, "pos", "kind", "a", "b", "c", "d") == rows(parsed, "pos", "kind", "a", "b", "c", "d")
    ramp = spark.createDataFrame([(1, [[0.0], [0.7], [1.0]], [[0.0], [1.0]])], "id int, v array<array<double>>, d array<array<double>>")
    assert rows(program.ramp_changes(ramp, "id", "v", "d"), "pos", "change") == [(1, "changed"), (2, "appended")]


def test_shrinking(spark):
    head = ["import bpy", "def shader_material(m):", "  a = nodes.new('T')", f"  {program.PARAMETERS}"]
    lines = [f"  a.inputs[{k}].default_value = {k}" for k in range(6)] + ["  a.color_ramp.elements[0].position = 0.5", "  e = 1", "  a.color_ramp.elements.new(0.3)", "  a.color_ramp.elements[2].color = 1"]
    code = "\n".join(head + lines)
    df = spark.createDataFrame([(k, code) for k in range(5)], "id int, code string")
    size = lambda text: spark.range(1).select(gates.token_count(F.lit(text)).alias("n")).first().n
    full, least = size(code), size("\n".join([*head, lines[6]]))
    assert all(r.code == code for r in program.shrunk(df, "id", "code", full, 3).collect())
    for limit in (full - 1, (full + least) // 2, least):
        got = program.shrunk(df, "id", "code", limit, 3).collect()
        for r in got:
            kept = r.code.split("\n")
            assert size(r.code) <= limit and kept[:4] == head and lines[6] in kept and (lines[8] in kept) == (lines[9] in kept)
            assert kept == [x for x in code.split("\n") if x in kept]
    assert all(r.code is None for r in program.shrunk(df, "id", "code", least - 1, 3).collect())


def test_render_figures(spark):
    def image(a):
        a = np.asarray(a, np.uint8)
        return (4, 4, np.repeat(a.reshape(4, 4, 1), 3, 2).tobytes())

    white = np.full(16, 255)
    white[3] = 128
    board = np.indices((4, 4)).sum(0) % 2 * 255
    df = spark.createDataFrame([("black", *image(np.zeros(16))), ("white15", *image(white)), ("flat", *image(np.full(16, 120))), ("ok", *image(board))], "id string, height int, width int, data binary")
    got = dict(rows(vision.render_figures(df, ["id"]).select("id", vision.render_reason().alias("r")), "id", "r"))
    assert got == {"black": "Rendered image is black or white", "white15": "Rendered image is black or white", "flat": "Rendered image is uniform", "ok": None}
    assert vision.pixels(1, 1, bytes([10, 20, 30])).reshape(-1) == pytest.approx(np.array([30, 20, 10]) / 255)


def test_masks(spark):
    mask = np.array([[1, 1, 0, 2], [1, 2, 0, 2]], "<i4")
    counted = vision.histograms(spark.createDataFrame([("s", mask.tobytes())], "seed string, data binary"), ["seed"])
    tags = spark.createDataFrame([("s", "rock", 1), ("s", "cave", 2), ("s", "petal", 3)], "seed string, tag string, id long")
    assert dict(rows(vision.tag_shares(counted, tags), "tag", "percent")) == {"rock": 37.5, "cave": 37.5, "petal": 0.0, "untagged": 25.0}
    hit = (mask == 1).astype(np.uint8)
    one = np.ones_like(mask).tobytes()
    frame = spark.createDataFrame([("s", 4, hit.tobytes(), one, one)], "seed string, width int, hit binary, objects binary, instances binary")
    assert rows(vision.boxes(frame, ["seed"]), "x_min", "y_min", "x_max", "y_max") == [(0, 0, 1, 1)]


def test_similarity():
    r = np.random.default_rng(0)
    x = r.random((40, 40, 3))
    assert vision.ssim(x, x)[0] == pytest.approx(1) and vision.multi_ssim(np.tile(x, (5, 5, 1)), np.tile(x, (5, 5, 1))) == pytest.approx(1)
    y = np.clip(x + r.normal(0, 0.1, x.shape), 0, 1)
    g = np.exp(-((np.arange(11) - 5) ** 2) / 4.5)
    w = np.outer(g, g) / g.sum() ** 2
    parts = []
    for c in range(3):
        for i in range(30):
            for k in range(30):
                a, b = x[i : i + 11, k : k + 11, c], y[i : i + 11, k : k + 11, c]
                ma, mb = (w * a).sum(), (w * b).sum()
                va, vb, ab = (w * a * a).sum() - ma**2, (w * b * b).sum() - mb**2, (w * a * b).sum() - ma * mb
                parts.append((2 * ma * mb + 1e-4) / (ma**2 + mb**2 + 1e-4) * (2 * ab + 9e-4) / (va + vb + 9e-4))
    assert vision.ssim(x, y)[0] == pytest.approx(np.mean(parts))
    assert vision.noise(0.5 + r.normal(0, 0.1, (400, 400, 1))) == pytest.approx(0.1, rel=0.05)


def test_greedy_keeps_the_cheapest(spark):
    base = [0.1] * 16
    df = spark.createDataFrame([(0, base, 10), (1, base, 8), (2, base, 8), (3, [0.9] * 16, 5)], "id long, pixels array<double>, cost int")
    assert rows(dedup.greedy(df, 0.02, 0.95), "id") == [(1,), (3,)]
    near = [*base[:15], 0.5]
    pair = spark.createDataFrame([(0, base, 1), (1, near, 1)], "id long, pixels array<double>, cost int")
    assert dedup.pixel_pairs(pair, 0.02, 0.95).count() == 0 and dedup.pixel_pairs(pair, 0.02, 0.9).count() == 1
    again = spark.createDataFrame([(1, 0, base), (1, 1, base), (1, 2, near)], "case_id int, trial_id int, pixels array<double>")
    assert rows(dedup.accept_new(again, 0.02, 0.95), "trial_id") == [(0,), (2,)]


def test_pixel_pairs_lose_none(spark):
    r = np.random.default_rng(5)
    table = np.clip(np.repeat(r.random((12, 1)), 20, 1) + r.normal(0, 0.02, (12, 20)), 0, 1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(table)], "id long, pixels array<double>")
    want = sorted((a, b) for a in range(12) for b in range(a + 1, 12) if (np.abs(table[a] - table[b]) <= 0.05).mean() > 0.6)
    assert rows(dedup.pixel_pairs(df, 0.05, 0.6), "a", "b") == want


@pytest.mark.parametrize(("share", "channels", "size"), [(0.9, 1, 64), (0.97, 3, 30), (0.3, 1, 7), (0.999, 1, 200), (0.5, 2, 2)])
def test_pigeonholes_lose_no_pair(spark, share, channels, size):
    r = np.random.default_rng(size)
    base = r.random((6, size * channels))
    table = np.repeat(base, 8, 0)
    table += (r.random(table.shape) < (1 - share) * 0.6 / channels * r.random((48, 1))) * r.normal(0, 0.5, table.shape)
    table = np.clip(table + r.uniform(-0.012, 0.012, table.shape), 0, 1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(table)] + [(90, None), (91, []), (92, [0.5])], "id long, pixels array<double>")
    same = (np.abs(table[:, None] - table) <= 0.03).reshape(48, 48, size, channels).all(3).sum(2)
    want = sorted(((a, b, int(same[a, b])) for a in range(48) for b in range(a + 1, 48) if same[a, b] / size > share), key=repr)
    assert want and rows(dedup.pixel_pairs(df, 0.03, share, channels), "a", "b", "same") == want


def in_turn(costs, same):
    """(stays, replaced_by) of each row, one after the other."""
    kept, by = [], {}
    for k, cost in enumerate(costs):
        linked = [b for b in kept if (b, k) in same]
        if linked:
            best = min(linked, key=lambda b: (-same[b, k], b))
            if cost >= costs[best]:
                continue
            kept.remove(best)
            by[best] = k
        kept.append(k)
    return [(k, k in kept, by.get(k)) for k in range(len(costs))]


def test_greedy_in_rounds_is_greedy_in_turn(spark):
    r = np.random.default_rng(4)
    chain = 9
    cases = [
        # A chain in which each row replaces the one before; one in which none does; a clique; sparse and dense links at random.
        (list(range(chain, 0, -1)), {(k, k + 1): 5 for k in range(chain - 1)}),
        ([1] * chain, {(k, k + 1): 5 for k in range(chain - 1)}),
        (r.integers(0, 30, 24).tolist(), {(a, b): 3 for a in range(24) for b in range(a + 1, 24)}),
        *[(r.integers(0, 6, 60).tolist(), {(int(a), int(b)): int(r.integers(1, 4)) for a in range(60) for b in range(a + 1, 60) if r.random() < odds}) for odds in (0.02, 0.08, 0.3)],
    ]
    offset, costs, pairs, want = 0, [], [], []
    for cost, same in cases:
        costs += [(offset + k, float(c)) for k, c in enumerate(cost)]
        pairs += [(offset + a, offset + b, s) for (a, b), s in same.items()]
        want += [(offset + k, stays, None if by is None else offset + by) for k, stays, by in in_turn(cost, same)]
        offset += 1000
    got = dedup.settled(spark.createDataFrame(costs, "id long, cost double"), spark.createDataFrame(pairs, "a long, b long, same int"))
    assert sorted(tuple(x) for x in got.collect()) == want


def test_greedy_of_copies_and_missing_costs(spark):
    df = spark.createDataFrame([(k, [0.3] * 8 if k % 2 else [0.8] * 8, None if k < 2 else 10 - k) for k in range(8)] + [(20, None, 1), (21, [], 1)], "id long, pixels array<double>, cost int")
    assert rows(dedup.greedy(df, 0.01, 0.9), "id") == [(20,), (21,), (6,), (7,)]
    assert dedup.greedy(df.limit(0), 0.01, 0.9).collect() == []


def test_search_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    table = r.normal(size=(60, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(table)] + [(99, None)], "id long, v array<double>")
    once = rows(search.top_k(df.where("id < 20"), df, "id", "v", 3), "query", "id", "score", "rank")
    monkeypatch.setattr(search, "BLOCK", 6)
    assert rows(search.top_k(df.where("id < 20"), df, "id", "v", 3), "query", "id", "score", "rank") == once and len(once) == 60
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    for q in range(20):
        best = [i for i in np.argsort(-(unit @ unit[q])) if i != q][:3]
        assert [i for a, i, _, k in sorted(once, key=lambda x: x[3]) if a == q] == best


def test_variation_stays_in_range(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0.0, 2.0, 10, 2, 1.0, 0.3), ("b", 5.0, 1.0, 5.0, 5.0, 10, 0, 5.0, 0.0), ("c", 1.0, 1.0, 0.0, 9.0, 60, 60, 1.0, 0.0)], "key string, value double, usual double, lo double, hi double, n long, default_count long, mean double, std double")
    out = sampling.varied(df, 200, 4, odds=1.0).collect()
    assert all(r.lo <= r.drawn <= r.hi and (r.key == "a" or r.drawn == r.value) for r in out) and len({r.drawn for r in out if r.key == "a"}) > 150
    drawn = [r.drawn for r in sampling.varied(df.where("key = 'a'").withColumn("n", F.lit(50)), 3000, 4, odds=1.0, confident=F.lit(True)).collect()]
    assert abs(np.mean(drawn) - 1) < 0.03 and abs(np.std(drawn) - 0.3) < 0.03


def test_ssim_bound_holds_and_prunes(spark):
    r = np.random.default_rng(8)
    images = {}
    for k in range(40):
        kind, (h, w, c) = k % 5, (24, 20, 3) if k % 2 else (16, 16, 1)
        smooth = np.kron(r.random((h // 4, w // 4, c)), np.ones((4, 4, 1)))
        x = {0: r.random((h, w, c)), 1: smooth, 2: np.full((h, w, c), r.random()), 3: smooth * 0.1, 4: 0.5 + 0.05 * r.normal(size=(h, w, c))}[kind]
        images[k] = (np.clip(x, 0, 1) * 255).astype(np.uint8)
        if k >= 20:
            images[k] = np.clip(images[k - 20] + r.normal(0, 1 + k % 7 * 6, images[k - 20].shape), 0, 255).astype(np.uint8)
    df = spark.createDataFrame([(k, x.shape[0], x.shape[1], x[..., ::-1].tobytes()) for k, x in images.items()], "id long, height int, width int, data binary")
    index = {x.id: x for x in vision.ssim_index(df, ["id"]).collect()}
    value = {}
    for a in images:
        for b in images:
            if images[a].shape == images[b].shape:
                value[a, b] = vision.ssim(images[a] / 255.0, images[b] / 255.0)[0]
                assert vision.ssim_bounds(np.array([index[a].blocks]), np.array([index[b].blocks]))[0] >= value[a, b] - 1e-9
    for least in (0.3, 0.8, 0.95):
        met, left, similar = vision.similar_pairs(df, df.where("id % 3 = 0"), "id", least)
        want = {(a, b): v for (a, b), v in value.items() if b % 3 == 0 and v >= least}
        assert {(x.a, x.b): round(x.ssim, 9) for x in similar.collect()} == {p: round(v, 9) for p, v in want.items()}
        if least > 0.9:
            counts = (40 * 14, met.count(), left.count(), len(want))
            assert counts == tuple(sorted(counts, reverse=True)) and counts[2] < 0.5 * counts[0], counts


def test_image_leaks_takes_the_nearest_of_the_similar(spark):
    flat = lambda g: bytes([g]) * 256
    rows_ = [(1, 16, 16, flat(100), [0.5]), (2, 16, 16, flat(200), [0.5]), (3, 16, 8, flat(100)[:128], [0.5]), (4, 16, 16, flat(101), None), (5, 16, 16, flat(101), [0.1])]
    refs = [(10, 16, 16, flat(101), [0.9]), (11, 16, 16, flat(102), [0.6]), (12, 16, 16, flat(100), [0.6]), (13, 16, 16, flat(0), [0.5])]
    schema = "id long, height int, width int, data binary, v array<double>"
    got = dedup.image_leaks(spark.createDataFrame(rows_, schema), spark.createDataFrame(refs, schema), "id", "v", 0.99, 0.2)
    assert rows(got, "id", "nearest", "distance", "similar") == [(1, 11, 0.1, 3)]


def test_constants_go_through_typed_nodes(spark):
    links = [("m", 1, 0, 10, 0, "color"), ("m", 10, 0, 11, 0, "color"), ("m", 11, 0, 20, 3, "color"), ("m", 1, 0, 21, 0, "shader"), ("m", 10, 0, 22, 1, "shader"), ("m", 1, 0, 23, 0, "string"), ("m", 20, 0, 30, 0, "shader"), ("n", 1, 0, 2, 0, "float")]
    df = spark.createDataFrame(links, "mat string, from_node int, from_slot int, to_node int, to_slot int, to_kind string")
    constants = spark.createDataFrame([("m", 1, [2.0], "float")], "mat string, node int, value array<double>, kind string")
    passing = spark.createDataFrame([("m", 10, "vector"), ("m", 11, "float")], "mat string, node int, kind string")
    left, params, wrong = graph.folded_typed(df, constants, passing, "mat")
    assert rows(params, "node", "slot", "value") == [(-2, 0, [1.0, 1.0, 1.0, 1.0]), (20, 3, [1.0, 1.0, 1.0, 1.0])]
    assert rows(wrong, "node", "slot", "kind", "to_kind") == [(23, 0, "float", "string")]
    assert rows(left, "mat", "from_node", "to_node", "to_slot") == [("m", -2, 21, 0), ("m", -2, 22, 1), ("m", 20, 30, 0), ("n", 1, 2, 0)]
    none = graph.folded_typed(df, constants.limit(0), passing, "mat")
    assert none[0].count() == 8 and none[1].count() == none[2].count() == 0


def test_contraction_of_chains_and_cycles(spark):
    links = [("m", 1, 0, 10, 0), ("m", 10, 0, 11, 0), ("m", 11, 0, 12, 0), ("m", 12, 0, 10, 0), ("m", 12, 0, 2, 5), ("m", 11, 0, 1, 1), ("m", 3, 0, 2, 1), ("m", 13, 0, 2, 2), ("m", 3, 1, 14, 0)]
    df = spark.createDataFrame(links, "mat string, from_node int, from_slot int, to_node int, to_slot int")
    passing = spark.createDataFrame([("m", k) for k in (10, 11, 12, 13, 14)] * 2, "mat string, node int")
    assert rows(graph.contracted(df, passing, "mat"), "from_node", "from_slot", "to_node", "to_slot") == [(1, 0, 2, 5), (3, 0, 2, 1)]
    assert graph.contracted(df, passing.limit(0), "mat").count() == 9


def test_a_duplicate_is_one_of_what_was_accepted(spark):
    a, b, c = [0.1] * 10, [0.5] * 10, [0.9] * 10
    data = [(1, 0, a, "bad answer", None), (1, 1, a, None, "too long"), (1, 2, a, None, None), (1, 3, a, None, "too long"), (1, 4, b, None, None), (1, 5, c, None, None), (1, 6, None, None, None), (2, 7, b, None, None)]
    df = spark.createDataFrame(data, "case_id long, trial_id long, pixels array<double>, x string, y string")
    truths = spark.createDataFrame([(1, c), (1, c), (2, a), (1, None)], "case_id long, pixels array<double>")
    got = dedup.cascade(df, truths, F.col("x"), F.col("y"), 0.02, 0.95)
    assert rows(got, "trial_id", "reason") == [(0, "bad answer"), (1, "too long"), (2, None), (3, dedup.DUPLICATE), (4, None), (5, dedup.DUPLICATE), (6, None), (7, None)]


def test_leaks_of_texts_in_other_alphabets(spark):
    held = spark.createDataFrame([(1, "Пример текста для проверки утечки"), (2, "naïve café où déjà vu")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "xx ПРИМЕР текста, для проверки!"), (11, "na ve caf o d j vu"), (12, "Naïve; café — où déjà"), (13, None)], "doc_id long, text string")
    assert rows(dedup.text_leaks(docs, held, 4), "doc_id", "shared", "items") == [(10, 1, 1), (12, 1, 1)]


def test_like_trials_are_settled_in_batches_without_their_pairs(spark, monkeypatch):
    r = np.random.default_rng(6)
    table = np.concatenate([np.full((300, 12), 0.5), np.repeat(r.random((30, 12)), 10, 0) + r.normal(0, 0.004, (300, 12))])
    table = table[r.permutation(600)]
    df = spark.createDataFrame([("big" if k % 5 else "small", k * k, v.tolist()) for k, v in enumerate(table)] + [(None, 7, [0.5] * 12)], "case_id string, trial_id long, pixels array<double>")
    truths = spark.createDataFrame([("big", table[1].tolist()), ("big", table[1].tolist())], "case_id string, pixels array<double>")
    kept, want = [], []
    for k, v in enumerate(table):
        like = lambda i, v=v: (np.abs(table[i] - v) <= 0.01).mean() > 0.6
        twice = (k % 5 > 0 and like(1)) or any(bool(i % 5) == bool(k % 5) and like(i) for i in kept)
        late = k % 7 == 0
        kept += [] if twice or late else [k]
        want.append(("big" if k % 5 else "small", k * k, dedup.DUPLICATE if twice else "late" if late else None))
    most = []
    monkeypatch.setattr(dedup, "written", lambda rows, label, f=dedup.written: [f(rows, label), most.append(rows.count())][0])
    late = F.when(F.sqrt("trial_id").cast("int") % 7 == 0, "late")
    for size in (16, 4096):
        monkeypatch.setattr(dedup, "LEAST", size)
        monkeypatch.setattr(dedup, "BATCH", size)
        monkeypatch.setattr(dedup, "FEW", size)
        got = dedup.cascade(df, truths, F.lit(None).cast("string"), late.when(F.col("case_id").isNull(), None), 0.01, 0.6)
        assert sorted((tuple(x) for x in got.where("case_id IS NOT NULL").select("case_id", "trial_id", "reason").collect()), key=repr) == sorted(want, key=repr)
    # Not the pairs of like trials, of which there are some 30,000.
    assert max(most) <= 601


def test_tiles_count_what_plain_comparison_counts(monkeypatch):
    monkeypatch.setattr(tiles, "DIRECT", 1000)
    monkeypatch.setattr(tiles, "COLUMNS", 128)
    r = np.random.default_rng(3)
    for size, channels, share, spread in ((64, 1, 0.5, 0.125), (300, 1, 0.45, 0.125), (12, 3, 0.3, 0.1), (9, 2, 0.0, 40.0), (5, 1, 0.9, 0.0)):
        a, b = r.normal(0, spread, (150, size * channels)), r.normal(0, spread, (300, size * channels))
        a[3, 0], b[5, 1], b[7] = np.nan, np.inf, a[8]
        with np.errstate(invalid="ignore"):
            same = (np.abs(a[:, None] - b) <= 0.06).reshape(150, 300, size, channels).all(3).sum(2)
        want = sorted((int(i), int(j), int(same[i, j])) for i, j in zip(*np.nonzero(same / size > share), strict=True))
        got = sorted((int(i), int(j), int(n)) for part in tiles.pairs(a, b, 0.06, share, channels) for i, j, n in zip(*part, strict=True))
        assert want and got == want


def test_long_chains_are_settled_in_few_rounds(spark, monkeypatch):
    r = np.random.default_rng(9)
    # A chain of 40 and links at random; a number of pairs is left to one task, or all rounds are gone through.
    costs = [*range(40, 0, -1), *r.integers(0, 6, 60).tolist()]
    same = {(k, k + 1): 5 for k in range(39)} | {(a, b): int(r.integers(1, 4)) for a in range(40, 100) for b in range(a + 1, 100) if r.random() < 0.1}
    want = [(k, stays, by) for k, stays, by in in_turn(costs, same)]
    df, pairs = spark.createDataFrame(list(enumerate(map(float, costs))), "id long, cost double"), spark.createDataFrame([(a, b, n) for (a, b), n in same.items()], "a long, b long, same int")
    tables = []
    monkeypatch.setattr(dedup, "written", lambda rows, label, f=dedup.written: [f(rows, label), tables.append(label)][0])
    assert sorted(tuple(x) for x in dedup.settled(df, pairs).collect()) == want and len(tables) < 10
    monkeypatch.setattr(dedup, "TAIL", 120)
    assert sorted(tuple(x) for x in dedup.settled(df, pairs).collect()) == want


def test_search_keeps_a_tile_of_scores_in_memory(spark, monkeypatch):
    r = np.random.default_rng(12)
    table = np.concatenate([r.normal(size=(200, 6)), np.repeat(r.normal(size=(4, 6)), 20, 0)])[r.permutation(280)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(table)], "id long, v array<double>")
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6) + 0.0
    want = [(q, i, float(scores[q, i]), n + 1) for q in range(0, 280, 4) for n, i in enumerate([i for i in sorted(range(280), key=lambda i: (-scores[q, i], i)) if i != q][:5])]
    for tile in (7, 300, 1 << 20):
        monkeypatch.setattr(search, "TILE", tile)
        assert rows(search.top_k(df.where("id % 4 = 0"), df, "id", "v", 5), "query", "id", "score", "rank") == sorted(want, key=repr)
    # What one task holds at once: 3,000 queries by 10,000 rows are 240 MB of scores, of which only tiles are made.
    made = []
    many = r.normal(size=(10_000, 6))
    monkeypatch.setattr(search.np, "nonzero", lambda x, f=np.nonzero: [f(x), made.append(x.size)][0])
    held = type("Held", (), {"value": (list(range(3000)), many[:3000])})()
    found = {}
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema, g=type(df).mapInPandas: [found.update(f=f), g(self, f, schema)][1])
    search.top_k(df.where("id % 4 = 0"), df, "id", "v", 5)
    out = list(found["f"](iter([pd.DataFrame({"id": range(10_000), "v": list(many)})]), kept=held))
    assert sum(map(len, out)) == 3000 * 6 and made and max(made) <= 1 << 20


def test_nearest_leak_compares_few_pairs_by_value(spark, monkeypatch):
    r = np.random.default_rng(15)
    for spread, size, limit in ((0.125, 64, 0.115), (30.0, 5, 9.0), (0.0, 3, 0.0), (0.125, 2000, 0.14)):
        table, mine = r.normal(0, spread, (300, size)), r.normal(0, spread, (200, size))
        mine[:20], table[50:60] = table[100:120], table[100:110]
        ids = r.permutation(300)
        apart = np.abs(mine[:, None] - table).mean(2)
        want = [min((d, i) for d, i in zip(row, ids, strict=True)) for row in apart.tolist()]
        speed, height = dedup._speed(table)
        best, place = dedup._nearest(mine, table, ids, limit, (speed, height, dedup._waves(table, speed, np.dtype(np.float32 if size <= 1024 else np.float64))))
        assert [(d, ids[p]) if np.isfinite(d) else None for d, p in zip(best, place, strict=True)] == [(d, i) if d <= limit else None for d, i in want]
    # Of 600 x 4,000 pairs less than a quarter is compared by its values.
    table, compared = r.normal(0, 0.125, (4600, 64)), []
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(table)] + [(9000, None)], "id long, v array<double>")
    made = {}
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema, g=type(df).mapInPandas: [made.update(f=f), g(self, f, schema)][1])
    got = {x.id: (x.nearest, x.distance) for x in dedup.leaks(df.where("id < 600 OR id = 9000"), df.where("id >= 600"), "id", "v", 0.115).collect()}
    apart = np.abs(table[:600, None] - table[None, 600:]).mean(2)
    assert got == {k: (600 + int(row.argmin()), round(float(row.min()), 6)) for k, row in enumerate(apart) if row.min() <= 0.115}
    monkeypatch.setattr(dedup.np, "abs", lambda x, f=np.abs: [f(x), compared.append(x.size // 64)][0])
    list(made["f"](iter([pd.DataFrame({"id": range(600), "v": list(table[:600])})])))
    assert 0 < sum(compared) < 600 * 4000 / 4


def test_small_images_are_compared_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(21)
    for shape in ((1, 64, 1), (12, 14, 3), (4, 5, 1)):
        base = r.integers(0, 256, (6, *shape))
        images = np.clip(base[r.integers(0, 6, 60)] + r.integers(-40, 41, (60, *shape)), 0, 255).astype(np.uint8)
        table = vision.ssim_table(images[:40, ..., ::-1] / 255.0, images[40:, ..., ::-1] / 255.0, values=1000)
        for low, j, part in table:
            assert part == pytest.approx([vision.ssim(images[low + k, ..., ::-1] / 255.0, images[40 + j, ..., ::-1] / 255.0)[0] for k in range(len(part))], abs=1e-9)
        vectors = [None if k % 9 == 4 else r.integers(0, 4, 3 if k % 7 else 2).astype(float).tolist() for k in range(60)]
        df = spark.createDataFrame([(k, shape[0], shape[1], images[k].tobytes(), v) for k, v in enumerate(vectors)], "id long, height int, width int, data binary, v array<double>")
        got = []
        monkeypatch.setattr(dedup, "FEW", 8)
        for small in (4096, 0):
            monkeypatch.setattr(dedup, "SMALL", small)
            got.append(rows(dedup.image_leaks(df.where("id < 40"), df.where("id >= 40"), "id", "v", 0.6, 1.5), "id", "nearest", "distance", "similar"))
        assert got[0] and got[0] == got[1]
