import io
import json

import numpy as np
from pyspark.sql import functions as F

from matterloom.operators import palette
from matterloom.sources import corpus, files
from matterloom.streaming import jobs, logs


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def put(root, path, content):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_corpus(spark, tmp_path):
    for name in ("s/a/blender", "s/a/var_00000", "s/a/var_00001", "s/d/blender", "mat_llm/x/blender"):
        put(tmp_path, f"{name}_full.py", f"code of {name}")
        if name not in ("s/a/var_00001", "s/d/blender"):
            put(tmp_path, f"{name}_render.jpg", b"x")
    every = corpus.programs(spark, str(tmp_path))
    assert rows(every, "mat_name", "data_name") == [("mat_llm/x", "blender"), ("s/a", "blender"), ("s/a", "var_00000")]
    assert rows(corpus.programs(spark, str(tmp_path), variations=False, generated=False), "mat_name", "code") == [("s/a", "code of s/a/blender")]
    assert {r.generated for r in every.select((F.col("mat_name").startswith("mat_llm")).alias("generated")).collect()} == {True, False}


def test_analyses_and_ranges(spark, tmp_path):
    nodes = [{"name": "n", "type": "TypeNum", "linked_input": [1], "params": [{"id": 0, "name": "Scale", "value": 5.0}]}, {"name": "g", "type": "Group", "group_type": "G1", "linked_input": [], "params": [{"id": 1, "name": "c", "value": [1, 2]}]}]
    put(tmp_path, "s/a.json", json.dumps(nodes))
    put(tmp_path, "mat_llm_1/b/analysis.json", json.dumps(nodes[:1]))
    got = corpus.analyses(spark, str(tmp_path))
    assert rows(got, "mat_name", "node_pos", "type") == [("mat_llm_1/b", 0, "TypeNum"), ("s/a", 0, "TypeNum"), ("s/a", 1, "Group")]
    assert got.where("mat_name = 's/a' AND node_pos = 0").select(F.try_variant_get(F.col("params")[0]["value"], "$", "double").alias("v")).first().v == 5.0
    signatures = spark.createDataFrame([("T", "a", 0.0, 1.0, None), ("T", "b", 0.0, 1.0, None), ("T", "c", 0.0, 1.0, None), ("T", "d", 0.0, 1.0, None)], "sig_key string, name string, min double, max double, enum array<string>")
    ranges = spark.createDataFrame([("T", "a", "[-2, 3.5]"), ("T", "b", '["x", "y"]'), ("T", "c", '"unused"')], "sig_key string, name string, text string")
    assert rows(corpus.with_ranges(signatures, ranges), "name", "min", "max", "enum") == [("a", -2.0, 3.5, None), ("b", 0.0, 1.0, ["x", "y"]), ("c", 0.0, 0.0, None), ("d", 0.0, 1.0, None)]


def test_splits_and_tables(spark, tmp_path):
    examples = spark.createDataFrame([("1", "s/a/x.jpg", "train"), ("2", "s/a/y.jpg", "train"), ("3", "s/b/x.jpg", "val")], "id string, image string, split string")
    corpus.write_splits(examples, f"{tmp_path}/splits")
    assert rows(corpus.split_materials(spark, f"{tmp_path}/splits"), "split", "mat_name") == [("train", "s/a"), ("val", "s/b")]
    table = spark.createDataFrame([("ab", "True", ["x.gin", "y"]), ("cd", "False", [])], "seed string, all_done string, configs array<string>")
    corpus.write_scenes(table, f"{tmp_path}/scenes")
    assert rows(corpus.scenes(spark, f"{tmp_path}/scenes"), "seed", "configs") == [("ab", ["x.gin", "y"]), ("cd", [])]
    corpus.write_log(examples, f"{tmp_path}/log", "id")
    assert spark.read.csv(f"{tmp_path}/log", header=True).count() == 3


def test_run_files(spark, tmp_path):
    put(tmp_path, "runs/ab/pipeline_coarse.csv", ",name,ran,mem_at_finish,obj_count,instance_count\n0,terrain,True,100,1,1\n1,trees,False,100,1,1\n")
    assert rows(corpus.stage_runs(spark, f"{tmp_path}/runs"), "seed", "phase", "name", "ran") == [("ab", "coarse", "terrain", True), ("ab", "coarse", "trees", False)]
    put(tmp_path, "logs/coarse_1.log", "[times] [INFO] | [trees] finished in 0:02:05.123\n[x] finished in 0:00:00.5\n[MAIN TOTAL] finished in 1 day, 2:00:00\n")
    put(tmp_path, "logs/coarse_2.log", "[trees] finished in 0:02:05\n")
    steps = spark.createDataFrame([(0, "coarse"), (1, "coarse_1")], "pos int, step string")
    assert rows(corpus.log_times(corpus.logs(spark, f"{tmp_path}/logs"), steps), "step", "name", "seconds") == [("coarse", "trees", 125)]
    put(tmp_path, "done/ab/logs/FINISH_coarse", "")
    assert rows(corpus.finished_tasks(spark, f"{tmp_path}/done"), "seed", "task") == [("ab", "coarse")]


def test_index_masks_and_selection(spark, tmp_path):
    index = spark.createDataFrame([(json.dumps({"Depth": {"npy": {"00": {"01": {"7": "d.npy"}}}}}),)], "value string")
    assert rows(corpus.file_index(index), "type", "ext", "rig", "subcam", "frame", "path") == [("Depth", "npy", "00", "01", "7", "d.npy")]
    np.save(tmp_path / "m.npy", np.array([[1, 1], [2, 0]], np.int32))
    assert rows(corpus.mask_histograms(spark, str(tmp_path)), "id", "n") == [(0, 1), (1, 2), (2, 1)]
    lines = spark.createDataFrame([(0, "1 3"), (1, ""), (2, " 0 ")], "pos int, value string")
    assert rows(corpus.selected(lines), "key") == [("case_00000_gen_01",), ("case_00000_gen_03",), ("case_00002_gen_00",)]


def test_images(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\x00\x0a\x14\x1e")) + chunk(b"IEND", b"")
    put(tmp_path, "one.png", png)
    from matterloom.operators import vision

    r = corpus.images(spark, str(tmp_path)).first()
    assert np.allclose(vision.pixels(r.height, r.width, r.data).reshape(-1) * 255, [10, 20, 30])


def test_upserts_and_crashes(spark, tmp_path):
    events = [("a", "render", "running", 1), ("a", "render", "crashed", 2), ("b", "render", "done", 1), ("a", "render", "crashed", 3)]
    for k, e in enumerate(events):
        spark.createDataFrame([e], "seed string, task string, state string, ts int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("seed string, task string, state string, ts int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    table = f"{tmp_path}/table"
    query = jobs.latest_states(stream, ["seed", "task"], "state", ["ts"]).writeStream.outputMode("update").foreachBatch(jobs.upsert(table, ["seed", "task"])).option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(logs.Deltas(table, ["seed", "task"]).read(spark), "seed", "state") == [("a", "crashed"), ("b", "done")]
    crashes = jobs.once(stream.where("state = 'crashed'"), ["seed", "task"])
    assert rows(jobs.run_once(crashes, "crashes", "append", f"{tmp_path}/c2"), "seed", "task") == [("a", "render")]
    assert rows(jobs.fresh(spark.range(4).toDF("k"), spark.range(2).toDF("k"), ["k"]), "k") == [(2,), (3,)]


def test_results_of_streams_are_files(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", k), (f"b{k}", k)], "key string, n int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("key string, n int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    whole = jobs.run_once(stream.groupBy("key").count(), "counts", "complete", f"{tmp_path}/c3")
    assert rows(whole, "key", "count") == [("a", 3), ("b0", 1), ("b1", 1), ("b2", 1)] and whole.inputFiles()
    each = jobs.run_once(stream, "all_rows", "append", f"{tmp_path}/c4")
    assert rows(each, "n") == [(0,), (0,), (1,), (1,), (2,), (2,)] and each.inputFiles()
    again = jobs.run_once(stream, "all_rows", "append", f"{tmp_path}/c4")
    assert again.count() == 6


def test_palette(spark):
    r = np.random.default_rng(3)
    data = [((0.2 if k % 3 else 0.7) + x, 0.5 + x / 2, 0.5 - x / 3) for k, x in enumerate(r.normal(0, 0.02, 300))]
    pixels = spark.createDataFrame([([float(c) for c in x],) for x in data], "p array<double>")
    fitted = palette.fit(pixels, "p", 2, 1)
    assert abs(fitted[0]["mean"][0] - 0.2) < 0.02 and abs(fitted[0]["weight"] - 2 / 3) < 0.05
    out = palette.drawn(spark.range(50), "id", fitted, 2).collect()
    assert all(0 <= c <= 1 for x in out for c in x.color)


def test_a_log_has_each_entry_once_and_state_expires(spark, tmp_path):
    import datetime as dt

    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [("a", "render", "crashed", at(1)), ("a", "render", "crashed", at(0)), ("a", "upload", "done", at(2)), (None, "x", "done", at(2))],
        [("a", "render", "crashed", at(3)), ("b", "coarse", "crashed", at(3)), ("a", "upload", "done", at(3))],
        [("b", "coarse", "crashed", at(100)), ("b", "fine", "crashed", at(100))],
        [("c", "upload", "done", at(101))],
        [("c", "upload", "done", at(102)), ("b", "upload", "done", at(102))],
    ]
    schema = "seed string, task string, state string, ts timestamp"
    want, sizes = {("a", "crashed", "render", at(0)), ("a", "finished", "upload", at(2)), ("b", "crashed", "coarse", at(3)), ("b", "crashed", "fine", at(100)), ("c", "finished", "upload", at(101)), ("b", "finished", "upload", at(102))}, []
    log, checkpoint = logs.Deltas(f"{tmp_path}/log", ["seed", "kind", "task"], first=True, every=2), f"{tmp_path}/checkpoint"
    assert log.read(spark) is None
    sent = []

    def write(batch, number):
        log.sink()(batch, number)
        # A batch that comes again, as after a lost driver, changes nothing.
        once = sorted(map(tuple, log.read(spark).collect()))
        log.sink()(batch, number)
        assert sorted(map(tuple, log.read(spark).collect())) == once
        sent.append(number)

    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = logs.scene_log(stream, "upload", keep_ms=3_600_000).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").option("stateVarName", "crashes").load(checkpoint)
        sizes.append(state.count())
    got = log.read(spark)
    assert got.count() == len(want) and {(r.seed, r.kind, r.task, r.ts) for r in got.collect()} == want
    assert len(sent) >= len(batches) and sizes[1] == 2 and sizes[-1] == 2, sizes  # a's crash went, b's two are left
    assert len(list((tmp_path / "log/delta").iterdir())) <= 4 and len(list((tmp_path / "log/base").iterdir())) <= 2


def test_quota_over_frames(spark, tmp_path):
    data = [(c, k, (k * 7 + c) % 3 == 0) for c in (1, 2) for k in range(30)]
    for n in range(3):
        spark.createDataFrame([d for d in data if d[1] // 10 == n][::-1], "case_id long, trial_id long, passed boolean").coalesce(1).write.parquet(f"{tmp_path}/q/{n}")
    stream = spark.readStream.schema("case_id long, trial_id long, passed boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/q")
    want = []
    for c in (1, 2):
        passed = 0
        for _, k, ok in [d for d in data if d[0] == c][:20]:
            if ok and passed < 5:
                want.append((c, k, passed))
                passed += 1
    assert rows(jobs.run_once(jobs.accepted(stream, 5, 20), "quota_test", "append", f"{tmp_path}/cq"), "case_id", "trial_id", "sample_id") == sorted(want, key=repr)


def test_scene_files_are_dealt_out_and_pruned(spark, tmp_path):
    made = [(f"s{k}/logs/FINISH_t{k % 2}", b"") for k in range(9)] + [("s3/logs/other", b""), ("s4/FINISH_no", b""), ("stray", b"x")]
    mask = io.BytesIO()
    np.save(mask, np.array([[1, 1, 7], [0, 1, 7]], np.int16))
    made += [("s5/frames/a.npy", mask.getvalue()), ("s5/frames/a.txt", b""), ("s6/summary.json", json.dumps({"D": {"npy": {"0": {"1": {"7": "d.npy"}}}}, "Tags": {"7": "t.json"}}).encode())]
    root = f"file://{tmp_path}/scenes"
    files.write_files(spark.createDataFrame(made, "path string, content binary").repartition(3), root)
    markers = files.scene_files(spark, root, "markers", group=2)
    assert rows(markers, "seed", "task") == [(f"s{k}", f"t{k % 2}") for k in range(9)]
    assert markers.rdd.getNumPartitions() == 5
    one = markers.where("seed IN ('s3', 's4') AND task = 't1'")
    assert one.rdd.getNumPartitions() == 1 and rows(one, "seed", "task") == [("s3", "t1")]
    assert rows(files.scene_files(spark, root, "masks"), "seed", "path", "height", "width", "ids", "counts") == [("s5", "frames/a.npy", 2, 3, [0, 1, 7], [1, 3, 2])]
    shapes = files.scene_files(spark, root, "masks", "seed", "height", "width")
    assert shapes.columns == ["seed", "height", "width"] and rows(shapes, "height", "width") == [(2, 3)]
    assert rows(files.scene_files(spark, root, "index"), "type", "frame", "path") == [("D", "7", "d.npy")]
    assert files.scene_files(spark, f"{tmp_path}/none", "markers").collect() == []
    reader = files.SceneReader(files.StructType.fromDDL(files.KINDS["masks"]) if hasattr(files.StructType, "fromDDL") else shapes.schema, {"path": root, "kind": "masks"})
    left = list(reader.pushFilters([files.EqualTo(("seed",), "s5"), files.EqualTo(("height",), 2)]))
    assert [f.attribute for f in left] == [("height",)] and [p.names for p in reader.partitions()] == [["s5"]]


def test_programs_are_listed_by_the_tasks(spark, tmp_path):
    names = ["s/m1/blender", "s/m1/var_00001", "s/m 2/blender", "deep/er/s/m3/blender", "_not/m4/blender", ".no/m5/blender", "s/_m6/blender", "s/a=b/blender"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        for end in ("_full.py", "_render.jpg", ".txt"):
            (tmp_path / f"{name}{end}").write_text(f"{name} ü")
    (tmp_path / "s/m1/var_00002_full.py").write_text("no render")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        got = corpus.programs(spark, root)
        want = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_render.jpg").load(root)
        assert sorted(r.render_path for r in got.collect()) == sorted(r.path for r in want.collect())
        assert sorted((r.mat_name, r.data_name, r.code) for r in got.collect()) == sorted(("/".join(n.split("/")[-3:-1]), n.split("/")[-1], f"{n} ü") for n in names if not any(p[0] in "._" for p in n.split("/")))
        # What the driver lists are the files of the written levels, not those of the corpus.
        assert not [f for f in got.inputFiles() if f.endswith((".py", ".jpg"))]
    (tmp_path / "none").mkdir()
    assert corpus.programs(spark, str(tmp_path / "none")).collect() == []
