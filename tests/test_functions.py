import numpy as np
import pytest
from pyspark.sql import functions as F

from matterloom.functions import text as fx
from matterloom.functions.hashing import int_hash
from matterloom.operators import palette


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()], F.lit(0).alias("_"))
    return row.select(column.alias("v")).first().v


def test_scalars(spark):
    for x, want in [(0.123456, 0.123), (12.345, 12.3), (1234.5, 1230.0), (-0.00456, -0.005), (0.0123, 0.012), (0.0, 0.0)]:
        assert value(spark, fx.literal(F.lit(x))) == want
    assert value(spark, fx.identifier(F.lit("Größe--Node  (α)__x"))) == "Größe_Node_α_x"
    assert value(spark, int_hash(42, "abc")) == 1686778371
    assert [value(spark, fx.short_count(F.lit(n))) for n in (999, 1500, 2_500_000)] == ["999", "1.50K", "2.50M"]
    assert value(spark, fx.short_stem(F.lit("a_very_much_too_long_name__" + "x" * 21))) == "a_very_much_too_long_name"
    assert tuple(value(spark, fx.asset_name(F.lit("Tree(12).spawn_asset(3)")))) == ("Tree", 12, "asset", 3)
    assert value(spark, fx.asset_name(F.lit("Tree.spawn_asset(3)"))) is None
    assert value(spark, fx.class_name(F.lit("a:Rock.001(12)"))) == "Rock"
    assert value(spark, fx.bytes_text(F.lit(1536.0))) == "1.5 KiB" and value(spark, fx.bytes_text(F.lit(12.0))) == "12.0 B"
    assert value(spark, fx.literal_text(F.array(F.lit(0.123456), F.lit(2.0)), "array")) == "[0.123, 2.0]"


def test_literals_that_round_to_zero_keep_their_sign(spark):
    values = F.array(*map(F.lit, (-0.0003, 0.0003, -0.0005, 0.0, -1234.5)))
    assert value(spark, fx.literal_text(values, "array")) == "[-0.0, 0.0, -0.001, 0.0, -1230.0]"


def test_times_and_jobs(spark):
    assert [value(spark, fx.seconds(F.lit(t))) for t in ("0:02:05.123", "1 day, 2:00:00", "x", "11:00:00")] == [125, 93600, None, 39600]
    assert value(spark, fx.clock(F.lit(93605))) == "26:00:05"
    job = value(spark, fx.job_line(F.lit("123 job_ab12_coarse cpu=4,mem=24G,node=1,gpu=1 3600 COMPLETED node007 2023-07-01T10:00:00")))
    assert (job.job_id, job.resources["mem"], job.elapsed, job.state, job.start.year) == (123, "24G", 3600, "COMPLETED", 2023)
    assert value(spark, fx.job_line(F.lit("nothing"))) is None
    assert value(spark, fx.job_line(F.lit("1 a b 2 RUNNING node1 2023-07-01T10:00:00 and more"))).node == "node1"
    assert value(spark, fx.job_line(F.lit("1 a b 2 running node1 x"))) is None and value(spark, fx.job_line(F.lit("1 a b 2 RUNNING gpu1 x"))) is None
    assert [value(spark, fx.memory_gb(F.lit(t).cast("string"))) for t in ("512000K", "24G", "1500M", None, "")] == [0.512, 24.0, 1.5, -1.0, -1.0]


def test_crash_reasons(spark):
    assert value(spark, fx.crash_reason(F.lit("srun: error\nSystem is out of GPU memory\n"))) == "Out of GPU memory"
    assert value(spark, fx.crash_reason(F.lit("Error: Not freed memory blocks: 2\n"))) == fx.NO_REASON
    assert value(spark, fx.crash_reason(F.lit("Error: a\nError: Not freed memory blocks\nError: b\n"))) == "Error: a,Error: b"
    assert value(spark, fx.tool_error(F.lit("x Error: Python: boom\nBlender quit"))) == "Error: Python: boom\n"


def test_responses(spark):
    block = "Hi ```python\ndef shader_material(m):\n  pass\n``` end"
    assert value(spark, fx.response_code(F.lit(block))) == "def shader_material(m):\n  pass\n"
    assert value(spark, fx.response_reason(F.lit("plain"))) == "No code block found"
    assert value(spark, fx.response_reason(F.lit("```python\nx = 1"))) == "Function not defined"
    assert value(spark, fx.response_reason(F.lit(block))) is None
    assert value(spark, fx.extract_code(F.lit("just text"))) == "just text" and value(spark, fx.extract_code(F.lit("a ```python x``` b"))) == " x"
    assert value(spark, fx.extract_code(F.lit("\u2003 python y\n"))) == " y"
    assert value(spark, fx.bare_answer(F.lit("```python\nx = 1\n```"))) == "x = 1\n"
    assert value(spark, fx.pair_prompt(F.lit("import bpy\ndef shader_material(m):"), F.lit("y"))).startswith("```python\nimport bpy\n\n")


def test_urls_and_keys(spark):
    assert tuple(value(spark, fx.data_url(F.lit("data:image/png;base64,aGk=")))) == (".png", b"hi")
    assert value(spark, fx.data_url(F.lit("data:x/y;base64,aGk="))).extension == ".bin"
    kinds = {"jpeg": ".jpg", "jpg": ".jpg", "webp": ".webp", "bmp": ".bmp", "tiff": ".tiff", "gif": ".bin"}
    assert {k: value(spark, fx.data_url(F.lit(f"data:image/{k};base64,aGk="))).extension for k in kinds} == kinds
    assert value(spark, fx.data_url(F.lit("data:image/png;base64,a"))) is None and value(spark, fx.data_url(F.lit("http://x"))) is None
    import hashlib

    none = F.lit(None).cast("string")
    assert value(spark, fx.content_key(none, F.lit(""), F.lit("oak"), F.lit(0))) == hashlib.sha256(b"oak::rank=0").hexdigest()[:16]


def test_colours(spark):
    import colorsys

    r = np.random.default_rng(1)
    for rgb in r.random((20, 3)).tolist() + [[0.2, 0.2, 0.2], [0.0, 0.0, 0.0]]:
        hsv = [value(spark, c) for c in palette.rgb_to_hsv(*map(F.lit, rgb))]
        assert hsv == pytest.approx(colorsys.rgb_to_hsv(*rgb)) and [value(spark, c) for c in palette.hsv_to_rgb(*map(F.lit, hsv))] == pytest.approx(rgb)
    moved = value(spark, palette.jittered(F.array(*map(F.lit, (0.5, 0.2, 0.1, 1.0))), 0.5, 1, "k"))
    assert len(moved) == 4 and all(0 <= x <= 1 for x in moved)
