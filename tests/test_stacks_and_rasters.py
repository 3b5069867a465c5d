"""Op stacks, canonical numbers, palettes and resampling against facts worked by hand and plain versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.functions import recipes, stacks
from reelframe.operators import palette, raster

PRORES, H264 = (1920, 1080, 30.0, 4.0, 120, True, False, None, None), (1280, 720, 30000 / 1001, 10.0, 300, False, False, None, None)
GIF, STILL = (480, 270, 20.0, 3.0, 60, True, False, None, None), (800, 600, 0.0, 0.0, 1, True, True, None, None)
PLAIN = (0, 0, "", 0.0, "webp")


def sequence(count, delay):
    return (200, 100, None, None, count, True, False, count, delay)


def op(kind, **params):
    return {"kind": kind, "params": params}


def trims(*bounds):
    return [op("trim", start=a, end=b) for a, b in bounds]


#: Source, operations, output; width, height, rate, frames, length and alpha, or the error.
CASES = [
    (PRORES, [], PLAIN, (1920, 1080, 30, 120, 4, True)),
    (GIF, [], (0, 0, "", 0.0, "gif"), (480, 270, 20, 60, 3, True)),
    (H264, [*trims((1.5, 4)), op("fps", fps=30)], (0, 0, "", 0.0, "gif"), (1280, 720, 30, 75, 2.5, False)),
    (H264, [op("fps", fps=25), op("speed", factor=2)], PLAIN, (1280, 720, 25, 125, 5, False)),
    (H264, [op("speed", factor=0.5)], PLAIN, (1280, 720, 29.97, 599, 20, False)),
    (H264, [op("speed", factor=2), op("speed", factor=1.5)], PLAIN, (1280, 720, 29.97, 99, 10 / 3, False)),
    (PRORES, [op("crop", x=100, y=50, w=800, h=600), op("resize", width=400, height=400, fit="contain")], PLAIN, (400, 300, 30, 120, 4, True)),
    (H264, [op("resize", width=400, height=400, fit="contain")], PLAIN, (400, 225, 29.97, 299, 10, False)),
    (H264, [op("resize", width=400, height=400, fit="cover")], PLAIN, (400, 400, 29.97, 299, 10, False)),
    (H264, [op("resize", width=400, height=400, fit="exact")], PLAIN, (400, 400, 29.97, 299, 10, False)),
    (H264, [op("resize", width=640, height=0, fit="cover")], PLAIN, (640, 360, 29.97, 299, 10, False)),
    (PRORES, [op("resize", width=0, height=540)], PLAIN, (960, 540, 30, 120, 4, True)),
    (H264, [op("canvas", width=1280, height=1280)], PLAIN, (1280, 1280, 29.97, 299, 10, True)),
    (H264, [op("canvas", width=1000, height=1000)], PLAIN, (1000, 1000, 29.97, 299, 10, True)),
    (H264, [op("canvas", width=640, height=640)], PLAIN, (640, 640, 29.97, 299, 10, False)),
    (H264, [op("canvas", width=1280, height=1280, color="#313338")], PLAIN, (1280, 1280, 29.97, 299, 10, False)),
    (H264, [op("canvas", width=1280, height=1280, color="FF000080")], PLAIN, (1280, 1280, 29.97, 299, 10, True)),
    (H264, [op("rotate", degrees=90), op("crop", w=720, h=1000)], PLAIN, (720, 1000, 29.97, 299, 10, False)),
    (H264, [op("flip", horizontal=True), op("unpremultiply")], PLAIN, (1280, 720, 29.97, 299, 10, False)),
    (PRORES, [], (128, 128, "", 25.0, "gif"), (128, 128, 25, 100, 4, True)),
    (H264, [], (320, 320, "cover", 20.0, "gif"), (320, 320, 20, 200, 10, False)),
    (H264, trims((0, 5), (2, 8)), PLAIN, (1280, 720, 29.97, 89, 3, False)),
    (STILL, [], PLAIN, (800, 600, 10, 1, 0, True)),
    (sequence(34, 33), [], PLAIN, (200, 100, 30.303, 34, 34 / 30.303, True)),
    (sequence(5000, 17), [], PLAIN, (200, 100, 58.824, 5000, 5000 / 58.824, True)),
    (sequence(60, 40), trims((0, 0.11)), PLAIN, (200, 100, 25, 3, 0.12, True)),
    (sequence(60, 40), trims((0, 0.09)), PLAIN, (200, 100, 25, 2, 0.08, True)),
    (sequence(60, 40), trims((0.06, 0.11)), PLAIN, (200, 100, 25, 1, 0.04, True)),
    (sequence(60, 100), trims((5.9, 0)), PLAIN, (200, 100, 10, 1, 0.1, True)),
    (sequence(60, 100), trims((0, 5.94)), PLAIN, (200, 100, 10, 59, 5.9, True)),
    (sequence(60, 100), [op("speed", factor=1.5)], PLAIN, (200, 100, 10, 40, 4, True)),
    (sequence(60, 100), [*trims((0, 0.7)), op("speed", factor=2)], PLAIN, (200, 100, 10, 3, 0.35, True)),
    (sequence(60, 100), [*trims((0, 0.7)), op("speed", factor=2), op("fps", fps=20)], PLAIN, (200, 100, 20, 6, 0.35, True)),
    (sequence(60, 40), [op("delay", ms=100), op("fps", fps=25)], PLAIN, (200, 100, 25, 150, 6, True)),
    (sequence(60, 1), [], PLAIN, (200, 100, 60, 3, 0.06, True)),
    (sequence(60, 60000), [], PLAIN, (200, 100, 0.017, 60, 60 / 0.017, True)),
    (H264, [op("blur")], PLAIN, "0:blur:unknown"),
    (H264, [op("crop", w=0, h=9)], PLAIN, "0:crop:size"),
    (H264, [op("crop", w=9, h=9, x=-1)], PLAIN, "0:crop:offset"),
    (H264, [op("rotate", degrees=90), op("crop", w=721, h=9)], PLAIN, "1:crop:outside"),
    (H264, [op("resize", width=9, height=9, fit="fill")], PLAIN, "0:resize:fit"),
    (H264, [op("resize")], PLAIN, "0:resize:missing"),
    (H264, [op("resize", width=10**18)], PLAIN, "0:resize:side"),
    (H264, [op("resize", width=8192, height=8192, fit="cover")], PLAIN, "0:resize:frame"),
    (H264, [op("canvas", width=9, height=9, color="red")], PLAIN, "0:canvas:color"),
    (H264, [op("rotate", degrees=45)], PLAIN, "0:rotate:degrees"),
    (H264, [op("speed", factor=0)], PLAIN, "0:speed:factor"),
    (H264, [op("speed", factor=90), op("speed", factor=90)], PLAIN, "speed:range"),
    (H264, [op("fps", fps=0.0001)], PLAIN, "fps:low"),
    (H264, trims((-1, 0)), PLAIN, "0:trim:start"),
    (H264, trims((4, 3)), PLAIN, "0:trim:order"),
    (H264, trims((0, 3), (4, 0)), PLAIN, "trim:apart"),
    # Trims are planned before frames, whatever their order.
    (H264, [op("crop", w=0, h=9), *trims((10, 0))], PLAIN, "trim:late"),
    (STILL, trims((1, 0)), PLAIN, "0:trim:still"),
    (sequence(1, 100), trims((0, 0.05)), PLAIN, "0:trim:single"),
    (sequence(60, 100), trims((5.96, 0)), PLAIN, "trim:none"),
    (sequence(60, 100), trims((1, 1.04)), PLAIN, "trim:short"),
    (sequence(60, 100), [op("delay", ms=0)], PLAIN, "0:delay:ms"),
    (sequence(2, 100), [op("speed", factor=4)], PLAIN, "speed:none"),
    (H264, [], (0, 0, "wide", 0.0, "webp"), "output:fit"),
    (H264, [], (9000, 0, "", 0.0, "webp"), "output:side"),
    (H264, [op("speed", factor=0.05), op("resize", width=8000)], PLAIN, "1:resize:frame"),
    ((0, 9, *H264[2:]), [], PLAIN, "source:size"),
]
SOURCE = "i long, width long, height long, fps double, duration double, frames long, has_alpha boolean, is_still boolean, count long, delay long, json string, out_w long, out_h long, out_fit string, out_fps double, format string"


def test_op_stacks_by_hand(spark):
    rows = [(i, *source, json.dumps(ops), *out) for i, (source, ops, out, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, SOURCE).withColumn("ops", stacks.parse_ops(F.col("json")))
    for r in stacks.plan(df).select("i", "plan.*").collect():
        want = CASES[r.i][3]
        if isinstance(want, str) or r.error:
            assert (r.error, r.width) == (want, None), CASES[r.i]
        else:
            assert (r.width, r.height, r.fps, r.frames, r.duration, r.has_alpha) == pytest.approx(want), CASES[r.i]


def test_odd_stacks_have_a_plan(spark):
    """Null operations, null parameters, unknown lengths: no row raises."""
    odd = [None, "[]", "nonsense", '[{"kind":null}]', '[{"kind":"crop"}]', '[{"kind":"speed","params":null}]', '[{"kind":"fps","params":{"fps":"x"}}]', json.dumps([op("flip")] * 200)]
    rows = [(i, *(PRORES if i % 2 else (640, 480, None, None, None, None, None, None, None)), j, *PLAIN) for i, j in enumerate(odd)]
    df = spark.createDataFrame(rows, SOURCE).withColumn("ops", stacks.parse_ops(F.col("json")))
    got = {r.i: r.plan for r in stacks.plan(df).select("i", "plan").collect()}
    assert len(got) == len(odd) and got[0].frames is None and got[0].width == 640 and got[4].error == "0:crop:size"
    assert got[5].error == "0:speed:factor" and got[7].frames == 120


def test_canonical_numbers(spark):
    """Numbers of recipes as their nearest double's shortest digits; hashes follow from these texts."""
    cases = [
        ('{"ops":[{"kind":"speed","params":{"f":1e3,"z":1.50,"y":100000000000000000000,"x":1e21,"w":1e-7,"u":12345678901234567890.5,"t":0.000001,"s":"1e3 2.0"}}],"output":{"format":"gif","fps":1e2}}',
         '{"v":1,"sources":null,"ops":[{"kind":"speed","params":{"f":1000,"s":"1e3 2.0","t":0.000001,"u":12345678901234567000,"w":1e-7,"x":1e+21,"y":100000000000000000000,"z":1.5}}],"output":{"format":"gif","fps":100}}'),
        ('{"output":{"format":"webp","fps":12.50,"colors":0,"fitBytes":9007199254740993},"ops":[{"kind":"a","params":{"n":9007199254740993,"m":-2.5e-3,"k":-1.25e10}}]}',
         '{"v":1,"sources":null,"ops":[{"kind":"a","params":{"k":-12500000000,"m":-0.0025,"n":9007199254740992}}],"output":{"format":"webp","fps":12.5,"fitBytes":9007199254740993}}'),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string")
    assert {r.i: r.c for r in df.select("i", recipes.canonical(F.col("j")).alias("c")).collect()} == {i: c[1] for i, c in enumerate(cases)}
    plan = df.select(F.sha2(recipes.canonical(F.col("j")), 256).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def pixels(spark, frames):
    rows = [(c, i, x, y, *map(int, f[y, x])) for c, clip in enumerate(frames) for i, f in enumerate(clip) for y in range(f.shape[0]) for x in range(f.shape[1])]
    return spark.createDataFrame(rows, "clip long, frame_idx long, x int, y int, r int, g int, b int, a int")


def test_palettes(spark):
    rnd = np.random.default_rng(1)
    solid = rnd.integers(0, 256, (2, 9, 9, 4)).astype(np.uint8)
    solid[..., 3] = 255
    clear = solid.copy()
    clear[0, 0, 0, 3] = 0
    still = np.repeat(solid[:1], 2, axis=0)
    one, none = np.full((1, 4, 4, 4), 255, np.uint8), np.zeros((1, 2, 2, 4), np.uint8)
    got = {}
    for r in palette.palettes(pixels(spark, [solid, clear, still, one, none]), 8).collect():
        got.setdefault(r.clip, []).append(r)
    assert [len(got[c]) for c in range(5)] == [8, 8, 8, 1, 1]
    assert all(sorted(r["index"] for r in p) == list(range(len(p))) for p in got.values())
    assert [sum(r.n for r in got[c]) for c in (0, 2, 3)] == [162, 81, 16]  # a still second frame counts once
    assert [r for r in got[1] if r.r is None][0]["index"] == 7 and got[4][0].r is None and (got[3][0].r, got[3][0].g) == (255, 255)
    # Means of a clip's boxes weigh up to the mean of its pixels.
    assert abs(sum(r.r * r.n for r in got[0]) / 162 - solid[..., 0].mean()) <= 0.5


def test_lanczos_equals_the_kernel_on_arrays(spark):
    rnd = np.random.default_rng(2)
    for (h, w), (th, tw) in (((5, 7), (9, 4)), ((8, 8), (3, 3)), ((4, 4), (4, 4)), ((1, 6), (2, 13))):
        f = rnd.integers(0, 256, (h, w, 4)).astype(np.uint8)
        f[0, :2, 3] = 0
        size = lambda a, b: F.struct(F.lit(a).alias("w"), F.lit(b).alias("h"))
        got = np.zeros((th, tw, 4), np.int64)
        for r in palette.resize(pixels(spark, [[f]]), size(w, h), size(tw, th)).collect():
            got[r.y, r.x] = r.r, r.g, r.b, r.a
        want = raster.resize(f, tw, th).astype(np.int64)
        solid = want[..., 3] > 16
        assert abs(got - want)[solid].max() <= 1 and abs(got[..., 3] - want[..., 3]).max() <= 1
        if (h, w) == (th, tw):
            assert (got[f[..., 3] > 0] == f[f[..., 3] > 0]).all()


def test_a_recipe_writes_each_json_value_once(spark):
    """Sources, edits and output are written once each, however often their texts are looked at."""
    df = spark.createDataFrame([('{"output":{"format":"gif","fps":1e-7}}',)], "j string").repartition(1)
    out = df.select(recipes.canonical(F.col("j")).alias("c"))
    assert out.first().c == '{"v":1,"sources":null,"ops":[],"output":{"format":"gif","fps":1e-7}}'
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("to_json(") + plan.count("structstojson") <= 3
