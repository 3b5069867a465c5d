"""Planner queries: rates, sizes, counts, guards, probe derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planning as P
from ..functions.numbers import div, round_half_up
from ..operators.temporal import frame_count
from ..sources import views as V
from .registry import query

R = V.over("v_recipes")
KEYS = ["k1", "k2", "k3", "k4"]
_KEYS = "k1, k2, k3, k4"


def recipes(spark, d):
    return V.recipes(spark, d)


def _round3(x: str) -> str:
    return f"(floor(({x}) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE)"


_CAP = "CASE WHEN format = 'gif' THEN 50.0::DOUBLE ELSE 60.0::DOUBLE END"


def _snap(wanted: str) -> str:
    return _round3(f"greatest(0.001::DOUBLE, least(coalesce({wanted}, fps), {_CAP}))")


@query("snap_fps", R + f"SELECT {_KEYS}, format, {_snap('CASE WHEN n % 2 = 0 THEN fps * 1.37::DOUBLE END')} AS out_fps FROM v_recipes")
def snap_fps(spark, d):
    r = recipes(spark, d)
    return r.select(*KEYS, "format", P.snap_fps(F.col("fps"), F.when(F.col("n") % 2 == 0, F.col("fps") * F.lit(1.37)), F.col("format")).alias("out_fps"))


@query("sequence_rate", R + f"SELECT q, n, {_round3('1000.0::DOUBLE / coalesce(nullif(q % 7 * n, 0), 100)')} AS rate FROM v_recipes")
def sequence_rate(spark, d):
    return recipes(spark, d).select("q", "n", P.sequence_rate(F.col("q") % 7 * F.col("n")).alias("rate"))


_BY_W = "greatest(1, (h * box_w * 2 + w) // (w * 2))"
_BY_H = "greatest(1, (w * box_h * 2 + h) // (h * 2))"
_FIT = "['contain', 'cover', 'exact'][n % 3 + 1]"
_BIND = f"(CASE WHEN {_FIT} = 'cover' THEN box_w * h >= box_h * w ELSE box_w * h <= box_h * w END)"
_SIZE_W = f"CASE WHEN {_FIT} = 'exact' THEN box_w WHEN {_BIND} THEN box_w ELSE {_BY_H} END"
_SIZE_H = f"CASE WHEN {_FIT} = 'exact' THEN box_h WHEN {_BIND} THEN {_BY_W} ELSE box_h END"


def fit_mode():
    return F.element_at(F.array(F.lit("contain"), F.lit("cover"), F.lit("exact")), (F.col("n") % 3 + 1).cast("int"))


@query("scaled_size", R + f"SELECT {_KEYS}, {_SIZE_W} AS out_w, {_SIZE_H} AS out_h FROM v_recipes")
def scaled_size(spark, d):
    w, h = P.scaled_size(F.col("w"), F.col("h"), F.col("box_w"), F.col("box_h"), fit_mode())
    return recipes(spark, d).select(*KEYS, w.alias("out_w"), h.alias("out_h"))


@query("output_fit", R + f"""SELECT {_KEYS}, CASE WHEN fit = 'cover' THEN sw - box_w ELSE 0 END AS crop_x2, CASE WHEN fit = 'cover' THEN sh - box_h ELSE 0 END AS crop_y2, CASE WHEN fit = 'contain' THEN box_w - sw ELSE 0 END AS pad_w, CASE WHEN fit = 'contain' THEN box_h - sh ELSE 0 END AS pad_h
FROM (SELECT *, {_FIT} AS fit, {_SIZE_W} AS sw, {_SIZE_H} AS sh FROM v_recipes)""")
def output_fit(spark, d):
    """What is cropped (cover) or padded (contain) after scaling, so that the box is met exactly."""
    w, h = P.scaled_size(F.col("w"), F.col("h"), F.col("box_w"), F.col("box_h"), fit_mode())
    r = recipes(spark, d).select("*", fit_mode().alias("fit"), w.alias("sw"), h.alias("sh"))
    on = lambda fit, x: F.when(F.col("fit") == fit, x).otherwise(F.lit(0).cast("long"))
    return r.select(*KEYS, on("cover", F.col("sw") - F.col("box_w")).alias("crop_x2"), on("cover", F.col("sh") - F.col("box_h")).alias("crop_y2"), on("contain", F.col("box_w") - F.col("sw")).alias("pad_w"), on("contain", F.col("box_h") - F.col("sh")).alias("pad_h"))


_OPS_SQL = """, ops AS (SELECT k1, k2, k3, k4, w AS w0, h AS h0, n, q, box_w, box_h,
 CASE WHEN n % 2 = 0 THEN h ELSE w END AS w1, CASE WHEN n % 2 = 0 THEN w ELSE h END AS h1 FROM v_recipes),
cropped AS (SELECT *, greatest(1, w1 - q) AS w2, greatest(1, h1 - n) AS h2 FROM ops),
resized AS (SELECT *, CASE WHEN q % 3 = 0 THEN box_w ELSE w2 END AS w3, CASE WHEN q % 3 = 0 THEN greatest(1, (h2 * box_w * 2 + w2) // (w2 * 2)) ELSE h2 END AS h3 FROM cropped)
"""


@query("plan_geometry", R + _OPS_SQL + "SELECT k1, k2, k3, k4, CASE WHEN n % 4 = 0 THEN box_w ELSE w3 END AS width, CASE WHEN n % 4 = 0 THEN box_h ELSE h3 END AS height, n % 4 = 0 AND (box_w > w3 OR box_h > h3) AS has_alpha FROM resized")
def plan_geometry(spark, d):
    """Rotate, crop, resize and canvas folded over an array of operations."""
    ops = F.array(
        F.struct(F.when(F.col("n") % 2 == 0, "rotate").otherwise("none").alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")),
        F.struct(F.lit("crop").alias("kind"), F.col("q").alias("a"), F.col("n").alias("b")),
        F.struct(F.when(F.col("q") % 3 == 0, "resize").otherwise("none").alias("kind"), F.col("box_w").alias("a"), F.lit(0).cast("long").alias("b")),
        F.struct(F.when(F.col("n") % 4 == 0, "canvas").otherwise("none").alias("kind"), F.col("box_w").alias("a"), F.col("box_h").alias("b")),
    )

    def step(s, op):
        w, h = s["w"], s["h"]
        k = op["kind"]
        nw = F.when(k == "rotate", h).when(k == "crop", F.greatest(F.lit(1), w - op["a"])).when(k.isin("resize", "canvas"), op["a"]).otherwise(w)
        nh = F.when(k == "rotate", w).when(k == "crop", F.greatest(F.lit(1), h - op["b"])).when(k == "resize", F.greatest(F.lit(1), div(h * op["a"] * 2 + w, w * 2))).when(k == "canvas", op["b"]).otherwise(h)
        alpha = s["alpha"] | ((k == "canvas") & ((op["a"] > w) | (op["b"] > h)))
        return F.struct(nw.cast("long").alias("w"), nh.cast("long").alias("h"), alpha.alias("alpha"))

    zero = F.struct(F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"), F.lit(False).alias("alpha"))
    r = recipes(spark, d).withColumn("s", F.aggregate(ops, zero, step))
    return r.select(*KEYS, F.col("s.w").alias("width"), F.col("s.h").alias("height"), F.col("s.alpha").alias("has_alpha"))


@query("plan_duration", R + f"SELECT {_KEYS}, (least(duration, CASE WHEN n = 1 THEN duration ELSE start + q END) - start) / speed AS out_duration FROM v_recipes WHERE start < duration")
def plan_duration(spark, d):
    end = F.least(F.col("duration"), F.when(F.col("n") == 1, F.col("duration")).otherwise(F.col("start") + F.col("q")))
    return recipes(spark, d).where("start < duration").select(*KEYS, ((end - F.col("start")) / F.col("speed")).alias("out_duration"))


@query("plan_summary", R + f"""SELECT {_KEYS}, out_w AS width, out_h AS height, out_fps, greatest(1, floor(out_duration * out_fps + 1e-4))::BIGINT AS frames, out_duration FROM
(SELECT *, {_SIZE_W} AS out_w, {_SIZE_H} AS out_h, {_snap('NULL')} AS out_fps, (duration - start) / speed AS out_duration FROM v_recipes WHERE start < duration)""")
def plan_summary(spark, d):
    w, h = P.scaled_size(F.col("w"), F.col("h"), F.col("box_w"), F.col("box_h"), fit_mode())
    r = recipes(spark, d).where("start < duration").select(*KEYS, w.alias("width"), h.alias("height"), P.snap_fps(F.col("fps"), F.lit(None).cast("double"), F.col("format")).alias("out_fps"), ((F.col("duration") - F.col("start")) / F.col("speed")).alias("out_duration"))
    return r.withColumn("frames", frame_count(F.col("out_duration"), F.col("out_fps")))


@query("sequence_selection", R + f"""SELECT {_KEYS}, first, kept, CASE WHEN first >= count OR kept = 0 THEN NULL ELSE least(kept, count - first) END AS selected FROM
(SELECT *, (2 * a * rate + 1000000000) // 2000000000 AS first, (2 * b * rate + 1000000000) // 2000000000 AS kept FROM (SELECT *, q * 2 AS count, (n - 1) * 330000 AS a, q * 40000 AS b, floor(fps * 1000 + 0.5::DOUBLE)::BIGINT AS rate FROM v_recipes))""")
def sequence_selection(spark, d):
    r = recipes(spark, d).select(*KEYS, (F.col("q") * 2).alias("count"), ((F.col("n") - 1) * 330000).alias("a"), (F.col("q") * 40000).alias("b"), round_half_up(F.col("fps") * 1000).alias("rate"))
    r = r.select(*KEYS, "count", P.grid_round(F.col("a"), F.col("rate")).alias("first"), P.grid_round(F.col("b"), F.col("rate")).alias("kept"))
    return r.select(*KEYS, "first", "kept", F.when((F.col("first") < F.col("count")) & (F.col("kept") > 0), F.least("kept", F.col("count") - F.col("first"))).alias("selected"))


@query("sequence_frames", R + f"SELECT {_KEYS}, floor(q * 10 / speed)::BIGINT * (n * 5000) // floor(fps * 1000 + 0.5::DOUBLE)::BIGINT AS frames FROM v_recipes")
def sequence_frames(spark, d):
    return recipes(spark, d).select(*KEYS, P.sequence_frames(F.col("q") * 10, F.col("speed"), F.col("n") * 5000, round_half_up(F.col("fps") * 1000)).alias("frames"))


@query("plan_errors", R + f"""SELECT {_KEYS}, CASE WHEN w * 8 > 8192 OR h * 8 > 8192 THEN 'side' WHEN w * 8 * h * 8 > 33554432 THEN 'area' WHEN speed * n * 8 < 0.05 OR speed * n * 8 > 100 THEN 'speed' WHEN w * 8 * h * 8 * 4 * (q * 10) > 8589934592 THEN 'master' END AS error FROM v_recipes""")
def plan_errors(spark, d):
    r = recipes(spark, d)
    return r.select(*KEYS, P.plan_error(F.col("w") * 8, F.col("h") * 8, F.col("speed") * F.col("n") * 8, F.col("q") * 10).alias("error"))


@query("scratch_reserve", R + f"SELECT {_KEYS}, (need + greatest(need // 8, 8388608)) * (1 + k3 % 3) AS bytes FROM (SELECT *, w * h * 4 * q AS need FROM v_recipes)")
def scratch_reserve(spark, d):
    return recipes(spark, d).select(*KEYS, P.reserve_bytes(F.col("w"), F.col("h"), F.col("q"), 1 + F.col("k3") % 3).alias("bytes"))


@query("still_time", R + f"SELECT {_KEYS}, CASE WHEN q = 1 THEN 0.0::DOUBLE ELSE floor(least(start * 10, (q - 0.5::DOUBLE) / fps) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE END AS t FROM v_recipes")
def still_time(spark, d):
    from ..functions.numbers import round_to

    t = F.least(F.col("start") * 10, (F.col("q") - F.lit(0.5)) / F.col("fps"))
    return recipes(spark, d).select(*KEYS, F.when(F.col("q") == 1, F.lit(0.0)).otherwise(round_to(t, 3)).alias("t"))


@query("still_seek", R + f"""SELECT {_KEYS}, k AS seek_slots, start + k * period AS seek_start, greatest(0, least(floor(t * fps + 1e-6)::BIGINT, q - 1) - k) AS slot FROM
(SELECT *, floor((greatest(start, start + t * speed - back) - start) / period + 1e-6)::BIGINT AS k FROM (SELECT *, n * 0.5::DOUBLE AS t, speed / fps AS period, greatest(2 / fps, 0.1::DOUBLE) + speed / fps AS back FROM v_recipes))""")
def still_seek(spark, d):
    """Where a decoder starts for the frame at time t: a slot boundary at least a margin before it."""
    r = recipes(spark, d).select("*", (F.col("n") * F.lit(0.5)).alias("t"), (F.col("speed") / F.col("fps")).alias("period"))
    r = r.withColumn("back", F.greatest(F.lit(2) / F.col("fps"), F.lit(0.1)) + F.col("speed") / F.col("fps"))
    target = F.greatest(F.col("start"), F.col("start") + F.col("t") * F.col("speed") - F.col("back"))
    r = r.withColumn("k", F.floor((target - F.col("start")) / F.col("period") + F.lit(1e-6)).cast("long"))
    slot = F.least(F.floor(F.col("t") * F.col("fps") + F.lit(1e-6)).cast("long"), F.col("q") - 1) - F.col("k")
    return r.select(*KEYS, F.col("k").alias("seek_slots"), (F.col("start") + F.col("k") * F.col("period")).alias("seek_start"), F.greatest(F.lit(0).cast("long"), slot).alias("slot"))


@query("variant_frames", R + f"SELECT {_KEYS}, CASE WHEN box_fps < fps AND floor(q * box_fps / fps + 1e-6) >= 1 THEN floor(q * box_fps / fps + 1e-6)::BIGINT ELSE q END AS frames FROM (SELECT *, n * 4.0::DOUBLE AS box_fps FROM v_recipes)")
def variant_frames(spark, d):
    return recipes(spark, d).select(*KEYS, P.variant_frames(F.col("q"), F.col("fps"), F.col("n") * F.lit(4.0)).alias("frames"))


@query("tile_grid", R + f"SELECT {_KEYS}, (q + rows - 1) // rows AS cols, rows FROM (SELECT *, (q + c - 1) // c AS rows FROM (SELECT *, least(ceil(sqrt(q::DOUBLE))::BIGINT, greatest(1, 16384 // w)) AS c FROM v_recipes))")
def tile_grid(spark, d):
    c, r = P.tile_grid(F.col("q"), F.col("w"))
    return recipes(spark, d).select(*KEYS, c.alias("cols"), r.alias("rows"))


@query("mjpeg_q", R + "SELECT DISTINCT q * 2 AS quality, 31 - floor((least(100, greatest(1, q * 2)) - 1) * 29.0::DOUBLE / 99.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS mjpeg_q FROM v_recipes")
def mjpeg_q(spark, d):
    return recipes(spark, d).select((F.col("q") * 2).alias("quality"), P.mjpeg_q(F.col("q") * 2).alias("mjpeg_q")).distinct()


@query("loop_counts", R + f"SELECT {_KEYS}, format, least(65535, CASE WHEN l <= 0 THEN 0 WHEN format IN ('webp', 'apng') THEN l + 1 ELSE l END) AS stored FROM (SELECT *, (q - 5) * (n * n * 200) AS l FROM v_recipes)")
def loop_counts(spark, d):
    return recipes(spark, d).select(*KEYS, "format", P.loop_counts((F.col("q") - 5) * (F.col("n") * F.col("n") * 200), F.col("format")).alias("stored"))


@query("clamp_defaults", R + "SELECT q, n, CASE WHEN c = 0 THEN 256 ELSE least(256, greatest(2, c)) END AS colors, CASE WHEN qu = 0 THEN 80 ELSE least(100, greatest(1, qu)) END AS quality FROM (SELECT DISTINCT q, n, (q - 1) * n AS c, (n - 1) * q AS qu FROM v_recipes)")
def clamp_defaults(spark, d):
    r = recipes(spark, d).select("q", "n").distinct()
    clamp = lambda x, least, most, default: F.when(x == 0, F.lit(default)).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), x))).cast("long")
    return r.select("q", "n", clamp((F.col("q") - 1) * F.col("n"), 2, 256, 256).alias("colors"), clamp((F.col("n") - 1) * F.col("q"), 1, 100, 80).alias("quality"))


@query("frame_span", R + f"SELECT {_KEYS}, floor(start * fps + 1e-6)::BIGINT AS a, least(q - 1, greatest(floor(start * fps + 1e-6)::BIGINT, ceil(least(duration, start + n) * fps - 1e-6)::BIGINT - 1)) AS b FROM v_recipes")
def frame_span(spark, d):
    """First and last source frame inside a trim."""
    a = F.floor(F.col("start") * F.col("fps") + F.lit(1e-6)).cast("long")
    b = F.ceil(F.least(F.col("duration"), F.col("start") + F.col("n")) * F.col("fps") - F.lit(1e-6)).cast("long") - 1
    return recipes(spark, d).select(*KEYS, a.alias("a"), F.least(F.col("q") - 1, F.greatest(a, b)).alias("b"))


_CS = "floor(duration * n * 37 * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT"


@query("fmt_timecode", R + f"SELECT {_KEYS}, CASE WHEN cs // 6000 < 100 THEN lpad((cs // 6000)::VARCHAR, 2, '0') ELSE (cs // 6000)::VARCHAR END || ':' || lpad((cs % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((cs % 100)::VARCHAR, 2, '0') AS timecode FROM (SELECT *, {_CS} AS cs FROM v_recipes)")
def fmt_timecode(spark, d):
    return recipes(spark, d).select(*KEYS, P.timecode(F.col("duration") * F.col("n") * 37).alias("timecode"))


@query("fmt_bytes", "SELECT o_orderkey AS job, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN (b // 1024) || '.' || (b % 1024 * 10 // 1024) || ' KiB' ELSE (b // 1048576) || '.' || (b % 1048576 * 10 // 1048576) || ' MiB' END AS size FROM (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 50))::BIGINT AS b FROM orders)")
def fmt_bytes(spark, d):
    o = V.read(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 50)).cast("long").alias("b"))
    unit = lambda u, name: F.concat(div("b", u), F.lit("."), div(F.col("b") % u * 10, u), F.lit(f" {name}"))
    return o.select(F.col("o_orderkey").alias("job"), F.when(F.col("b") < 1024, F.concat("b", F.lit(" B"))).when(F.col("b") < 1048576, unit(1024, "KiB")).otherwise(unit(1048576, "MiB")).alias("size"))


@query("avif_timing", R + f"SELECT {_KEYS}, CASE WHEN fps = floor(fps) THEN fps::BIGINT ELSE floor(fps * 1000 + 0.5::DOUBLE)::BIGINT END AS timescale, CASE WHEN fps = floor(fps) THEN 1 ELSE 1000 END::BIGINT AS unit FROM v_recipes")
def avif_timing(spark, d):
    whole = F.col("fps") == F.floor("fps")
    return recipes(spark, d).select(*KEYS, F.when(whole, F.col("fps").cast("long")).otherwise(round_half_up(F.col("fps") * 1000)).alias("timescale"), F.when(whole, 1).otherwise(1000).cast("long").alias("unit"))


@query("gifsicle_args", R + f"SELECT {_KEYS}, concat_ws(' ', CASE WHEN n % 2 = 0 THEN '-U' END, '-O' || CASE WHEN n = 0 THEN 2 ELSE least(3, greatest(1, n)) END, CASE WHEN l > 0 THEN '--lossy=' || least(200, l) END, CASE WHEN q % 4 = 0 THEN '--colors=' || least(256, greatest(2, q * 6)) END) AS args FROM (SELECT *, (q - 10) * n AS l FROM v_recipes)")
def gifsicle_args(spark, d):
    """Options of a GIF post-pass in their fixed order, normalised to their ranges."""
    lossy = (F.col("q") - 10) * F.col("n")
    level = F.when(F.col("n") == 0, 2).otherwise(F.least(F.lit(3), F.greatest(F.lit(1), "n"))).cast("long")
    parts = [F.when(F.col("n") % 2 == 0, F.lit("-U")), F.concat(F.lit("-O"), level), F.when(lossy > 0, F.concat(F.lit("--lossy="), F.least(F.lit(200), lossy).cast("long"))), F.when(F.col("q") % 4 == 0, F.concat(F.lit("--colors="), F.least(F.lit(256), F.greatest(F.lit(2), F.col("q") * 6)).cast("long")))]
    return recipes(spark, d).select(*KEYS, F.concat_ws(" ", *parts).alias("args"))


@query("encoder_dispatch", R + "SELECT format, q % 9 = 0 AS still, count(*) AS n, format IN ('gif', 'webp', 'apng', 'avif', 'png', 'jpeg') AS can_fit, CASE WHEN format IN ('png', 'jpeg') OR (q % 9 = 0 AND format <> 'gif') THEN 'still' WHEN format = 'gif' THEN 'palette' ELSE 'animation' END AS path FROM v_recipes GROUP BY ALL")
def encoder_dispatch(spark, d):
    still = F.col("q") % 9 == 0
    path = F.when(F.col("format").isin("png", "jpeg") | (still & (F.col("format") != "gif")), "still").when(F.col("format") == "gif", "palette").otherwise("animation")
    r = recipes(spark, d).select("format", still.alias("still"), F.col("format").isin("gif", "webp", "apng", "avif", "png", "jpeg").alias("can_fit"), path.alias("path"))
    return r.groupBy("format", "still", "can_fit", "path").agg(F.count("*").alias("n"))


# -- probe ------------------------------------------------------------------------------
_RATE = "CASE n % 4 WHEN 0 THEN q * 1000 || '/1001' WHEN 1 THEN q || '/1' WHEN 2 THEN q || '.5' ELSE q || '/0' END"


@query("parse_rate", R + f"""SELECT DISTINCT rate, coalesce(CASE WHEN contains(rate, '/') THEN CASE WHEN try_cast(split_part(rate, '/', 2) AS DOUBLE) > 0 THEN try_cast(split_part(rate, '/', 1) AS DOUBLE) / try_cast(split_part(rate, '/', 2) AS DOUBLE) END ELSE try_cast(rate AS DOUBLE) END, 0.0) AS fps FROM (SELECT {_RATE} AS rate FROM v_recipes)""")
def parse_rate(spark, d):
    n = F.col("n") % 4
    rate = F.when(n == 0, F.concat(F.col("q") * 1000, F.lit("/1001"))).when(n == 1, F.concat("q", F.lit("/1"))).when(n == 2, F.concat("q", F.lit(".5"))).otherwise(F.concat("q", F.lit("/0")))
    return recipes(spark, d).select(rate.alias("rate")).distinct().select("rate", parsed_rate(F.col("rate")).alias("fps"))


def parsed_rate(rate):
    """Frames a second of "num/den" or a number; 0 where it says none."""
    a, b = F.split(rate, "/")[0].try_cast("double"), F.get(F.split(rate, "/"), F.lit(1)).try_cast("double")
    return F.coalesce(F.when(F.contains(rate, F.lit("/")), F.when(b > 0, a / b)).otherwise(rate.try_cast("double")), F.lit(0.0))


@query("anim_fps", R + "SELECT q, n, CASE WHEN q * n <= 60 AND q * n > 0 THEN q * n ELSE q * 0.9::DOUBLE END::DOUBLE AS fps FROM (SELECT DISTINCT q, n FROM v_recipes)")
def anim_fps(spark, d):
    r = F.col("q") * F.col("n")
    return recipes(spark, d).select("q", "n").distinct().select("q", "n", F.when((r <= 60) & (r > 0), r.cast("double")).otherwise(F.col("q") * F.lit(0.9)).alias("fps"))


@query("rotation_swap", R + f"SELECT {_KEYS}, CASE WHEN r IN (90, 270) THEN h ELSE w END AS width, CASE WHEN r IN (90, 270) THEN w ELSE h END AS height FROM (SELECT *, ((n - 4) * 90 % 360 + 360) % 360 AS r FROM v_recipes)")
def rotation_swap(spark, d):
    turned = F.pmod((F.col("n") - 4) * 90, F.lit(360)).isin(90, 270)
    return recipes(spark, d).select(*KEYS, F.when(turned, F.col("h")).otherwise(F.col("w")).alias("width"), F.when(turned, F.col("w")).otherwise(F.col("h")).alias("height"))


_FORMATS = ["gif", "apng", "webp_pipe", "mov,mp4,m4a", "png_pipe", "image2", "matroska,webm", "avif"]


@query("container_class", R + f"SELECT fmt, CASE WHEN fmt = 'gif' THEN 'gif' WHEN fmt = 'apng' THEN 'apng' WHEN starts_with(fmt, 'webp') THEN 'webp' WHEN fmt LIKE '%avif%' THEN 'avif' WHEN fmt LIKE '%_pipe' OR fmt = 'image2' THEN 'image' ELSE 'video' END AS class, count(*) AS n FROM (SELECT {V._list(_FORMATS)}[k3 % 8 + 1] AS fmt FROM v_recipes) GROUP BY ALL")
def container_class(spark, d):
    fmt = F.element_at(F.array(*map(F.lit, _FORMATS)), (F.col("k3") % 8 + 1).cast("int"))
    f = F.col("fmt")
    kind = F.when(f == "gif", "gif").when(f == "apng", "apng").when(f.startswith("webp"), "webp").when(f.contains("avif"), "avif").when(f.rlike("_pipe$") | (f == "image2"), "image").otherwise("video")
    return recipes(spark, d).select(fmt.alias("fmt")).groupBy("fmt", kind.alias("class")).agg(F.count("*").alias("n"))


_PIX = ["yuv420p", "yuva420p", "yuv420p10le", "rgba64be", "gray12le", "pal8", "gbrpf32le", "p010le", "rgba", ""]


@query("pixfmt_facts", R + f"""SELECT pix_fmt, CASE WHEN pix_fmt = '' THEN 0 WHEN base LIKE '%f32' THEN 32 WHEN base LIKE '%f16' THEN 16 WHEN regexp_matches(base, 'p(9|10|12|14|16)$') THEN regexp_extract(base, 'p(9|10|12|14|16)$', 1)::INT WHEN regexp_matches(base, '^gray\\d+$') THEN regexp_extract(base, '^gray(\\d+)$', 1)::INT
 WHEN base IN ('rgb48', 'rgba64', 'bgr48', 'bgra64', 'ya16') THEN 16 WHEN base = 'p010' THEN 10 WHEN base = 'p012' THEN 12 ELSE 8 END AS bits, regexp_matches(pix_fmt, '^(yuva|rgba|bgra|argb|abgr|ya|gbrap)') AS alpha_plane, count(*) AS n
 FROM (SELECT pix_fmt, regexp_replace(pix_fmt, '(le|be)$', '') AS base FROM (SELECT {V._list(_PIX)}[k2 % 10 + 1] AS pix_fmt FROM v_recipes)) GROUP BY ALL""")
def pixfmt_facts(spark, d):
    pix = F.element_at(F.array(*map(F.lit, _PIX)), (F.col("k2") % 10 + 1).cast("int")).alias("pix_fmt")
    base = F.regexp_replace("pix_fmt", "(le|be)$", "")
    bits = (
        F.when(F.col("pix_fmt") == "", 0).when(base.endswith("f32"), 32).when(base.endswith("f16"), 16)
        .when(base.rlike("p(9|10|12|14|16)$"), F.regexp_extract(base, "p(9|10|12|14|16)$", 1).try_cast("int"))
        .when(base.rlike(r"^gray\d+$"), F.regexp_extract(base, r"^gray(\d+)$", 1).try_cast("int"))
        .when(base.isin("rgb48", "rgba64", "bgr48", "bgra64", "ya16"), 16).when(base == "p010", 10).when(base == "p012", 12).otherwise(8)
    )
    r = recipes(spark, d).select(pix)
    return r.groupBy("pix_fmt").agg(F.count("*").alias("n")).select("pix_fmt", bits.alias("bits"), F.col("pix_fmt").rlike("^(yuva|rgba|bgra|argb|abgr|ya|gbrap)").alias("alpha_plane"), "n")


@query("probe_derive", R + f"""SELECT {_KEYS}, kind, frames, CASE WHEN kind = 'image' THEN 0.0::DOUBLE ELSE fps END AS fps, CASE WHEN kind = 'image' THEN 0.0::DOUBLE WHEN duration > 0 THEN duration ELSE frames / fps END AS duration FROM
(SELECT *, CASE WHEN format IN ('png', 'jpeg') OR f = 1 THEN 'image' WHEN format IN ('gif', 'apng', 'webp', 'avif') AND n < 5 THEN 'animation' ELSE 'video' END AS kind, CASE WHEN format IN ('png', 'jpeg') THEN 1 ELSE f END AS frames FROM (SELECT *, CASE WHEN n % 3 = 0 THEN greatest(1, floor(duration * fps + 0.5::DOUBLE)::BIGINT) ELSE q END AS f FROM v_recipes))""")
def probe_derive(spark, d):
    """Kind, frames, rate and duration from what a container states; stills have no rate or length."""
    r = recipes(spark, d).withColumn("f", F.when(F.col("n") % 3 == 0, F.greatest(F.lit(1).cast("long"), round_half_up(F.col("duration") * F.col("fps")))).otherwise(F.col("q")))
    image = F.col("format").isin("png", "jpeg")
    r = r.withColumn("kind", F.when(image | (F.col("f") == 1), "image").when(F.col("format").isin("gif", "apng", "webp", "avif") & (F.col("n") < 5), "animation").otherwise("video"))
    still = F.col("kind") == "image"
    frames = F.when(image, F.lit(1).cast("long")).otherwise(F.col("f"))
    return r.select(*KEYS, "kind", frames.alias("frames"), F.when(still, F.lit(0.0)).otherwise(F.col("fps")).alias("fps"), F.when(still, F.lit(0.0)).when(F.col("duration") > 0, F.col("duration")).otherwise(frames / F.col("fps")).alias("duration"))


@query("stream_pick", "SELECT l_orderkey AS clip, max_by(l_linenumber, (l_quantity::BIGINT * 10000 - l_linenumber)) AS stream, max(l_quantity)::BIGINT AS frames FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey")
def stream_pick(spark, d):
    """The stream with most frames that isn't a cover picture; ties go to the first."""
    line = V.read(spark, d, "lineitem").where("l_returnflag <> 'R'")
    q = F.col("l_quantity").cast("long")
    return line.groupBy(F.col("l_orderkey").alias("clip")).agg(F.max_by("l_linenumber", q * 10000 - F.col("l_linenumber")).alias("stream"), F.max(q).alias("frames"))


@query("scan_budget", R + f"SELECT {_KEYS}, greatest(2, least(q * 20, 67108864 // (w * h))) AS frames FROM v_recipes")
def scan_budget(spark, d):
    return recipes(spark, d).select(*KEYS, F.greatest(F.lit(2), F.least(F.col("q") * 20, div(67108864, F.col("w") * F.col("h")))).alias("frames"))


@query("sample_indices", V.over("v_clips") + "SELECT clip, i, i * (frames - 1) // (m - 1) AS idx FROM (SELECT clip, frames, least(frames, 5) AS m, unnest(range(least(frames, 5))) AS i FROM v_clips) WHERE m > 1")
def sample_indices(spark, d):
    """Evenly spread frames to look at, first and last among them."""
    c = V.clips(spark, d).select("clip", "frames", F.least(F.col("frames"), F.lit(5)).alias("m")).where("m > 1")
    return c.select("clip", "frames", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("i")).select("clip", "i", div(F.col("i") * (F.col("frames") - 1), F.col("m") - 1).alias("idx"))


@query("sequence_mixed", R + "SELECT k1, max(w) AS width, max(h) AS height, count(DISTINCT (w, h)) > 1 AS mixed, count(*) AS frames FROM v_recipes GROUP BY k1")
def sequence_mixed(spark, d):
    """The frame that all of a sequence's frames fit in."""
    return recipes(spark, d).groupBy("k1").agg(F.max("w").alias("width"), F.max("h").alias("height"), (F.countDistinct("w", "h") > 1).alias("mixed"), F.count("*").alias("frames"))


_HEX = "CASE n % 4 WHEN 0 THEN '#' ELSE '' END || CASE q % 3 WHEN 0 THEN 'FF00AA' WHEN 1 THEN '313338cc' ELSE 'xyz' END"


@query("normalize_hex", R + f"SELECT DISTINCT raw, CASE WHEN regexp_full_match(c, '[0-9a-f]{{6}}|[0-9a-f]{{8}}') THEN c END AS colour FROM (SELECT raw, lower(regexp_replace(trim(raw), '^#', '')) AS c FROM (SELECT {_HEX} AS raw FROM v_recipes))")
def normalize_hex(spark, d):
    raw = F.concat(F.when(F.col("n") % 4 == 0, "#").otherwise(""), F.when(F.col("q") % 3 == 0, "FF00AA").when(F.col("q") % 3 == 1, "313338cc").otherwise("xyz"))
    return recipes(spark, d).select(raw.alias("raw")).distinct().select("raw", P.normalize_hex(F.col("raw")).alias("colour"))


@query("sequence_scan", R + """, m AS (SELECT *, max(w) OVER (PARTITION BY k1) AS mw, max(h) OVER (PARTITION BY k1) AS mh, row_number() OVER (PARTITION BY k1 ORDER BY k4, k2, k3, q) - 1 AS i FROM v_recipes),
s AS (SELECT *, CASE WHEN mw * h <= mh * w THEN mw ELSE greatest(1, (w * mh * 2 + h) // (h * 2)) END AS sw, CASE WHEN mw * h <= mh * w THEN greatest(1, (h * mw * 2 + w) // (w * 2)) ELSE mh END AS sh FROM m)
SELECT k1, i, sw, sh, (mw - sw) // 2 AS x, (mh - sh) // 2 AS y FROM s""")
def sequence_scan(spark, d):
    """Frames of a sequence in order, each scaled into the largest one and centred on it."""
    from pyspark.sql import Window

    per = Window.partitionBy("k1")
    r = recipes(spark, d).select("*", F.max("w").over(per).alias("mw"), F.max("h").over(per).alias("mh"), (F.row_number().over(per.orderBy("k4", "k2", "k3", "q")) - 1).cast("long").alias("i"))
    sw, sh = P.scaled_size(F.col("w"), F.col("h"), F.col("mw"), F.col("mh"), F.lit("contain"))
    r = r.select("k1", "i", "mw", "mh", sw.alias("sw"), sh.alias("sh"))
    return r.select("k1", "i", "sw", "sh", div(F.col("mw") - F.col("sw"), 2).alias("x"), div(F.col("mh") - F.col("sh"), 2).alias("y"))
