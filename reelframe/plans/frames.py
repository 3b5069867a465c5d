"""Temporal queries: trim, speed, resampling, delays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import media as M
from ..operators import temporal as T
from ..sources import views as V
from .registry import query


@query("fps_resample", V.over("v_frames") + """, best AS (SELECT clip, floor(pts_us * 2.0 / 1e6)::BIGINT AS slot, max((pts_us, frame_idx, event_id, value)) AS f FROM v_frames GROUP BY 1, 2),
grid AS (SELECT clip, unnest(range(min(slot), max(slot) + 1)) AS slot FROM best GROUP BY clip)
SELECT g.clip, g.slot, b.f[2] AS frame_idx, b.f[3] AS event_id, b.f[4] AS value FROM grid g ASOF JOIN (SELECT clip, slot, f FROM best) b ON g.clip = b.clip AND g.slot >= b.slot""".replace("f[2]", "f.b").replace("f[3]", "f.c").replace("f[4]", "f.d").replace("max((pts_us, frame_idx, event_id, value))", "max({'a': pts_us, 'b': frame_idx, 'c': event_id, 'd': value})"))  # fmt: skip
def fps_resample(spark, d):
    return T.resample(V.frames(spark, d), F.lit(2.0), ["event_id", "value"])


@query("trim_intersect", V.over("v_frames") + """, cut AS (SELECT clip, max(s) AS a, min(e) AS b FROM (SELECT user_id AS clip, unnest([1000000 + user_id % 7 * 500000, 2000000]) AS s, unnest([60000000 - user_id % 5 * 1000000, 50000000]) AS e FROM (SELECT DISTINCT user_id FROM events)) GROUP BY clip)
SELECT f.clip, f.frame_idx, f.pts_us - c.a AS pts_us, f.value FROM v_frames f JOIN cut c USING (clip) WHERE f.pts_us >= c.a AND f.pts_us < c.b""")  # fmt: skip
def trim_intersect(spark, d):
    f = V.frames(spark, d)
    clip = V.read(spark, d, "events").select(F.col("user_id").alias("clip")).distinct()
    one = clip.select("clip", (F.lit(1000000) + F.col("clip") % 7 * 500000).alias("start_us"), (F.lit(60000000) - F.col("clip") % 5 * 1000000).alias("end_us"))
    two = clip.select("clip", F.lit(2000000).cast("long").alias("start_us"), F.lit(50000000).cast("long").alias("end_us"))
    return T.trim(f, one.unionByName(two)).select("clip", "frame_idx", "pts_us", "value")


@query("speed_retime", V.over("v_frames") + "SELECT clip, frame_idx, floor(pts_us / (0.5::DOUBLE + (clip % 4) * 0.25::DOUBLE))::BIGINT AS pts_us FROM v_frames")
def speed_retime(spark, d):
    return T.retime(V.frames(spark, d), F.lit(0.5) + (F.col("clip") % 4) * F.lit(0.25)).select("clip", "frame_idx", "pts_us")


@query("plan_frames", V.over("v_clips") + "SELECT clip, duration, fps, greatest(1, floor(duration * fps + 1e-4))::BIGINT AS frames FROM v_clips")
def plan_frames(spark, d):
    return V.clips(spark, d).select("clip", "duration", "fps", T.frame_count(F.col("duration"), F.col("fps")).alias("frames"))


@query("drop_every_n", V.over("v_delays") + """, g AS (SELECT clip, i, delay, sum(CASE WHEN (i + 1) % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip ORDER BY i) AS g FROM v_delays)
SELECT clip, min(i) AS i, least(65535, sum(greatest(0, delay)))::BIGINT AS delay FROM g GROUP BY clip, g""")  # fmt: skip
def drop_every_n(spark, d):
    return T.merge_delays(V.delays(spark, d), 3)


@query("drop_rate_map", V.over("v_recipes") + """SELECT DISTINCT fps, n, CASE WHEN w >= fps THEN 1 WHEN abs(w - fps * (2 - 1) / 2) <= fps * (2 - 1) / 2 * 0.05 THEN 2 WHEN abs(w - fps * (3 - 1) / 3) <= fps * (3 - 1) / 3 * 0.05 THEN 3 WHEN abs(w - fps * (4 - 1) / 4) <= fps * (4 - 1) / 4 * 0.05 THEN 4 END::INT AS drop_n FROM (SELECT fps, n, fps * (n + 2) / 10 AS w FROM v_recipes)""")
def drop_rate_map(spark, d):
    r = V.recipes(spark, d).select("fps", "n", (F.col("fps") * (F.col("n") + 2) / 10).alias("w")).distinct()
    return r.select("fps", "n", T.drop_every(F.col("fps"), F.col("w")).cast("int").alias("drop_n"))


_DELAYS = "floor((i + 1) * 100.0::DOUBLE / fps + 0.5::DOUBLE)::BIGINT - floor(i * 100.0::DOUBLE / fps + 0.5::DOUBLE)::BIGINT"


@query("gif_centiseconds", V.over("v_clips") + f""", g AS (SELECT clip, fps, unnest(range(frames)) AS i FROM v_clips)
SELECT clip, i::INT AS i, {_DELAYS} AS delay FROM g""")
def gif_centiseconds(spark, d):
    c = V.clips(spark, d)
    return c.select("clip", F.posexplode(T.centiseconds(F.col("fps"), F.col("frames"))).alias("i", "delay"))


@query("gif_delays", V.over("v_clips") + f""", g AS (SELECT clip, fps, unnest(range(frames)) AS i FROM v_clips), x AS (SELECT clip, {_DELAYS} AS delay FROM g)
SELECT clip, min(delay) AS shortest, max(delay) AS longest, sum(delay)::BIGINT AS total FROM x GROUP BY clip""")
def gif_delays(spark, d):
    c = V.clips(spark, d).select("clip", T.centiseconds(F.col("fps"), F.col("frames")).alias("v"))
    return c.select("clip", F.array_min("v").alias("shortest"), F.array_max("v").alias("longest"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("first_frame", V.over("v_frames") + "SELECT clip, pts_us, event_id, value FROM v_frames WHERE frame_idx = 0")
def first_frame(spark, d):
    return V.frames(spark, d).where("frame_idx = 0").select("clip", "pts_us", "event_id", "value")


@query("still_frame", V.over("v_frames") + "SELECT clip, max(frame_idx) AS frame_idx, max_by(event_id, frame_idx) AS event_id FROM v_frames WHERE (pts_us * 10 // 1000000) <= 35 GROUP BY clip")
def still_frame(spark, d):
    """The frame that slot 35 at 10 fps shows."""
    at = V.frames(spark, d).where((F.col("pts_us") * 10 - F.pmod(F.col("pts_us") * 10, F.lit(1000000))) / 1000000 <= 35)
    return at.groupBy("clip").agg(F.max("frame_idx").alias("frame_idx"), F.max_by("event_id", "frame_idx").alias("event_id"))


@query("clip_timing", V.over("v_frames") + "SELECT clip, count(*) AS frames, sum(dur_us)::BIGINT AS total_us, min(dur_us) AS min_us, count(*) FILTER (dur_us = 0) AS zero FROM v_frames GROUP BY clip")
def clip_timing(spark, d):
    return V.frames(spark, d).groupBy("clip").agg(F.count("*").alias("frames"), F.sum("dur_us").alias("total_us"), F.min("dur_us").alias("min_us"), F.count_if(F.col("dur_us") == 0).alias("zero"))


@query("frame_count", "SELECT user_id AS clip, count(*) AS frames FROM events GROUP BY user_id")
def frame_count(spark, d):
    return V.read(spark, d, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("frames"))


@query("frame_timings", V.over("v_clips") + """, g AS (SELECT clip, fps, unnest(range(frames)) AS i, NULL::VARCHAR AS error FROM v_clips WHERE frames <= 2000 UNION ALL SELECT clip, fps, NULL, 'too many frames (' || frames || ', the limit is 2000); trim or lower fps' FROM v_clips WHERE frames > 2000)
SELECT clip, i::BIGINT AS i, floor(i * 1000.0::DOUBLE / fps + 0.5::DOUBLE)::BIGINT AS start_ms, floor((i + 1) * 1000.0::DOUBLE / fps + 0.5::DOUBLE)::BIGINT - floor(i * 1000.0::DOUBLE / fps + 0.5::DOUBLE)::BIGINT AS duration_ms, error FROM g""")  # fmt: skip
def frame_timings(spark, d):
    """Start and length of every frame of an export; a clip with too many frames is one row with the refusal."""
    c = V.clips(spark, d).select("clip", "fps", "frames", M.too_many(F.col("frames")).alias("error"))
    c = c.select("clip", "fps", "error", F.explode_outer(F.when(F.col("error").isNull() & (F.col("frames") > 0), F.sequence(F.lit(0).cast("long"), F.col("frames") - 1))).alias("i")).where("error IS NOT NULL OR i IS NOT NULL")
    at = lambda i: F.floor(i * F.lit(1000.0) / F.col("fps") + F.lit(0.5)).cast("long")
    return c.select("clip", "i", at(F.col("i")).alias("start_ms"), (at(F.col("i") + 1) - at(F.col("i"))).alias("duration_ms"), "error")


@query("proxy", V.over("v_frames") + """, best AS (SELECT clip, floor(pts_us * 15.0 / 1e6)::BIGINT AS slot, max({'a': pts_us, 'b': frame_idx, 'c': event_id}) AS f FROM v_frames WHERE pts_us < 10000000 GROUP BY 1, 2),
grid AS (SELECT clip, unnest(range(min(slot), max(slot) + 1)) AS slot FROM best GROUP BY clip)
SELECT g.clip, g.slot, b.f.b AS frame_idx, b.f.c AS event_id FROM grid g ASOF JOIN best b ON g.clip = b.clip AND g.slot >= b.slot""")  # fmt: skip
def proxy(spark, d):
    """The first ten seconds at 15 fps; the pixels of a proxy go through the geometry operators."""
    f = V.frames(spark, d).where("pts_us < 10000000")
    return T.resample(f, F.lit(15.0), ["event_id"])


@query("alpha_merge", V.over("v_pixels") + "SELECT c.clip, c.frame_idx, c.x, c.y, c.r, c.g, c.b, m.r AS a FROM v_pixels c JOIN v_pixels m ON m.clip = c.clip + 5 AND m.frame_idx = c.frame_idx AND m.x = c.x AND m.y = c.y WHERE c.clip < 5")
def alpha_merge(spark, d):
    """Colour from one stream and opacity from another, frame by frame."""
    p = V.channels(spark, d)
    mask = p.where("clip >= 5").select((F.col("clip") - 5).alias("clip"), "frame_idx", "x", "y", F.col("r").alias("a"))
    return p.where("clip < 5").drop("a").join(mask, ["clip", "frame_idx", "x", "y"])


