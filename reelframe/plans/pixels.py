"""Pixel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import palette as L
from ..operators import pixels as X
from ..sources import views as V
from .registry import query

P = V.over("v_pixels")


@query("crop_pixels", P + "SELECT clip, frame_idx, x - 1 AS x, y - 1 AS y, r, g, b, a FROM v_pixels WHERE x BETWEEN 1 AND 2 AND y BETWEEN 1 AND 3")
def crop_pixels(spark, d):
    return X.crop(V.channels(spark, d), 1, 1, 2, 3)


@query("flip_pixels", P + "SELECT clip, frame_idx, 3 - x AS x, 3 - y AS y, r, g, b, a FROM v_pixels")
def flip_pixels(spark, d):
    return X.flip(V.channels(spark, d), 4, 4, True, True)


@query("rotate_pixels", P + "SELECT clip, frame_idx, 3 - y AS x, x AS y, r, g, b, a FROM v_pixels UNION ALL SELECT clip + 100, frame_idx, y, 3 - x, r, g, b, a FROM v_pixels")
def rotate_pixels(spark, d):
    px = V.channels(spark, d)
    return X.rotate(px, 4, 4, 90).unionByName(X.rotate(px.withColumn("clip", F.col("clip") + 100), 4, 4, 270))


@query("canvas_pad", P + """, f AS (SELECT DISTINCT clip, frame_idx FROM v_pixels), grid AS (SELECT clip, frame_idx, (p % 6)::INT AS x, (p // 6)::INT AS y FROM (SELECT *, unnest(range(18)) AS p FROM f))
SELECT g.clip, g.frame_idx, g.x, g.y, coalesce(r, 49) AS r, coalesce(v.g, 51) AS g, coalesce(b, 56) AS b, coalesce(a, 255) AS a FROM grid g LEFT JOIN v_pixels v ON v.clip = g.clip AND v.frame_idx = g.frame_idx AND v.x = g.x - 1 AND v.y = g.y + 0""")
def canvas_pad(spark, d):
    """4 x 4 frames on a canvas of 6 x 3: two columns of padding, one row cut."""
    return X.canvas(V.channels(spark, d), 4, 4, 6, 3, (49, 51, 56, 255))


@query("unpremultiply", P + "SELECT clip, frame_idx, x, y, CASE WHEN a = 0 THEN 0 ELSE least(255, (r * 510 + a) // (a * 2)) END AS r, CASE WHEN a = 0 THEN 0 ELSE least(255, (g * 510 + a) // (a * 2)) END AS g, CASE WHEN a = 0 THEN 0 ELSE least(255, (b * 510 + a) // (a * 2)) END AS b, a FROM v_pixels")
def unpremultiply(spark, d):
    return X.unpremultiply(V.channels(spark, d))


@query("alpha_scan", P + "SELECT clip, min(a) < 255 AS has_alpha, min(a) AS least FROM v_pixels GROUP BY clip")
def alpha_scan(spark, d):
    return X.alpha_scan(V.channels(spark, d))


@query("matte_composite", P + "SELECT clip, frame_idx, x, y, (r * a * 2 + 49 * (255 - a) * 2 + 255) // 510 AS r, (g * a * 2 + 51 * (255 - a) * 2 + 255) // 510 AS g, (b * a * 2 + 56 * (255 - a) * 2 + 255) // 510 AS b, a FROM v_pixels")
def matte_composite(spark, d):
    return X.over_matte(V.channels(spark, d), (0x31, 0x33, 0x38))


@query("alpha_threshold", P + "SELECT clip, frame_idx, x, y, r, g, b, CASE WHEN a >= 128 THEN 255 ELSE 0 END AS a FROM v_pixels")
def alpha_threshold(spark, d):
    return X.alpha_threshold(V.channels(spark, d))


@query("palette_histogram", P + "SELECT clip, r >> 3 AS r, g >> 3 AS g, b >> 3 AS b, count(*) AS n FROM v_pixels WHERE a > 0 GROUP BY ALL")
def palette_histogram(spark, d):
    return X.palette_histogram(V.channels(spark, d))


@query("diff_rect", P + """, c AS (SELECT *, lag({'r': r, 'g': g, 'b': b, 'a': a}) OVER (PARTITION BY clip, x, y ORDER BY frame_idx) AS was FROM v_pixels)
SELECT clip, frame_idx, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM c WHERE was IS NULL OR was <> {'r': r, 'g': g, 'b': b, 'a': a} GROUP BY clip, frame_idx""")
def diff_rect(spark, d):
    return X.diff_rect(V.channels(spark, d))


@query("ordered_dither", P + f"SELECT clip, frame_idx, x, y, " + ", ".join(f"(least(3, ({c} * 3 * 16 + t * 255) // (255 * 16)) * 255 / 3)::INT AS {c}" for c in "rgb") + f", a FROM (SELECT *, {X.BAYER}[y % 4 * 4 + x % 4 + 1] AS t FROM v_pixels)")
def ordered_dither(spark, d):
    return X.ordered_dither(V.channels(spark, d), 4)


@query("tile_layout", P + "SELECT clip, x + frame_idx % 8 * 4 AS x, y + frame_idx // 8 * 4 AS y, r, g, b, a FROM v_pixels")
def tile_layout(spark, d):
    """All frames of a clip on one sheet of eight columns."""
    px = V.channels(spark, d)
    dx, dy = X.tile_place(F.col("frame_idx"), 8, 4, 4)
    return px.select("clip", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "r", "g", "b", "a")


@query("resize_pixels", P + "SELECT clip, frame_idx, x // 2 AS x, y // 2 AS y, ((2 * sum(r) + 4) // 8)::BIGINT AS r, ((2 * sum(g) + 4) // 8)::BIGINT AS g, ((2 * sum(b) + 4) // 8)::BIGINT AS b, ((2 * sum(a) + 4) // 8)::BIGINT AS a FROM v_pixels GROUP BY clip, frame_idx, x // 2, y // 2")
def resize_pixels(spark, d):
    """Half size by area average; other ratios go through the Lanczos kernel of ``lanczos_pixels``."""
    px = V.channels(spark, d)
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    mean = lambda c: F.floor((F.sum(c) * 2 + 4) / 8).cast("long").alias(c)
    return px.groupBy("clip", "frame_idx", half("x"), half("y")).agg(*map(mean, "rgba"))


_COLORS = 16
_ROUND = """b{k} AS (SELECT clip, r, g, b, n, room, CASE WHEN score > 0 AND place <= room - boxes AND v > at_v THEN box * 2 + 1 ELSE box * 2 END AS box FROM (
  SELECT *, max(place) OVER (PARTITION BY clip) AS boxes FROM (SELECT *, dense_rank() OVER (PARTITION BY clip ORDER BY score DESC, box) AS place,
   coalesce(min(v) FILTER (upto * 2 >= total AND v < top) OVER (PARTITION BY clip, box), max(v) FILTER (v < top) OVER (PARTITION BY clip, box)) AS at_v FROM (
   SELECT *, sum(n) OVER (PARTITION BY clip, box ORDER BY v) AS upto, max(v) OVER (PARTITION BY clip, box) AS top FROM (
    SELECT *, CASE greatest(dr, dg, db) WHEN dr THEN r WHEN dg THEN g ELSE b END AS v, greatest(dr, dg, db)::BIGINT * total AS score FROM (
     SELECT *, max(r) OVER w - min(r) OVER w AS dr, max(g) OVER w - min(g) OVER w AS dg, max(b) OVER w - min(b) OVER w AS db, sum(n) OVER w AS total FROM b{j} WINDOW w AS (PARTITION BY clip, box)))))))"""


@query("palette_generate", P + f""", c AS (SELECT *, lag({{'r': r, 'g': g, 'b': b, 'a': a}}) OVER (PARTITION BY clip, x, y ORDER BY frame_idx) AS was FROM v_pixels),
h AS (SELECT clip, r, g, b, count(*) AS n FROM c WHERE a >= 128 AND (was IS NULL OR was <> {{'r': r, 'g': g, 'b': b, 'a': a}}) GROUP BY ALL), k AS (SELECT clip, bool_or(a < 128) AS clear FROM v_pixels GROUP BY clip),
b0 AS (SELECT h.*, {_COLORS} - clear::INT AS room, 0::BIGINT AS box FROM h JOIN k USING (clip)), {", ".join(_ROUND.format(k=k, j=k - 1) for k in range(1, 5))},
p AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY n DESC, r, g, b, box) - 1 AS index, r, g, b, n FROM (SELECT clip, box, ((2 * sum(r * n) + sum(n)) // (2 * sum(n)))::INT AS r, ((2 * sum(g * n) + sum(n)) // (2 * sum(n)))::INT AS g, ((2 * sum(b * n) + sum(n)) // (2 * sum(n)))::INT AS b, sum(n)::BIGINT AS n FROM b4 GROUP BY clip, box))
SELECT * FROM p UNION ALL SELECT clip, coalesce((SELECT count(*) FROM p WHERE p.clip = k.clip), 0), NULL, NULL, NULL, 0 FROM k WHERE clear""")
def palette_generate(spark, d):
    """A palette of 16 for each clip from what changes between frames, one entry kept for clear pixels."""
    return L.palettes(V.channels(spark, d), _COLORS)


#: Sizes that a clip's frames of 4 x 4 pixels get.
_SIZES = [(7, 3), (4, 9), (2, 2), (11, 4)]
_KERNEL = """SELECT n, m, t, f, round(CASE WHEN abs(x) < 1e-9 THEN 1 WHEN abs(x) >= 3 THEN 0 ELSE sin(x * pi()) / (x * pi()) * (sin(x * pi() / 3) / (x * pi() / 3)) END * 16384 / s)::BIGINT AS w
 FROM (SELECT n, m, t, f, greatest(1.0::DOUBLE, n / m::DOUBLE) AS s, (f - ((t + 0.5::DOUBLE) * n / m - 0.5)) / greatest(1.0::DOUBLE, n / m::DOUBLE) AS x FROM (SELECT 4 AS n, m, unnest(range(m)) AS t FROM (SELECT unnest([2, 3, 4, 7, 9, 11]) AS m)), (SELECT unnest(range(4)) AS f))"""


def _sum(of: str) -> str:
    return ", ".join(f"sum({c} * w) AS {c}" for c in ("r", "g", "b", "a", "one")) if of else ""


@query("lanczos_pixels", P + f""", k AS (SELECT * FROM ({_KERNEL}) WHERE w <> 0),
s AS (SELECT clip, frame_idx, x, y, r * a AS r, g * a AS g, b * a AS b, a * 255 AS a, 1 AS one, {[w for w, _ in _SIZES]}[clip % 4 + 1] AS tw, {[h for _, h in _SIZES]}[clip % 4 + 1] AS th FROM v_pixels),
h AS (SELECT clip, frame_idx, th, y, t AS x, {_sum("h")} FROM s JOIN k ON m = tw AND f = x GROUP BY ALL), v AS (SELECT clip, frame_idx, x, t AS y, {_sum("v")} FROM h JOIN k ON m = th AND f = y GROUP BY ALL),
q AS (SELECT *, greatest(0, least(255, floor((a * 2 + one * 255)::DOUBLE / (one * 255 * 2)::DOUBLE))) AS o FROM v)
SELECT clip, frame_idx, x, y, {", ".join(f"CASE WHEN o > 0 AND a > 0 THEN greatest(0, least(255, floor(({c}::DOUBLE * 255 * 2 + a::DOUBLE) / (a::DOUBLE * 2)))) ELSE 0 END::INT AS {c}" for c in "rgb")}, o::INT AS a FROM q""")
def lanczos_pixels(spark, d):
    """Frames resampled up and down with the Lanczos kernel, colour weighted by opacity."""
    px = V.channels(spark, d)
    to = F.element_at(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in _SIZES]), (F.col("clip") % 4 + 1).cast("int"))
    return L.resize(px, F.struct(F.lit(4).alias("w"), F.lit(4).alias("h")), to)
