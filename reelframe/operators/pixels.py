"""Geometry and colour on exploded pixels (clip, frame_idx, x, y, r, g, b, a): coordinate maps and column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["clip", "frame_idx"]
RGBA = ["r", "g", "b", "a"]


def crop(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = px.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def flip(px: DataFrame, w: int, h: int, horizontal: bool, vertical: bool) -> DataFrame:
    return px.withColumns({"x": (w - 1 - F.col("x")) if horizontal else F.col("x"), "y": (h - 1 - F.col("y")) if vertical else F.col("y")})


def rotate(px: DataFrame, w: int, h: int, degrees: int) -> DataFrame:
    """Clockwise by quarter turns."""
    x, y = F.col("x"), F.col("y")
    to = {90: (h - 1 - y, x), 180: (w - 1 - x, h - 1 - y), 270: (y, w - 1 - x)}[degrees]
    return px.withColumns({"x": to[0], "y": to[1]})


def canvas(px: DataFrame, cw: int, ch: int, w: int, h: int, colour: tuple[int, int, int, int] = (0, 0, 0, 0)) -> DataFrame:
    """Centre on a canvas of w x h: larger sides are cropped, smaller ones padded with ``colour``."""
    dx, dy = (w - min(cw, w)) // 2 - max(0, cw - w) // 2, (h - min(ch, h)) // 2 - max(0, ch - h) // 2
    placed = px.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy}).where(F.col("x").between(0, w - 1) & F.col("y").between(0, h - 1))
    # Only the border is new: no grid join with the pixels that are there.
    frames = px.select(*FRAME).distinct()
    grid = frames.select(*FRAME, F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("p")).select(*FRAME, (F.col("p") % w).alias("x"), F.floor(F.col("p") / w).cast("int").alias("y"))
    left, top, right, bottom = max(0, dx), max(0, dy), min(w, dx + cw), min(h, dy + ch)
    border = grid.where(~(F.col("x").between(left, right - 1) & F.col("y").between(top, bottom - 1)))
    pad = border.withColumns({c: F.lit(v) for c, v in zip(RGBA, colour, strict=True)})
    return placed.unionByName(pad)


def unpremultiply(px: DataFrame) -> DataFrame:
    up = lambda c: F.when(F.col("a") == 0, 0).otherwise(F.least(F.lit(255), F.floor((F.col(c) * 510 + F.col("a")) / (F.col("a") * 2)).cast("int")))
    return px.withColumns({c: up(c) for c in "rgb"})


def over_matte(px: DataFrame, matte: tuple[int, int, int]) -> DataFrame:
    """Half-transparent pixels over a colour, rounded halves up; opacity stays."""
    mix = lambda c, m: F.floor((F.col(c) * F.col("a") * 2 + F.lit(m) * (255 - F.col("a")) * 2 + 255) / 510).cast("int")
    return px.withColumns({c: mix(c, m) for c, m in zip("rgb", matte, strict=True)})


def alpha_threshold(px: DataFrame, least: int = 128) -> DataFrame:
    return px.withColumn("a", F.when(F.col("a") >= least, 255).otherwise(0))


def alpha_scan(px: DataFrame, by: tuple[str, ...] = ("clip",)) -> DataFrame:
    return px.groupBy(*by).agg((F.min("a") < 255).alias("has_alpha"), F.min("a").alias("least"))


def palette_histogram(px: DataFrame, bits: int = 5) -> DataFrame:
    """Pixels by colour, channels cut to ``bits``; fully transparent pixels are left out."""
    cut = lambda c: F.shiftright(F.col(c), 8 - bits)
    return px.where("a > 0").groupBy("clip", cut("r").alias("r"), cut("g").alias("g"), cut("b").alias("b")).agg(F.count("*").alias("n"))


def changed(px: DataFrame) -> DataFrame:
    """Pixels that differ from the frame before (all of the first frame's)."""
    w = Window.partitionBy("clip", "x", "y").orderBy("frame_idx")
    was = F.lag(F.struct(*RGBA)).over(w)
    return px.withColumn("was", was).where(~F.struct(*RGBA).eqNullSafe(F.col("was"))).drop("was")


def diff_rect(px: DataFrame) -> DataFrame:
    """The rectangle of each frame that changed; frames without change have none."""
    return changed(px).groupBy(*FRAME).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


#: The 4 x 4 ordered dither matrix.
BAYER = [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]


def ordered_dither(px: DataFrame, levels: int) -> DataFrame:
    """Each colour channel to one of ``levels`` steps, the threshold by place in the 4 x 4 matrix."""
    t = F.element_at(F.array(*map(F.lit, BAYER)), (F.col("y") % 4 * 4 + F.col("x") % 4 + 1).cast("int"))
    step = lambda c: (F.least(F.lit(levels - 1), F.floor((F.col(c) * (levels - 1) * 16 + t * 255) / (255 * 16)).cast("int")) * F.lit(255) / F.lit(levels - 1)).cast("int")
    return px.withColumns({c: step(c) for c in "rgb"})


def tile_place(idx: Column, cols: int, w: int, h: int) -> tuple[Column, Column]:
    return idx % cols * w, F.floor(idx / cols).cast("long") * h
