"""Temporal operators over frame tables (clip, frame_idx, pts_us, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up

#: Counts tolerate this much below a whole frame.
FRAME_SLACK = 1e-4
DELAY_CAP = 65535


def frame_count(duration: Column, fps: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(duration * fps + F.lit(FRAME_SLACK))).cast("long")


def trim(frames: DataFrame, bounds: DataFrame) -> DataFrame:
    """Frames inside the intersection of all trims of a clip, times counted from its start.

    ``bounds``: clip, start_us, end_us (null: to the end). An interval filter on one
    equi-join; clips without trims are kept whole.
    """
    cut = bounds.groupBy("clip").agg(F.max("start_us").alias("from_us"), F.min("end_us").alias("to_us"))
    j = frames.join(cut, "clip", "left").withColumn("from_us", F.coalesce("from_us", F.lit(0)))
    return j.where((F.col("pts_us") >= F.col("from_us")) & (F.col("to_us").isNull() | (F.col("pts_us") < F.col("to_us")))).withColumn("pts_us", F.col("pts_us") - F.col("from_us")).drop("from_us", "to_us")


def retime(frames: DataFrame, factor: Column) -> DataFrame:
    """Play faster by ``factor``: times divided by it, in whole microseconds."""
    return frames.withColumn("pts_us", F.floor(F.col("pts_us") / factor).cast("long"))


def resample(frames: DataFrame, fps: Column, keep: list[str]) -> DataFrame:
    """Constant-rate frames: slot k of a clip shows the last frame whose time, rounded down to slots, is at most k.

    A backward as-of join without a join: frames that fall in one slot are reduced to the
    last, and each then fills the slots up to the next one's. ``fps`` is an expression over
    clip columns; ``keep`` names frame columns to carry.
    """
    slot = F.floor(F.col("pts_us") * fps / F.lit(1e6)).cast("long")
    best = frames.select("clip", slot.alias("slot"), F.struct("pts_us", "frame_idx", *keep).alias("f")).groupBy("clip", "slot").agg(F.max("f").alias("f"))
    until = F.coalesce(F.lead("slot").over(Window.partitionBy("clip").orderBy("slot")) - 1, F.col("slot"))
    shown = best.withColumn("until", until).select("clip", F.explode(F.sequence("slot", "until")).alias("slot"), "f")
    return shown.select("clip", "slot", "f.frame_idx", *[F.col(f"f.{c}") for c in keep])


def merge_delays(frames: DataFrame, n: int | Column) -> DataFrame:
    """Drop every n-th frame (clip, i, delay) and give its delay to the kept frame before it.

    Negative delays count as nothing; a sum stops at the cap of two bytes.
    """
    n = F.lit(n) if isinstance(n, int) else n
    kept = F.pmod(F.col("i") + 1, n) != 0
    w = Window.partitionBy("clip").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    grouped = frames.withColumn("g", F.sum(F.when(kept, 1).otherwise(0)).over(w))
    return grouped.groupBy("clip", "g").agg(F.min("i").alias("i"), F.least(F.lit(DELAY_CAP).cast("long"), F.sum(F.greatest(F.lit(0), "delay"))).alias("delay")).drop("g")


def centiseconds(fps: Column, frames: Column) -> Column:
    """Delays of a GIF's frames at ``fps``: each time is rounded to hundredths, so the sum is exact."""
    def at(i: Column) -> Column:
        return round_half_up(i * F.lit(100.0) / fps)

    return F.transform(F.sequence(F.lit(0), frames.cast("int") - 1), lambda i: at(i + 1) - at(i))


def drop_every(source: Column, wanted: Column) -> Column:
    """The N of "drop every N-th" that brings ``source`` within 5 % of ``wanted`` (1: nothing to drop, null: none does)."""
    out = F.when(wanted >= source, F.lit(1))
    for n in (2, 3, 4):
        rate = source * (n - 1) / n
        out = out.when(F.abs(wanted - rate) <= rate * 0.05, F.lit(n))
    return out
