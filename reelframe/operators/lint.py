"""Quality rules as predicates over frame facts; every rule gives a row even when it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT_WORDS = "size|limit|bytes|dims|dimension|duration|emote|sticker|fit\\."
STICKER_MS, STICKER_FRAMES, STICKER_FPS = 5000, 1000, 60


def timing_level(fmt: Column, ms: Column, sticker: Column) -> Column:
    """Worst finding on a frame's delay in milliseconds: null where there is none."""
    gif = F.when(ms < 20, "warn")
    webp = F.when(ms <= 10, "warn").when(ms < 20, "info")
    apng = F.when(ms == 0, F.when(sticker, "error").otherwise("warn")).when(ms <= 10, "warn").when(ms < 20, "info")
    return F.when(fmt == "gif", gif).when(fmt == "webp", webp).when(fmt == "apng", apng)


def disposal_fix(disposal: Column) -> tuple[Column, Column]:
    """(ok, disposal after the fix): 0 becomes 1, 3 and more can't be mended."""
    return disposal.isin(1, 2), F.when(disposal == 0, 1).otherwise(disposal)


def loop_check(fmt: Column, count: Column, known_target: Column) -> Column:
    """Level of a loop that isn't for ever; null where it is."""
    return F.when(count == 0, None).when((fmt == "gif") | known_target, "error").otherwise("info")


def rule_class(rule: Column) -> Column:
    return F.when(rule.rlike(LIMIT_WORDS), "limit").otherwise("structure")


def sticker_checks(clips: DataFrame) -> DataFrame:
    """Length, frames and rate of (clip, frames, total_ms); one row a rule."""
    rules = [
        ("sticker-duration", F.col("total_ms") <= STICKER_MS),
        ("sticker-frames", F.col("frames") <= STICKER_FRAMES),
        ("sticker-rate", F.col("frames") * 1000 <= F.col("total_ms") * STICKER_FPS),
        ("sticker-length", (F.col("total_ms") > 0) | (F.col("frames") <= 1)),
    ]
    checks = F.array(*[F.struct(F.lit(r).alias("rule"), ok.alias("ok")) for r, ok in rules])
    return clips.select("clip", F.explode(checks).alias("c")).select("clip", "c.rule", "c.ok")


def reports(checks: DataFrame, key: str) -> DataFrame:
    """A report is ok when no error-level rule failed."""
    failed = lambda level: F.count_if(~F.col("ok") & (F.col("level") == level))
    return checks.groupBy(key).agg(F.count("*").alias("checks"), failed("error").alias("errors"), failed("warn").alias("warnings"), (failed("error") == 0).alias("ok"))


def neighbour_delay(frames: DataFrame) -> DataFrame:
    """Frames without a delay take the last one before them, else the first one after."""
    back = Window.partitionBy("clip").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("clip").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    return frames.withColumn("delay", F.coalesce(F.last("delay", ignorenulls=True).over(back), F.first("delay", ignorenulls=True).over(ahead)))


def apng_us(num: Column, den: Column) -> Column:
    """A frame's delay in microseconds; a denominator of 0 means hundredths."""
    d = F.when(den == 0, 100).otherwise(den)
    return ((num * 1000000 + F.floor(d / 2)) / d).cast("long")


def apng_ms(num: Column, den: Column) -> Column:
    """A frame's delay in whole milliseconds."""
    return F.floor((apng_us(num, den) + 500) / 1000).cast("long")
