"""Streams of a file: which one is the picture, and which one is its alpha plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_streams(streams: DataFrame) -> DataFrame:
    """clip, color, alpha: numbers among a file's video streams; alpha is null where none belongs to the picture.

    ``streams``: clip, index, type, width, height, frames, pix_fmt, title, cover. The picture is
    the stream with most frames, the first of equals, among those that aren't planes; where all
    are gray, among those without an alpha title; where all have one, the first that is no cover.
    Its alpha plane is the first other plane of its size whose frames, where both are known, are
    as many. A file's streams meet once; both choices are windows over them.
    """
    video = streams.where("type = 'video'").withColumn("v", F.row_number().over(Window.partitionBy("clip").orderBy("index")) - 1)
    titled = F.lower(F.trim(F.coalesce("title", F.lit("")))) == "alpha"
    plane = F.lower(F.trim(F.coalesce("pix_fmt", F.lit("")))).startswith("gray") | titled
    frames = F.greatest(F.lit(0), F.coalesce("frames", F.lit(0)))
    tier = F.when(~plane, 0).when(~titled, 1).otherwise(2)
    ranked = video.select("clip", "v", "width", "height", frames.alias("frames"), plane.alias("plane"), tier.alias("tier"), F.coalesce("cover", F.lit(False)).alias("cover"))
    order = Window.partitionBy("clip").orderBy("tier", F.when(F.col("tier") < 2, -F.col("frames")).otherwise(F.col("cover").cast("int")), "v")
    chosen = ranked.withColumn("main", F.first(F.struct("v", "width", "height", "frames")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    m = F.col("main")
    fits = F.col("plane") & (F.col("v") != m["v"]) & F.col("width").eqNullSafe(m["width"]) & F.col("height").eqNullSafe(m["height"]) & ((F.col("frames") == 0) | (m["frames"] == 0) | (F.col("frames") == m["frames"]))
    return chosen.groupBy("clip").agg(F.first(m["v"]).alias("color"), F.min(F.when(fits, F.col("v"))).alias("alpha"))


def reconcile_alpha(scanned: DataFrame, stated: DataFrame) -> DataFrame:
    """clip, stated, scanned, found: files whose pixels and container disagree about alpha; what pixels show stands.

    A file that only one side knows is told too. Agreement gives no row.
    """
    both = scanned.select("clip", F.col("has_alpha").alias("scanned")).join(stated.select("clip", F.col("has_alpha").alias("stated")), "clip", "full_outer")
    return both.where(~F.col("scanned").eqNullSafe(F.col("stated"))).select("clip", "stated", "scanned", F.coalesce("scanned", "stated").alias("found"))


#: Frames of a sequence whose headers are looked at, and of those whose pixels are.
HEADERS, SCANS = 200, 5


def _spread(at: Column, count: Column, most: int) -> Column:
    """Whether place ``at`` of 0..count-1 is one of at most ``most`` evenly spread ones, first and last among them."""
    m = F.least(count, F.lit(most)).cast("long")
    near = F.ceil(at * (m - 1) / F.greatest(count - 1, F.lit(1))).cast("long")
    return F.when(m > 1, F.floor(near * (count - 1) / (m - 1)).cast("long") == at).otherwise(at == 0)


def probe_sequences(frames: DataFrame, headers: int = HEADERS, scans: int = SCANS) -> DataFrame:
    """clip, frames, width, height, mixed, has_alpha of image sequences.

    ``frames``: clip, frame_idx (from 0), width, height, may_alpha (the header admits it), alpha
    (what a scan of the pixels found, null where it failed). Sizes come from at most
    ``headers`` evenly spread frames: the sequence is as large as the largest, and mixed if any
    differs. Alpha is what at most ``scans`` frames spread over those that admit it show; where
    every scan fails it is taken for granted. Which frames are looked at is arithmetic on their
    places, so no frame is joined with a sample.
    """
    clip = Window.partitionBy("clip")
    counted = frames.withColumn("_n", F.count("*").over(clip))
    seen = counted.where(_spread(F.col("frame_idx"), F.col("_n"), headers))
    admits = F.coalesce("may_alpha", F.lit(False))
    ranked = seen.withColumns({"_r": F.count_if(admits).over(clip.orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)), "_k": F.count_if(admits).over(clip)})
    looked = ranked.withColumn("_scan", admits & _spread(F.col("_r"), F.col("_k"), scans))
    found = looked.groupBy("clip").agg(
        F.max("_n").alias("frames"), F.max("width").alias("width"), F.max("height").alias("height"), F.min("width").alias("_w"), F.min("height").alias("_h"),
        F.count_if("_scan").alias("_scans"), F.count_if(F.col("_scan") & F.col("alpha").isNotNull()).alias("_read"), F.count_if(F.col("_scan") & F.col("alpha")).alias("_clear"),
    )
    mixed = (F.col("_w") != F.col("width")) | (F.col("_h") != F.col("height"))
    return found.select("clip", "frames", "width", "height", mixed.alias("mixed"), ((F.col("_clear") > 0) | ((F.col("_scans") > 0) & (F.col("_read") == 0))).alias("has_alpha"))
