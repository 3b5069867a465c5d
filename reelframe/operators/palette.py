"""Palettes by weighted median cut and Lanczos resampling, as rounds of windows and joins over pixel tables."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pixels import FRAME, changed

#: Opacity from which a pixel counts as solid.
SOLID = 128


def histogram(px: DataFrame, changes_only: bool = True) -> DataFrame:
    """clip, r, g, b, n of solid pixels; with ``changes_only`` those that differ from the frame before, so that moving parts weigh more."""
    counted = changed(px) if changes_only else px
    return counted.where(F.col("a") >= SOLID).groupBy("clip", "r", "g", "b").agg(F.count("*").alias("n"))


def _cut(boxes: DataFrame) -> DataFrame:
    """One round: of each clip's boxes, those that matter most are cut in two until the clip has its ``room`` of boxes.

    A box is cut across its widest channel, behind the least value up to which half of its
    pixels lie; both halves have a colour. Boxes with the greater width times pixels come first.
    """
    box, clip = Window.partitionBy("clip", "box"), Window.partitionBy("clip")
    span = {c: F.max(c).over(box) - F.min(c).over(box) for c in "rgb"}
    wide = boxes.withColumns({f"_{c}": s for c, s in span.items()} | {"_n": F.sum("n").over(box)})
    width = F.greatest("_r", "_g", "_b")
    value = F.when(F.col("_r") == width, F.col("r")).when(F.col("_g") == width, F.col("g")).otherwise(F.col("b"))
    wide = wide.withColumns({"_v": value, "_score": width.cast("long") * F.col("_n")})
    upto = Window.partitionBy("clip", "box").orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    wide = wide.withColumns({"_sum": F.sum("n").over(upto), "_top": F.max("_v").over(box)})
    # The greatest value stays to the right of the cut.
    half = F.min(F.when((F.col("_sum") * 2 >= F.col("_n")) & (F.col("_v") < F.col("_top")), F.col("_v"))).over(box)
    least = F.max(F.when(F.col("_v") < F.col("_top"), F.col("_v"))).over(box)
    place = F.dense_rank().over(Window.partitionBy("clip").orderBy(F.desc("_score"), "box"))
    wide = wide.withColumns({"_at": F.coalesce(half, least), "_place": place})
    count = F.max("_place").over(clip)
    split = (F.col("_score") > 0) & (F.col("_place") <= F.col("room") - count)
    return wide.withColumn("box", F.when(split & (F.col("_v") > F.col("_at")), F.col("box") * 2 + 1).when(split, F.col("box") * 2).otherwise(F.col("box") * 2)).select("clip", "r", "g", "b", "n", "room", "box")


def palettes(px: DataFrame, colors: int, changes_only: bool = True) -> DataFrame:
    """clip, index, r, g, b, n: at most ``colors`` entries a clip, the heaviest first; a clip with clear pixels has its last entry for them (null colour).

    A clip's histogram is at most all colours, and stays where it is: one shuffle by clip
    serves every round. A clip without a solid pixel has only the clear entry.
    """
    counts = histogram(px, changes_only)
    clear = px.groupBy("clip").agg(F.bool_or(F.col("a") < SOLID).alias("clear"))
    # One row a clip; its histogram meets it where it is dealt by clip.
    boxes = counts.join(clear, "clip").select("clip", "r", "g", "b", "n", (F.lit(colors) - F.col("clear").cast("int")).alias("room"), F.lit(0).cast("long").alias("box"))
    boxes = boxes.repartition("clip")
    for _ in range(max(0, ceil(log2(colors)))):
        boxes = _cut(boxes)
    mean = lambda c: F.floor((F.sum(F.col(c).cast("long") * F.col("n")) * 2 + F.sum("n")) / (F.sum("n") * 2)).cast("int").alias(c)
    solid = boxes.groupBy("clip", "box").agg(*[mean(c) for c in "rgb"], F.sum("n").alias("n"))
    solid = solid.withColumn("index", F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("n"), "r", "g", "b", "box")) - 1).drop("box")
    last = solid.groupBy("clip").agg(F.count("*").alias("index"))
    none = [F.lit(None).cast("int").alias(c) for c in "rgb"]
    slot = clear.where("clear").join(last, "clip", "left").select("clip", F.coalesce("index", F.lit(0)).cast("int").alias("index"), *none, F.lit(0).cast("long").alias("n"))
    return solid.select("clip", "index", "r", "g", "b", "n").unionByName(slot)


#: Fixed-point one of a weight; lobes of the kernel.
ONE, LOBES = 1 << 14, 3


def kernel(sizes: DataFrame) -> DataFrame:
    """Weights of the Lanczos kernel: ``sizes`` (size_in, size_out) with from, to and weight, whole numbers of about ONE together for each ``to``.

    As many rows as outputs times taps, so bounded by the largest side; a pair of sizes that
    scales down widens the kernel.
    """
    n, m = F.col("size_in"), F.col("size_out")
    scale = F.greatest(F.lit(1.0), n / m)
    centre = (F.col("to") + 0.5) * n / m - 0.5
    rows = sizes.select("size_in", "size_out", F.explode(F.sequence(F.lit(0), m - 1)).alias("to"))
    first, last = F.greatest(F.lit(0), F.ceil(centre - scale * LOBES).cast("int")), F.least(n - 1, F.floor(centre + scale * LOBES).cast("int"))
    taps = rows.select("size_in", "size_out", "to", F.explode(F.sequence(first, last)).alias("from")).withColumn("_x", (F.col("from") - centre) / scale)
    turn = F.col("_x") * F.pi()
    value = F.when(F.abs("_x") < 1e-9, 1.0).when(F.abs("_x") >= LOBES, 0.0).otherwise(F.sin(turn) / turn * (F.sin(turn / LOBES) / (turn / LOBES)))
    return taps.select("size_in", "size_out", "to", "from", F.round(value * ONE / scale).cast("long").alias("weight")).where("weight <> 0")


def resize(px: DataFrame, size: Column, to: Column) -> DataFrame:
    """Frames resampled with the Lanczos kernel, first across and then down, each a join with the weights of its sizes.

    ``size`` and ``to``: structs (w, h) of a row's frame before and after. Colour is weighted
    by opacity, so that hidden colour doesn't bleed; sums stay whole numbers until the end.
    """
    known = px.withColumns({"_s": size, "_t": to})
    sides = known.select(F.explode(F.array(F.struct(F.col("_s.w").alias("size_in"), F.col("_t.w").alias("size_out")), F.struct(F.col("_s.h").alias("size_in"), F.col("_t.h").alias("size_out")))).alias("p")).select("p.*").distinct()
    weights = kernel(sides)
    premultiplied = known.select(*FRAME, "x", "y", "_s", "_t", *[(F.col(c) * F.col("a")).cast("long").alias(c) for c in "rgb"], (F.col("a") * 255).cast("long").alias("a"), F.lit(1).cast("long").alias("_one"))

    def across(rows: DataFrame, at: str, side: str, keep: list[str]) -> DataFrame:
        w = weights.select(F.col("size_in").alias("_in"), F.col("size_out").alias("_out"), F.col("from").alias(at), F.col("to").alias("_to"), "weight")
        joined = rows.join(w, (rows["_s"][side] == F.col("_in")) & (rows["_t"][side] == F.col("_out")) & (rows[at] == w[at])).drop(w[at])
        sums = [F.sum(F.col(c) * F.col("weight")).alias(c) for c in [*"rgba", "_one"]]
        return joined.groupBy(*FRAME, "_s", "_t", *keep, F.col("_to").alias(at)).agg(*sums)

    done = across(across(premultiplied, "x", "w", ["y"]), "y", "h", ["x"])
    # Both kernels together weigh _one; opacity comes back from 255ths, colour from opacity.
    whole = lambda num, den: F.floor((num * 2 + den) / (den * 2))
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")
    a = byte(whole(F.col("a"), F.col("_one") * 255))
    colour = [F.when((a > 0) & (F.col("a") > 0), byte(whole(F.col(c).cast("double") * 255, F.greatest(F.col("a"), F.lit(1)).cast("double")))).otherwise(0).cast("int").alias(c) for c in "rgb"]
    return done.select(*FRAME, "x", "y", *colour, a.alias("a"))
