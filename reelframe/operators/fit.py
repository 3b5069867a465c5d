"""Fit-to-size search: budgets, ladders, knobs, bracketed search on the log of the size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.recipes import targets

MARGIN, WINDOW = 0.02, 0.04
ROUNDS, ALTERNATIVES = 5, 2

# Ladders (rate, colours, side, dither) mildest first, and knobs (least, most, mild probe, harsh probe).
LADDERS = {
    "emote_gif": [(25.0, 256, 128, "bayer"), (20.0, 128, 128, "bayer"), (16.7, 128, 128, "bayer"), (12.5, 64, 112, "none"), (10.0, 32, 96, "none")],
    "emote_webp": [(25.0, None, 128, None), (20.0, None, 128, None), (16.7, None, 128, None), (12.5, None, 112, None), (10.0, None, 96, None)],
    "sticker_rgba": [(25.0, None, None, None), (20.0, None, None, None), (16.7, None, None, None), (12.5, None, None, None)],
    "sticker_apng": [(25.0, 256, None, None), (20.0, 256, None, None), (16.7, 256, None, None), (12.5, 128, None, None), (10.0, 64, None, None)],
    "sticker_gif": [(25.0, 256, None, "bayer"), (20.0, 128, None, "bayer"), (16.7, 128, None, "bayer"), (12.5, 64, None, "none"), (10.0, 32, None, "none")],
}
KNOBS = {"gif": (0, 200, 30, 150), "webp": (5, 90, 20, 70), "avif": (5, 90, 20, 70), "apng": (0, 2, 0, 2), "png": (0, 2, 0, 2), "jpeg": (10, 80, 20, 60), "other": (0, 100, 20, 70)}


def ladders(spark: SparkSession) -> DataFrame:
    rows = [(name, i, *r) for name, rungs in LADDERS.items() for i, r in enumerate(rungs)]
    return spark.createDataFrame(rows, "ladder string, idx int, fps double, colors int, px int, dither string")


def knobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, *k) for f, k in KNOBS.items()], "format string, lo int, hi int, mild int, harsh int")


def budget(target: Column) -> tuple[Column, Column]:
    """(most bytes that fit, fewest that end the search at once)."""
    return F.floor(target * F.lit(1 - MARGIN)).cast("long"), F.ceil(target * F.lit(1 - WINDOW)).cast("long")


def clamp_to_target(rows: DataFrame) -> DataFrame:
    """``bytes``: the size asked for within the target's cap. The seven targets are broadcast."""
    j = rows.join(F.broadcast(targets(rows.sparkSession)), "target")
    return j.withColumn("bytes", F.when(F.col("cap") == 0, F.col("fit")).otherwise(F.least("fit", "cap")))


def size_at(base: Column, knob: int | Column) -> Column:
    k = F.lit(1000) - F.lit(4) * (F.lit(knob) if isinstance(knob, int) else knob)
    total = (base * k).cast("long")
    return ((total - F.pmod(total, F.lit(1000))) / 1000).cast("long")


def rung_outcomes(curve: DataFrame, target: Column, mild: int = 30, harsh: int = 150) -> DataFrame:
    most, _ = budget(target)
    c = curve.select("*", most.alias("most"), size_at(F.col("base"), mild).alias("mild"), size_at(F.col("base"), harsh).alias("harsh"))
    return c.withColumn("outcome", F.when(F.col("mild") <= F.col("most"), "mild").when(F.col("harsh") > F.col("most"), "skipped").otherwise("refine"))


def winners(outcomes: DataFrame) -> DataFrame:
    """The mildest rung with a candidate and its alternatives among the next two."""
    best = F.min(F.when(F.col("outcome") != "skipped", F.col("rung"))).over(Window.partitionBy("clip"))
    o = outcomes.withColumn("best", best).where((F.col("outcome") != "skipped") & (F.col("rung") <= F.col("best") + ALTERNATIVES))
    return o.withColumn("role", F.when(F.col("rung") == F.col("best"), "best").otherwise("alternative"))


def fallback(outcomes: DataFrame) -> DataFrame:
    none = outcomes.groupBy("clip").agg(F.bool_and(F.col("outcome") == "skipped").alias("none")).where("none").select("clip")
    left = outcomes.join(none, "clip", "left_semi")
    w = Window.partitionBy("clip").orderBy(F.desc("sound"), "harsh", "rung")
    return left.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def trace(outcomes: DataFrame) -> DataFrame:
    """One row a clip with what its search reports: best, alternatives, skipped, failed (rungs in order), rule, ok, fallback.

    ``outcomes``: clip, rung, outcome (mild, refine, skipped, failed), harsh, sound. The search
    is a machine over the rungs in order that ends where its window does: ALTERNATIVES rungs
    behind the first that fits, or at the last rung where none does. What lies behind the end
    is not reported. Where nothing fits, rule ``fit.target`` fails, and the rung that comes nearest
    is named: structurally sound first, then fewest bytes. A ladder is a few rungs.
    """
    fits = F.col("outcome").isin("mild", "refine")
    step = F.struct("rung", "outcome")
    near = F.min_by("rung", F.when(F.col("outcome") != "failed", F.struct(~F.col("sound"), F.col("harsh"), F.col("rung"))))
    found = outcomes.groupBy("clip").agg(F.min(F.when(fits, F.col("rung"))).alias("best"), F.max("rung").alias("last"), F.array_sort(F.collect_list(step)).alias("steps"), near.alias("near"))
    end = F.coalesce(F.least(F.col("best") + ALTERNATIVES, F.col("last")), F.col("last"))
    seen = found.withColumn("steps", F.filter("steps", lambda x: x["rung"] <= end))
    of = lambda name, *kinds: F.transform(F.filter("steps", lambda x: x["outcome"].isin(*kinds) & (~x["rung"].eqNullSafe(F.col("best")))), lambda x: x["rung"]).alias(name)
    ok = F.col("best").isNotNull()
    return seen.select("clip", "best", of("alternatives", "mild", "refine"), of("skipped", "skipped"), of("failed", "failed"), F.lit("fit.target").alias("rule"), ok.alias("ok"), F.when(~ok, F.col("near")).alias("fallback"))


def search(curve: DataFrame, target: Column, mild: int = 30, harsh: int = 150, sized: Callable[[Column, Column], Column] = None) -> DataFrame:
    """clip, rung, knob, bytes, encodes: the largest candidate of every rung under the budget, nulls where none fits.

    The two probes bracket the budget. A rung between them is narrowed by false position on the
    logarithm of the size (Illinois variant: an end that stays while the other moves twice counts
    half) in at most ROUNDS rounds, folded over a fixed sequence, so the whole search is one
    column expression of its row. ``sized`` (base, knob) gives a candidate's bytes.
    """
    sized = sized or size_at
    most, least = budget(target)
    log = lambda c: F.log(F.greatest(F.lit(1), c).cast("double"))
    rows = curve.select("clip", "rung", "base", most.alias("most"), least.alias("least"))
    rows = rows.withColumns({"aim": (log(F.col("most")) + log(F.col("least"))) / 2, "soft": sized(F.col("base"), F.lit(mild)), "hard": sized(F.col("base"), F.lit(harsh))})
    mild_fits, none_fits = F.col("soft") <= F.col("most"), F.col("hard") > F.col("most")

    def end(knob: Column, gap: Column) -> Column:
        return F.struct(knob.cast("long").alias("knob"), gap.alias("gap"))

    def state(over: Column, under: Column, moved: Column, best: Column, tried: Column) -> Column:
        return F.struct(over.alias("over"), under.alias("under"), moved.alias("moved"), best.alias("best"), tried.alias("tried"))

    def candidate(knob: Column, size: Column) -> Column:
        return F.struct(size.alias("bytes"), (-knob).cast("long").alias("mildness"))

    first = state(end(F.lit(mild), log(F.col("soft")) - F.col("aim")), end(F.lit(harsh), log(F.col("hard")) - F.col("aim")), F.lit(""), candidate(F.lit(harsh), F.col("hard")), F.lit(0))

    def narrowed(s: Column, _: Column) -> Column:
        over, under = s["over"], s["under"]
        fall = over["gap"] - under["gap"]
        share = F.when(fall > 0, over["gap"] / fall).otherwise(0.5)
        inside = over["knob"] + F.floor(share * (under["knob"] - over["knob"]) + 0.5)
        knob = F.least(under["knob"] - 1, F.greatest(over["knob"] + 1, inside))
        size = sized(F.col("base"), knob)
        here, big = end(knob, log(size) - F.col("aim")), size > F.col("most")
        kept = lambda e, other: end(e["knob"], F.when(s["moved"] == other, e["gap"] / 2).otherwise(e["gap"]))
        to = F.when(big, state(here, kept(under, "over"), F.lit("over"), s["best"], s["tried"] + 1)).otherwise(state(kept(over, "under"), here, F.lit("under"), F.greatest(s["best"], candidate(knob, size)), s["tried"] + 1))
        open_ = (under["knob"] - over["knob"] > 1) & (s["best"]["bytes"] < F.col("least"))
        return F.when(open_, to).otherwise(s)

    found = rows.withColumn("end", F.when(~mild_fits & ~none_fits, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, narrowed)))
    knob = F.when(mild_fits, F.lit(mild).cast("long")).otherwise(-F.col("end.best.mildness"))
    size = F.when(mild_fits, F.col("soft")).otherwise(F.col("end.best.bytes"))
    encodes = F.when(mild_fits | F.lit(harsh == mild), 1).otherwise(2 + F.coalesce("end.tried", F.lit(0)))
    return found.select("clip", "rung", knob.alias("knob"), size.alias("bytes"), encodes.cast("long").alias("encodes"))


def realise(masters: DataFrame, ladder: str) -> DataFrame:
    """A ladder's rungs for masters (mfps, side): what wouldn't lower rate or size is the master's own (null)."""
    rungs = F.broadcast(ladders(masters.sparkSession).where(F.col("ladder") == ladder))
    j = masters.join(rungs)
    return j.withColumns({"fps": F.when(F.col("fps") < F.col("mfps") - F.lit(1e-6), F.col("fps")), "px": F.when(F.col("px") < F.col("side"), F.col("px"))})


def distinct_rungs(rungs: DataFrame, key: list[str]) -> DataFrame:
    """Of rungs that agree in all settings the first stays."""
    return rungs.groupBy(*key, "fps", "colors", "px", "dither").agg(F.min("idx").alias("idx"))


def generic_ladder(masters: DataFrame) -> DataFrame:
    """As it is; lower rates; fewer colours and smaller scales at the lowest rate."""
    low = F.least(F.lit(15.0), "mfps")
    none = F.lit(None).cast("double")

    def rung(fps: Column, colors: int | None, scale: float) -> Column:
        return F.struct(fps.alias("fps"), F.lit(colors).cast("int").alias("colors"), F.lit(scale).alias("scale"))

    fixed = [rung(none, None, 1.0)]
    rates = [F.when(F.col("mfps") > r, rung(F.lit(r), None, 1.0)) for r in (30.0, 24.0, 20.0, 15.0)]
    tail = [rung(low, 128, 1.0), rung(low, 64, 1.0), rung(low, 64, 0.75), rung(low, 64, 0.5)]
    rungs = F.filter(F.array(*fixed, *rates, *tail), lambda x: x.isNotNull())
    return masters.select("mfps", F.posexplode(rungs).alias("idx", "r")).select("mfps", F.col("idx").cast("long").alias("idx"), "r.fps", "r.colors", "r.scale")


def ladder_for(target: Column, fmt: Column) -> Column:
    return (
        F.when((target == "emote") & (fmt == "gif"), "emote_gif").when((target == "emote") & fmt.isin("webp", "avif"), "emote_webp")
        .when((target == "sticker") & (fmt == "apng"), "sticker_apng").when((target == "sticker") & (fmt == "gif"), "sticker_gif").otherwise("generic")
    )


def colour_steps(colors: Column) -> Column:
    """Halvings that bring a palette to 64 colours or fewer."""
    out = F.lit(0)
    for k, over in enumerate((64, 129, 259), 1):
        out = F.when(colors > over, k).otherwise(out)
    return out


def knob_value(fmt: Column, knob: Column) -> Column:
    halved = F.greatest(F.lit(64), F.element_at(F.array(F.lit(256), F.lit(128), F.lit(64)), (knob % 3 + 1).cast("int"))).cast("long")
    quality = F.least(F.lit(100), F.greatest(F.lit(1), F.lit(100) - knob)).cast("long")
    return F.when(fmt == "gif", knob).when(fmt == "apng", halved).when(fmt == "png", F.when(knob % 3 == 0, F.lit(0).cast("long")).otherwise(halved)).otherwise(quality)


def filtered(rungs: DataFrame) -> DataFrame:
    """``rungs`` (job, ladder, idx, fps, colors, px, dither, keep_size, keep_fps, most) as their job wants them: kept sides, rates and colour limits are the master's own (null), and of rungs that then agree the mildest stays."""
    kept = rungs.withColumns({"px": F.when(~F.col("keep_size"), F.col("px")), "fps": F.when(~F.col("keep_fps"), F.col("fps")), "colors": F.when(F.col("most").isNull() | (F.col("colors") < F.col("most")), F.col("colors"))})
    return distinct_rungs(kept, ["job", "ladder"])


def label(fps: Column, colors: Column, px: Column) -> Column:
    rate = F.when(fps == F.floor(fps), fps.cast("long").cast("string")).otherwise(fps.cast("string"))
    text = F.concat_ws(" · ", F.concat(rate, F.lit(" fps")), F.concat(colors, F.lit(" colours")), F.concat(px, F.lit(" px")))
    return F.when(text == "", "master settings").otherwise(text)
