"""Op stacks: a recipe's operations, any number of any kinds in any order, folded over a source's facts.

The accumulator is what an operation can see or change: size, alpha, trim, speed, rate, delay,
and for each phase of planning its first error. Phases come in a fixed order whatever the order
of the operations, so a plan's error is the first phase's that has one. Errors are values:
``2:crop:outside`` is the third operation's, others name their phase alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import planning as P
from .numbers import div, floor_long, round_half_up, round_to

# Kinds of operations, their parameters in recipes, limits.
KINDS = ["trim", "speed", "fps", "crop", "resize", "canvas", "flip", "rotate", "delay", "unpremultiply"]
PARAMS = "w bigint, h bigint, x bigint, y bigint, width bigint, height bigint, fit string, color string, degrees bigint, start double, end double, factor double, fps double, ms bigint"
LEAST_DELAY, MOST_DELAY = 1, 60_000
OPS = f"array<struct<kind: string, params: struct<{PARAMS.replace(' ', ': ').replace(',: ', ', ')}>>>"
#: Phases in the order in which their errors count.
PHASES = ["kind", "delay", "trim", "speed", "fps", "frame"]


def parse_ops(json: Column) -> Column:
    """The ``ops`` of a recipe from their JSON text."""
    return F.from_json(json, OPS)


def fit_name(fit: Column) -> Column:
    """contain, cover or exact; null for anything else."""
    name = F.lower(F.trim(F.coalesce(fit, F.lit(""))))
    return F.when(name == "", "contain").when(name.isin("contain", "cover", "exact"), name)


def too_large(w: Column, h: Column) -> Column:
    return (w > P.MAX_SIDE) | (h > P.MAX_SIDE) | (w * h > P.MAX_AREA)


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once: a lambda's variable stands for it."""
    return F.transform(F.array(value), then)[0]


def scaled_for(w: Column, h: Column, box_w: Column, box_h: Column, fit: Column) -> Column:
    """Size after scaling for a box (sw, sh) and, for cover with both sides given, after the crop to it (w, h)."""
    cut = (fit == "cover") & (box_w > 0) & (box_h > 0)
    sw, sh = P.scaled_size(w, h, box_w, box_h, fit)
    return let(F.struct(sw.alias("sw"), sh.alias("sh")), lambda z: F.struct(z["sw"].alias("sw"), z["sh"].alias("sh"), F.when(cut, F.least(box_w, z["sw"])).otherwise(z["sw"]).alias("w"), F.when(cut, F.least(box_h, z["sh"])).otherwise(z["sh"]).alias("h")))


def _zero(x: Column, kind: str = "bigint") -> Column:
    return F.coalesce(x, F.lit(0)).cast(kind)


def _side(x: Column) -> Column:
    """A length or offset; beyond what any rule allows it doesn't matter how far, and products stay small."""
    return F.greatest(F.lit(-(1 << 20)), F.least(F.lit(1 << 20), _zero(x)))


def _frame(error: Column, w: Column, h: Column, alpha: Column) -> Column:
    return F.struct(error.cast("string").alias("error"), w.cast("long").alias("w"), h.cast("long").alias("h"), alpha.alias("alpha"))


def _crop(s: Column, p: Column) -> Column:
    w, h, x, y = (_side(p[c]) for c in "whxy")
    error = F.when(F.least(w, h) < 1, "size").when(F.least(x, y) < 0, "offset").when((x + w > s["w"]) | (y + h > s["h"]), "outside")
    return _frame(error, w, h, s["alpha"])


def _resize(s: Column, p: Column) -> Column:
    def sized(b: Column) -> Column:
        w, h = b["w"], b["h"]

        def made(z: Column) -> Column:
            error = (
                F.when(b["fit"].isNull(), "fit").when(F.least(w, h) < 0, "size").when(F.greatest(w, h) == 0, "missing")
                .when(F.greatest(w, h) > P.MAX_SIDE, "side").when(too_large(z["sw"], z["sh"]), "frame")
            )
            return _frame(error, z["w"], z["h"], s["alpha"])

        return let(scaled_for(s["w"], s["h"], w, h, b["fit"]), made)

    return let(F.struct(_side(p["width"]).alias("w"), _side(p["height"]).alias("h"), fit_name(p["fit"]).alias("fit")), sized)


def _canvas(s: Column, p: Column) -> Column:
    w, h, given = _side(p["width"]), _side(p["height"]), F.trim(F.coalesce(p["color"], F.lit("")))
    colour = P.normalize_hex(given)
    clear = (given == "") | ((F.length(colour) == 8) & (F.substring(colour, 7, 2) != "ff"))
    error = F.when(F.least(w, h) < 1, "size").when(F.greatest(w, h) > P.MAX_SIDE, "side").when(too_large(w, h), "frame").when((given != "") & colour.isNull(), "color")
    grown = (w > s["w"]) | (h > s["h"])
    return _frame(error, w, h, s["alpha"] | (grown & clear))


def _rotate(s: Column, p: Column) -> Column:
    turn = _zero(p["degrees"])
    side = turn.isin(90, 270)
    return _frame(F.when(~turn.isin(90, 180, 270), "degrees"), F.when(side, s["h"]).otherwise(s["w"]), F.when(side, s["w"]).otherwise(s["h"]), s["alpha"])


GEOMETRY = {"crop": _crop, "resize": _resize, "canvas": _canvas, "rotate": _rotate}
STATE = ["at", "w", "h", "alpha", "start", "end", "speed", "fps", "delay", *(f"bad_{p}" for p in PHASES)]


def _step(s: Column, op: Column, still: Column, single: Column, sequence: Column) -> Column:
    kind, p = op["kind"], op["params"]
    known = F.coalesce(kind.isin(*KINDS), F.lit(False))
    is_ = lambda name: F.coalesce(kind == name, F.lit(False))
    out = {c: s[c] for c in STATE}

    def bad(phase: str, code: Column) -> None:
        named = F.concat_ws(":", s["at"].cast("string"), F.coalesce(kind, F.lit("")), code)
        out[f"bad_{phase}"] = F.coalesce(s[f"bad_{phase}"], F.when(code.isNotNull(), named))

    bad("kind", F.when(~known, "unknown"))
    ms = _zero(p["ms"])
    bad("delay", F.when(is_("delay") & sequence & ((ms < LEAST_DELAY) | (ms > MOST_DELAY)), "ms"))
    out["delay"] = F.when(is_("delay"), ms).otherwise(s["delay"])

    start, end = round_to_micros(_zero(p["start"], "double")), F.greatest(F.lit(0.0), round_to_micros(_zero(p["end"], "double")))
    cuts = (start != 0) | (end != 0)
    bad("trim", F.when(is_("trim"), F.when(start < 0, "start").when((end > 0) & (end <= start), "order").when(cuts & still, "still").when(cuts & single, "single")))
    out["start"] = F.when(is_("trim"), F.greatest(s["start"], start)).otherwise(s["start"])
    out["end"] = F.when(is_("trim") & (end > 0) & ((s["end"] == 0) | (end < s["end"])), end).otherwise(s["end"])

    factor = _zero(p["factor"], "double")
    bad("speed", F.when(is_("speed"), F.when(F.isnan(factor) | (factor <= 0) | (factor == float("inf")), "factor").when((factor < P.SPEED[0]) | (factor > P.SPEED[1]), "range")))
    out["speed"] = F.when(is_("speed"), s["speed"] * factor).otherwise(s["speed"])

    rate = _zero(p["fps"], "double")
    bad("fps", F.when(is_("fps") & (F.isnan(rate) | (rate <= 0) | (rate == float("inf"))), "rate"))
    out["fps"] = F.when(is_("fps"), rate).otherwise(s["fps"])

    # Only the branch of an operation's own kind is computed.
    frame = F.lit(None)
    for name, apply in GEOMETRY.items():
        frame = F.when(is_(name), apply(s, p)) if name == "crop" else frame.when(is_(name), apply(s, p))
    frame = frame.otherwise(_frame(F.lit(None), s["w"], s["h"], s["alpha"]))

    def placed(g: Column) -> Column:
        bad("frame", g["error"])
        # Behind an error nothing changes any more.
        fine = s["bad_frame"].isNull() & g["error"].isNull()
        now = out | {"at": s["at"] + 1} | {c: F.when(fine, g[c]).otherwise(s[c]) for c in ("w", "h", "alpha")}
        return F.struct(*[now[c].alias(c) for c in STATE])

    return let(frame, placed)


def round_to_micros(seconds: Column) -> Column:
    return F.signum(seconds) * round_to(F.abs(seconds), 6)


def micros(seconds: Column) -> Column:
    return round_half_up(seconds * F.lit(1e6))


def plan(clips: DataFrame) -> DataFrame:
    """``clips`` with a last column ``plan``: width, height, has_alpha, fps, speed, trim_start, trim_end (0: to the end), frames, duration, error.

    Columns of ``clips``: width, height, fps, duration, frames, has_alpha, is_still; count (null
    but for image sequences) and delay; ops; out_w, out_h, out_fit, out_fps, format. Unknown
    duration, rate or count give unknown (null) frames; a plan with an error has nothing else.
    """
    c = F.col
    still, sequence = F.coalesce("is_still", F.lit(False)), c("count").isNotNull()
    single = still | F.coalesce(c("count") == 1, F.lit(False))
    zero = {"at": F.lit(0), "w": F.greatest(F.lit(1), _side(c("width"))), "h": F.greatest(F.lit(1), _side(c("height"))), "alpha": F.coalesce("has_alpha", F.lit(False)), "start": F.lit(0.0), "end": F.lit(0.0), "speed": F.lit(1.0), "fps": F.lit(0.0), "delay": F.when(F.coalesce("delay", F.lit(0)) > 0, c("delay")).otherwise(100).cast("long")}
    zero |= {f"bad_{p}": F.lit(None).cast("string") for p in PHASES}
    ops = F.coalesce("ops", F.from_json(F.lit("[]"), OPS))
    folded = clips.withColumn("_s", F.aggregate(ops, F.struct(*[v.alias(k) for k, v in zero.items()]), lambda s, op: _step(s, op, still, single, sequence)))

    # A sequence's rate follows its delay; its length is its frames at that rate.
    s = c("_s")
    rate = F.when(sequence, P.sequence_rate(s["delay"])).otherwise(F.when(c("fps") > 0, c("fps")))
    source = F.when(sequence, c("count") / rate).when(c("duration") > 0, c("duration")).when((c("frames") > 0) & (c("fps") > 0), c("frames") / c("fps"))
    timed = folded.withColumns({"_rate": rate, "_source": source})
    length = c("_source")
    end = F.when((s["end"] >= length) & (length > 0), 0.0).otherwise(s["end"])
    timed = timed.withColumns({"_end": end, "_first": P.grid_round(micros(s["start"]), round_half_up(c("_rate") * 1000)), "_kept": P.grid_round(micros(end) - micros(s["start"]), round_half_up(c("_rate") * 1000))})
    trimmed = (s["start"] > 0) | (s["end"] > 0)
    late_delay = F.when(sequence & (c("delay") > MOST_DELAY), "delay:ms")
    trim_error = F.when(trimmed, F.when((s["end"] > 0) & (s["end"] <= s["start"]), "trim:apart").when(length <= s["start"], "trim:late").when(sequence & (c("_first") >= c("count")), "trim:none").when(sequence & (c("_end") > 0) & (c("_kept") == 0), "trim:short"))
    speed_error = F.when((s["speed"] < P.SPEED[0]) | (s["speed"] > P.SPEED[1]), "speed:range")
    wanted = F.when(s["fps"] > 0, s["fps"]).when(c("out_fps") > 0, c("out_fps"))
    asked = F.coalesce(wanted, c("_rate"), F.lit(P.DEFAULT_FPS))
    fps_error = F.when((s["fps"] <= 0) & (c("out_fps") < 0), "output:fps").when(asked < P.LEAST_FPS, "fps:low")

    box_w, box_h, fit = _side(c("out_w")), _side(c("out_h")), fit_name(c("out_fit"))
    boxed = F.greatest(box_w, box_h) > 0
    timed = timed.withColumn("_box", scaled_for(s["w"], s["h"], box_w, box_h, fit))
    sw, sh, cut_w, cut_h = (c("_box")[k] for k in ("sw", "sh", "w", "h"))
    padded = boxed & (fit == "contain") & (box_w > 0) & (box_h > 0)
    out_error = F.when(fit.isNull(), "output:fit").when(F.least(box_w, box_h) < 0, "output:size").when(F.greatest(box_w, box_h) > P.MAX_SIDE, "output:side").when(boxed & too_large(sw, sh), "output:frame")
    w = F.when(padded, box_w).when(boxed, cut_w).otherwise(s["w"])
    h = F.when(padded, box_h).when(boxed, cut_h).otherwise(s["h"])
    alpha = s["alpha"] | (padded & ((sw != box_w) | (sh != box_h)))

    # An error is told where there is no speed; it must not divide by zero before.
    speed = F.when(s["speed"] > 0, s["speed"])
    fps = P.snap_fps(c("_rate"), wanted, c("format"))
    selected = F.when(trimmed, F.when(c("_end") > 0, F.least(c("count") - c("_first"), "_kept")).otherwise(c("count") - c("_first"))).otherwise(c("count"))
    duration = F.when(single, 0.0).when(sequence, selected / c("_rate") / speed).otherwise(F.greatest(F.lit(0.0), F.when(c("_end") > 0, c("_end")).otherwise(length) - s["start"]) / speed)
    whole = div(floor_long(selected / speed) * round_half_up(fps * 1000), F.greatest(F.lit(1), round_half_up(c("_rate") * 1000)))
    frames = F.when(single, F.lit(1)).when(sequence, whole).otherwise(F.greatest(F.lit(1), floor_long(duration * fps + F.lit(1e-4)))).cast("long")
    frames = F.when(single | length.isNotNull(), frames)
    sized = timed.withColumns({"_w": w.cast("long"), "_h": h.cast("long"), "_alpha": alpha, "_fps": fps, "_frames": frames, "_duration": duration})
    size_error = F.when(~((c("width") > 0) & (c("height") > 0)), "source:size")
    last_error = F.when(too_large(c("_w"), c("_h")), "output:frame").when(sequence & ~single & (c("_frames") < 1), "speed:none").when((c("_w") * c("_h") * 4).cast("double") * c("_frames") > P.MAX_MASTER, "master")
    error = F.coalesce(F.when(F.coalesce(size_error.isNotNull(), F.lit(False)), size_error), s["bad_kind"], late_delay, s["bad_delay"], s["bad_trim"], trim_error, s["bad_speed"], speed_error, s["bad_fps"], fps_error, s["bad_frame"], out_error, last_error)
    told = sized.withColumn("_error", error)
    fine = c("_error").isNull()
    columns = {"width": "_w", "height": "_h", "has_alpha": "_alpha", "fps": "_fps", "speed": s["speed"], "trim_start": s["start"], "trim_end": "_end", "frames": "_frames", "duration": F.when(single | length.isNotNull(), c("_duration"))}
    result = F.struct(*[F.when(fine, c(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()], c("_error").alias("error"))
    return told.select(*clips.columns, result.alias("plan"))
