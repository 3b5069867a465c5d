"""Quality rules of file formats as aggregates over block tables: one row a rule and file, also where it passes.

A file's blocks meet once, by its name; running counts over their order and two groupings say
all rules of it. Rows: clip, format, target, rule, level, ok, fixed (whether the rule can be
mended without encoding again).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recipes import TARGETS
from .blocks import FILE
from .lint import STICKER_FPS, STICKER_FRAMES, STICKER_MS, apng_us

# Fixed values of the targets and of players.
STICKER_SIDE, EMOTE_SIDE = 320, 128
HELD_MS, SAFE_MS, LEAST_CS = 10, 20, 2
ICC, ALPHA, EXIF, XMP, ANIM = 0x20, 0x10, 0x08, 0x04, 0x02

KEY = [*FILE, "bytes"]


def _order(*by: str):
    return Window.partitionBy(*KEY, *by).orderBy("ord")


def _before(condition: Column, *by: str) -> Column:
    """How many earlier blocks of the file meet a condition."""
    return F.count_if(condition).over(_order(*by).rowsBetween(Window.unboundedPreceding, -1))


def rule(name: str, level: Column | str, ok: Column, fixed: Column | bool = False, when: Column | bool = True) -> Column:
    """A finding as a struct, null unless ``when``."""
    row = F.struct(F.lit(name).alias("rule"), (F.lit(level) if isinstance(level, str) else level).alias("level"), F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(fixed if isinstance(fixed, Column) else F.lit(fixed), F.lit(False)).alias("fixed"))
    return F.when(when if isinstance(when, Column) else F.lit(when), row)


def rows(files: DataFrame, findings: list[Column]) -> DataFrame:
    found = files.select(*FILE, F.explode(F.filter(F.array(*findings), lambda r: r.isNotNull())).alias("r"))
    return found.select(*FILE, "r.*")


def size_limit(fmt: str) -> Column:
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv]), F.col("target"))
    return rule(f"{fmt}.size-limit", "error", F.col("bytes") <= cap, when=F.coalesce(cap > 0, F.lit(False)))


def _side(most: int, w: str = "width", h: str = "height") -> Column:
    return F.greatest(w, h) <= most


def sticker_timing(frames: Column, us: Column) -> Column:
    """Length in whole milliseconds, frames and rate of an animated sticker; several frames need a length."""
    rate = F.when(us > 0, frames * 1_000_000 <= us * STICKER_FPS).otherwise(frames <= 1)
    return (frames <= STICKER_FRAMES) & (F.floor((us + 500) / 1000) <= STICKER_MS) & rate


def _codes(found: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(so, F.lit(name)) for name, so in found.items()]), lambda x: x.isNotNull())


def gif_files(blocks: DataFrame) -> DataFrame:
    """One row a file with what its rules ask; images are numbered, and control blocks belong to the image behind them."""
    kind = F.col("kind")
    is_ = lambda *names: kind.isin(*names)
    numbered = blocks.withColumn("image", _before(is_("image")))
    images = numbered.groupBy(*KEY, "image").agg(
        F.max_by(F.struct("width", "height", "x", "y", "colors", "interlaced", "used"), F.when(is_("image"), F.col("ord"))).alias("shape"),
        F.max_by(F.struct("delay", "disposal", "transparent"), F.when(is_("gce"), F.col("ord"))).alias("control"),
        F.count_if(is_("gce")).alias("controls"),
        F.max_by(F.struct("width", "height", "background", "colors"), F.when(is_("header"), F.col("ord"))).alias("header"),
        F.count_if(is_("loop")).alias("loops"), F.count_if(is_("loop") & F.col("loops").isNull()).alias("odd_loops"), F.count_if(is_("loop") & (F.col("loops") > 0)).alias("finite"),
        F.count_if(is_("comment", "text", "app")).alias("extra"), F.count_if(is_("trailer")).alias("trailer"), F.count_if(is_("problem")).alias("problem"),
    )
    shown, clear = F.col("shape").isNotNull(), F.col("control.transparent")
    # A flagged image that can't be decoded counts as transparent.
    through = shown & clear.isNotNull() & F.coalesce(F.array_contains("shape.used", clear), F.lit(True))
    out = images.withColumn("through", F.coalesce(through, F.lit(False))).groupBy(*KEY).agg(
        F.count_if(shown).alias("frames"), F.count_if(shown & (F.col("controls") != 1)).alias("uneven"), F.count_if(~shown & (F.col("controls") > 0)).alias("dangling"),
        F.min_by(F.struct("shape", "control"), F.when(shown, F.col("image"))).alias("first"), F.max("header").alias("header"), F.bool_or("through").alias("through"),
        F.collect_set(F.when(shown, clear)).alias("clears"), F.mode(F.when(shown & (F.col("image") > 0), clear), deterministic=True).alias("usual"),
        F.count_if(shown & ~F.col("control.disposal").isin(1, 2)).alias("disposals"), F.count_if(shown & (F.col("control.disposal") > 2)).alias("lost"),
        F.count_if(shown & (F.col("control.delay") < LEAST_CS)).alias("quick"), F.coalesce(F.sum(F.when(shown, F.col("control.delay"))), F.lit(0)).alias("delay_cs"),
        F.sum("loops").alias("loops"), F.sum(F.when(F.col("image") == 0, F.col("loops"))).alias("in_front"), F.sum("odd_loops").alias("odd_loops"), F.sum("finite").alias("finite"),
        F.count_if(shown & (F.col("shape.colors") > 0)).alias("local"), F.max(F.when(shown, F.col("shape.colors"))).alias("most_local"), F.count_if(shown & F.col("shape.interlaced")).alias("interlaced"),
        F.sum("extra").alias("extra"), F.sum("trailer").alias("trailer"), F.sum("problem").alias("problem"),
    )
    return out.select("*", F.col("header.width").alias("width"), F.col("header.height").alias("height"), F.greatest(F.col("header.colors"), F.coalesce("most_local", F.lit(0))).alias("colors"))


def gif_rules(blocks: DataFrame) -> DataFrame:
    f = gif_files(blocks)
    whole = F.col("problem") == 0
    known = F.col("target") != ""
    shape, clear = F.col("first.shape"), F.col("first.control.transparent")
    uncovered = (shape["x"] != 0) | (shape["y"] != 0) | (shape["width"] != F.col("width")) | (shape["height"] != F.col("height"))
    missing = (F.col("through") | uncovered) & clear.isNull()
    # An index of the global palette that the first image leaves free.
    free = (shape["colors"] == 0) & F.exists(F.sequence(F.lit(0), F.greatest(F.col("header.colors"), F.lit(1)) - 1), lambda i: ~F.array_contains(shape["used"], i)) & (F.col("header.colors") > 0)
    only = F.coalesce((F.size(shape["used"]) == 1) & F.array_contains(shape["used"], clear), F.lit(False))
    empty = (shape["width"] == 0) | (shape["height"] == 0)
    loop = (F.coalesce("in_front", F.lit(0)) > 0) & (F.col("odd_loops") == 0) & (~known | (F.col("finite") == 0))
    no_palette = (F.col("header.colors") == 0) & (F.col("local") < F.col("frames"))
    some = F.col("frames") > 0
    return rows(f, [
        rule("gif.container", "error", whole),
        rule("gif.gce-every-frame", "error", some & (F.col("uneven") == 0), some, whole),
        rule("gif.frame0-transparency", "error", ~missing, missing & free, whole & some),
        rule("gif.lsd-background-index", "error", F.when(clear.isNotNull(), F.col("header.background") == clear).otherwise(~F.array_contains("clears", F.col("header.background"))), True, whole),
        rule("gif.disposal", "error", F.col("disposals") == 0, F.col("lost") == 0, whole),
        rule("gif.netscape-loop", "error", loop, True, whole),
        rule("gif.min-delay", "warn", F.col("quick") == 0, True, whole),
        rule("gif.global-palette", F.when(known | no_palette, "error").otherwise("warn"), ~no_palette & (F.col("local") == 0), when=whole),
        rule("gif.no-interlace", "warn", F.col("interlaced") == 0, when=whole),
        rule("gif.no-extra-extensions", "info", F.col("extra") + F.col("dangling") == 0, True, whole),
        rule("gif.first-frame-visible", "warn", ~empty & ~only, when=whole & some & (empty | clear.isNull() | shape["used"].isNotNull())),
        rule("gif.trailer", "error", F.col("trailer") > 0, True, whole),
        F.when(whole, size_limit("gif")),
        rule("gif.emote-dims", "warn", _side(EMOTE_SIDE), when=whole & (F.col("target") == "emote")),
        rule("gif.sticker-dims", "warn", _side(STICKER_SIDE), when=whole & (F.col("target") == "sticker")),
        rule("gif.sticker-duration", "error", sticker_timing(F.col("frames"), F.col("delay_cs") * 10_000), when=whole & (F.col("target") == "sticker")),
    ])


def webp_files(chunks: DataFrame) -> DataFrame:
    """One row a file: how many chunks of each kind, where they stand, and what the first of each says."""
    kind, outer = F.col("kind"), F.col("frame").isNull()
    image = kind.isin("VP8", "VP8L")
    of = lambda name: outer & (kind == name)
    known = F.col("problem").isNull()
    # A frame's number stands on its own row and on those of the chunks inside it.
    frames = chunks.groupBy(*KEY, "frame").agg(
        F.max_by(F.struct("x", "y", "width", "height", "ms"), F.when((kind == "ANMF") & known, F.col("ord"))).alias("rect"),
        F.min_by(F.struct("width", "height", "problem"), F.when(~outer & image, F.col("ord"))).alias("stream"),
        F.count_if(~outer & (kind == "cut")).alias("cut_inside"), F.bool_or(~outer & ((kind == "ALPH") | F.coalesce("alpha", F.lit(False)))).alias("frame_alpha"),
        F.max(F.when(of("RIFF"), F.col("chunk_size"))).alias("declared"), F.count_if(kind == "none").alias("none"), F.count_if(of("cut")).alias("cut"),
        F.min_by(F.struct("flags", "width", "height"), F.when(of("VP8X") & known, F.col("ord"))).alias("canvas"), F.count_if(of("VP8X")).alias("vp8x"), F.max(F.when(of("VP8X"), F.col("ord"))).alias("vp8x_at"),
        F.min_by(F.struct("loops"), F.when(of("ANIM") & known, F.col("ord"))).alias("anim"), F.count_if(of("ANIM")).alias("anims"), F.count_if(outer & kind.isin("VP8X", "ANIM") & ~known).alias("short"),
        F.min_by(F.struct("width", "height", "alpha", "problem"), F.when(outer & image, F.col("ord"))).alias("still"), F.count_if(outer & image).alias("stills"),
        F.count_if(of("ALPH")).alias("alph"), F.count_if(outer & kind.isin("ICCP", "EXIF", "XMP")).alias("metadata"),
    )
    is_frame = F.col("frame").isNotNull()
    w, h = F.col("canvas.width"), F.col("canvas.height")
    files = frames.withColumns({c: F.max(c).over(Window.partitionBy(*KEY)) for c in ("canvas", "still")})
    r, s = F.col("rect"), F.col("stream")
    size = F.coalesce(F.col("canvas.width"), F.col("still.width"), F.lit(0)), F.coalesce(F.col("canvas.height"), F.col("still.height"), F.lit(0))
    good = r.isNotNull() & s.isNotNull() & (F.col("cut_inside") == 0) & s["problem"].isNull() & (s["width"] == r["width"]) & (s["height"] == r["height"]) & (r["x"] + r["width"] <= size[0]) & (r["y"] + r["height"] <= size[1])
    out = files.groupBy(*KEY, "canvas", "still").agg(
        F.count_if(is_frame).alias("frames"), F.count_if(is_frame & ~F.coalesce(good, F.lit(False))).alias("bad"), F.bool_or(is_frame & F.col("frame_alpha")).alias("frame_alpha"), F.min(F.when(is_frame, F.coalesce(r["ms"], F.lit(0)))).alias("shortest"), F.coalesce(F.sum(F.when(is_frame, r["ms"])), F.lit(0)).alias("ms"),
        *[F.max(c).alias(c) for c in ("declared", "none", "cut", "vp8x", "vp8x_at", "anim", "anims", "short", "stills", "alph", "metadata")],
    )
    return out.select("*", size[0].alias("width"), size[1].alias("height"), (F.col("frames") + F.when(F.col("frames") == 0, F.least("stills", F.lit(1))).otherwise(0)).alias("images"), w.alias("canvas_w"), h.alias("canvas_h"))


def webp_problems() -> Column:
    """Names of what is wrong with a container."""
    c = F.col
    wrong = {
        "size": (c("declared") < 4) | (c("declared") + 8 > c("bytes")), "odd": c("declared") % 2 == 1, "cut": c("cut") > 0, "short": c("short") > 0,
        "vp8x-place": (c("vp8x") > 0) & (c("vp8x_at") > 1), "vp8x-again": c("vp8x") > 1, "anim-again": c("anims") > 1, "images": c("stills") > 1,
        "no-image": c("images") == 0, "both": (c("frames") > 0) & (c("stills") > 0), "frames-plain": (c("frames") > 0) & c("canvas").isNull(),
        "frames-unlooped": (c("frames") > 0) & c("anim").isNull(), "alpha-plain": (c("alph") > 0) & c("canvas").isNull(),
    }
    return _codes(wrong)


def webp_rules(chunks: DataFrame) -> DataFrame:
    f = webp_files(chunks)
    c = F.col
    whole = c("none") == 0
    flags = F.coalesce(c("canvas.flags"), F.lit(0))
    has = lambda bits: flags.bitwiseAND(bits) != 0
    plain = c("canvas").isNull()
    known = c("target") != ""
    alpha = c("frame_alpha") | (c("still").isNotNull() & ((c("alph") > 0) | F.coalesce(c("still.alpha"), F.lit(False))))
    moving = (c("images") > 1) | c("anim").isNotNull() | has(ANIM)
    loops = c("anim.loops")
    told = moving & (loops > 0) & ~known
    still_bad = c("still").isNotNull() & (c("still.problem").isNotNull() | (~plain & ((c("still.width") != c("canvas_w")) | (c("still.height") != c("canvas_h")))))
    fits = (c("bad") == 0) & ~F.coalesce(still_bad, F.lit(False)) & (c("width").cast("long") * c("height") < 1 << 32)
    shortest = F.coalesce("shortest", F.lit(SAFE_MS))
    return rows(f, [
        rule("webp.riff", "error", whole & (F.size(webp_problems()) == 0)),
        rule("webp.anim-flag", "error", F.when(plain, c("images") <= 1).otherwise(has(ANIM) == (c("images") > 1)), when=whole),
        rule("webp.alpha-flag", "error", plain | (has(ALPHA) == alpha), when=whole),
        rule("webp.loop-forever", F.when(F.coalesce(told, F.lit(False)), "info").otherwise("error"), ~moving | (loops == 0) | told, when=whole),
        rule("webp.canvas", "error", fits, when=whole),
        rule("webp.no-metadata", "warn", (c("metadata") == 0) & ~has(ICC | EXIF | XMP), when=whole),
        rule("webp.min-delay", F.when((shortest > HELD_MS) & (shortest < SAFE_MS), "info").otherwise("warn"), shortest >= SAFE_MS, when=whole),
        F.when(whole, size_limit("webp")),
        rule("webp.sticker", "error", F.lit(False), when=whole & (c("target") == "sticker")),
        rule("webp.emote-dims", "warn", _side(EMOTE_SIDE), when=whole & (c("target") == "emote")),
    ])


# Bit depths of each colour type; bytes of a transparency chunk by colour type; the largest side.
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
KEYED, LARGEST = {0: 2, 2: 6}, (1 << 31) - 1


def png_files(parts: DataFrame) -> DataFrame:
    """One row a file with the set of its problems, by code, and the facts that rules ask.

    The grammar of a file is a walk over its chunks; a chunk's place in it is given by how many
    of each kind stand before it, a frame by the number of frame controls up to it.
    """
    c, kind = F.col, F.col("kind")
    head, control, frame, data = (kind == "IHDR") & (c("part_size") == 13), (kind == "acTL") & (c("part_size") == 8), (kind == "fcTL") & (c("part_size") == 26), (kind == "fdAT") & (c("part_size") >= 4)
    upto = _order().rowsBetween(Window.unboundedPreceding, 0)
    behind = _order().rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({
        "frame": F.count_if(frame).over(upto), "heads": _before(head), "palettes": _before(kind == "PLTE"), "keys": _before(kind == "tRNS"), "controls": _before(control),
        "images": _before(kind == "IDAT"), "datas": _before(kind == "fdAT"), "expected": F.coalesce(F.last("seq", ignorenulls=True).over(behind) + 1, F.lit(0)),
        "seen": F.last(F.when(head, c("colour")), ignorenulls=True).over(behind),
    })
    # Whether the frame that a chunk belongs to is the default image: its control stands before any image data.
    placed = placed.withColumn("default", F.last(F.when(frame, c("images") == 0), ignorenulls=True).over(upto))
    named = lambda name: kind == name
    first_head = named("IHDR") & (c("heads") == 0)
    valid = F.lit(False)
    for colour, depths in DEPTHS.items():
        valid = valid | ((c("colour") == colour) & c("depth").isin(*depths))
    codes = _codes({
        "signature": named("none"), "stray": named("stray"), "cut": named("cut"), "crc": ~c("crc"),
        "ihdr-again": named("IHDR") & (c("heads") > 0), "ihdr-place": first_head & (c("ord") > 0), "ihdr-size": first_head & ~head,
        "ihdr-dimensions": first_head & head & ((F.least("width", "height") == 0) | (F.greatest("width", "height") > LARGEST)), "ihdr-depth": first_head & head & ~valid,
        "ihdr-method": first_head & head & (c("methods") != 0), "ihdr-interlace": first_head & head & (c("interlace") > 1),
        "plte-again": named("PLTE") & (c("palettes") > 0), "plte-late": named("PLTE") & (c("palettes") == 0) & (c("images") > 0), "plte-behind-trns": named("PLTE") & (c("palettes") == 0) & (c("keys") > 0) & (c("seen") == 3),
        "plte-size": named("PLTE") & (c("palettes") == 0) & ((c("part_size") == 0) | (c("part_size") % 3 != 0) | (c("part_size") > 768)),
        "trns-again": named("tRNS") & (c("keys") > 0), "trns-late": named("tRNS") & (c("keys") == 0) & (c("images") > 0),
        "actl-again": named("acTL") & (c("controls") > 0), "actl-late": named("acTL") & (c("controls") == 0) & (c("images") > 0), "actl-size": named("acTL") & (c("controls") == 0) & ~control, "actl-empty": control & (c("controls") == 0) & (c("frames") == 0),
        "fctl-size": named("fcTL") & ~frame, "fctl-again": frame & c("default") & (c("frame") > 1), "fctl-dispose": frame & (c("dispose") > 2), "fctl-blend": frame & (c("blend") > 1),
        "sequence": c("seq") != c("expected"), "fdat-size": named("fdAT") & ~data, "fdat-early": data & (c("frame") == 0), "fdat-default": data & c("default"), "idat-late": named("IDAT") & (c("datas") > 0),
    })
    own = F.when(head & (c("heads") == 0), c("ord"))
    by_frame = placed.withColumn("codes", codes).groupBy(*KEY, "frame").agg(
        F.flatten(F.collect_list("codes")).alias("codes"), F.max_by(F.struct("width", "height", "x", "y", "num", "den", "default"), F.when(frame, c("ord"))).alias("own"),
        F.count_if(F.when(c("default"), named("IDAT")).otherwise(data)).alias("data"), F.min_by(F.struct("width", "height", "colour"), own).alias("head"),
        F.min_by(F.struct("frames", "plays"), F.when(control, c("ord"))).alias("control"), F.min_by(F.struct("part_size"), F.when(named("PLTE"), c("ord"))).alias("palette"), F.min_by(F.struct("part_size"), F.when(named("tRNS"), c("ord"))).alias("key"),
        *[F.count_if(named(k)).alias(k) for k in ("IDAT", "fdAT", "IEND")], F.count_if(~kind.isin("none", "empty", "stray", "cut")).alias("parts"),
    )
    shown = c("frame") > 0
    empty = _codes({"frame-empty": shown & (c("data") == 0)})
    out = by_frame.groupBy(*KEY).agg(
        F.array_distinct(F.flatten(F.collect_list(F.concat("codes", empty)))).alias("codes"), F.count_if(shown).alias("frames"), F.collect_list(F.when(shown, F.struct(F.col("frame").alias("n"), "own.*"))).alias("every"),
        F.max("head").alias("head"), F.min_by("control", F.when(c("control").isNotNull(), c("frame"))).alias("control"), F.min_by("palette", F.when(c("palette").isNotNull(), c("frame"))).alias("palette"), F.min_by("key", F.when(c("key").isNotNull(), c("frame"))).alias("key"),
        *[F.sum(k).alias(k) for k in ("IDAT", "fdAT", "IEND", "parts")],
    )
    entries = F.when((c("palette.part_size") % 3 == 0) & (c("palette.part_size") <= 768), c("palette.part_size") / 3).otherwise(0)
    colour, key = c("head.colour"), c("key.part_size")
    readable = ~F.array_contains("codes", "signature")
    whole = _codes({
        "no-chunks": readable & (c("parts") == 0), "no-ihdr": readable & (c("parts") > 0) & c("head").isNull(), "no-idat": readable & (c("IDAT") == 0), "no-iend": readable & (c("IEND") == 0),
        "palette-missing": (colour == 3) & c("palette").isNull(), "trns-long": (colour == 3) & (key > entries), "trns-size": colour.isin(*KEYED) & (key != F.element_at(F.create_map(*[F.lit(x) for kv in KEYED.items() for x in kv]), colour)), "trns-alpha": colour.isin(4, 6) & key.isNotNull(),
        "actl-count": c("control").isNotNull() & (c("control.frames") != c("frames")), "no-actl": c("control").isNull() & (c("frames") + c("fdAT") > 0),
    })
    return out.withColumns({"problems": F.array_sort(F.array_distinct(F.concat("codes", whole))), "readable": readable, "width": F.coalesce(c("head.width"), F.lit(0)), "height": F.coalesce(c("head.height"), F.lit(0)), "every": F.array_sort("every")})


def png_problems(parts: DataFrame) -> DataFrame:
    """clip, format, target, code: every structural problem of every file once."""
    return png_files(parts).select(*FILE, F.explode("problems").alias("code"))


def png_rules(parts: DataFrame) -> DataFrame:
    f = png_files(parts)
    c, target = F.col, F.col("target")
    known, animated, readable = target != "", c("control").isNotNull(), c("readable")
    us = lambda x: apng_us(x["num"].cast("long"), x["den"].cast("long"))
    ms = F.transform("every", lambda x: F.floor((us(x) + 500) / 1000))
    timed = animated & (c("frames") > 0)
    zero, held, short = F.exists("every", lambda x: x["num"] == 0), F.exists(ms, lambda x: x <= HELD_MS), F.exists(ms, lambda x: x < SAFE_MS)
    strict = F.when(target == "sticker", "error").otherwise("warn")
    level = F.when(~timed | zero | ~short, strict).when(held, "warn").otherwise("info")
    w, h = c("width"), c("height")
    outside = F.exists("every", lambda x: (F.least(x["width"], x["height"]) == 0) | (x["x"] + x["width"] > w) | (x["y"] + x["height"] > h) | (x["default"] & ((x["x"] != 0) | (x["y"] != 0) | (x["width"] != w) | (x["height"] != h))))
    total = F.aggregate("every", F.lit(0).cast("long"), lambda s, x: s + us(x))
    timing, fits = sticker_timing(F.greatest("frames", F.lit(1)), total), _side(STICKER_SIDE)
    return rows(f, [
        rule("apng.container", "error", F.size("problems") == 0),
        rule("apng.plays-forever", F.when(animated & (c("control.plays") != 0) & ~known, "info").otherwise("error"), ~animated | (c("control.plays") == 0) | ~known, when=readable),
        rule("apng.first-frame", "warn", ~animated | F.coalesce(F.get("every", F.lit(0))["default"], F.lit(False)), when=readable),
        rule("apng.canvas", "error", (F.least(w, h) > 0) & ~outside, when=readable),
        rule("apng.min-delay", level, ~timed | ~short, when=readable),
        rule("apng.indexed", "info", (c("head.colour") == 3) & c("palette").isNotNull() & c("key").isNotNull(), when=readable),
        F.when(readable, size_limit("apng")),
        rule("apng.sticker", F.when(timing & ~fits, "warn").otherwise("error"), timing & fits, when=readable & (target == "sticker")),
        rule("apng.not-emote", "error", ~animated, when=readable & (target == "emote")),
        rule("apng.attachment", "info", ~animated, when=readable & target.startswith("attachment")),
    ])


def still_rules(facts: DataFrame) -> DataFrame:
    """Rules of stills from their headers: ``facts`` has clip, format, target, bytes, width, height, problem."""
    target, png = F.col("target"), F.col("format") == "png"
    unknown = F.least("width", "height") == 0
    fits = unknown | _side(STICKER_SIDE)
    good = F.col("problem") == ""
    return rows(facts, [
        rule("static.format", F.when(good, "info").otherwise("warn"), good),
        size_limit("static"),
        rule("static.emote-dims", "warn", unknown | _side(EMOTE_SIDE), when=target == "emote"),
        rule("static.sticker", F.when(png & ~fits, "warn").otherwise("error"), png & fits, when=target == "sticker"),
    ])


def transparency(blocks: DataFrame) -> DataFrame:
    """clip, format, target, certain, assumed, uncovered, transparent: what makes an animation see-through.

    Frames with clear pixels, flagged frames whose pixels can't be read, and a first frame that
    leaves part of the canvas out. Files without an image have no row.
    """
    numbered = blocks.withColumn("image", _before(F.col("kind") == "image"))
    images = numbered.groupBy(*KEY, "image").agg(
        F.max_by(F.struct("width", "height", "x", "y", "used"), F.when(F.col("kind") == "image", F.col("ord"))).alias("shape"),
        F.max_by("transparent", F.when(F.col("kind") == "gce", F.col("ord"))).alias("clear"), F.max_by(F.struct("width", "height"), F.when(F.col("kind") == "header", F.col("ord"))).alias("canvas"),
    )
    shown, read = F.col("shape").isNotNull() & F.col("clear").isNotNull(), F.col("shape.used").isNotNull()
    first = F.min_by("shape", F.when(F.col("shape").isNotNull(), F.col("image")))
    found = images.groupBy(*KEY).agg(F.count_if(shown & read & F.array_contains("shape.used", F.col("clear"))).alias("certain"), F.count_if(shown & ~read).alias("assumed"), first.alias("s"), F.max("canvas").alias("c")).where(F.col("s").isNotNull())
    uncovered = (F.col("s.x") != 0) | (F.col("s.y") != 0) | (F.col("s.width") != F.col("c.width")) | (F.col("s.height") != F.col("c.height"))
    return found.select(*FILE, "certain", "assumed", uncovered.alias("uncovered"), ((F.col("certain") + F.col("assumed") > 0) | uncovered).alias("transparent"))


def coverage(frames: DataFrame) -> DataFrame:
    """clip, frame_idx, uncovered: pixels of the canvas that no frame shows while this one is up.

    ``frames``: clip, frame_idx, x, y, w, h, disposal, width, height (of the canvas). Once shown, a
    frame's rectangle stays, is cleared (2) or becomes again what it was (3). The edges of a
    clip's rectangles, no more than its canvas has, cut it into cells; a frame is an event of each
    cell inside it, and what a cell is until its next event follows from the last one that didn't
    restore it. A change of a cell counts at its frame, and a running sum gives the area: no
    canvas is built. All steps are by clip, so rows move once, and not if they lie by clip already.
    """
    c = F.col
    clip = Window.partitionBy("clip")
    cut = frames.select(
        "clip", "frame_idx", "disposal", (c("width") * c("height")).cast("long").alias("whole"),
        F.greatest(F.lit(0), c("x")).alias("x0"), F.least("width", c("x") + c("w")).alias("x1"), F.greatest(F.lit(0), c("y")).alias("y0"), F.least("height", c("y") + c("h")).alias("y1"),
    )

    def edges(a: str, b: str) -> Column:
        own = lambda v: F.collect_set(F.when(c(a) < c(b), c(v))).over(clip)
        return F.array_sort(F.array_union(own(a), own(b)))

    def cells(edges: str, a: str, b: str, shown: Column) -> Column:
        """Starts and lengths of a clip's cells between ``a`` and ``b``."""
        within = F.when(shown, F.filter(edges, lambda v: v.between(c(a), c(b)))).otherwise(F.array())
        return F.transform(F.slice(within, 1, F.greatest(F.size(within) - 1, F.lit(0))), lambda v, i: F.struct(v.alias("at"), (F.get(within, i + 1) - v).alias("size")))

    shown = (c("x0") < c("x1")) & (c("y0") < c("y1"))
    cut = cut.withColumns({"xs": edges("x0", "x1"), "ys": edges("y0", "y1")})
    # A frame without cells stays as one row.
    inside = cut.withColumn("across", F.explode_outer(cells("xs", "x0", "x1", shown))).withColumn("down", F.explode_outer(cells("ys", "y0", "y1", shown)))
    inside = inside.select("clip", "frame_idx", "disposal", "whole", c("across.at").alias("x"), c("down.at").alias("y"), F.coalesce((c("across.size") * c("down.size")).cast("long"), F.lit(0)).alias("area"))
    cell = Window.partitionBy("clip", "x", "y").orderBy("frame_idx")
    stays = F.coalesce(F.last(F.when(c("disposal") != 3, c("disposal") != 2), ignorenulls=True).over(cell.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    events = inside.select("clip", "frame_idx", "whole", "area", stays.alias("stays"), F.lead("frame_idx").over(cell).alias("next"))
    ends = F.when(c("stays"), c("next")).otherwise(c("frame_idx") + 1)
    none = F.lit(None).cast("long")
    changes = events.select("clip", F.explode(F.array(
        F.struct(c("frame_idx").alias("frame_idx"), c("area").alias("change"), c("whole").alias("whole")), F.struct(ends.alias("frame_idx"), (-c("area")).alias("change"), none.alias("whole")),
    )).alias("e")).select("clip", "e.*").where(c("frame_idx").isNotNull())
    moved = changes.groupBy("clip", "frame_idx").agg(F.sum("change").alias("change"), F.max("whole").alias("whole"))
    covered = F.sum("change").over(clip.orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0))
    # Changes may lie between frames or behind the last one.
    return moved.select("clip", "frame_idx", "whole", (c("whole") - covered).alias("uncovered")).where(c("whole").isNotNull()).drop("whole")
