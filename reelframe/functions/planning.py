"""Planner outputs as columns: rates, sizes, frame counts, guards. Errors are values, never exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import div, floor_long, round_half_up, round_to

# Fixed values of the data model.
MAX_SIDE = 8192
MAX_AREA = 32 * 1024 * 1024
MAX_MASTER = 8 << 30
SPEED = (0.05, 100.0)
GIF_FPS, OTHER_FPS, DEFAULT_FPS, LEAST_FPS = 50.0, 60.0, 10.0, 0.001
TILE_SIDE = 16384


def snap_fps(source: Column, wanted: Column, fmt: Column) -> Column:
    """The rate asked for, else the source's, else the default; capped by format; three decimals."""
    rate = F.coalesce(wanted, source, F.lit(DEFAULT_FPS))
    cap = F.when(F.lower(F.trim(fmt)) == "gif", F.lit(GIF_FPS)).otherwise(F.lit(OTHER_FPS))
    return round_to(F.greatest(F.lit(LEAST_FPS), F.least(rate, cap)), 3)


def scaled_size(cw: Column, ch: Column, w: Column, h: Column, fit: Column) -> tuple[Column, Column]:
    """Size of a frame scaled for a box; a missing side (0) follows the other. Cover may exceed the box and is cropped later."""
    by_w = F.greatest(F.lit(1), div(ch * w * 2 + cw, cw * 2))
    by_h = F.greatest(F.lit(1), div(cw * h * 2 + ch, ch * 2))
    wide = w * ch <= h * cw
    bind_w = F.when(F.lower(F.trim(fit)) == "cover", w * ch >= h * cw).otherwise(wide)
    out_w = F.when(w <= 0, by_h).when(h <= 0, w).when(F.lower(F.trim(fit)) == "exact", w).when(bind_w, w).otherwise(by_h)
    out_h = F.when(h <= 0, by_w).when(w <= 0, h).when(F.lower(F.trim(fit)) == "exact", h).when(bind_w, by_w).otherwise(h)
    return out_w.cast("long"), out_h.cast("long")


def sequence_rate(delay_ms: Column) -> Column:
    """Frames a second of an image sequence, three decimals; delay defaults to 100 ms."""
    return round_to(F.lit(1000.0) / F.coalesce(F.nullif(delay_ms, F.lit(0)), F.lit(100)), 3)


def grid_round(micros: Column, rate1000: Column) -> Column:
    """Frames of a sequence at ``rate1000`` thousandths of a frame a second that ``micros`` spans, halves up."""
    return div(micros * 2 * rate1000 + 1000000000, F.lit(2000000000).cast("long"))


def sequence_frames(count: Column, speed: Column, fps1000: Column, rate1000: Column) -> Column:
    return div(floor_long(count / speed) * fps1000, rate1000)


def tile_grid(n: Column, w: Column) -> tuple[Column, Column]:
    """Near-square sheet of n tiles of width w within the largest side; no empty columns."""
    most = F.greatest(F.lit(1), div(F.lit(TILE_SIDE), w))
    cols = F.least(F.ceil(F.sqrt(n.cast("double"))).cast("long"), most)
    rows = div(n + cols - 1, cols)
    return div(n + rows - 1, rows), rows


def mjpeg_q(quality: Column) -> Column:
    q = F.greatest(F.lit(1), F.least(F.lit(100), quality))
    return F.lit(31) - round_half_up((q - 1) * F.lit(29.0) / F.lit(99.0))


def loop_counts(n: Column, fmt: Column) -> Column:
    """What the container stores for "repeat n times after the first play"; 0 is for ever; two bytes hold it."""
    plays = F.when(n <= 0, F.lit(0)).when(fmt.isin("webp", "apng"), n + 1).otherwise(n)
    return F.least(plays, F.lit(65535))


def variant_frames(n: Column, src: Column, out: Column) -> Column:
    """Frames after a lower rate; the rate changes only if at least one frame remains."""
    fewer = floor_long(n * out / src + F.lit(1e-6))
    return F.when((out < src) & (fewer >= 1), fewer).otherwise(n)


def reserve_bytes(w: Column, h: Column, frames: Column, factor: Column) -> Column:
    """Scratch that a render takes: the raw frames, an eighth or 8 MiB on top, times a factor by format."""
    need = w * h * 4 * frames
    return (need + F.greatest(div(need, F.lit(8)), F.lit(8 << 20))) * factor


def plan_error(w: Column, h: Column, speed: Column, frames: Column) -> Column:
    return (
        F.when((w > MAX_SIDE) | (h > MAX_SIDE), F.lit("side"))
        .when(w * h > MAX_AREA, F.lit("area"))
        .when((speed < SPEED[0]) | (speed > SPEED[1]), F.lit("speed"))
        .when(w * h * 4 * frames > F.lit(MAX_MASTER), F.lit("master"))
    )


def timecode(seconds: Column) -> Column:
    """MM:SS.cc in whole hundredths."""
    cs = round_half_up(seconds * F.lit(100.0))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes = div(cs, F.lit(6000))
    return F.concat(F.when(minutes < 100, two(minutes)).otherwise(minutes.cast("string")), F.lit(":"), two(div(cs % 6000, F.lit(100))), F.lit("."), two(cs % 100))


def normalize_hex(colour: Column) -> Column:
    """rrggbb or rrggbbaa in lower case without "#"; null for anything else."""
    c = F.lower(F.regexp_replace(F.trim(colour), "^#", ""))
    return F.when(c.rlike("^([0-9a-f]{6}|[0-9a-f]{8})$"), c)
