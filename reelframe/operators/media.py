"""Encoding, parsing, linting and mending files: binary columns through Arrow-batched Python."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codecs import BUILT_IN, gif, plugin, png, stills
from . import blocks, raster, rules

FILES = "clip long, format string, content binary"


def clips_of(px: DataFrame, w: int, h: int) -> DataFrame:
    """Frames as packed RGBA rows (clip, frame_idx, rgba), built JVM-side: pixels never go to Python one by one."""
    place = F.col("y") * w + F.col("x")
    hexed = F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "rgba"])
    rows = px.groupBy("clip", "frame_idx").agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), hexed.alias("v")))).alias("px"))
    return rows.select("clip", "frame_idx", F.unhex(F.concat_ws("", F.transform("px", lambda s: s["v"]))).alias("rgba"))


def _encode(fmt: str, frames: np.ndarray, colors: int) -> bytes:
    if fmt == "gif":
        opaque = np.array(frames)
        opaque[..., 3] = np.where(opaque[..., 3] >= 128, 255, 0)
        flat = opaque.reshape(-1, 4)
        seen = flat[flat[:, 3] > 0][:, :3]
        clear = len(seen) < len(flat)
        cols, counts = np.unique(seen, axis=0, return_counts=True) if len(seen) else (np.zeros((1, 3), np.uint8), np.ones(1, np.int64))
        palette = raster.median_cut(cols, counts, colors - clear)
        mark = len(palette) if clear else -1
        table = np.vstack((palette, np.zeros((1, 3), np.uint8))) if clear else palette
        idx = [np.where(f[..., 3] > 0, raster.nearest(f[..., :3], palette), mark if clear else 0).astype(np.uint8) for f in opaque]
        return gif.write(idx, table, [10] * len(idx), mark)
    if fmt in ("apng", "png"):
        return png.write(frames, [(1, 10)] * len(frames))
    return plugin(fmt)(list(frames))


def encode_clips(px: DataFrame, w: int, h: int, fmt: str, colors: int = 64) -> DataFrame:
    """One file a clip (clip, format, content). A clip's frames are one file, so they meet in one task; plans bound their bytes."""
    if fmt not in BUILT_IN:
        plugin(fmt)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        frames = np.frombuffer(b"".join(pdf["rgba"]), np.uint8).reshape(-1, h, w, 4)
        return pd.DataFrame({"clip": [key[0]], "format": [fmt], "content": [_encode(fmt, frames, colors)]})

    return clips_of(px, w, h).groupBy("clip").applyInPandas(one, FILES)


def _each(fn: Callable[[int, str, bytes], list[tuple]], names: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [r for c, k, b in zip(f["clip"], f["format"], f["content"], strict=True) for r in fn(c, k, bytes(b))]
            yield pd.DataFrame(rows, columns=names)

    return run


def made_files(rows: DataFrame, make: Callable[..., bytes]) -> DataFrame:
    """Files (clip, format, content, target) that ``make`` builds from the format and the columns after clip, format and target."""
    names = rows.columns[3:]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [make(k, *v) for k, *v in zip(f["format"], *(f[n].tolist() for n in names), strict=True)]
            yield pd.DataFrame({"clip": f["clip"], "format": f["format"], "content": made, "target": f["target"]})

    return rows.mapInPandas(run, FILES + ", target string")


#: Block table and rules of each animation format.
RULES = {"gif": (blocks.gif_blocks, rules.gif_rules), "webp": (blocks.webp_chunks, rules.webp_rules), "apng": (blocks.png_parts, rules.png_rules), "png": (blocks.png_parts, rules.png_rules)}


def _aimed(files: DataFrame, target: str) -> DataFrame:
    return files if "target" in files.columns else files.withColumn("target", F.lit(target))


def lint_files(files: DataFrame, target: str = "", formats: tuple[str, ...] = ("gif", "apng", "webp")) -> DataFrame:
    """Findings (clip, format, target, rule, level, ok, fixed) on animations, for their own ``target`` where the table has such a column.

    ``clip``, ``format`` and ``target`` name a file. Files of other formats have no findings.
    """
    aimed = _aimed(files, target)
    found = [apply(table(aimed.where(F.col("format") == fmt))) for fmt, (table, apply) in RULES.items() if fmt in formats]
    return reduce(DataFrame.unionByName, found)


def lint_stills(files: DataFrame, target: str = "") -> DataFrame:
    """Findings on still images, from their headers alone."""
    return rules.still_rules(still_facts(_aimed(files, target)))


def still_facts(files: DataFrame) -> DataFrame:
    """Size and alpha of still images (clip, format, target, bytes, width, height, alpha, animated, problem); what can't be read has a ``problem``."""
    @F.udf("struct<width: bigint, height: bigint, alpha: boolean, animated: boolean, problem: string>", useArrow=True)
    def header(fmt: str, data: bytes):
        got = stills.read(fmt, bytes(data or b""))
        return got.width, got.height, got.alpha, got.animated, got.problem

    read = _aimed(files, "").withColumn("h", header("format", "content"))
    return read.select("clip", "format", "target", F.octet_length("content").cast("long").alias("bytes"), F.col("h.width").cast("int").alias("width"), F.col("h.height").cast("int").alias("height"), "h.alpha", "h.animated", "h.problem")


def _shown(fmt: str, data: bytes) -> Iterator[np.ndarray]:
    if fmt == "gif":
        return (f for f, _ in gif.shown(data))
    return png.shown(data) if fmt in ("apng", "png") else iter(plugin(fmt)(data)[0])


#: Bytes of decoded frames that are held at once, and what a frame takes beside its pixels.
HELD, BESIDE = 8 << 20, 256


def _in_parts(frames: Iterator[np.ndarray]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """(number, width, height, pixels) of frames, a bounded number at a time."""
    out, size = [], 0
    for i, p in enumerate(frames):
        out.append((i, p.shape[1], p.shape[0], p.tobytes()))
        size += p.nbytes + BESIDE
        if size >= HELD:
            yield out
            out, size = [], 0
    yield out


def decode_files(files: DataFrame) -> DataFrame:
    """Frames as packed RGBA rows (clip, format, frame_idx, width, height, rgba, error); a file that can't be decoded is one row with its error."""
    names = ["clip", "format", "frame_idx", "width", "height", "rgba", "error"]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"frame_idx": "Int64", "width": "Int32", "height": "Int32"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c, k, b in zip(f["clip"], f["format"], f["content"], strict=True):
                parts, more = [], False
                try:
                    # A file of several parts is gone through first: if it can't be decoded, none of its frames counts.
                    for part in _in_parts(_shown(k, bytes(b))):
                        parts, more = [part], more or bool(parts)
                    if more:
                        parts = _in_parts(_shown(k, bytes(b)))
                except Exception as e:  # noqa: BLE001 - one bad file is a row, whatever its codec raises
                    yield framed([(c, k, None, None, None, None, str(e) or type(e).__name__)])
                    continue
                for part in parts:
                    yield framed([(c, k, *r, None) for r in part])

    return files.mapInPandas(run, "clip long, format string, frame_idx long, width int, height int, rgba binary, error string")


def verify_files(files: DataFrame) -> DataFrame:
    """(clip, format, frames, ok): whether each file decodes to as many frames as its blocks announce."""
    decoded = decode_files(files).groupBy("clip", "format").agg(F.count("rgba").cast("int").alias("frames"), F.max("error").alias("error"))
    said = facts(files, tuple(RULES)).select("clip", "format", F.col("frames").alias("said"))
    # A format without a block table announces nothing.
    ok = F.col("error").isNull() & (F.col("frames") > 0) & (F.col("frames") == F.coalesce("said", "frames"))
    return decoded.join(said, ["clip", "format"], "left").select("clip", "format", "frames", ok.alias("ok"))


def facts(files: DataFrame, formats: tuple[str, ...] = ("gif", "apng", "webp")) -> DataFrame:
    """clip, format, width, height, frames, delay_cs, colors from the blocks, without decoding."""
    out = []
    for fmt in formats:
        table = RULES[fmt][0]
        own = _aimed(files, "").where(F.col("format") == fmt)
        if fmt == "gif":
            f = rules.gif_files(table(own)).select("clip", "format", "width", "height", "frames", "delay_cs", "colors")
        elif fmt == "webp":
            f = rules.webp_files(table(own)).select("clip", "format", "width", "height", F.col("images").alias("frames"), F.floor(F.col("ms") / 10).alias("delay_cs"), F.lit(0).alias("colors"))
        else:
            cs = F.aggregate("every", F.lit(0).cast("long"), lambda s, x: s + F.floor(x["num"] * 100 / F.when(x["den"] == 0, 100).otherwise(x["den"])).cast("long"))
            f = rules.png_files(table(own)).select("clip", "format", "width", "height", F.greatest("frames", F.lit(1)).alias("frames"), cs.alias("delay_cs"), F.coalesce(F.floor(F.col("palette.part_size") / 3), F.lit(0)).alias("colors"))
        out.append(f.select("clip", "format", *[F.col(c).cast("int").alias(c) for c in ("width", "height", "frames", "delay_cs", "colors")]))
    return reduce(DataFrame.unionByName, out)


def _damaged(clip: int, fmt: str, data: bytes) -> list[tuple]:
    g = gif.parse(data)
    kind, images = clip % 8, g.images
    first = images[0][0] if images else None
    if kind == 0:
        g.trailer = False
    elif kind == 1:
        g.blocks = [b for b in g.blocks if b.kind != "loop"]
    elif kind == 2:
        g.blocks.insert(1, gif.Block("comment", b"\x21\xfe\x02hi\0"))
    elif kind in (3, 4):
        for i, b in enumerate(g.blocks):
            if b.kind == "gce":
                args = (b.delay, 0, b.transparent) if kind == 3 else (0, b.disposal, b.transparent)
                g.blocks[i] = gif.Block("gce", gif.gce(*args), *args)
    elif kind == 5:
        g.head = b"GIF87a" + g.head[6:]
    elif kind == 6:
        own = iter(images)
        for i, b in enumerate(g.blocks):
            if b.kind == "gce":
                image, _ = next(own)
                args = (b.delay, b.disposal, -1 if image is first else int(gif.indices(image)[0, 0]))
                g.blocks[i] = gif.Block("gce", gif.gce(*args), *args)
    return [(clip, fmt, g.bytes()[:-9] if kind == 7 else g.bytes())]


def damage(files: DataFrame) -> DataFrame:
    """Break GIFs by clip: no trailer, no loop block, a comment, disposal 0, delay 0, an 87a header, a first image without the flag that a later one needs, a cut."""
    return files.mapInPandas(_each(_damaged, ["clip", "format", "content"]), FILES)


def fix_files(files: DataFrame) -> DataFrame:
    """Mended GIFs: whether anything changed, whether a second pass would change more, and whether fixable rules hold now."""
    @F.udf("struct<content: binary, changed: boolean, again: boolean>", useArrow=True)
    def mended(data: bytes):
        data = bytes(data or b"")
        out = gif.fix(data)
        return out, out != data, gif.fix(out) != out

    done = files.where(F.col("format") == "gif").withColumn("m", mended("content")).select("clip", "format", "m.*")
    found = lint_files(done, formats=("gif",))
    ok = F.bool_and(F.col("ok") | ~F.col("fixed") | (F.col("level") == "info")) & F.bool_and(F.col("ok") | (F.col("rule") != "gif.container"))
    return done.join(found.groupBy("clip").agg(ok.alias("ok")), "clip")


def diffuse(px: DataFrame, w: int, h: int, levels: int) -> DataFrame:
    """Floyd-Steinberg on each colour channel; frames are independent rows."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for b in f["rgba"]:
                p = np.frombuffer(bytes(b), np.uint8).reshape(h, w, 4).copy()
                for k in range(3):
                    p[..., k] = raster.diffuse(p[..., k], levels)
                out.append(p.tobytes())
            yield f[["clip", "frame_idx"]].assign(rgba=out)

    return clips_of(px, w, h).mapInPandas(run, "clip long, frame_idx long, rgba binary")


def resize_frames(frames: DataFrame, w: int, h: int, to_w: int, to_h: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield f[["clip", "frame_idx"]].assign(rgba=[raster.resize(np.frombuffer(bytes(b), np.uint8).reshape(h, w, 4), to_w, to_h).tobytes() for b in f["rgba"]])

    return frames.mapInPandas(run, "clip long, frame_idx long, rgba binary")


#: Frames that one export may hold.
MOST_FRAMES = 2000


def too_many(frames: Column, most: int = MOST_FRAMES) -> Column:
    """The refusal of an export with more frames than allowed, else null."""
    return F.when(frames > most, F.concat(F.lit("too many frames ("), frames.cast("string"), F.lit(f", the limit is {most}); trim or lower fps")))


def zip_frames(px: DataFrame, w: int, h: int, most: int = MOST_FRAMES) -> DataFrame:
    """A clip's frames as numbered PNGs in an uncompressed archive; entry times are fixed, so bytes are stable.

    A clip of more than ``most`` frames is refused with an error and no archive; none is cut.
    """
    counted = clips_of(px, w, h).withColumn("error", too_many(F.count("*").over(Window.partitionBy("clip")), most))
    refused = counted.where("error IS NOT NULL").groupBy("clip", "error").agg(F.lit(0).alias("entries"), F.lit(None).cast("binary").alias("content"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        pdf = pdf.sort_values("frame_idx")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for i, b in enumerate(pdf["rgba"], 1):
                z.writestr(zipfile.ZipInfo(f"f{i:05d}.png", (1980, 1, 1, 0, 0, 0)), png.write([np.frombuffer(b, np.uint8).reshape(h, w, 4)], level=6))
        return pd.DataFrame({"clip": [key[0]], "entries": [len(pdf)], "content": [out.getvalue()], "error": [None]})

    done = counted.where("error IS NULL").drop("error").groupBy("clip").applyInPandas(one, "clip long, entries int, content binary, error string")
    return done.unionByName(refused.select(done.columns))
