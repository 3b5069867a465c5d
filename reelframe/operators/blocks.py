"""Block tables: the blocks of GIFs and the chunks of WebPs and PNGs as rows.

A reader only reads: it walks a file's bytes and yields what stands there, also where
the file is broken. What the blocks mean for a file is left to DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import gif, png, webp

#: What names a file; its length comes along.
FILE = ["clip", "format", "target"]

GIF_BLOCK = "ord int, kind string, width int, height int, x int, y int, background int, colors int, delay int, disposal int, transparent int, interlaced boolean, loops int, used array<int>"
CHUNK = "ord int, kind string, frame int, chunk_size long, flags int, width int, height int, x int, y int, ms int, loops int, alpha boolean, problem string"
PART = "ord int, kind string, part_size long, crc boolean, width long, height long, depth int, colour int, methods int, interlace int, frames long, plays long, seq long, x long, y long, num int, den int, dispose int, blend int"


class GifBlocks:
    """Header, blocks and trailer of a GIF; ``used`` has the palette indices of the first image and of flagged ones, null where they can't be decoded."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data = bytes(content or b"")
        g = gif.Gif(data[:13])
        blocks = gif.walk(data, g)
        # What the header says is known from the first block on.
        ahead = next(blocks, None)
        yield (0, "header", g.width, g.height, None, None, g.background, len(g.palette) // 3, *[None] * 6)
        at, first, control = 0, True, None
        for at, b in enumerate(chain([ahead] if ahead else [], blocks), 1):
            if b.kind == "gce":
                control = b
                yield (at, "gce", *[None] * 6, b.delay, b.disposal, None if b.transparent < 0 else b.transparent, None, None, None)
            elif b.kind == "image":
                own = gif.used(b) if first or (control is not None and control.transparent >= 0) else None
                indices = None if own is None else np.flatnonzero(own).tolist()
                yield (at, "image", b.w, b.h, b.x, b.y, None, b.local, None, None, None, b.interlaced, None, indices)
                first, control = False, None
            else:
                # A looping block of another shape has no count.
                loops = b.loops if b.kind == "loop" and b.raw[14:16] == b"\x03\x01" and len(b.raw) == 19 else None
                yield (at, b.kind, *[None] * 10, loops, None)
        if g.trailer or g.problem:
            yield (at + 1, "problem" if g.problem else "trailer", *[None] * 12)


class WebpChunks:
    def eval(self, content: bytes) -> Iterator[tuple]:
        for at, c in enumerate(webp.walk(bytes(content or b""))):
            yield (at, *c)


class PngParts:
    def eval(self, content: bytes) -> Iterator[tuple]:
        for at, c in enumerate(png.walk(bytes(content or b""))):
            yield (at, *c)


#: Rows of a block table that go out at once: a file may have any number of blocks.
ROWS = 2048
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def _joined(files: DataFrame, reader: type, returns: str) -> DataFrame:
    named = files.select("clip", "format", F.coalesce("target", F.lit("")).alias("target") if "target" in files.columns else F.lit("").alias("target"), F.octet_length("content").cast("long").alias("bytes"), "content")
    names, types = zip(*(f.split(" ") for f in returns.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for rows in batched(reader().eval(batch.column("content")[i].as_py()), ROWS):
                    own = [batch.column(c).take(pa.array([i] * len(rows))) for c in (*FILE, "bytes")]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, _ARROW[t]) for v, t in zip(zip(*rows, strict=True), types, strict=True))], [*FILE, "bytes", *names])

    return named.mapInArrow(run, f"clip {files.schema['clip'].dataType.simpleString()}, format string, target string, bytes long, {returns}")


def gif_blocks(files: DataFrame) -> DataFrame:
    """clip, format, target, bytes and a row for each block of ``files`` (clip, format, content, target if any); a reader's rows go out as it walks."""
    return _joined(files, GifBlocks, GIF_BLOCK)


def webp_chunks(files: DataFrame) -> DataFrame:
    return _joined(files, WebpChunks, CHUNK)


def png_parts(files: DataFrame) -> DataFrame:
    return _joined(files, PngParts, PART)
