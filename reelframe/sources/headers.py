"""Smallest files that a header reader can read, made from known facts: fixtures whose findings SQL can state."""

from __future__ import annotations

import struct

from ..codecs import png, webp
from ..codecs.stills import ALPHA_NAMES


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def still(fmt: str, w: int, h: int, alpha: bool) -> bytes:
    """A still's header; JPEG has no alpha."""
    if fmt == "png":
        head = png.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if alpha else 2, 0, 0, 0))
        return png.SIGN + head + png.chunk(b"IDAT", b"") + png.chunk(b"IEND", b"")
    if fmt == "webp":
        return webp.mux([(b"VP8L", webp.lossless_header(w, h, alpha))], [], [], (w, h), alpha=alpha)
    if fmt == "jpeg":
        comment = b"\xff\xfe" + struct.pack(">H", 6) + b"text"
        frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + bytes(3)
        return b"\xff\xd8" + comment + frame + b"\xff\xd9"
    size = _box(b"ispe", struct.pack(">III", 0, w, h))
    plane = _box(b"auxC", bytes(4) + ALPHA_NAMES[0] + b"\0") if alpha else b""
    return _box(b"ftyp", b"avif" + bytes(4) + b"mif1") + _box(b"meta", bytes(4) + _box(b"iprp", _box(b"ipco", size + plane)))


def animation(n: int, side: int, ms: int, loops: int, flag: bool, alpha_flag: bool, alpha: bool, metadata: bool, outside: bool) -> bytes:
    """A WebP of ``n`` frames of a square canvas; ``outside`` moves the last frame of several over the edge."""
    rects = [(0, 0, side, side)] * n
    if outside:
        rects[-1] = (2, 0, side, side)
    streams = [(b"VP8L", webp.lossless_header(side, side, alpha))] * n
    return webp.mux(streams, rects, [ms] * n, (side, side), loops, alpha_flag, [(b"EXIF", b"made")] if metadata else [], flag)
