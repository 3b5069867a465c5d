"""WebP containers: walker over chunks and bitstream headers, writer around given bitstreams. Pixels need a plug-in; rules are in operators/rules.py."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

# Fixed values of the container format.
ICC, ALPHA, EXIF, XMP, ANIM = 0x20, 0x10, 0x08, 0x04, 0x02
BITSTREAMS = ("VP8", "VP8L")


class Chunk(NamedTuple):
    """One chunk; ``frame`` is the animation frame that holds it, or that it is. RIFF stands for the container itself."""

    kind: str
    frame: int | None = None
    size: int = 0
    flags: int | None = None
    width: int | None = None
    height: int | None = None
    x: int | None = None
    y: int | None = None
    ms: int | None = None
    loops: int | None = None
    alpha: bool | None = None
    problem: str | None = None


def _u24(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 3], "little")


def _pieces(data: bytes) -> Iterator[tuple[str, bytes | None]]:
    """(name, payload) of consecutive chunks; a broken one has no payload and is the last."""
    at = 0
    while at < len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8
        if at + size > len(data):
            yield "cut", None
            return
        yield name.decode("latin-1").strip(), data[at : at + size]
        at += size + size % 2


def bitstream(kind: str, data: bytes, frame: int | None) -> Chunk:
    """What the header of an encoded image says."""
    if kind == "VP8L":
        if data[:1] != b"\x2f" or len(data) < 5:
            return Chunk(kind, frame, len(data), problem="no lossless header")
        v = int.from_bytes(data[1:5], "little")
        return Chunk(kind, frame, len(data), width=v % 16384 + 1, height=v // 16384 % 16384 + 1, alpha=v >> 28 & 1 == 1, problem="unknown version" if v >> 29 else None)
    if len(data) < 10 or data[3:6] != b"\x9d\x01\x2a" or data[0] % 2:
        return Chunk(kind, frame, len(data), problem="no key frame header")
    w, h = (v % 16384 for v in struct.unpack("<HH", data[6:10]))
    return Chunk(kind, frame, len(data), width=w, height=h, alpha=False, problem=None if w and h else "empty frame")


def _read(kind: str, data: bytes, frame: int | None) -> Chunk:
    if kind in BITSTREAMS:
        return bitstream(kind, data, frame)
    size = len(data)
    if kind == "VP8X" and size >= 10:
        return Chunk(kind, frame, size, flags=data[0], width=_u24(data, 4) + 1, height=_u24(data, 7) + 1)
    if kind == "ANIM" and size >= 6:
        return Chunk(kind, frame, size, loops=int.from_bytes(data[4:6], "little"))
    if kind == "ANMF" and size >= 16:
        return Chunk(kind, frame, size, x=2 * _u24(data, 0), y=2 * _u24(data, 3), width=_u24(data, 6) + 1, height=_u24(data, 9) + 1, ms=_u24(data, 12))
    return Chunk(kind, frame, size, problem="short" if kind in ("VP8X", "ANIM", "ANMF") else None)


def walk(data: bytes) -> Iterator[Chunk]:
    """The container and all its chunks in order, a frame's own chunks right behind it; a file that is no container is one row."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        yield Chunk("none", problem="not a WebP container")
        return
    declared, frames = int.from_bytes(data[4:8], "little"), 0
    yield Chunk("RIFF", size=declared)
    for kind, body in _pieces(data[12 : 8 + max(declared, 4)]):
        if body is None:
            yield Chunk("cut")
        elif kind == "ANMF":
            yield _read(kind, body, frames)
            for inner, own in _pieces(body[16:]):
                yield Chunk("cut", frames) if own is None else _read(inner, own, frames)
            frames += 1
        else:
            yield _read(kind, body, None)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)


def lossless_header(width: int, height: int, alpha: bool) -> bytes:
    """The first five bytes of a lossless bitstream."""
    return b"\x2f" + (width - 1 | height - 1 << 14 | int(alpha) << 28).to_bytes(4, "little")


def mux(streams: list[tuple[bytes, bytes]], rects: list[tuple[int, int, int, int]], ms: list[int], canvas: tuple[int, int], loops: int = 0, alpha: bool = False, metadata: list[tuple[bytes, bytes]] = (), animated: bool | None = None) -> bytes:
    """A container around encoded bitstreams (name, bytes): an animation of frames at rects (x, y, w, h), or one still.

    ``animated`` sets the animation flag otherwise than by the number of frames; x and y are even.
    """
    moving = len(streams) > 1
    bits = {b"ICCP": ICC, b"EXIF": EXIF, b"XMP ": XMP}
    flags = sum({bits[n] for n, _ in metadata}) | (ALPHA if alpha else 0) | (ANIM if (moving if animated is None else animated) else 0)
    u24 = lambda v: v.to_bytes(3, "little")
    body = chunk(b"VP8X", bytes([flags, 0, 0, 0]) + u24(canvas[0] - 1) + u24(canvas[1] - 1))
    if moving:
        body += chunk(b"ANIM", bytes(4) + loops.to_bytes(2, "little"))
        for (name, data), (x, y, w, h), t in zip(streams, rects, ms, strict=True):
            body += chunk(b"ANMF", u24(x // 2) + u24(y // 2) + u24(w - 1) + u24(h - 1) + u24(t) + b"\0" + chunk(name, data))
    else:
        body += chunk(*streams[0])
    body += b"".join(chunk(n, b) for n, b in metadata)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WEBP" + body
