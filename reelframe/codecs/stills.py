"""Sizes and alpha of still images from their headers (PNG, WebP, JPEG, AVIF); rules are in operators/rules.py."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from . import png, webp

# JPEG markers that stand alone, that end the header, and of the C0-CF range those that start no frame.
ALONE, ENDS, NO_FRAME = {0x01, 0xD8, *range(0xD0, 0xD8)}, {0xD9, 0xDA}, {0xC4, 0xC8, 0xCC}
# Names of the auxiliary image that is an alpha plane.
ALPHA_NAMES = (b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", b"urn:mpeg:hevc:2015:auxid:1")


@dataclass
class Still:
    width: int = 0
    height: int = 0
    alpha: bool = False
    animated: bool = False
    problem: str = ""


def _png(data: bytes) -> Still:
    parts = png.chunks(data)
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) < 13:
        return Still(problem="no IHDR chunk")
    w, h, _, colour = struct.unpack(">IIBB", parts[0][1][:10])
    names = {k for k, _, _ in parts}
    broken = not all(ok for *_, ok in parts) or not {b"IDAT", b"IEND"} <= names or not (w and h)
    return Still(w, h, colour in (4, 6) or b"tRNS" in names, b"acTL" in names, "broken chunks" if broken else "")


def _webp(data: bytes) -> Still:
    parts = list(webp.walk(data))
    images = [c for c in parts if c.kind in webp.BITSTREAMS]
    sized = [c for c in parts if c.kind == "VP8X" and c.width] + images
    broken = next((c.problem or "broken chunk" for c in parts if c.kind in ("cut", "none") or (c.problem and c.kind != "ANMF")), "")
    # A declared size beyond the file's end cuts its last chunk or leaves none.
    if not images or parts[0].size + 8 > len(data):
        broken = broken or "no whole image"
    return Still(sized[0].width or 0 if sized else 0, sized[0].height or 0 if sized else 0, any(c.alpha or c.kind == "ALPH" for c in parts), sum(c.kind == "ANMF" for c in parts) > 1, broken)


def _jpeg(data: bytes) -> Still:
    if data[:2] != b"\xff\xd8":
        return Still(problem="no start marker")
    at = 2
    while at < len(data):
        if data[at] != 0xFF:
            return Still(problem="no marker where one belongs")
        while data[at : at + 1] == b"\xff":
            at += 1
        kind = data[at : at + 1]
        at += 1
        if kind and kind[0] in ALONE:
            continue
        if not kind or kind[0] in ENDS:
            break
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            return Still(problem="broken segment")
        if kind[0] >> 4 == 0xC and kind[0] not in NO_FRAME:
            if size < 8:
                return Still(problem="short frame header")
            h, w = struct.unpack(">HH", data[at + 3 : at + 7])
            return Still(w, h, problem="" if w and h else "no size")
        at += size
    return Still(problem="no frame header")


def boxes(data: bytes) -> dict[bytes, list[bytes]]:
    """Payloads of consecutive boxes by type; the first broken box ends them."""
    out: dict[bytes, list[bytes]] = {}
    at = 0
    while at + 8 <= len(data):
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            break
        out.setdefault(data[at + 4 : at + 8], []).append(data[at + head : at + size])
        at += size
    return out


def _avif(data: bytes) -> Still:
    top = boxes(data)
    kind = top.get(b"ftyp", [b""])[0]
    brands = {kind[:4]} | {kind[i : i + 4] for i in range(8, len(kind) - 3, 4)}
    if not brands & {b"avif", b"avis"}:
        return Still(problem="no AVIF brand")
    inner = boxes(top.get(b"meta", [b""])[0][4:])
    for name in (b"iprp", b"ipco"):
        if name not in inner:
            return Still(problem=f"no {name.decode()} box")
        inner = boxes(inner[name][0])
    sizes = [struct.unpack(">II", b[4:12]) for b in inner.get(b"ispe", []) if len(b) >= 12]
    w, h = next(((w, h) for w, h in sizes if w or h), (0, 0))
    alpha = any(b[4:].split(b"\0")[0] in ALPHA_NAMES for b in inner.get(b"auxC", []))
    return Still(w, h, alpha, b"avis" in brands, "" if w and h else "no size")


READERS = {"png": _png, "webp": _webp, "jpeg": _jpeg, "avif": _avif}


def read(fmt: str, data: bytes) -> Still:
    """The header's facts; what can't be read is told in ``problem``, never raised."""
    try:
        return READERS[fmt](data)
    except (ValueError, IndexError, struct.error, KeyError) as e:
        return Still(problem=f"not read as {fmt}: {e}")
