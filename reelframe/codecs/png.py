"""PNG and APNG: chunk walker, RGBA and indexed writers, decoder; rules are in operators/rules.py."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

SIGN = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


class Part(NamedTuple):
    """One chunk with the fields that its kind has; ``none`` stands for a file that is no PNG, ``empty`` for one without chunks, ``cut`` for a broken end, ``stray`` for bytes too few for a chunk."""

    kind: str
    size: int = 0
    crc: bool = True
    width: int | None = None
    height: int | None = None
    depth: int | None = None
    colour: int | None = None
    methods: int | None = None
    interlace: int | None = None
    frames: int | None = None
    plays: int | None = None
    seq: int | None = None
    x: int | None = None
    y: int | None = None
    num: int | None = None
    den: int | None = None
    dispose: int | None = None
    blend: int | None = None


def _part(kind: str, body: bytes, crc: bool) -> Part:
    size = len(body)
    if kind == "IHDR" and size == 13:
        w, h, depth, colour, packed, filtered_by, interlace = struct.unpack(">IIBBBBB", body)
        return Part(kind, size, crc, width=w, height=h, depth=depth, colour=colour, methods=packed << 8 | filtered_by, interlace=interlace)
    if kind == "acTL" and size == 8:
        frames, plays = struct.unpack(">II", body)
        return Part(kind, size, crc, frames=frames, plays=plays)
    if kind == "fcTL" and size == 26:
        seq, w, h, x, y, num, den, dispose, blend = struct.unpack(">IIIIIHHBB", body)
        return Part(kind, size, crc, width=w, height=h, seq=seq, x=x, y=y, num=num, den=den, dispose=dispose, blend=blend)
    if kind == "fdAT" and size >= 4:
        return Part(kind, size, crc, seq=int.from_bytes(body[:4], "big"))
    return Part(kind, size, crc)


def walk(data: bytes) -> Iterator[Part]:
    """All chunks in order up to the end chunk."""
    if data[:8] != SIGN:
        yield Part("none")
        return
    at = 8
    if len(data) == at:
        yield Part("empty")
    while at < len(data):
        if at + 8 > len(data):
            yield Part("stray", len(data) - at)
            return
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            yield Part("cut", size)
            return
        named = data[at + 4 : at + 8 + size]
        kind = named[:4].decode("latin-1")
        at += 12 + size
        yield _part(kind, named[4:], zlib.crc32(named) == int.from_bytes(data[at - 4 : at], "big"))
        if kind == "IEND":
            return


def bodies(data: bytes) -> Iterator[tuple[bytes, bytes, bool]]:
    """(kind, body, checksum right) one by one as far as the file goes."""
    if data[:8] != SIGN:
        raise ValueError("not a png")
    at = 8
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + n > len(data):
            break
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        yield kind, body, zlib.crc32(kind + body) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        at += 12 + n


def chunks(data: bytes) -> list[tuple[bytes, bytes, bool]]:
    """All of ``bodies``."""
    return list(bodies(data))


def filtered(px: np.ndarray) -> bytes:
    """Rows with the filter (none, sub, up) whose residues are smallest."""
    h, w, depth = px.shape
    rows = px.reshape(h, w * depth).astype(np.int16)
    left = np.zeros_like(rows)
    left[:, depth:] = rows[:, :-depth]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    kinds = [(rows % 256).astype(np.uint8), ((rows - left) % 256).astype(np.uint8), ((rows - up) % 256).astype(np.uint8)]
    cost = np.stack([np.abs(k.astype(np.int8).astype(np.int16)).sum(1) for k in kinds])
    pick = cost.argmin(0) if depth > 1 else np.zeros(h, np.int64)
    return b"".join(bytes([p]) + kinds[p][i].tobytes() for i, p in enumerate(pick.tolist()))


def unfiltered(raw: bytes, w: int, h: int, depth: int) -> np.ndarray:
    size = w * depth
    out = np.zeros((h, size), np.uint8)
    before = np.zeros(size, np.int64)
    for y in range(h):
        kind, row = raw[y * (size + 1)], np.frombuffer(raw, np.uint8, size, y * (size + 1) + 1).astype(np.int64)
        if kind == 2:
            row = (row + before) % 256
        elif kind:
            row = row.copy()
            for x in range(size):
                a = row[x - depth] if x >= depth else 0
                b, c = before[x], before[x - depth] if x >= depth else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    e = a + b - c
                    da, db, dc = abs(e - a), abs(e - b), abs(e - c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                row[x] = (row[x] + p) % 256
        out[y] = before = row
    return out.reshape(h, w, depth)


def write(frames: list[np.ndarray], delays: list[tuple[int, int]] | None = None, plays: int = 0, palette: np.ndarray | None = None, level: int = 9) -> bytes:
    """One frame: a PNG; more: an APNG. Frames are height x width x 4, or x 1 with an RGBA palette."""
    h, w, depth = frames[0].shape
    out = [SIGN, chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 3 if palette is not None else 6, 0, 0, 0))]
    if palette is not None:
        out += [chunk(b"PLTE", palette[:, :3].astype(np.uint8).tobytes()), chunk(b"tRNS", palette[:, 3].astype(np.uint8).tobytes())]
    if len(frames) > 1:
        out.append(chunk(b"acTL", struct.pack(">II", len(frames), plays)))
    seq = 0
    for i, f in enumerate(frames):
        body = zlib.compress(filtered(f), level)
        if len(frames) > 1:
            num, den = (delays or [(1, 10)] * len(frames))[i]
            out.append(chunk(b"fcTL", struct.pack(">IIIIIHHBB", seq, w, h, 0, 0, num, den, 0, 0)))
            seq += 1
        if i == 0:
            out.append(chunk(b"IDAT", body))
        else:
            out.append(chunk(b"fdAT", struct.pack(">I", seq) + body))
            seq += 1
    return b"".join(out) + chunk(b"IEND", b"")


def shown(data: bytes) -> Iterator[np.ndarray]:
    """Full-size frames as RGBA, one at a time; colour types 3 and 6 at eight bits."""
    palette = np.zeros((256, 4), np.uint8)
    palette[:, 3] = 255
    head = b""
    for k, (kind, body, _) in enumerate(bodies(data)):
        if k == 0:
            head = body
        if kind == b"PLTE":
            palette[: len(body) // 3, :3] = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            palette[: len(body), 3] = np.frombuffer(body, np.uint8)
    if len(head) < 10:
        raise ValueError("no header")
    w, h, bits, colour = struct.unpack(">IIBB", head[:10])
    if bits != 8 or colour not in (3, 6):
        raise ValueError(f"colour type {colour} at {bits} bits isn't read")

    def frame(body: bytes) -> np.ndarray:
        px = unfiltered(zlib.decompress(body), w, h, 1 if colour == 3 else 4)
        return palette[px[:, :, 0]] if colour == 3 else px

    now: bytearray | None = None
    for kind, body, _ in bodies(data):
        if kind == b"fcTL":
            if now is not None:
                yield frame(bytes(now))
            now = bytearray()
        elif kind == b"IDAT":
            now = (bytearray() if now is None else now) + body
        elif kind == b"fdAT":
            if now is None:
                raise ValueError("data before its frame")
            now += body[4:]
    if now is not None:
        yield frame(bytes(now))


def read(data: bytes) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """All frames of ``shown``, and their delays."""
    return list(shown(data)), [struct.unpack(">HH", body[20:24]) for kind, body, _ in bodies(data) if kind == b"fcTL"]
