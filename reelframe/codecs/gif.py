"""GIF: block parser, writer with LZW, decoder, repairs. Bytes of untouched blocks are kept as they are; rules are in operators/rules.py."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np


@dataclass(slots=True)
class Block:
    kind: str  # gce, image, loop, comment, app, text
    raw: bytes
    delay: int = 0
    disposal: int = 0
    transparent: int = -1
    x: int = 0
    y: int = 0
    w: int = 0
    h: int = 0
    local: int = 0
    interlaced: bool = False
    loops: int = -1


@dataclass
class Gif:
    head: bytes
    width: int = 0
    height: int = 0
    background: int = 0
    palette: bytes = b""
    blocks: list[Block] = field(default_factory=list)
    trailer: bool = False
    problem: str = ""

    @property
    def images(self) -> list[tuple[Block, list[Block]]]:
        """Images with the control blocks before them."""
        out, held = [], []
        for b in self.blocks:
            if b.kind == "gce":
                held.append(b)
            elif b.kind == "image":
                out.append((b, held))
                held = []
        return out

    def bytes(self) -> bytes:
        return self.head + self.palette + b"".join(b.raw for b in self.blocks) + (b"\x3b" if self.trailer else b"")


def _sub_blocks(data: bytes, at: int) -> int:
    while data[at]:
        at += data[at] + 1
    return at + 1


def walk(data: bytes, g: Gif) -> Iterator[Block]:
    """The file's blocks one by one; what else stands there goes into ``g``, its trailer or problem when the walk is over.

    A file that ends after a whole block only lacks its trailer; one cut inside a block has the ``problem`` "cut".
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        g.problem = "not a gif"
        return
    g.width, g.height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    g.background = data[11]
    at = 13
    if data[10] & 0x80:
        n = 3 << ((data[10] & 7) + 1)
        g.palette = data[at : at + n]
        if len(g.palette) < n:
            g.problem = "cut"
            return
        at += n
    while at < len(data):
        start, mark = at, data[at]
        if mark == 0x3B:
            g.trailer = True
            return
        if mark not in (0x21, 0x2C):
            g.problem = f"unknown block {mark:#x}"
            return
        try:
            if mark == 0x21:
                label = data[at + 1]
                at = _sub_blocks(data, at + 2)
                raw = data[start:at]
                if label == 0xF9:
                    flags = raw[3]
                    b = Block("gce", raw, int.from_bytes(raw[4:6], "little"), flags >> 2 & 7, raw[6] if flags & 1 else -1)
                elif label == 0xFF and raw[3:14] in (b"NETSCAPE2.0", b"ANIMEXTS1.0"):
                    b = Block("loop", raw, loops=int.from_bytes(raw[16:18], "little"))
                else:
                    b = Block({0xFE: "comment", 0x01: "text"}.get(label, "app"), raw)
            else:
                x, y, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
                flags = data[at + 9]
                local = 2 << (flags & 7) if flags & 0x80 else 0
                at = _sub_blocks(data, at + 11 + 3 * local)
                b = Block("image", data[start:at], x=x, y=y, w=w, h=h, local=local, interlaced=bool(flags & 0x40))
        except IndexError:
            g.problem = "cut"
            return
        yield b


def parse(data: bytes) -> Gif:
    """The file with all its blocks."""
    g = Gif(data[:13])
    g.blocks.extend(walk(data, g))
    return g


def lzw_encode(indices: np.ndarray, bits: int) -> bytes:
    clear, stop = 1 << bits, (1 << bits) + 1
    out, acc, used = bytearray(), 0, 0
    table: dict[tuple[int, int], int] = {}
    width, nxt = bits + 1, stop + 1

    def put(code: int) -> None:
        nonlocal acc, used
        acc |= code << used
        used += width
        while used >= 8:
            out.append(acc & 255)
            acc >>= 8
            used -= 8

    put(clear)
    now = -1
    for c in indices.tolist():
        if now < 0:
            now = c
            continue
        got = table.get((now, c))
        if got is not None:
            now = got
            continue
        put(now)
        if nxt < 4096:
            table[now, c] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        else:
            put(clear)
            table, width, nxt = {}, bits + 1, stop + 1
        now = c
    if now >= 0:
        put(now)
        if nxt == 1 << width and width < 12:
            width += 1
    put(stop)
    if used:
        out.append(acc & 255)
    return bytes(out)


def lzw_decode(data: bytes, bits: int, most: int) -> np.ndarray:
    clear, stop = 1 << bits, (1 << bits) + 1
    width, acc, used = bits + 1, 0, 0
    table: list[bytes] = []
    last: bytes | None = None
    out = bytearray()
    for byte in data:
        acc |= byte << used
        used += 8
        while used >= width:
            code = acc & ((1 << width) - 1)
            acc >>= width
            used -= width
            if code == clear:
                table = [bytes([i]) for i in range(clear)] + [b"", b""]
                width, last = bits + 1, None
                continue
            if code == stop or len(out) >= most:
                return np.frombuffer(bytes(out[:most]), np.uint8)
            if code < len(table):
                entry = table[code]
            elif last is not None and code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("broken image data")
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    return np.frombuffer(bytes(out[:most]), np.uint8)


def gce(delay: int, disposal: int, transparent: int) -> bytes:
    return b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent >= 0)]) + delay.to_bytes(2, "little") + bytes([max(0, transparent)]) + b"\0"


def loop(count: int) -> bytes:
    return b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + count.to_bytes(2, "little") + b"\0"


def write(frames: list[np.ndarray], palette: np.ndarray, delays: list[int], transparent: int = -1, loops: int = 0) -> bytes:
    """Frames of palette indices (height x width), one global palette, full frames."""
    h, w = frames[0].shape
    bits = max(2, int(len(palette) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(palette)] = palette[:, :3]
    head = b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([0x80 | 0x70 | (bits - 1), max(0, transparent), 0])
    parts = [head, table.tobytes(), loop(loops)]
    for f, delay in zip(frames, delays, strict=True):
        code = lzw_encode(f.ravel(), bits)
        image = b"\x2c" + bytes(4) + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\0" + bytes([bits])
        image += b"".join(bytes([len(code[i : i + 255])]) + code[i : i + 255] for i in range(0, len(code), 255)) + b"\0"
        parts += [gce(delay, 2 if transparent >= 0 else 1, transparent), image]
    return b"".join(parts) + b"\x3b"


def indices(block: Block) -> np.ndarray:
    """An image block's palette indices in row order."""
    raw = block.raw
    at = 10 + 3 * block.local
    bits, at = raw[at], at + 1
    code = bytearray()
    while raw[at]:
        code += raw[at + 1 : at + 1 + raw[at]]
        at += raw[at] + 1
    got = lzw_decode(bytes(code), bits, block.w * block.h)
    if len(got) < block.w * block.h:
        raise ValueError("image data ends early")
    return got.reshape(block.h, block.w)


def in_order(px: np.ndarray) -> np.ndarray:
    """Rows of an interlaced image, stored in four passes, in their places."""
    h = len(px)
    out = np.empty_like(px)
    out[np.concatenate([np.arange(at, h, step) for at, step in ((0, 8), (4, 8), (2, 4), (1, 2))])] = px
    return out


def shown(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """Full-size RGBA frames as they are shown, each with its delay in hundredths, one at a time; ValueError where an image can't be decoded.

    A frame draws its pixels over the canvas but for the transparent ones; once shown, its
    rectangle stays, is cleared (disposal 2) or becomes again what it was (3).
    """
    g = Gif(data[:13])
    for _ in walk(data, g):
        pass
    if g.problem:
        raise ValueError(g.problem)
    canvas = np.zeros((g.height, g.width, 4), np.uint8)
    control = none = Block("gce", b"")
    for b in walk(data, g):
        if b.kind == "gce":
            control = b
        if b.kind != "image":
            continue
        at = np.s_[b.y : b.y + b.h, b.x : b.x + b.w]
        raw = b.raw[10 : 10 + 3 * b.local] or g.palette
        palette = np.zeros((256, 4), np.uint8)
        palette[:, 3] = 255
        palette[: len(raw) // 3, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        try:
            px = indices(b)
        except IndexError as e:
            raise ValueError("image data ends early") from e
        px = (in_order(px) if b.interlaced else px)[: max(0, g.height - b.y), : max(0, g.width - b.x)]
        before = canvas[at].copy()
        canvas[at] = np.where((px == control.transparent)[..., None], before, palette[px])
        yield canvas.copy(), control.delay
        if control.disposal == 2:
            canvas[at] = 0
        elif control.disposal == 3:
            canvas[at] = before
        control = none


def decode(data: bytes) -> tuple[list[np.ndarray], list[int]]:
    """All frames of ``shown``, and their delays."""
    frames = list(shown(data))
    return [f for f, _ in frames], [d for _, d in frames]


def used(block: Block) -> np.ndarray | None:
    """Whether the image uses each of the 256 indices; None where it can't be decoded."""
    try:
        return np.bincount(indices(block).ravel(), minlength=256) > 0
    except (ValueError, IndexError):
        return None


def _shows_through(g: Gif) -> list[bool]:
    """Of each image whether it has transparent pixels; one that can't be decoded counts by its flag."""
    out = []
    for b, c in g.images:
        t = c[-1].transparent if c else -1
        own = used(b) if t >= 0 else None
        out.append(t >= 0 and (own is None or bool(own[t])))
    return out


def _needs_flag(g: Gif) -> bool:
    """Whether the first image must carry a transparency flag and doesn't."""
    b, c = g.images[0]
    clear = any(_shows_through(g)) or (b.x, b.y, b.w, b.h) != (0, 0, g.width, g.height)
    return clear and not (c and c[-1].transparent >= 0)


def spare_index(g: Gif) -> int:
    """A palette index that the first image doesn't use, -1 if there is none: the one most other images are transparent in, else the least."""
    b, _ = g.images[0]
    own = None if b.local or not g.palette else used(b)
    if own is None:
        return -1
    others = Counter(c[-1].transparent for _, c in g.images[1:] if c and c[-1].transparent >= 0)
    likely = others.most_common(1)
    if likely and not own[likely[0][0]]:
        return likely[0][0]
    free = np.flatnonzero(~own[: len(g.palette) // 3])
    return int(free[0]) if len(free) else -1


def fix(data: bytes) -> bytes:
    """Mend what the rules call fixable; a clean file comes back byte for byte, and so does one that is cut inside a block."""
    g = parse(data)
    if g.problem or not g.images:
        return data
    flag = spare_index(g) if _needs_flag(g) else -1
    known = [c[-1].delay for _, c in g.images if c]
    spare = known[0] if known else 10
    blocks: list[Block] = []
    held: Block | None = None
    first_clear = -1
    for b in g.blocks:
        if b.kind == "gce":
            held = b
        elif b.kind == "image":
            c = held
            held = None
            delay = c.delay if c else spare
            spare = delay
            disposal = c.disposal if c else 1
            clear = c.transparent if c else -1
            if not any(x.kind == "image" for x in blocks):
                first_clear = clear = clear if clear >= 0 else flag
            want = (10 if delay < 2 else delay, 1 if disposal == 0 else disposal, clear)
            if c is None or (c.delay, c.disposal, c.transparent) != want:
                c = Block("gce", gce(*want), *want)
            blocks += [c, b]
        elif b.kind == "loop":
            pass
    loops = [b for b in g.blocks if b.kind == "loop"]
    front = loops[0] if loops and loops[0].loops == 0 else Block("loop", loop(0), loops=0)
    blocks.insert(0, front)
    g.blocks = blocks
    head = bytearray(g.head)
    if first_clear >= 0:
        head[11] = first_clear
    else:
        marks = {b.transparent for b in blocks if b.kind == "gce"}
        if head[11] in marks:
            head[11] = next(i for i in range(256) if i not in marks)
    if bytes(head[:6]) == b"GIF87a":
        head[:6] = b"GIF89a"
    g.head = bytes(head)
    g.trailer = True
    return g.bytes()
