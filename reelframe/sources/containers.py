"""Sound and damaged container files as scripts: short texts that Spark turns into bytes and SQL reads for its own findings.

A script is a row of tokens ``kind:hex[:note]``. For a GIF the hex digits are a block as it
stands in the file, and an image's note lists the palette indices it uses. For a PNG they are
a chunk's body; length and checksum are added, a note ``x`` spoils the checksum, and kind
``raw`` stands as it is. ``DDDD`` and ``WWWWWWWW`` are filled in from a row's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import gif
from .views import read

TARGETS = ["", "emote", "sticker", "attachment"]


def _header(version: str = "89a", flags: int = 0x81, background: int = 0, palette: bool = True) -> str:
    return "header:" + (f"GIF{version}".encode() + bytes([4, 0, 2, 0, flags, background, 0]) + (bytes(range(12)) if palette else b"")).hex()


def _control(disposal: int = 1, clear: int | None = None) -> str:
    return f"gce:21f904{disposal << 2 | (clear is not None):02x}DDDD{clear or 0:02x}00"


def _image(indices: list[int], rect: tuple[int, int, int, int] = (0, 0, 4, 2), flags: int = 0, local: bytes = b"", broken: bool = False) -> str:
    import numpy as np

    code = gif.lzw_encode(np.array(indices, np.uint8), 2) if not broken else b"\xff\xff"
    raw = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in rect) + bytes([flags]) + local + bytes([2, len(code)]) + code + b"\0"
    return f"image:{raw.hex()}:" + ("?" if broken else "".join(map(str, sorted(set(indices)))))


def _loop(count: int = 0) -> str:
    return "loop:" + gif.loop(count).hex()


_A, _B, _END = [0, 1, 2, 0, 1, 2, 0, 1], [1, 1, 3, 3, 1, 1, 3, 3], "trailer:3b"
_COMMENT, _APP, _ODD_LOOP = "comment:21fe02686900", "app:21ff0b58585858585858585831300100" + "00", "loop:21ff0b" + b"NETSCAPE2.0".hex() + "01ff00"

#: Name, script and the rules that fail whatever the delay and target are.
GIFS: list[tuple[str, list[str], set[str]]] = [
    ("opaque", [_header(), _loop(), _control(), _image(_A), _control(), _image(_B), _END], set()),
    ("opaque first, clear differences", [_header(background=3), _loop(), _control(1, 3), _image(_A), _control(1, 3), _image(_B), _END], set()),
    ("clear", [_header(background=0), _loop(), _control(2, 0), _image(_A), _control(2, 0), _image(_A), _END], set()),
    ("no control", [_header(), _loop(), _image(_A), _control(), _image(_B), _END], {"gif.gce-every-frame"}),
    ("two controls", [_header(), _loop(), _control(), _control(), _image(_A), _END], {"gif.gce-every-frame"}),
    ("disposal 0", [_header(), _loop(), _control(0), _image(_A), _END], {"gif.disposal"}),
    ("disposal 3", [_header(), _loop(), _control(), _image(_A), _control(3), _image(_B), _END], {"gif.disposal"}),
    ("no loop", [_header(), _control(), _image(_A), _control(), _image(_B), _END], {"gif.netscape-loop"}),
    ("late loop", [_header(), _control(), _image(_A), _loop(), _control(), _image(_B), _END], {"gif.netscape-loop"}),
    ("odd loop", [_header(), _ODD_LOOP, _control(), _image(_A), _END], {"gif.netscape-loop"}),
    ("counted loop", [_header(), _loop(2), _control(), _image(_A), _END], set()),
    ("local palette", [_header(), _loop(), _control(), _image(_A, flags=0x81, local=bytes(12)), _END], {"gif.global-palette"}),
    ("no palette", [_header(flags=1, palette=False), _loop(), _control(), _image(_A), _END], {"gif.global-palette"}),
    ("interlaced", [_header(), _loop(), _control(), _image(_A, flags=0x40), _END], {"gif.no-interlace"}),
    ("comment", [_header(), _COMMENT, _loop(), _control(), _image(_A), _END], {"gif.no-extra-extensions"}),
    ("application", [_header(), _loop(), _APP, _control(), _image(_A), _END], {"gif.no-extra-extensions"}),
    ("dangling control", [_header(), _loop(), _control(), _image(_A), _control(), _END], {"gif.no-extra-extensions"}),
    ("background", [_header(background=1), _loop(), _control(1, 2), _image(_A), _END], {"gif.lsd-background-index"}),
    ("background clear later", [_header(background=3), _loop(), _control(), _image(_A), _control(1, 3), _image([0] * 8), _END], {"gif.lsd-background-index"}),
    ("flag missing", [_header(), _loop(), _control(), _image(_A), _control(1, 3), _image(_B), _END], {"gif.frame0-transparency"}),
    ("not covered", [_header(), _loop(), _control(), _image([0, 1], (1, 0, 2, 1)), _END], {"gif.frame0-transparency"}),
    ("no index free", [_header(), _loop(), _control(), _image([0, 1, 2, 3] * 2), _control(1, 3), _image(_B), _END], {"gif.frame0-transparency"}),
    ("first blank", [_header(background=2), _loop(), _control(2, 2), _image([2] * 8), _control(2, 2), _image(_A), _END], {"gif.first-frame-visible"}),
    ("no pixels read", [_header(background=2), _loop(), _control(2, 2), _image(_A, broken=True), _END], set()),
    ("no trailer", [_header(), _loop(), _control(), _image(_A)], {"gif.trailer"}),
    ("old version", [_header("87a"), _loop(), _control(), _image(_A), _END], set()),
    ("no image", [_header(), _loop(), _END], {"gif.gce-every-frame"}),
    ("cut", [_header(), _loop(), _control(), "problem:2c0000"], {"gif.container"}),
    ("unknown block", [_header(), _loop(), _control(), _image(_A), "problem:99"], {"gif.container"}),
]


def _head(colour: int = 6, depth: int = 8, methods: str = "0000", interlace: int = 0, width: str = "WWWWWWWW") -> str:
    return f"IHDR:{width}00000002{depth:02x}{colour:02x}{methods}{interlace:02x}"


def _frame(seq: int, rect: tuple[int, int, int, int] | None = None, delay: tuple[int, int] = (1, 10), dispose: int = 0, blend: int = 0) -> str:
    size = "WWWWWWWW000000020000000000000000" if rect is None else "".join(f"{v:08x}" for v in rect)
    return f"fcTL:{seq:08x}{size}{delay[0]:04x}{delay[1]:04x}{dispose:02x}{blend:02x}"


def _animation(frames: int, plays: int = 0) -> str:
    return f"acTL:{frames:08x}{plays:08x}"


def _more(seq: int) -> str:
    return f"fdAT:{seq:08x}aa"


_D, _I, _PAL, _KEY = "IDAT:aa", "IEND:", "PLTE:000000ffffff", "tRNS:00ff"
#: Name, script and the codes of the file's problems.
PNGS: list[tuple[str, list[str], set[str]]] = [
    ("animation", [_head(), _animation(2), _frame(0), _D, _frame(1), _more(2), _I], set()),
    ("plain", [_head(), _D, _I], set()),
    ("indexed", [_head(3), _PAL, _KEY, _animation(2), _frame(0), _D, _D, _frame(1), _more(2), _more(3), _I], set()),
    ("played once", [_head(), _animation(1, 1), _frame(0), _D, _I], set()),
    ("hidden default", [_head(), _animation(1), _D, _frame(0), _more(1), _I], set()),
    ("still delays", [_head(), _animation(3), _frame(0, delay=(0, 100)), _D, _frame(1, delay=(1, 100)), _more(2), _frame(3, delay=(1, 0)), _more(4), _I], set()),
    ("sixtieths", [_head(), _animation(2), _frame(0, delay=(1, 60)), _D, _frame(1, delay=(1, 60)), _more(2), _I], set()),
    ("outside", [_head(), _animation(2), _frame(0), _D, _frame(1, (900, 2, 0, 0)), _more(2), _I], set()),
    ("default not whole", [_head(), _animation(1), _frame(0, (1, 1, 0, 0)), _D, _I], set()),
    ("empty rectangle", [_head(), _animation(2), _frame(0), _D, _frame(1, (0, 2, 0, 0)), _more(2), _I], set()),
    ("no chunk", [], {"no-chunks", "no-idat", "no-iend"}),
    ("head late", [_PAL, _head(3), _D, _I], {"ihdr-place"}),
    ("head twice", [_head(), _head(), _D, _I], {"ihdr-again"}),
    ("head short", ["IHDR:00", _D, _I], {"ihdr-size", "no-ihdr"}),
    ("no side", [_head(width="00000000"), _D, _I], {"ihdr-dimensions"}),
    ("side too large", [_head(width="ffffffff"), _D, _I], {"ihdr-dimensions"}),
    ("depth", [_head(3, 16), _PAL, _D, _I], {"ihdr-depth"}),
    ("methods", [_head(methods="0100", interlace=2), _D, _I], {"ihdr-method", "ihdr-interlace"}),
    ("palette twice", [_head(3), _PAL, _PAL, _D, _I], {"plte-again"}),
    ("palette late", [_head(), _D, _PAL, _I], {"plte-late"}),
    ("palette behind key", [_head(3), _KEY, _PAL, _D, _I], {"plte-behind-trns"}),
    ("palette size", [_head(3), "PLTE:0000", _KEY, _D, _I], {"plte-size", "trns-long"}),
    ("no palette", [_head(3), _D, _I], {"palette-missing"}),
    ("key twice and late", [_head(2), "tRNS:000000000000", _D, _KEY, _I], {"trns-again"}),
    ("key late", [_head(0), _D, _KEY, _I], {"trns-late"}),
    ("key too long", [_head(3), _PAL, "tRNS:000000", _D, _I], {"trns-long"}),
    ("key size", [_head(2), _KEY, _D, _I], {"trns-size"}),
    ("key beside alpha", [_head(6), _KEY, _D, _I], {"trns-alpha"}),
    ("control twice", [_head(), _animation(1), _animation(1), _frame(0), _D, _I], {"actl-again"}),
    ("control late", [_head(), _D, _animation(1), _frame(0), _more(1), _I], {"actl-late"}),
    ("control short", [_head(), "acTL:00", _frame(0), _D, _I], {"actl-size", "no-actl"}),
    ("no frames", [_head(), _animation(0), _D, _I], {"actl-empty"}),
    ("too few frames", [_head(), _animation(3), _frame(0), _D, _I], {"actl-count"}),
    ("frame short", [_head(), _animation(1), "fcTL:00", _frame(0), _D, _I], {"fctl-size"}),
    ("two before data", [_head(), _animation(2), _frame(0), _frame(1), _D, _I], {"fctl-again", "frame-empty"}),
    ("operations", [_head(), _animation(1), _frame(0, dispose=3, blend=2), _D, _I], {"fctl-dispose", "fctl-blend"}),
    ("numbers", [_head(), _animation(2), _frame(0), _D, _frame(2), _more(3), _I], {"sequence"}),
    ("number twice", [_head(), _animation(2), _frame(0), _D, _frame(1), _more(1), _I], {"sequence"}),
    ("data short", [_head(), _animation(2), _frame(0), _D, _frame(1), "fdAT:00", _I], {"fdat-size", "frame-empty"}),
    ("data early", [_head(), _animation(0), _more(0), _D, _I], {"actl-empty", "fdat-early", "idat-late"}),
    ("data of the default", [_head(), _animation(1), _frame(0), _D, _more(1), _I], {"fdat-default"}),
    ("image behind data", [_head(), _animation(2), _frame(0), _D, _frame(1), _more(2), _D, _I], {"idat-late"}),
    ("frame without data", [_head(), _animation(2), _frame(0), _D, _frame(1), _I], {"frame-empty"}),
    ("no control", [_head(), _frame(0), _D, _frame(1), _more(2), _I], {"no-actl"}),
    ("no image", [_head(), _I], {"no-idat"}),
    ("no end", [_head(), _D], {"no-iend"}),
    ("cut", [_head(), _D, "raw:000000ff49444154aa"], {"cut", "no-iend"}),
    ("stray", [_head(), _D, "raw:0000"], {"stray", "no-iend"}),
    ("behind the end", [_head(), _D, _I, "raw:00112233445566778899"], set()),
    ("checksum", [_head(), _D + ":x", _I], {"crc"}),
    ("other chunks", [_head(), "tEXt:6162", _D, "tIME:00", _I], set()),
]


def scripts(spark: SparkSession, d: str, kinds: list) -> DataFrame:
    """clip, target, script: one file for each document."""
    i = F.col("doc_id")
    texts = F.array(*[F.lit(" ".join(tokens)) for _, tokens, _ in kinds])
    script = F.element_at(texts, (i % len(kinds) + 1).cast("int"))
    script = F.replace(F.replace(script, F.lit("DDDD"), F.concat(F.lpad(F.hex(F.floor(i / 7) % 9), 2, "0"), F.lit("00"))), F.lit("WWWWWWWW"), F.lpad(F.hex(1 + F.floor(i / 3) % 400), 8, "0"))
    target = F.element_at(F.array(*map(F.lit, TARGETS)), (F.floor(i / 11) % 4 + 1).cast("int"))
    return read(spark, d, "documents").select(i.alias("clip"), target.alias("target"), script.alias("script"))


def scripts_sql(kinds: list) -> str:
    """``files`` (clip, target, script) and ``tok`` (clip, target, ord, kind, hex, note) for the same documents."""
    texts = "[" + ", ".join("'" + " ".join(tokens) + "'" for _, tokens, _ in kinds) + "]"
    return f"""files AS (SELECT doc_id AS clip, {TARGETS}[doc_id // 11 % 4 + 1] AS target,
  replace(replace({texts}[doc_id % {len(kinds)} + 1], 'DDDD', lpad(hex(doc_id // 7 % 9), 2, '0') || '00'), 'WWWWWWWW', lpad(hex(1 + doc_id // 3 % 400), 8, '0')) AS script FROM documents),
tok AS (SELECT clip, target, ord, split_part(t, ':', 1) AS kind, split_part(t, ':', 2) AS hex, split_part(t, ':', 3) AS note
  FROM (SELECT clip, target, unnest(string_split(script, ' ')) AS t, unnest(range(len(string_split(script, ' ')))) AS ord FROM files) WHERE t <> '')"""


def _tokens(script: Column) -> Column:
    return F.filter(F.split(script, " "), lambda t: t != "")


def gif_content(script: Column) -> Column:
    return F.unhex(F.concat_ws("", F.transform(_tokens(script), lambda t: F.split_part(t, F.lit(":"), F.lit(2)))))


def png_content(script: Column) -> Column:
    def chunk(t: Column) -> Column:
        kind, body = F.split_part(t, F.lit(":"), F.lit(1)), F.split_part(t, F.lit(":"), F.lit(2))
        named = F.concat(F.hex(kind.cast("binary")), body)
        crc = F.crc32(F.unhex(named)).bitwiseXOR(F.when(F.split_part(t, F.lit(":"), F.lit(3)) == "x", 1).otherwise(0).cast("long"))
        return F.when(kind == "raw", body).otherwise(F.concat(F.lpad(F.hex(F.floor(F.length(body) / 2)), 8, "0"), named, F.lpad(F.hex(crc), 8, "0")))

    return F.unhex(F.concat(F.lit("89504e470d0a1a0a"), F.concat_ws("", F.transform(_tokens(script), chunk))))


def gifs(spark: SparkSession, d: str) -> DataFrame:
    """clip, format, target, content."""
    return scripts(spark, d, GIFS).select("clip", F.lit("gif").alias("format"), "target", gif_content(F.col("script")).alias("content"))


def pngs(spark: SparkSession, d: str) -> DataFrame:
    return scripts(spark, d, PNGS).select("clip", F.lit("apng").alias("format"), "target", png_content(F.col("script")).alias("content"))
