"""File names and content: sanitising, natural order, sniffing, content types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and their MIME types.
MIME = {
    "gif": "image/gif", "png": "image/png", "apng": "image/apng", "webp": "image/webp", "avif": "image/avif", "jpg": "image/jpeg", "jpeg": "image/jpeg", "bmp": "image/bmp",
    "tif": "image/tiff", "tiff": "image/tiff", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm", "mkv": "video/x-matroska", "zip": "application/zip", "json": "application/json",
}
OTHER_MIME = "application/octet-stream"
SEQUENCE = ["png", "jpg", "jpeg", "webp", "bmp", "tiff", "tif"]
#: First bytes in hex, offset, format.
MAGIC = [("89504e470d0a1a0a", 0, "png"), ("ffd8ff", 0, "jpeg"), ("474946383761", 0, "gif"), ("474946383961", 0, "gif"), ("57454250", 8, "webp"), ("424d", 0, "bmp"), ("49492a00", 0, "tiff"), ("4d4d002a", 0, "tiff"), ("6674797061766966", 4, "avif"), ("6674797061766973", 4, "avif")]
NAME_BYTES = 200


def sanitize_ext(ext: Column) -> Column:
    """Lower-case letters and digits, eight at most; names of the store's own files are set apart; else "bin"."""
    e = F.lower(F.regexp_replace(ext, r"^\.", ""))
    return F.when(e == "json", "jsonfile").when(e == "seq", "seqfile").when(e.rlike("^[a-z0-9]{1,8}$"), e).otherwise("bin")


def sanitize_name(name: Column) -> Column:
    """Last path element without control characters, within the byte limit, never empty."""
    last = F.regexp_replace(F.element_at(F.split(name, r"[/\\]"), -1), r"[\x00-\x1f\x7f]", "")
    # Whole characters as long as the bytes fit: none has over four.
    cut = F.when(F.octet_length(last) <= NAME_BYTES, last).otherwise(F.aggregate(F.split(F.substring(last, 1, NAME_BYTES), ""), F.lit(""), lambda a, c: F.when(F.octet_length(a) + F.octet_length(c) <= NAME_BYTES, F.concat(a, c)).otherwise(a)))
    return F.when(F.trim(cut).isin("", ".", ".."), "upload").otherwise(cut)


def natural_key(name: Column) -> Column:
    """Sort key: digit runs by value (length, then digits), other runs case-folded; ties by the name itself."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(F.concat(F.lit("1"), F.lower(run)))

    return F.struct(F.transform(runs, key).alias("key"), name.alias("name"))


def sniff(content: Column) -> Column:
    """Format by the first bytes, null if none matches."""
    head = F.lower(F.hex(F.substring(content, 1, 16)))
    out = F.lit(None).cast("string")
    for magic, at, name in reversed(MAGIC):
        out = F.when(F.substring(head, 2 * at + 1, len(magic)) == magic, name).otherwise(out)
    return out


def content_type(ext: Column) -> Column:
    pairs = [F.lit(x) for kv in MIME.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(ext)), F.lit(OTHER_MIME))


def stem(name: Column) -> Column:
    """Name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
