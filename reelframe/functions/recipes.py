"""Recipes: canonical form, keys, validation, presets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the recipe schema.
FORMATS = ["gif", "webp", "apng", "avif", "png", "jpeg", "frames"]
TARGETS = {"": 0, "emote": 262144, "sticker": 524288, "attachment": 20_000_000, "attachment-50": 50_000_000, "attachment-100": 100_000_000, "attachment-500": 500_000_000}
PRESETS = [
    ("emote", "gif", "emote", 128, 128, 25.0, 262144), ("sticker", "apng", "sticker", 320, 320, 25.0, 524288), ("chat", "gif", "attachment", None, None, None, None),
    ("optimize", "gif", "", None, None, None, None), ("frames", "frames", "", None, None, None, None),
]


# Members of a recipe's output in the order of its canonical form; all but the first are left out at their zero value.
OUTPUT = (
    "format string, width bigint, height bigint, fit string, fps variant, quality bigint, lossless boolean, lossy bigint, colors bigint, dither string, alphaThreshold bigint, matte string, loop bigint, "
    "fitBytes bigint, fitKeepSize boolean, fitKeepFps boolean, frameFormat string, preset string, target string"
)
VERSION = 1
RECIPE = f"sources array<string>, ops array<struct<kind: string, params: variant>>, output struct<{OUTPUT.replace(' ', ': ').replace(',: ', ', ')}>"


#: Members of an output that change the geometry of a preview.
PREVIEW = ("format", "width", "height", "fit", "fps")


def canonical(json: Column, members: tuple[str, ...] | None = None) -> Column:
    """The one JSON text of a recipe: version 1, members in fixed order, parameters as given with their keys sorted.

    With ``members`` the output keeps only these.

    The text is read into typed values and written anew. Null parameters and output members at
    their zero value are left out; nulls inside parameters stay. Null where the text isn't a recipe.
    """
    return bound(F.from_json(json, RECIPE), lambda r: _written(r, members))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


#: Where a number may need another spelling, and a JSON text cut into its strings, its numbers and the rest.
UNUSUAL, TOKENS = r"[0-9]E|\.[0-9]*0[,}\]]|[0-9]{16}", r'("(?:[^"\\]|\\.)*"|-?[0-9][-+.eE0-9]*|[^"0-9-]+)'


def plain_number(token: Column) -> Column:
    """A JSON number as its nearest double's shortest digits: with an exponent below 1e-6 and from 1e21 on, else written out."""

    def spelled(text: Column) -> Column:
        part = lambda of, sep, n: F.split_part(of, F.lit(sep), F.lit(n))
        sign, size = F.when(text.startswith("-"), "-").otherwise(""), F.ltrim(text, F.lit("-"))
        mantissa, power = part(size, "E", 1), F.coalesce(F.nullif(part(size, "E", 2), F.lit("")).cast("int"), F.lit(0))
        whole, rest = part(mantissa, ".", 1), F.regexp_replace(part(mantissa, ".", 2), "0+$", "")
        dotted = lambda a, b: F.concat(a, F.when(b != "", F.concat(F.lit("."), b)).otherwise(""))
        scientific = F.concat(dotted(whole, rest), F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string"))
        large = dotted(F.concat(whole, F.rpad(F.substring(rest, F.lit(1), power), power, "0")), F.substring(rest, power + 1, F.length(rest)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), whole, rest)
        return F.concat(sign, F.when((power >= 21) | (power < -6), scientific).when(power == 0, dotted(whole, rest)).when(power > 0, large).otherwise(small))

    return bound(token.cast("double").cast("string"), spelled)


def plain_numbers(json: Column) -> Column:
    """Numbers outside strings spelled as ``plain_number`` does."""

    def spelled(text: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(1)), lambda t: F.when(t.rlike("^-?[0-9]"), plain_number(t)).otherwise(t))
        return F.when(text.rlike(UNUSUAL), F.concat_ws("", tokens)).otherwise(text)

    return bound(json, spelled)


def fps_spelled(output: Column) -> Column:
    """An output's text with its rate spelled as ``plain_number`` does; its other numbers are whole and stay exact."""

    def spelled(text: Column, rate: Column) -> Column:
        number = F.when(rate != "", plain_number(rate))
        return F.when(rate.rlike(r"[.eE]|[0-9]{16}"), F.replace(text, F.concat(F.lit('"fps":'), rate), F.concat(F.lit('"fps":'), number))).otherwise(text)

    return bound(output, lambda text: bound(F.regexp_extract(text, r'"fps":(-?[0-9][-+.eE0-9]*)', 1), lambda rate: spelled(text, rate)))


def _written(recipe: Column, members: tuple[str, ...] | None = None) -> Column:
    """Canonical text of a recipe's typed value. A lambda's variable stands for the value, so that the JSON text is parsed once."""

    def member(name: str, kind: str) -> Column:
        value = recipe["output"][name]
        if name == "format":
            return F.coalesce(value, F.lit(""))
        if kind == "variant":
            return F.when(F.try_variant_get(value, "$", "double") != 0, value)
        return F.nullif(value, F.lit({"string": "", "bigint": 0, "boolean": False}[kind]))

    output = F.struct(*[member(*m.split(" ")).alias(m.split(" ")[0]) for m in OUTPUT.split(", ") if members is None or m.split(" ")[0] in members])
    ops = F.transform(recipe["ops"], lambda op: F.struct(F.coalesce(op["kind"], F.lit("")).alias("kind"), F.when(~F.is_variant_null(op["params"]), op["params"]).alias("params")))
    text = F.concat(
        F.lit(f'{{"v":{VERSION},"sources":'), F.coalesce(F.to_json(recipe["sources"]), F.lit("null")),
        F.lit(',"ops":'), F.coalesce(plain_numbers(F.to_json(ops)), F.lit("[]")), F.lit(',"output":'), fps_spelled(F.to_json(output)), F.lit("}"),
    )
    # These only occur inside strings, where the canonical form escapes them.
    for c in "<>&\u2028\u2029":
        text = F.replace(text, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return F.when(recipe.isNotNull(), text)


def result_key(recipe_hash: Column, pipeline: int, rules: int) -> Column:
    return F.sha2(F.concat_ws("\n", recipe_hash, F.lit(str(pipeline)), F.lit(str(rules))), 256)


def still_key(json: Column, seconds: Column, most_w: Column) -> Column:
    """The key of a preview's frame: its recipe as far as it changes the picture, the time in whole milliseconds, the width."""
    return F.sha2(F.concat(canonical(json, PREVIEW), F.lit("|t="), F.format_string("%.3f", seconds), F.lit("|w="), most_w.cast("string")), 256)


def recipe_error(sources: Column, hash_: Column, fmt: Column, target: Column) -> Column:
    """The first rule that a recipe breaks, null if none."""
    return F.when(sources == 0, "sources").when(~hash_.rlike("^[0-9a-f]{64}$"), "hash").when(~fmt.isin(*FORMATS), "format").when(~target.isin(*TARGETS), "target")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, format string, target string, width int, height int, fps double, fit_bytes long")


def targets(spark: SparkSession) -> DataFrame:
    """The seven targets and their byte caps (0: none); a table of fixed size, so it may be broadcast."""
    return spark.createDataFrame([(k, v, k.startswith("attachment")) for k, v in TARGETS.items()], "target string, cap long, attachment boolean")
