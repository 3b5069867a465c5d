"""Op stacks as a query: an order is a recipe, its lines are the operations in their order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stacks as S
from ..sources import views as V
from .registry import query

_LIST = V._list
_KINDS = [*S.KINDS, "blur"]
_FITS, _COLORS, _FORMATS = ["", "contain", " Cover", "exact", "fill"], ["", "#313338", "FF000080", "ff0000ff", "zz"], ["gif", "webp", "GIF ", "apng"]
#: Columns of an operation, in SQL that both engines read; ``one(list, n)`` picks an element.
_PARAMS = {
    "w": "CASE WHEN a % 29 = 0 THEN 0 ELSE 100 + a % 400 END", "h": "80 + b * 7 % 300", "x": "CASE WHEN a % 31 = 0 THEN -1 ELSE q END", "y": "q * 2 % 37",
    "width": "CASE WHEN a % 5 = 0 THEN 0 WHEN a % 37 = 0 THEN 9000 ELSE 64 + a % 1500 END", "height": "CASE WHEN b % 4 = 0 THEN 0 ELSE 48 + c % 900 END",
    "fit": (_FITS, "CASE WHEN c % 19 = 0 THEN 4 ELSE c % 4 END"), "color": (_COLORS, "CASE WHEN c % 23 = 0 THEN 4 ELSE b % 4 END"), "degrees": ("90 * (1 + a % 3) + CASE WHEN c % 13 = 0 THEN 1 ELSE 0 END"),
    "start": "(q % 7) * 0.25 - CASE WHEN c % 43 = 0 THEN 2.0 ELSE 0.0 END", "end": "(c % 40) * 0.25", "factor": ([0.5, 2.0, 1.5, 0.25, 20.0, 1.0, 200.0, 0.0], "CASE WHEN c % 17 = 0 THEN 6 + a % 2 ELSE a % 6 END"),
    "fps": ([10.0, 25.0, 30.0, 12.5, 120.0, 0.0005, -1.0], "CASE WHEN c % 17 = 0 THEN 5 + a % 2 ELSE a % 5 END"), "ms": ([20, 40, 100, 33, 0, 70000], "CASE WHEN c % 11 = 0 THEN 4 + a % 2 ELSE a % 4 END"),
}
_SOURCE = {
    "width": "320 + o % 1600", "height": "CASE WHEN o % 211 = 0 THEN 0 ELSE 240 + o % 1100 END", "fps": "CASE WHEN o % 23 = 0 THEN NULL ELSE 5.0 + (o % 200) * 0.25 END", "duration": "CASE WHEN o % 6 = 0 THEN 0.0 ELSE (o % 60) * 0.25 END",
    "frames": "CASE WHEN o % 12 = 0 THEN 0 ELSE o % 300 END", "has_alpha": "o % 3 = 0", "is_still": "o % 17 = 0", "count": "CASE WHEN o % 5 = 0 THEN o % 90 + 1 END", "delay": "CASE WHEN o % 10 = 0 THEN 0 WHEN o % 135 = 0 THEN 61000 ELSE 20 + o % 90 END",
    "out_w": "CASE WHEN o % 4 = 0 THEN 64 + o % 700 ELSE 0 END", "out_h": "CASE WHEN o % 8 = 0 THEN 64 + o % 500 WHEN o % 509 = 0 THEN -1 ELSE 0 END", "out_fps": "CASE WHEN o % 9 = 0 THEN 12.5 WHEN o % 307 = 0 THEN -1.0 ELSE 0.0 END",
    "out_fit": (_FITS, "CASE WHEN o % 401 = 0 THEN 4 ELSE o % 4 END"), "format": (_FORMATS, "o % 4"),
}
_TYPES = {name: kind for name, kind in (x.split(" ") for x in S.PARAMS.split(", "))} | {"fps": "double", "duration": "double", "frames": "bigint", "has_alpha": "boolean", "is_still": "boolean", "count": "bigint", "delay": "bigint", "out_w": "bigint", "out_h": "bigint", "out_fps": "double", "out_fit": "string", "format": "string"}


def _value(name: str, how, spark: bool) -> str:
    kind = _TYPES[name]
    if isinstance(how, tuple):
        items, at = how
        text = ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in items)
        how = f"element_at(array({text}), cast({at} AS INT) + 1)" if spark else f"[{text}][{at} + 1]"
    return f"CAST({how} AS {kind if spark else {'string': 'VARCHAR'}.get(kind, kind)})"


def _kind(spark: bool) -> str:
    text, at = ", ".join(f"'{k}'" for k in _KINDS), "CASE WHEN c % 97 = 0 THEN 10 ELSE c % 10 END"
    return f"element_at(array({text}), cast({at} AS INT) + 1)" if spark else f"[{text}][{at} + 1]"


def clips(spark, d):
    line = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    params = F.struct(*[F.expr(_value(n, h, True)).alias(n) for n, h in _PARAMS.items()])
    op = F.struct("n", "a", "b", "c", "q", F.struct(F.expr(_kind(True)).alias("kind"), params.alias("params")).alias("op"))
    stacks = line.groupBy("o").agg(F.transform(F.array_sort(F.collect_list(op)), lambda x: x["op"]).alias("ops"))
    return stacks.select(F.col("o").alias("clip"), "ops", *[F.expr(_value(n, h, True)).alias(n) for n, h in _SOURCE.items()])


def _scaled(w: str, h: str, bw: str, bh: str, fit: str) -> tuple[str, str]:
    by_w, by_h = f"greatest(1, ({h} * {bw} * 2 + {w}) // ({w} * 2))", f"greatest(1, ({w} * {bh} * 2 + {h}) // ({h} * 2))"
    bind = f"(CASE WHEN {fit} = 'cover' THEN {bw} * {h} >= {bh} * {w} ELSE {bw} * {h} <= {bh} * {w} END)"
    return (f"(CASE WHEN {bw} <= 0 THEN {by_h} WHEN {bh} <= 0 OR {fit} = 'exact' OR {bind} THEN {bw} ELSE {by_h} END)", f"(CASE WHEN {bh} <= 0 THEN {by_w} WHEN {bw} <= 0 OR {fit} = 'exact' OR NOT {bind} THEN {bh} ELSE {by_w} END)")


def _big(w: str, h: str) -> str:
    return f"({w} > 8192 OR {h} > 8192 OR {w} * {h} > 33554432)"


def _first(phase: str, code: str) -> str:
    return f"coalesce(bad_{phase}, (s.pos - 1) || ':' || kind || ':' || ({code}))"


_FIT_NAME = "CASE lower(trim({})) WHEN '' THEN 'contain' WHEN 'contain' THEN 'contain' WHEN 'cover' THEN 'cover' WHEN 'exact' THEN 'exact' END"
_SW, _SH = _scaled("s.w", "s.h", "t.width", "t.height", "f")
_OW, _OH = _scaled("w", "h", "out_w", "out_h", "fit")
_PARAM_SQL = ", ".join(f'{_value(n, h, False)} AS "{"cw" if n == "w" else "ch" if n == "h" else "rate" if n == "fps" else "till" if n == "end" else n}"' for n, h in _PARAMS.items())
_CUT = "(f = 'cover' AND t.width > 0 AND t.height > 0)"
_ROUND3 = "floor(({}) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE"

_SQL = f"""WITH RECURSIVE line AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS a, l_suppkey AS b, l_quantity::BIGINT AS q, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem),
t AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY n, a, b, c, q) AS pos, {_kind(False)} AS kind, {_PARAM_SQL}, {_FIT_NAME.format(_value("fit", _PARAMS["fit"], False))} AS f FROM line),
src AS (SELECT o, {", ".join(f"{_value(n, h, False)} AS {n}" for n, h in _SOURCE.items())} FROM (SELECT DISTINCT o FROM line)),
s AS (SELECT o, 1::BIGINT AS pos, width AS w, greatest(1, height) AS h, has_alpha AS alpha, 0.0::DOUBLE AS "from", 0.0::DOUBLE AS upto, 1.0::DOUBLE AS speed, 0.0::DOUBLE AS fps, CASE WHEN delay > 0 THEN delay ELSE 100 END AS delay, is_still, count,
  NULL::VARCHAR AS bad_kind, NULL::VARCHAR AS bad_delay, NULL::VARCHAR AS bad_trim, NULL::VARCHAR AS bad_speed, NULL::VARCHAR AS bad_fps, NULL::VARCHAR AS bad_frame FROM src
UNION ALL SELECT o, pos + 1, CASE WHEN bad_frame IS NULL THEN nw ELSE w END, CASE WHEN bad_frame IS NULL THEN nh ELSE h END, CASE WHEN bad_frame IS NULL THEN na ELSE alpha END, "from", upto, speed, fps, delay, is_still, count, bad_kind, bad_delay, bad_trim, bad_speed, bad_fps, bad_frame FROM (
 SELECT s.o, s.pos, s.w, s.h, s.alpha, is_still, count,
  CASE kind WHEN 'crop' THEN t.cw WHEN 'resize' THEN CASE WHEN {_CUT} THEN least(t.width, {_SW}) ELSE {_SW} END WHEN 'canvas' THEN t.width WHEN 'rotate' THEN CASE WHEN degrees IN (90, 270) THEN s.h ELSE s.w END ELSE s.w END AS nw,
  CASE kind WHEN 'crop' THEN t.ch WHEN 'resize' THEN CASE WHEN {_CUT} THEN least(t.height, {_SH}) ELSE {_SH} END WHEN 'canvas' THEN t.height WHEN 'rotate' THEN CASE WHEN degrees IN (90, 270) THEN s.w ELSE s.h END ELSE s.h END AS nh,
  s.alpha OR (kind = 'canvas' AND (t.width > s.w OR t.height > s.h) AND color IN ('', 'FF000080')) AS na,
  CASE WHEN kind = 'trim' THEN greatest("from", t.start) ELSE "from" END AS "from", CASE WHEN kind = 'trim' AND till > 0 AND (upto = 0 OR till < upto) THEN till ELSE upto END AS upto,
  CASE WHEN kind = 'speed' THEN speed * factor ELSE speed END AS speed, CASE WHEN kind = 'fps' THEN rate ELSE fps END AS fps, CASE WHEN kind = 'delay' THEN ms ELSE delay END AS delay,
  {_first("kind", "CASE WHEN kind = 'blur' THEN 'unknown' END")} AS bad_kind,
  {_first("delay", "CASE WHEN kind = 'delay' AND count IS NOT NULL AND (ms < 1 OR ms > 60000) THEN 'ms' END")} AS bad_delay,
  {_first("trim", "CASE WHEN kind = 'trim' THEN CASE WHEN t.start < 0 THEN 'start' WHEN till > 0 AND till <= t.start THEN 'order' WHEN t.start = 0 AND till = 0 THEN NULL WHEN is_still THEN 'still' WHEN count = 1 THEN 'single' END END")} AS bad_trim,
  {_first("speed", "CASE WHEN kind = 'speed' THEN CASE WHEN factor <= 0 THEN 'factor' WHEN factor < 0.05 OR factor > 100 THEN 'range' END END")} AS bad_speed,
  {_first("fps", "CASE WHEN kind = 'fps' AND rate <= 0 THEN 'rate' END")} AS bad_fps,
  {_first("frame", f'''CASE kind WHEN 'crop' THEN CASE WHEN cw < 1 OR ch < 1 THEN 'size' WHEN x < 0 OR y < 0 THEN 'offset' WHEN x + cw > s.w OR y + ch > s.h THEN 'outside' END
    WHEN 'resize' THEN CASE WHEN f IS NULL THEN 'fit' WHEN t.width = 0 AND t.height = 0 THEN 'missing' WHEN t.width > 8192 OR t.height > 8192 THEN 'side' WHEN {_big(_SW, _SH)} THEN 'frame' END
    WHEN 'canvas' THEN CASE WHEN t.width < 1 OR t.height < 1 THEN 'size' WHEN t.width > 8192 OR t.height > 8192 THEN 'side' WHEN {_big("t.width", "t.height")} THEN 'frame' WHEN color = 'zz' THEN 'color' END
    WHEN 'rotate' THEN CASE WHEN degrees NOT IN (90, 180, 270) THEN 'degrees' END END''')} AS bad_frame
  FROM s JOIN t ON t.o = s.o AND t.pos = s.pos)),
z AS (SELECT s.*, src.* EXCLUDE (o, has_alpha, is_still, count, delay, fps), src.delay AS delay0, src.fps AS fps0, {_FIT_NAME.format("out_fit")} AS fit, CASE WHEN s.count IS NOT NULL THEN {_ROUND3.format("1000.0::DOUBLE / coalesce(nullif(s.delay, 0), 100)")} WHEN src.fps > 0 THEN src.fps END AS rate
  FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY o ORDER BY pos DESC) = 1) s JOIN src USING (o)),
y AS (SELECT *, CASE WHEN count IS NOT NULL THEN count / rate WHEN duration > 0 THEN duration WHEN frames > 0 AND fps0 > 0 THEN frames / fps0 END AS len, "from" > 0 OR upto > 0 AS cut, greatest(out_w, out_h) > 0 AS boxed, is_still OR coalesce(count = 1, false) AS single, floor(rate * 1000 + 0.5)::BIGINT AS r1000 FROM z),
x AS (SELECT *, CASE WHEN len > 0 AND upto >= len THEN 0 ELSE upto END AS till, CASE WHEN fps > 0 THEN fps WHEN out_fps > 0 THEN out_fps ELSE coalesce(rate, 10) END AS asked FROM y),
w AS (SELECT *, (2 * floor("from" * 1000000 + 0.5)::BIGINT * r1000 + 1000000000) // 2000000000 AS skip, CASE WHEN till > "from" THEN (2 * floor((till - "from") * 1000000 + 0.5)::BIGINT * r1000 + 1000000000) // 2000000000 ELSE 0 END AS kept, {_ROUND3.format("least(asked, CASE WHEN lower(trim(format)) = 'gif' THEN 50.0 ELSE 60.0 END)")} AS out_rate,
  CASE WHEN NOT boxed OR h = 0 THEN w WHEN out_w > 0 AND out_h > 0 AND fit = 'contain' THEN out_w WHEN out_w > 0 AND out_h > 0 AND fit = 'cover' THEN least(out_w, {_OW}) ELSE {_OW} END AS ww, CASE WHEN NOT boxed OR h = 0 THEN h WHEN out_w > 0 AND out_h > 0 AND fit = 'contain' THEN out_h WHEN out_w > 0 AND out_h > 0 AND fit = 'cover' THEN least(out_h, {_OH}) ELSE {_OH} END AS hh,
  alpha OR (boxed AND out_w > 0 AND out_h > 0 AND fit = 'contain' AND h > 0 AND ({_OW} <> out_w OR {_OH} <> out_h)) AS aa, boxed AND h > 0 AND {_big(_OW, _OH)} AS too_big FROM x),
v AS (SELECT *, CASE WHEN cut THEN CASE WHEN till > 0 THEN least(count - skip, kept) ELSE count - skip END ELSE count END AS chosen FROM w),
u AS (SELECT *, CASE WHEN single THEN 0 WHEN count IS NOT NULL THEN chosen / rate / nullif(speed, 0) WHEN len IS NOT NULL THEN greatest(0, CASE WHEN till > 0 THEN till ELSE len END - "from") / nullif(speed, 0) END AS secs FROM v),
g AS (SELECT *, CASE WHEN single THEN 1 WHEN count IS NOT NULL THEN floor(chosen / nullif(speed, 0))::BIGINT * floor(out_rate * 1000 + 0.5)::BIGINT // r1000 WHEN len IS NOT NULL THEN greatest(1, floor(secs * out_rate + 1e-4)::BIGINT) END AS shown FROM u),
e AS (SELECT *, coalesce(CASE WHEN height = 0 THEN 'source:size' END, bad_kind, CASE WHEN count IS NOT NULL AND delay0 > 60000 THEN 'delay:ms' END, bad_delay, bad_trim,
  CASE WHEN cut THEN CASE WHEN upto > 0 AND upto <= "from" THEN 'trim:apart' WHEN len <= "from" THEN 'trim:late' WHEN count IS NOT NULL AND skip >= count THEN 'trim:none' WHEN count IS NOT NULL AND till > 0 AND kept = 0 THEN 'trim:short' END END,
  bad_speed, CASE WHEN speed < 0.05 OR speed > 100 THEN 'speed:range' END, bad_fps, CASE WHEN fps <= 0 AND out_fps < 0 THEN 'output:fps' WHEN asked < 0.001 THEN 'fps:low' END, bad_frame,
  CASE WHEN fit IS NULL THEN 'output:fit' WHEN out_w < 0 OR out_h < 0 THEN 'output:size' WHEN too_big THEN 'output:frame' END,
  CASE WHEN {_big("ww", "hh")} THEN 'output:frame' WHEN count IS NOT NULL AND NOT single AND shown < 1 THEN 'speed:none' WHEN ww * hh * 4 * shown > 8589934592 THEN 'master' END) AS error FROM g)
SELECT o AS clip, CASE WHEN error IS NULL THEN ww END AS width, CASE WHEN error IS NULL THEN hh END AS height, CASE WHEN error IS NULL THEN aa END AS has_alpha, CASE WHEN error IS NULL THEN out_rate END AS fps, CASE WHEN error IS NULL THEN shown END AS frames, CASE WHEN error IS NULL THEN secs END AS duration, error FROM e"""


@query("op_stacks", _SQL)
def op_stacks(spark, d):
    """Size, alpha, rate, frames and length of whole op stacks, or the first error; SQL walks each stack by recursion."""
    return S.plan(clips(spark, d)).select("clip", "plan.width", "plan.height", "plan.has_alpha", "plan.fps", "plan.frames", "plan.duration", "plan.error")
