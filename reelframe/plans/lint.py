"""Quality-rule queries, and the queries that write, parse and mend real files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import lint as L
from ..operators import media as M
from ..operators import rules as U
from ..sources import containers as C
from ..sources import headers as H
from ..sources import views as V
from .registry import query

D = V.over("v_delays")
R = V.over("v_recipes")


@query("lint_timing_tiers", D + """SELECT clip, i, format, CASE format WHEN 'gif' THEN CASE WHEN ms < 20 THEN 'warn' END WHEN 'webp' THEN CASE WHEN ms <= 10 THEN 'warn' WHEN ms < 20 THEN 'info' END
 WHEN 'apng' THEN CASE WHEN ms = 0 THEN CASE WHEN clip % 2 = 0 THEN 'error' ELSE 'warn' END WHEN ms <= 10 THEN 'warn' WHEN ms < 20 THEN 'info' END END AS level FROM (SELECT clip, i, greatest(0, delay) * 3 AS ms, ['gif', 'webp', 'apng'][clip % 3 + 1] AS format FROM v_delays)""")
def lint_timing_tiers(spark, d):
    fmt = F.element_at(F.array(F.lit("gif"), F.lit("webp"), F.lit("apng")), (F.col("clip") % 3 + 1).cast("int"))
    v = V.delays(spark, d).select("clip", "i", (F.greatest(F.lit(0), "delay") * 3).alias("ms"), fmt.alias("format"))
    return v.select("clip", "i", "format", L.timing_level(F.col("format"), F.col("ms"), F.col("clip") % 2 == 0).alias("level"))


@query("lint_limits", V.over("v_blobs") + ", t AS (SELECT * FROM (VALUES ('', 0), ('emote', 262144), ('sticker', 524288), ('attachment', 20000000)) AS t(target, cap)), b AS (SELECT doc_id, size * 200 AS bytes, ['', 'emote', 'sticker', 'attachment'][doc_id % 4 + 1] AS target FROM v_blobs) SELECT doc_id, target, bytes <= cap AS ok FROM b JOIN t USING (target) WHERE cap > 0")
def lint_limits(spark, d):
    from ..functions.recipes import targets

    target = F.element_at(F.array(*map(F.lit, ["", "emote", "sticker", "attachment"])), (F.col("doc_id") % 4 + 1).cast("int"))
    b = V.blobs(spark, d).select("doc_id", (F.col("size") * 200).alias("bytes"), target.alias("target"))
    return b.join(F.broadcast(targets(spark)), "target").where("cap > 0").select("doc_id", "target", (F.col("bytes") <= F.col("cap")).alias("ok"))


@query("lint_sticker", D + """, c AS (SELECT clip, count(*) AS frames, sum(greatest(0, delay) * 60)::BIGINT AS total_ms FROM v_delays GROUP BY clip)
SELECT clip, 'sticker-duration' AS rule, total_ms <= 5000 AS ok FROM c UNION ALL SELECT clip, 'sticker-frames', frames <= 1000 FROM c UNION ALL SELECT clip, 'sticker-rate', frames * 1000 <= total_ms * 60 FROM c UNION ALL SELECT clip, 'sticker-length', total_ms > 0 OR frames <= 1 FROM c""")
def lint_sticker(spark, d):
    c = V.delays(spark, d).groupBy("clip").agg(F.count("*").alias("frames"), F.sum(F.greatest(F.lit(0), "delay") * 60).alias("total_ms"))
    return L.sticker_checks(c)


_CHECKS = "SELECT source, doc_id, unnest(['gif.disposal', 'gif.min-delay']) AS rule, unnest(['error', 'warn']) AS level, unnest([quality <> 0, toxic <> 1]) AS ok FROM documents LEFT JOIN labels USING (doc_id)"


def checks(spark, d):
    doc = V.read(spark, d, "documents").select("doc_id", "source")
    lab = V.read(spark, d, "labels").select("doc_id", "quality", "toxic")
    rows = F.array(F.struct(F.lit("gif.disposal").alias("rule"), F.lit("error").alias("level"), (F.col("quality") != 0).alias("ok")), F.struct(F.lit("gif.min-delay").alias("rule"), F.lit("warn").alias("level"), (F.col("toxic") != 1).alias("ok")))
    return doc.join(lab, "doc_id", "left").select("source", "doc_id", F.explode(rows).alias("c")).select("source", "doc_id", "c.rule", "c.level", F.coalesce("c.ok", F.lit(True)).alias("ok"))


@query("lint_report_ok", f"SELECT source, count(*) AS checks, count(*) FILTER (NOT ok AND level = 'error') AS errors, count(*) FILTER (NOT ok AND level = 'warn') AS warnings, count(*) FILTER (NOT ok AND level = 'error') = 0 AS ok FROM (SELECT source, level, coalesce(ok, true) AS ok FROM ({_CHECKS})) GROUP BY source")
def lint_report_ok(spark, d):
    return L.reports(checks(spark, d), "source")


@query("lint_rollup", f"SELECT source, rule, count(*) AS n, count(*) FILTER (NOT ok) AS failed FROM (SELECT source, rule, coalesce(ok, true) AS ok FROM ({_CHECKS})) GROUP BY ROLLUP (source, rule)")
def lint_rollup(spark, d):
    return checks(spark, d).rollup("source", "rule").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"))


_RULES = ["gif.size-limit", "gif.disposal", "webp.emote-dims", "apng.container", "static.format", "apng.sticker", "fit.target", "gif.sticker-duration"]


@query("lint_rule_class", f"SELECT rule, CASE WHEN regexp_matches(rule, 'size|limit|bytes|dims|dimension|duration|emote|sticker|fit\\.') THEN 'limit' ELSE 'structure' END AS class, count(*) AS n FROM (SELECT {V._list(_RULES)}[p_partkey % 8 + 1] AS rule FROM part) GROUP BY ALL")
def lint_rule_class(spark, d):
    rule = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return V.read(spark, d, "part").select(rule.alias("rule")).groupBy("rule", L.rule_class(F.col("rule")).alias("class")).agg(F.count("*").alias("n"))


@query("lint_disposal", D + "SELECT clip, i, x IN (1, 2) AS ok, CASE WHEN x = 0 THEN 1 ELSE x END AS fixed FROM (SELECT clip, i, abs(delay) % 5 AS x FROM v_delays)")
def lint_disposal(spark, d):
    v = V.delays(spark, d).select("clip", "i", (F.abs("delay") % 5).alias("x"))
    ok, fixed = L.disposal_fix(F.col("x"))
    return v.select("clip", "i", ok.alias("ok"), fixed.cast("long").alias("fixed"))


@query("lint_loop", R + "SELECT k1, k2, k3, k4, format, CASE WHEN q % 4 = 0 THEN NULL WHEN format = 'gif' OR n = 1 THEN 'error' ELSE 'info' END AS level FROM v_recipes WHERE format IN ('gif', 'webp', 'apng')")
def lint_loop(spark, d):
    r = V.recipes(spark, d).where(F.col("format").isin("gif", "webp", "apng"))
    return r.select("k1", "k2", "k3", "k4", "format", L.loop_check(F.col("format"), F.col("q") % 4, F.col("n") == 1).alias("level"))


@query("lint_canvas", R + "SELECT k1, count(*) AS frames, count(*) FILTER (q + box_w <= w AND n + box_h <= h) AS inside, bool_and(q + box_w <= w AND n + box_h <= h) AS ok FROM v_recipes GROUP BY k1")
def lint_canvas(spark, d):
    inside = (F.col("q") + F.col("box_w") <= F.col("w")) & (F.col("n") + F.col("box_h") <= F.col("h"))
    return V.recipes(spark, d).groupBy("k1").agg(F.count("*").alias("frames"), F.count_if(inside).alias("inside"), F.bool_and(inside).alias("ok"))


@query("lint_neighbour_delay", D + "SELECT clip, i, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY clip ORDER BY i), first_value(x IGNORE NULLS) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS delay FROM (SELECT clip, i, CASE WHEN delay % 3 <> 0 THEN delay END AS x FROM v_delays)")
def lint_neighbour_delay(spark, d):
    v = V.delays(spark, d).select("clip", "i", F.when(F.col("delay") % 3 != 0, F.col("delay")).alias("delay"))
    return L.neighbour_delay(v)


@query("lint_apng_delay", R + "SELECT DISTINCT q, n, ((q * 1000000 + d // 2) // d + 500) // 1000 AS ms FROM (SELECT q, n, CASE WHEN (n - 1) * 30 = 0 THEN 100 ELSE (n - 1) * 30 END AS d FROM v_recipes)")
def lint_apng_delay(spark, d):
    r = V.recipes(spark, d).select("q", "n").distinct()
    return r.select("q", "n", L.apng_ms(F.col("q"), (F.col("n") - 1) * 30).alias("ms"))


# -- real files: no SQL form ---------------------------------------------------------------
@query("gif_encode")
def gif_encode(spark, d):
    """A GIF a clip: palette, threshold, frames, loop; then parsed and linted."""
    return M.lint_files(M.encode_clips(V.channels(spark, d), 4, 4, "gif"), formats=("gif",)).select("clip", "rule", "level", "ok", "fixed")


@query("apng_encode")
def apng_encode(spark, d):
    return M.lint_files(M.encode_clips(V.channels(spark, d), 4, 4, "apng"), formats=("apng",)).select("clip", "rule", "level", "ok", "fixed")


@query("gif_facts")
def gif_facts(spark, d):
    return M.facts(M.encode_clips(V.channels(spark, d), 4, 4, "gif"), ("gif",)).drop("format")


@query("probe")
def probe(spark, d):
    files = M.encode_clips(V.channels(spark, d), 4, 4, "gif").unionByName(M.encode_clips(V.channels(spark, d), 4, 4, "apng"))
    return M.facts(files, ("gif", "apng"))


@query("lint_fix")
def lint_fix(spark, d):
    """Damaged GIFs are mended; the second pass changes nothing."""
    return M.fix_files(M.damage(M.encode_clips(V.channels(spark, d), 4, 4, "gif"))).select("clip", "changed", "again", "ok")


@query("dither")
def dither(spark, d):
    return M.diffuse(V.channels(spark, d), 4, 4, 2)


@query("frames_zip")
def frames_zip(spark, d):
    return M.zip_frames(V.channels(spark, d), 4, 4).select("clip", "entries", F.sha2("content", 256).alias("sha256"), "error")


# -- files made from known facts: SQL states the findings ----------------------------------
_MADE = """m AS (SELECT doc_id, doc_id % 3 + 1 AS n, doc_id // 3 % 2 AS flag, doc_id // 6 % 2 AS aflag, doc_id // 12 % 2 AS alpha, doc_id // 24 % 2 AS loops, doc_id // 48 % 2 AS meta, doc_id // 288 % 2 AS outside,
 [5, 15, 40][doc_id // 96 % 3 + 1] AS ms, 100 + doc_id % 5 * 20 AS side, ['', 'emote', 'sticker', 'attachment'][doc_id // 7 % 4 + 1] AS target FROM documents)"""


@query("webp_lint", f"""WITH {_MADE} SELECT doc_id AS clip, rule, level, ok FROM (
 SELECT doc_id, 'webp.riff' AS rule, 'error' AS level, true AS ok FROM m UNION ALL SELECT doc_id, 'webp.anim-flag', 'error', (flag = 1) = (n > 1) FROM m
 UNION ALL SELECT doc_id, 'webp.alpha-flag', 'error', aflag = alpha FROM m UNION ALL SELECT doc_id, 'webp.canvas', 'error', n = 1 OR outside = 0 FROM m
 UNION ALL SELECT doc_id, 'webp.loop-forever', CASE WHEN n > 1 AND loops = 1 AND target = '' THEN 'info' ELSE 'error' END, CASE WHEN n = 1 THEN flag = 0 ELSE loops = 0 OR target = '' END FROM m
 UNION ALL SELECT doc_id, 'webp.no-metadata', 'warn', meta = 0 FROM m UNION ALL SELECT doc_id, 'webp.min-delay', CASE WHEN n > 1 AND ms = 15 THEN 'info' ELSE 'warn' END, n = 1 OR ms = 40 FROM m
 UNION ALL SELECT doc_id, 'webp.size-limit', 'error', true FROM m WHERE target <> '' UNION ALL SELECT doc_id, 'webp.sticker', 'error', false FROM m WHERE target = 'sticker'
 UNION ALL SELECT doc_id, 'webp.emote-dims', 'warn', side <= 128 FROM m WHERE target = 'emote')""")
def webp_lint(spark, d):
    i = F.col("doc_id")

    def digit(by: int, of: int):
        return (F.floor(i / by) % of).cast("int")

    facts = [(i % 3 + 1).cast("int"), (100 + i % 5 * 20).cast("int"), F.element_at(F.array(*map(F.lit, [5, 15, 40])), digit(96, 3) + 1), digit(24, 2), *[digit(k, 2) == 1 for k in (3, 6, 12, 48, 288)]]
    target = F.element_at(F.array(*map(F.lit, ["", "emote", "sticker", "attachment"])), digit(7, 4) + 1)
    made = M.made_files(V.read(spark, d, "documents").select(i.alias("clip"), F.lit("webp").alias("format"), target.alias("target"), *[f.alias(f"f{k}") for k, f in enumerate(facts)]), lambda fmt, *f: H.animation(*f))
    return M.lint_files(made, formats=("webp",)).select("clip", "rule", "level", "ok")


_STILLS = """s AS (SELECT doc_id, ['png', 'webp', 'jpeg', 'avif'][doc_id % 4 + 1] AS format, 60 + doc_id // 4 % 40 * 10 AS w, 50 + doc_id // 9 % 30 * 10 AS h, doc_id // 4 % 2 = 1 AND doc_id % 4 <> 2 AS alpha,
 ['', 'emote', 'sticker', 'attachment'][doc_id // 5 % 4 + 1] AS target FROM documents)"""


def made_stills(spark, d):
    i = F.col("doc_id")
    one_of = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    rows = V.read(spark, d, "documents").select(
        i.alias("clip"), one_of(["png", "webp", "jpeg", "avif"], i % 4).alias("format"), one_of(["", "emote", "sticker", "attachment"], F.floor(i / 5) % 4).alias("target"),
        (60 + F.floor(i / 4) % 40 * 10).cast("int").alias("w"), (50 + F.floor(i / 9) % 30 * 10).cast("int").alias("h"), ((F.floor(i / 4) % 2 == 1) & (i % 4 != 2)).alias("alpha"),
    )
    return M.made_files(rows, H.still)


@query("static_lint", f"""WITH {_STILLS} SELECT doc_id AS clip, 'static.format' AS rule, 'info' AS level, true AS ok FROM s UNION ALL SELECT doc_id, 'static.size-limit', 'error', true FROM s WHERE target <> ''
 UNION ALL SELECT doc_id, 'static.emote-dims', 'warn', w <= 128 AND h <= 128 FROM s WHERE target = 'emote'
 UNION ALL SELECT doc_id, 'static.sticker', CASE WHEN format = 'png' AND (w > 320 OR h > 320) THEN 'warn' ELSE 'error' END, format = 'png' AND w <= 320 AND h <= 320 FROM s WHERE target = 'sticker'""")
def static_lint(spark, d):
    return M.lint_stills(made_stills(spark, d)).select("clip", "rule", "level", "ok")


@query("still_probe", f"WITH {_STILLS} SELECT doc_id AS clip, format, w::INT AS width, h::INT AS height, alpha FROM s")
def still_probe(spark, d):
    return M.still_facts(made_stills(spark, d)).select("clip", "format", "width", "height", "alpha")


_C = V.over("v_pixels")


@query("gif_decode", _C + "SELECT clip, frame_idx, count(*) FILTER (a >= 128) AS solid FROM v_pixels GROUP BY clip, frame_idx")
def gif_decode(spark, d):
    """GIFs decoded to RGBA frames again: what was solid is, after every disposal."""
    frames = M.decode_files(M.encode_clips(V.channels(spark, d), 4, 4, "gif"))
    alpha = F.substring(F.hex("rgba"), F.col("p") * 8 + 7, F.lit(2))
    return frames.select("clip", "frame_idx", "rgba", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("p")).groupBy("clip", "frame_idx").agg(F.count_if(alpha == "FF").alias("solid"))


@query("verify_files", _C + "SELECT clip, format, count(DISTINCT frame_idx)::INT AS frames, true AS ok FROM v_pixels, (VALUES ('gif'), ('apng')) AS f(format) GROUP BY clip, format")
def verify_files(spark, d):
    px = V.channels(spark, d)
    return M.verify_files(M.encode_clips(px, 4, 4, "gif").unionByName(M.encode_clips(px, 4, 4, "apng")))


@query("lint_targets", _C + """, c AS (SELECT clip, count(DISTINCT frame_idx) AS n FROM v_pixels GROUP BY clip), k AS (SELECT clip, n, f.format, t.target FROM c, (VALUES ('gif'), ('apng')) AS f(format), (VALUES ('emote'), ('sticker'), ('attachment')) AS t(target))
SELECT clip, format, target, format || '.size-limit' AS rule, 'error' AS level, true AS ok FROM k UNION ALL SELECT clip, format, target, 'gif.emote-dims', 'warn', true FROM k WHERE format = 'gif' AND target = 'emote'
 UNION ALL SELECT clip, format, target, 'gif.sticker-dims', 'warn', true FROM k WHERE format = 'gif' AND target = 'sticker' UNION ALL SELECT clip, format, target, 'gif.sticker-duration', 'error', n * 100 <= 5000 FROM k WHERE format = 'gif' AND target = 'sticker'
 UNION ALL SELECT clip, format, target, 'apng.sticker', 'error', n * 100 <= 5000 FROM k WHERE format = 'apng' AND target = 'sticker' UNION ALL SELECT clip, format, target, 'apng.not-emote', 'error', false FROM k WHERE format = 'apng' AND target = 'emote'
 UNION ALL SELECT clip, format, target, 'apng.attachment', 'info', false FROM k WHERE format = 'apng' AND target = 'attachment'""")
def lint_targets(spark, d):
    """Rules that a target adds, on real files of both formats."""
    px = V.channels(spark, d)
    files = M.encode_clips(px, 4, 4, "gif").unionByName(M.encode_clips(px, 4, 4, "apng"))
    aimed = files.withColumn("target", F.explode(F.array(*map(F.lit, ["emote", "sticker", "attachment"]))))
    found = M.lint_files(aimed, formats=("gif", "apng")).where(F.col("rule").rlike(r"\.(size-limit|emote-dims|sticker.*|not-emote|attachment)$"))
    return found.select("clip", "format", "target", "rule", "level", "ok")


# -- sound and damaged files: rules over block tables, SQL reads the same files' scripts -------
def _byte(at: int) -> str:
    return f"TRY_CAST('0x' || substr(hex, {2 * at + 1}, 2) AS INT)"


def _short(at: int) -> str:
    return f"({_byte(at)} + 256 * {_byte(at + 1)})"


def _long(at: int) -> str:
    return f"TRY_CAST('0x' || substr(hex, {2 * at + 1}, 8) AS BIGINT)"


_GIF_LINT = f"""WITH {C.scripts_sql(C.GIFS)},
b AS (SELECT *, count(*) FILTER (kind = 'image') OVER (PARTITION BY clip ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS image FROM (SELECT clip, target, ord, kind, note, len(hex) // 2 AS bytes,
  CASE kind WHEN 'header' THEN {_short(6)} WHEN 'image' THEN {_short(5)} END AS w, CASE kind WHEN 'header' THEN {_short(8)} WHEN 'image' THEN {_short(7)} END AS h, CASE kind WHEN 'image' THEN {_short(1)} + {_short(3)} END AS corner,
  CASE kind WHEN 'header' THEN {_byte(11)} END AS background, CASE kind WHEN 'header' THEN {_byte(10)} WHEN 'image' THEN {_byte(9)} END AS flags,
  CASE kind WHEN 'gce' THEN {_short(4)} END AS delay, CASE kind WHEN 'gce' THEN {_byte(3)} // 4 % 8 END AS disposal, CASE WHEN kind = 'gce' AND {_byte(3)} % 2 = 1 THEN {_byte(6)} END AS clear,
  CASE WHEN kind = 'loop' AND substr(hex, 29, 4) = '0301' THEN {_short(16)} END AS loops FROM tok)),
i AS (SELECT clip, image, count(*) FILTER (kind = 'image') = 1 AS shown, count(*) FILTER (kind = 'gce') AS controls, arg_max((delay, disposal, clear), ord) FILTER (kind = 'gce') AS c,
  any_value((w, h, corner, flags, note)) FILTER (kind = 'image') AS p FROM b GROUP BY clip, image),
im AS (SELECT clip, image, controls, c[1] AS delay, c[2] AS disposal, c[3] AS clear, p[1] AS w, p[2] AS h, p[3] AS corner, p[4] >= 128 AS local, p[4] // 64 % 2 = 1 AS interlaced, p[5] AS used FROM i WHERE shown),
f AS (SELECT clip, any_value(target) AS target, sum(bytes) AS bytes, any_value(w) FILTER (kind = 'header') AS w, any_value(h) FILTER (kind = 'header') AS h, any_value(background) AS background, any_value(flags) FILTER (kind = 'header') >= 128 AS palette,
  count(*) FILTER (kind = 'loop') AS loops, count(*) FILTER (kind = 'loop' AND image = 0) AS in_front, count(*) FILTER (kind = 'loop' AND loops IS NULL) AS odd, count(*) FILTER (loops > 0) AS finite,
  count(*) FILTER (kind IN ('comment', 'app')) AS extra, count(*) FILTER (kind = 'trailer') AS trailer, count(*) FILTER (kind = 'problem') AS problem FROM b GROUP BY clip),
g AS (SELECT clip, count(*) AS n, bool_and(controls = 1) AS even, bool_or(clear IS NOT NULL AND (used = '?' OR contains(used, clear::VARCHAR))) AS through, coalesce(bool_and(disposal IN (1, 2)), true) AS kept, coalesce(max(disposal), 0) < 3 AS mendable, list(clear) FILTER (clear IS NOT NULL) AS clears,
  coalesce(min(delay), 9) >= 2 AS slow, coalesce(sum(delay), 0) AS cs, bool_or(local) AS local, bool_and(local) AS all_local, bool_or(interlaced) AS interlaced, arg_min((clear, w, h, corner, used, local), image) AS f0 FROM im GROUP BY clip),
d AS (SELECT clip, count(*) FILTER (NOT shown AND controls > 0) AS dangling FROM i GROUP BY clip),
x AS (SELECT f.*, coalesce(n, 0) AS n, even, through, kept, mendable, coalesce(clears, []) AS clears, slow, coalesce(cs, 0) AS cs, coalesce(local, false) AS local, coalesce(all_local, true) AS all_local, coalesce(interlaced, false) AS interlaced, f0[1] AS clear0, f0[5] AS used0, f0[6] AS local0, dangling,
  f0[1] IS NULL AND (through OR f0[2] <> w OR f0[3] <> h OR f0[4] <> 0) AS missing FROM f LEFT JOIN g USING (clip) JOIN d USING (clip)),
r AS (SELECT *, unnest([
  {{rule: 'gif.gce-every-frame', level: 'error', ok: n > 0 AND coalesce(even, false), fixed: n > 0, shown: true}},
  {{rule: 'gif.frame0-transparency', level: 'error', ok: NOT missing, fixed: missing AND palette AND NOT local0 AND used0 <> '?' AND len(used0) < 4, shown: n > 0}},
  {{rule: 'gif.lsd-background-index', level: 'error', ok: CASE WHEN clear0 IS NOT NULL THEN background = clear0 ELSE NOT list_contains(clears, background) END, fixed: true, shown: true}},
  {{rule: 'gif.disposal', level: 'error', ok: coalesce(kept, true), fixed: coalesce(mendable, true), shown: true}},
  {{rule: 'gif.netscape-loop', level: 'error', ok: in_front > 0 AND odd = 0 AND (target = '' OR finite = 0), fixed: true, shown: true}},
  {{rule: 'gif.min-delay', level: 'warn', ok: coalesce(slow, true), fixed: true, shown: true}},
  {{rule: 'gif.global-palette', level: CASE WHEN target <> '' OR (NOT palette AND NOT all_local) THEN 'error' ELSE 'warn' END, ok: (palette OR all_local) AND NOT local, fixed: false, shown: true}},
  {{rule: 'gif.no-interlace', level: 'warn', ok: NOT interlaced, fixed: false, shown: true}},
  {{rule: 'gif.no-extra-extensions', level: 'info', ok: extra + dangling = 0, fixed: true, shown: true}},
  {{rule: 'gif.first-frame-visible', level: 'warn', ok: clear0 IS NULL OR used0 <> clear0::VARCHAR, fixed: false, shown: n > 0 AND (clear0 IS NULL OR used0 <> '?')}},
  {{rule: 'gif.trailer', level: 'error', ok: trailer > 0, fixed: true, shown: true}},
  {{rule: 'gif.size-limit', level: 'error', ok: bytes <= 262144, fixed: false, shown: target <> ''}},
  {{rule: 'gif.emote-dims', level: 'warn', ok: w <= 128 AND h <= 128, fixed: false, shown: target = 'emote'}},
  {{rule: 'gif.sticker-dims', level: 'warn', ok: w <= 320 AND h <= 320, fixed: false, shown: target = 'sticker'}},
  {{rule: 'gif.sticker-duration', level: 'error', ok: cs <= 500 AND (CASE WHEN cs > 0 THEN n * 100 <= 60 * cs ELSE n <= 1 END), fixed: false, shown: target = 'sticker'}}]) AS c FROM x)
SELECT clip, target, 'gif.container' AS rule, 'error' AS level, problem = 0 AS ok, false AS fixed FROM f
UNION ALL SELECT clip, target, c.rule, c.level, c.ok, c.fixed FROM r WHERE problem = 0 AND c.shown"""


@query("gif_lint", _GIF_LINT)
def gif_lint(spark, d):
    """All rules of sound and damaged GIFs, from their block table."""
    return U.gif_rules(B.gif_blocks(C.gifs(spark, d))).drop("format")


_PNG_STEPS = f"""WITH RECURSIVE {C.scripts_sql(C.PNGS)},
t AS (SELECT clip, ord, CASE WHEN kind = 'raw' THEN CASE WHEN len(hex) < 16 THEN 'stray' ELSE 'cut' END ELSE kind END AS kind, note, len(hex) // 2 AS size, hex, max(CASE WHEN kind = 'IEND' THEN ord END) OVER (PARTITION BY clip) AS last FROM tok),
s AS (SELECT clip, -1::BIGINT AS ord, NULL::BIGINT AS colour, false AS head, NULL::BIGINT AS palette, NULL::BIGINT AS key, NULL::BIGINT AS control, 0::BIGINT AS frames, false AS def, 0::BIGINT AS filled, 0::BIGINT AS idat, 0::BIGINT AS fdat, false AS ended, 0::BIGINT AS parts, 0::BIGINT AS nxt, []::VARCHAR[] AS codes FROM files
UNION ALL SELECT s.clip, t.ord,
  CASE WHEN t.kind = 'IHDR' AND size = 13 AND NOT head THEN {_byte(9)} ELSE colour END, head OR (t.kind = 'IHDR' AND size = 13),
  CASE WHEN t.kind = 'PLTE' AND palette IS NULL THEN CASE WHEN size % 3 = 0 AND size BETWEEN 1 AND 768 THEN size // 3 ELSE 0 END ELSE palette END,
  CASE WHEN t.kind = 'tRNS' AND key IS NULL THEN size ELSE key END, CASE WHEN t.kind = 'acTL' AND size = 8 AND control IS NULL THEN {_long(0)} ELSE control END,
  frames + (t.kind = 'fcTL' AND size = 26)::INT, CASE WHEN t.kind = 'fcTL' AND size = 26 THEN idat = 0 ELSE def END,
  CASE WHEN t.kind = 'fcTL' AND size = 26 THEN 0 WHEN t.kind = 'IDAT' AND frames > 0 AND def OR t.kind = 'fdAT' AND size >= 4 AND frames > 0 AND NOT def THEN filled + 1 ELSE filled END,
  idat + (t.kind = 'IDAT')::INT, fdat + (t.kind = 'fdAT')::INT, ended OR t.kind = 'IEND', parts + (t.kind NOT IN ('stray', 'cut'))::INT,
  CASE WHEN t.kind = 'fcTL' AND size = 26 OR t.kind = 'fdAT' AND size >= 4 THEN {_long(0)} + 1 ELSE nxt END,
  codes || list_filter([
    CASE WHEN note = 'x' THEN 'crc' END, CASE WHEN t.kind IN ('stray', 'cut') THEN t.kind END,
    CASE t.kind WHEN 'IHDR' THEN CASE WHEN head THEN 'ihdr-again' WHEN size <> 13 THEN 'ihdr-size' END WHEN 'PLTE' THEN CASE WHEN palette IS NOT NULL THEN 'plte-again' WHEN idat > 0 THEN 'plte-late' END WHEN 'tRNS' THEN CASE WHEN key IS NOT NULL THEN 'trns-again' WHEN idat > 0 THEN 'trns-late' END
      WHEN 'acTL' THEN CASE WHEN control IS NOT NULL THEN 'actl-again' WHEN idat > 0 THEN 'actl-late' END WHEN 'fcTL' THEN CASE WHEN size <> 26 THEN 'fctl-size' WHEN idat = 0 AND frames > 0 THEN 'fctl-again' END
      WHEN 'fdAT' THEN CASE WHEN size < 4 THEN 'fdat-size' WHEN frames = 0 THEN 'fdat-early' WHEN def THEN 'fdat-default' END WHEN 'IDAT' THEN CASE WHEN fdat > 0 THEN 'idat-late' END END,
    CASE WHEN t.kind = 'IHDR' AND NOT head AND t.ord > 0 THEN 'ihdr-place' END,
    CASE WHEN t.kind = 'IHDR' AND NOT head AND size = 13 AND ({_long(0)} NOT BETWEEN 1 AND 2147483647 OR {_long(4)} NOT BETWEEN 1 AND 2147483647) THEN 'ihdr-dimensions' END,
    CASE WHEN t.kind = 'IHDR' AND NOT head AND size = 13 AND NOT list_contains([8, 1008, 2008, 3008, 4008, 6008, 16, 2016, 4016, 6016, 1, 2, 4, 3001, 3002, 3004], 1000 * {_byte(9)} + {_byte(8)}) THEN 'ihdr-depth' END,
    CASE WHEN t.kind = 'IHDR' AND NOT head AND size = 13 AND {_byte(10)} + {_byte(11)} > 0 THEN 'ihdr-method' END, CASE WHEN t.kind = 'IHDR' AND NOT head AND size = 13 AND {_byte(12)} > 1 THEN 'ihdr-interlace' END,
    CASE WHEN t.kind = 'PLTE' AND palette IS NULL AND key IS NOT NULL AND colour = 3 THEN 'plte-behind-trns' END, CASE WHEN t.kind = 'PLTE' AND palette IS NULL AND (size % 3 > 0 OR size NOT BETWEEN 1 AND 768) THEN 'plte-size' END,
    CASE WHEN t.kind = 'acTL' AND control IS NULL THEN CASE WHEN size <> 8 THEN 'actl-size' WHEN {_long(0)} = 0 THEN 'actl-empty' END END,
    CASE WHEN t.kind = 'fcTL' AND size = 26 AND {_byte(24)} > 2 THEN 'fctl-dispose' END, CASE WHEN t.kind = 'fcTL' AND size = 26 AND {_byte(25)} > 1 THEN 'fctl-blend' END,
    CASE WHEN (t.kind = 'fcTL' AND size = 26 OR t.kind = 'fdAT' AND size >= 4) AND {_long(0)} <> nxt THEN 'sequence' END,
    CASE WHEN (t.kind = 'fcTL' AND size = 26 OR t.kind = 'IEND') AND frames > 0 AND filled = 0 THEN 'frame-empty' END], lambda c: c IS NOT NULL)
  FROM s JOIN t ON t.clip = s.clip AND t.ord = s.ord + 1 WHERE NOT s.ended),
e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY clip ORDER BY ord DESC) = 1)"""


@query("png_grammar", _PNG_STEPS + """ SELECT clip, unnest(list_sort(list_distinct(codes || list_filter([
  CASE WHEN parts = 0 THEN 'no-chunks' WHEN NOT head THEN 'no-ihdr' END, CASE WHEN idat = 0 THEN 'no-idat' END, CASE WHEN NOT ended THEN 'no-iend' END, CASE WHEN NOT ended AND frames > 0 AND filled = 0 THEN 'frame-empty' END,
  CASE WHEN colour = 3 AND palette IS NULL THEN 'palette-missing' WHEN colour = 3 AND key > palette THEN 'trns-long' WHEN colour = 0 AND key <> 2 OR colour = 2 AND key <> 6 THEN 'trns-size' WHEN colour IN (4, 6) AND key IS NOT NULL THEN 'trns-alpha' END,
  CASE WHEN control <> frames THEN 'actl-count' WHEN control IS NULL AND frames + fdat > 0 THEN 'no-actl' END], lambda c: c IS NOT NULL)))) AS code FROM e""")
def png_grammar(spark, d):
    """Every structural problem of sound and damaged PNGs and APNGs; SQL walks the chunks as an automaton."""
    return U.png_problems(B.png_parts(C.pngs(spark, d))).select("clip", "code")


@query("apng_lint", _PNG_STEPS + f""", u AS (SELECT s.clip, s.ord, t.hex FROM t JOIN s ON s.clip = t.clip AND s.ord = t.ord AND t.kind = 'fcTL' AND t.size = 26),
w AS (SELECT clip, any_value({_long(0)}) AS w, any_value({_long(4)}) AS h FROM (SELECT clip, hex FROM t WHERE kind = 'IHDR' AND size = 13 QUALIFY row_number() OVER (PARTITION BY clip ORDER BY ord) = 1) GROUP BY clip),
r AS (SELECT s.clip, row_number() OVER (PARTITION BY s.clip ORDER BY u.ord) AS n, {_long(4)} AS rw, {_long(8)} AS rh, {_long(12)} AS x, {_long(16)} AS y, 256 * {_byte(20)} + {_byte(21)} AS num, CASE WHEN 256 * {_byte(22)} + {_byte(23)} = 0 THEN 100 ELSE 256 * {_byte(22)} + {_byte(23)} END AS den, s.def FROM u JOIN s USING (clip, ord)),
k AS (SELECT clip, bool_or(rw = 0 OR rh = 0 OR x + rw > coalesce(w, 0) OR y + rh > coalesce(h, 0) OR (def AND (x > 0 OR y > 0 OR rw <> w OR rh <> h))) AS outside, bool_or(num = 0) AS zero, min(((num * 1000000 + den // 2) // den + 500) // 1000) AS ms, sum((num * 1000000 + den // 2) // den) AS us, bool_or(n = 1 AND def) AS leads FROM r LEFT JOIN w USING (clip) GROUP BY clip),
p AS (SELECT clip, target, e.*, coalesce(w, 0) AS w, coalesce(h, 0) AS h, coalesce(outside, false) AS outside, coalesce(zero, false) AS zero, coalesce(ms, 20) AS ms, coalesce(us, 0) AS us, coalesce(leads, false) AS leads, control IS NOT NULL AS moving, greatest(frames, 1) AS shown,
  (SELECT substr(any_value(hex), 9, 8) FROM t WHERE t.clip = files.clip AND t.kind = 'acTL' AND t.size = 8) <> '00000000' AS counted FROM files JOIN e USING (clip) LEFT JOIN k USING (clip) LEFT JOIN w USING (clip)),
q AS (SELECT *, (us + 500) // 1000 <= 5000 AND shown <= 1000 AND CASE WHEN us > 0 THEN shown * 1000000 <= 60 * us ELSE shown <= 1 END AS timed, w <= 320 AND h <= 320 AS fits FROM p),
v AS (SELECT clip, target, unnest([
  {{rule: 'apng.plays-forever', level: CASE WHEN moving AND counted AND target = '' THEN 'info' ELSE 'error' END, ok: NOT moving OR NOT counted OR target = '', shown: true}}, {{rule: 'apng.first-frame', level: 'warn', ok: NOT moving OR leads, shown: true}},
  {{rule: 'apng.canvas', level: 'error', ok: w > 0 AND h > 0 AND NOT outside, shown: true}},
  {{rule: 'apng.min-delay', level: CASE WHEN NOT moving OR frames = 0 OR zero OR ms >= 20 THEN CASE WHEN target = 'sticker' THEN 'error' ELSE 'warn' END WHEN ms <= 10 THEN 'warn' ELSE 'info' END, ok: NOT moving OR frames = 0 OR ms >= 20, shown: true}},
  {{rule: 'apng.indexed', level: 'info', ok: coalesce(colour = 3, false) AND palette IS NOT NULL AND key IS NOT NULL, shown: true}}, {{rule: 'apng.size-limit', level: 'error', ok: true, shown: target <> ''}},
  {{rule: 'apng.sticker', level: CASE WHEN timed AND NOT fits THEN 'warn' ELSE 'error' END, ok: timed AND fits, shown: target = 'sticker'}}, {{rule: 'apng.not-emote', level: 'error', ok: NOT moving, shown: target = 'emote'}},
  {{rule: 'apng.attachment', level: 'info', ok: NOT moving, shown: target = 'attachment'}}]) AS c FROM q)
SELECT clip, target, c.rule, c.level, c.ok FROM v WHERE c.shown""")
def apng_lint(spark, d):
    """Rules of sound and damaged APNGs, from their chunk table; the container's own problems are png_grammar's."""
    return U.png_rules(B.png_parts(C.pngs(spark, d))).where("rule <> 'apng.container'").select("clip", "target", "rule", "level", "ok")


@query("gif_transparency", f"""WITH {C.scripts_sql(C.GIFS)}, i AS (SELECT *, count(*) FILTER (kind = 'image') OVER (PARTITION BY clip ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS image FROM tok),
f AS (SELECT clip, target, image, arg_max(CASE WHEN {_byte(3)} % 2 = 1 THEN {_byte(6)} ELSE -1 END, ord) FILTER (kind = 'gce') AS clear, any_value(note) FILTER (kind = 'image') AS used, any_value(substr(hex, 3, 16)) FILTER (kind = 'image') AS rect FROM i GROUP BY clip, target, image)
SELECT clip, target, count(*) FILTER (clear >= 0 AND contains(used, clear::VARCHAR)) AS certain, count(*) FILTER (clear >= 0 AND used = '?') AS assumed, arg_min(rect, image) <> '0000000004000200' AS uncovered,
 count(*) FILTER (clear >= 0 AND (used = '?' OR contains(used, clear::VARCHAR))) > 0 OR arg_min(rect, image) <> '0000000004000200' AS transparent FROM f WHERE rect IS NOT NULL GROUP BY clip, target""")
def gif_transparency(spark, d):
    """Which frames see through the canvas, surely or as far as they can be read, and whether the first leaves some of it out."""
    return U.transparency(B.gif_blocks(C.gifs(spark, d))).drop("format")


_RECTS = "f AS (SELECT l_orderkey AS clip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, l_partkey % 7 - 1 AS x, l_suppkey % 5 - 1 AS y, l_partkey % 5 + CASE WHEN l_linenumber = 1 THEN 5 ELSE 1 END AS w, l_quantity::BIGINT % 4 + CASE WHEN l_linenumber = 1 THEN 3 ELSE 1 END AS h, (l_quantity::BIGINT + l_suppkey) % 4 AS disposal FROM lineitem)"


@query("canvas_coverage", f"""WITH {_RECTS}, p AS (SELECT f.*, px, py FROM f, (SELECT unnest(range(8)) AS px), (SELECT unnest(range(6)) AS py)),
e AS (SELECT *, px >= x AND px < x + w AND py >= y AND py < y + h AS hit FROM p),
s AS (SELECT *, last_value(CASE WHEN hit AND disposal <> 3 THEN disposal <> 2 END IGNORE NULLS) OVER (PARTITION BY clip, px, py ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT clip, i AS frame_idx, count(*) FILTER (NOT hit AND NOT coalesce(before, false)) AS uncovered FROM s GROUP BY clip, i""")
def canvas_coverage(spark, d):
    """An order's lines as frames of 8 x 6 pixels: the area that shows through while each is up; SQL counts pixels."""
    from pyspark.sql import Window

    q, first = F.col("l_quantity").cast("long"), F.col("l_linenumber") == 1
    line = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    # A frame has about ten cells.
    frames = V.placed(line, "clip", V.ROWS // 5).select(
        "clip", (F.row_number().over(Window.partitionBy("clip").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1).cast("long").alias("frame_idx"),
        (F.col("l_partkey") % 7 - 1).alias("x"), (F.col("l_suppkey") % 5 - 1).alias("y"), (F.col("l_partkey") % 5 + F.when(first, 5).otherwise(1)).alias("w"), (q % 4 + F.when(first, 3).otherwise(1)).alias("h"),
        ((q + F.col("l_suppkey")) % 4).alias("disposal"), F.lit(8).cast("long").alias("width"), F.lit(6).cast("long").alias("height"),
    )
    return U.coverage(frames)
