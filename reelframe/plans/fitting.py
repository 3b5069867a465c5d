"""Fit-to-size queries: ladders, knobs, search, winners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fit as T
from ..sources import views as V
from .registry import query

C = V.over("v_curve")
R = V.over("v_recipes")
_TARGET = "(clip % 7 + 2) * 500000"


def _target():
    return (F.col("clip") % 7 + 2) * 500000


@query("fit_budget", R + "SELECT DISTINCT q * 10007 AS target, floor(q * 10007 * 0.98::DOUBLE)::BIGINT AS most, ceil(q * 10007 * 0.96::DOUBLE)::BIGINT AS least FROM v_recipes")
def fit_budget(spark, d):
    t = V.recipes(spark, d).select((F.col("q") * 10007).alias("target")).distinct()
    most, least = T.budget(F.col("target"))
    return t.select("target", most.alias("most"), least.alias("least"))


@query("fit_target", V.over("v_blobs") + """, t AS (SELECT * FROM (VALUES ('', 0), ('emote', 262144), ('sticker', 524288), ('attachment', 20000000)) AS t(target, cap)), b AS (SELECT doc_id, size * 400 AS fit, ['', 'emote', 'sticker', 'attachment'][doc_id % 4 + 1] AS target FROM v_blobs)
SELECT doc_id, CASE WHEN cap = 0 THEN fit ELSE least(fit, cap) END AS bytes FROM b JOIN t USING (target)""")
def fit_target(spark, d):
    target = F.element_at(F.array(*map(F.lit, ["", "emote", "sticker", "attachment"])), (F.col("doc_id") % 4 + 1).cast("int"))
    b = V.blobs(spark, d).select("doc_id", (F.col("size") * 400).alias("fit"), target.alias("target"))
    return T.clamp_to_target(b).select("doc_id", "bytes")


_OUT = C + f""", s AS (SELECT clip, rung, base, floor({_TARGET} * 0.98::DOUBLE)::BIGINT AS most, base * 880 // 1000 AS mild, base * 400 // 1000 AS harsh FROM v_curve),
o AS (SELECT *, CASE WHEN mild <= most THEN 'mild' WHEN harsh > most THEN 'skipped' ELSE 'refine' END AS outcome FROM s)
"""


@query("rung_outcome", _OUT + "SELECT clip, rung, mild, harsh, outcome FROM o")
def rung_outcome(spark, d):
    """Knobs 30 and 150 are the probes of a rung: fits at once, can't fit, or lies between."""
    return T.rung_outcomes(V.curve(spark, d), _target()).select("clip", "rung", "mild", "harsh", "outcome")


_BEST = "min(rung) FILTER (outcome <> 'skipped') OVER (PARTITION BY clip)"


@query("fit_winner", _OUT + f", w AS (SELECT clip, rung, outcome, {_BEST} AS best FROM o) SELECT clip, rung, CASE WHEN rung = best THEN 'best' ELSE 'alternative' END AS role FROM w WHERE outcome <> 'skipped' AND rung <= best + 2")
def fit_winner(spark, d):
    return T.winners(T.rung_outcomes(V.curve(spark, d), _target())).select("clip", "rung", "role")


@query("fit_fallback", _OUT + ", n AS (SELECT clip FROM o GROUP BY clip HAVING bool_and(outcome = 'skipped')) SELECT clip, rung, harsh FROM (SELECT clip, rung, harsh, row_number() OVER (PARTITION BY clip ORDER BY rung % 3 = 0, harsh, rung) AS r FROM o JOIN n USING (clip)) WHERE r = 1")
def fit_fallback(spark, d):
    """Where nothing fits: structurally sound first, then fewest bytes."""
    o = T.rung_outcomes(V.curve(spark, d), _target())
    return T.fallback(o.withColumn("sound", F.col("rung") % 3 != 0)).select("clip", "rung", "harsh")


_LIST = "coalesce(string_agg(rung::VARCHAR, ',' ORDER BY rung) FILTER ({} AND rung <= ends AND rung IS DISTINCT FROM best), '')"


@query("fit_trace", _OUT + f""", t AS (SELECT clip, rung, harsh, rung % 3 <> 0 AS sound, CASE WHEN (clip + rung) % 5 = 0 THEN 'failed' ELSE outcome END AS outcome FROM o),
e AS (SELECT *, least(coalesce(min(rung) FILTER (outcome IN ('mild', 'refine')) OVER w + 2, 99), max(rung) OVER w) AS ends, min(rung) FILTER (outcome IN ('mild', 'refine')) OVER w AS best FROM t WINDOW w AS (PARTITION BY clip))
SELECT clip, any_value(best) AS best, {_LIST.format("outcome IN ('mild', 'refine')")} AS alternatives, {_LIST.format("outcome = 'skipped'")} AS skipped, {_LIST.format("outcome = 'failed'")} AS failed, 'fit.target' AS rule, any_value(best) IS NOT NULL AS ok,
 CASE WHEN any_value(best) IS NULL THEN arg_min(rung, (NOT sound, harsh, rung)) FILTER (outcome <> 'failed') END AS fallback FROM e GROUP BY clip""")
def fit_trace(spark, d):
    """What a search reports inside its window, and the rule that blocks where nothing fits; every fifth rung fails."""
    o = T.rung_outcomes(V.curve(spark, d), _target()).withColumn("sound", F.col("rung") % 3 != 0)
    out = T.trace(o.withColumn("outcome", F.when((F.col("clip") + F.col("rung")) % 5 == 0, "failed").otherwise(F.col("outcome"))))
    return out.select("clip", "best", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("alternatives", "skipped", "failed")], "rule", "ok", "fallback")


_BYTES = "(base * (1000 - 4 * {k}) // 1000)"
_SEARCH = C + f""", start AS (SELECT clip, rung, base, floor({_TARGET} * 0.98::DOUBLE)::BIGINT AS most, ceil({_TARGET} * 0.96::DOUBLE)::BIGINT AS least FROM v_curve),
probed AS (SELECT *, (ln(greatest(1, most)::DOUBLE) + ln(greatest(1, least)::DOUBLE)) / 2 AS aim, {_BYTES.format(k=30)} AS soft, {_BYTES.format(k=150)} AS hard FROM start),
rounds AS (SELECT clip, rung, base, most, least, aim, 30::BIGINT AS lo, ln(greatest(1, soft)::DOUBLE) - aim AS lo_gap, 150::BIGINT AS hi, ln(greatest(1, hard)::DOUBLE) - aim AS hi_gap, '' AS moved, 150::BIGINT AS knob, hard AS bytes, 0 AS tried FROM probed WHERE soft > most AND hard <= most
UNION ALL SELECT clip, rung, base, most, least, aim, CASE WHEN big THEN k ELSE lo END, CASE WHEN big THEN gap WHEN moved = 'under' THEN lo_gap / 2 ELSE lo_gap END, CASE WHEN big THEN hi ELSE k END, CASE WHEN NOT big THEN gap WHEN moved = 'over' THEN hi_gap / 2 ELSE hi_gap END, CASE WHEN big THEN 'over' ELSE 'under' END,
 CASE WHEN NOT big AND (size > bytes OR (size = bytes AND k < knob)) THEN k ELSE knob END, CASE WHEN NOT big AND size > bytes THEN size ELSE bytes END, tried + 1
 FROM (SELECT *, size > most AS big, ln(greatest(1, size)::DOUBLE) - aim AS gap FROM (SELECT *, {_BYTES.format(k='k')} AS size FROM (SELECT *, least(hi - 1, greatest(lo + 1, lo + floor((CASE WHEN lo_gap > hi_gap THEN lo_gap / (lo_gap - hi_gap) ELSE 0.5::DOUBLE END) * (hi - lo) + 0.5::DOUBLE)::BIGINT)) AS k FROM rounds WHERE hi - lo > 1 AND bytes < least AND tried < 5)))),
ends AS (SELECT clip, rung, max({{'tried': tried, 'knob': knob, 'bytes': bytes}}) AS e FROM rounds GROUP BY clip, rung)
SELECT p.clip, p.rung, CASE WHEN soft <= most THEN 30 ELSE e.knob END AS knob, CASE WHEN soft <= most THEN soft ELSE e.bytes END AS bytes, CASE WHEN soft <= most THEN 1 ELSE 2 + coalesce(e.tried, 0) END AS encodes FROM probed p LEFT JOIN ends USING (clip, rung)"""


@query("secant_refine", _SEARCH.replace("WITH ", "WITH RECURSIVE ", 1))
def secant_refine(spark, d):
    return T.search(V.curve(spark, d), _target()).select("clip", "rung", "knob", "bytes", "encodes")


_LADDERS = ", ".join("('%s', %d, %s, %s, %s, %s)" % (name, i, *(("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else v) for v in rung)) for name, rungs in T.LADDERS.items() for i, rung in enumerate(rungs))
_LADDER_TABLE = f"ladders AS (SELECT ladder, idx, fps::DOUBLE AS fps, colors::INT AS colors, px::INT AS px, dither FROM (VALUES {_LADDERS}) AS t(ladder, idx, fps, colors, px, dither))"


_ASKED = f"asked AS (SELECT o_orderkey AS job, {V._list(list(T.LADDERS))}[o_custkey % 5 + 1] AS ladder, o_orderkey % 2 = 0 AS keep_size, o_custkey % 3 = 0 AS keep_fps, CASE WHEN o_custkey % 4 > 0 THEN 16 + o_orderkey % 241 END AS most FROM orders)"


def asked(spark, d):
    """An order asks for a ladder: job, ladder, keep_size, keep_fps, most (colours, null for no limit)."""
    o = V.read(spark, d, "orders")
    ladder = F.element_at(F.array(*map(F.lit, T.LADDERS)), (F.col("o_custkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("job"), ladder.alias("ladder"), (F.col("o_orderkey") % 2 == 0).alias("keep_size"), (F.col("o_custkey") % 3 == 0).alias("keep_fps"), F.when(F.col("o_custkey") % 4 > 0, 16 + F.col("o_orderkey") % 241).alias("most"))


def chosen(spark, d):
    """The rungs of the ladder that each order asks for; the ladders are a table of fixed size."""
    return asked(spark, d).join(F.broadcast(T.ladders(spark)), "ladder")


@query("ladder_preset", f"WITH {_LADDER_TABLE}, {_ASKED} SELECT job, ladder, idx, fps, colors, px, dither FROM asked JOIN ladders USING (ladder)")
def ladder_preset(spark, d):
    return chosen(spark, d).select("job", "ladder", "idx", "fps", "colors", "px", "dither")


@query("ladder_realise", R + f", m AS (SELECT DISTINCT fps AS mfps, greatest(w, h) AS side FROM v_recipes), {_LADDER_TABLE} SELECT mfps, side, ladder, idx, CASE WHEN fps < mfps - 1e-6 THEN fps END AS fps, colors, CASE WHEN px < side THEN px END AS px FROM m, ladders WHERE ladder = 'emote_gif'")
def ladder_realise(spark, d):
    """A ladder for a master: no rate above its own, no size above its longer side. The ladder is a table of fixed size."""
    m = V.recipes(spark, d).select(F.col("fps").alias("mfps"), F.greatest("w", "h").alias("side")).distinct()
    return T.realise(m, "emote_gif").select("mfps", "side", "ladder", "idx", "fps", "colors", "px")


@query("ladder_dedupe", R + f", m AS (SELECT DISTINCT fps AS mfps, greatest(w, h) AS side FROM v_recipes), {_LADDER_TABLE}, r AS (SELECT mfps, side, idx, CASE WHEN fps < mfps - 1e-6 THEN fps END AS fps, colors, CASE WHEN px < side THEN px END AS px, dither FROM m, ladders WHERE ladder = 'emote_webp') SELECT mfps, side, min(idx) AS idx, fps, px FROM r GROUP BY mfps, side, fps, colors, px, dither")
def ladder_dedupe(spark, d):
    m = V.recipes(spark, d).select(F.col("fps").alias("mfps"), F.greatest("w", "h").alias("side")).distinct()
    return T.distinct_rungs(T.realise(m, "emote_webp"), ["mfps", "side"]).select("mfps", "side", "idx", "fps", "px")


_LABEL = "(SELECT CASE WHEN l = '' THEN 'master settings' ELSE l END FROM (SELECT concat_ws(' · ', CASE WHEN fps IS NOT NULL THEN (CASE WHEN fps = floor(fps) THEN fps::BIGINT::VARCHAR ELSE fps::VARCHAR END) || ' fps' END, colors || ' colours', px || ' px') AS l))"


@query("ladder_filter", f"WITH {_LADDER_TABLE}, {_ASKED}, k AS (SELECT job, ladder, idx, CASE WHEN NOT keep_fps THEN fps END AS fps, CASE WHEN most IS NULL OR colors < most THEN colors END AS colors, CASE WHEN NOT keep_size THEN px END AS px, dither FROM asked JOIN ladders USING (ladder)), u AS (SELECT job, ladder, min(idx) AS idx, fps, colors, px, dither FROM k GROUP BY ALL) SELECT job, ladder, idx, fps, colors, px, {_LABEL} AS label FROM u")
def ladder_filter(spark, d):
    """Keep the size, keep the rate, clamp colours to the user's own: rungs that then agree fall together and get new labels."""
    return T.filtered(chosen(spark, d)).select("job", "ladder", "idx", "fps", "colors", "px", T.label(F.col("fps"), F.col("colors"), F.col("px")).alias("label"))


@query("ladder_generic", R + """, m AS (SELECT DISTINCT fps AS mfps FROM v_recipes), x AS (SELECT mfps, 0 AS part, 0 AS k, NULL::DOUBLE AS fps, NULL::INT AS colors, 1.0::DOUBLE AS scale FROM m
UNION ALL SELECT mfps, 1, k, f, NULL, 1.0 FROM m, (VALUES (0, 30.0), (1, 24.0), (2, 20.0), (3, 15.0)) AS v(k, f) WHERE f < mfps
UNION ALL SELECT mfps, 2, k, least(15.0, mfps), c, 1.0 FROM m, (VALUES (0, 128), (1, 64)) AS v(k, c) UNION ALL SELECT mfps, 3, k, least(15.0, mfps), 64, s FROM m, (VALUES (0, 0.75), (1, 0.5)) AS v(k, s))
SELECT mfps, row_number() OVER (PARTITION BY mfps ORDER BY part, k) - 1 AS idx, fps::DOUBLE AS fps, colors, scale::DOUBLE AS scale FROM x""")
def ladder_generic(spark, d):
    return T.generic_ladder(V.recipes(spark, d).select(F.col("fps").alias("mfps")).distinct())


@query("ladder_select", R + "SELECT format, target, CASE WHEN target = 'emote' AND format = 'gif' THEN 'emote_gif' WHEN target = 'emote' AND format IN ('webp', 'avif') THEN 'emote_webp' WHEN target = 'sticker' AND format = 'apng' THEN 'sticker_apng' WHEN target = 'sticker' AND format = 'gif' THEN 'sticker_gif' ELSE 'generic' END AS ladder, count(*) AS n FROM (SELECT format, ['emote', 'sticker', ''][n % 3 + 1] AS target FROM v_recipes) GROUP BY ALL")
def ladder_select(spark, d):
    target = F.element_at(F.array(F.lit("emote"), F.lit("sticker"), F.lit("")), (F.col("n") % 3 + 1).cast("int"))
    r = V.recipes(spark, d).select("format", target.alias("target"))
    return r.select("format", "target", T.ladder_for(F.col("target"), F.col("format")).alias("ladder")).groupBy("format", "target", "ladder").agg(F.count("*").alias("n"))


@query("ladder_optimize", R + "SELECT q, drop_n, colors FROM (SELECT DISTINCT q FROM v_recipes), (VALUES (0), (3), (2)) AS a(drop_n), (VALUES (256), (128), (64)) AS b(colors) WHERE colors = 256 OR colors < q * 5")
def ladder_optimize(spark, d):
    """Drop rates by palette sizes below the source's; both lists are of fixed length."""
    r = V.recipes(spark, d).select("q").distinct()
    r = r.select("q", F.explode(F.array(F.lit(0), F.lit(3), F.lit(2))).alias("drop_n")).select("q", "drop_n", F.explode(F.array(F.lit(256), F.lit(128), F.lit(64))).alias("colors"))
    return r.where((F.col("colors") == 256) | (F.col("colors") < F.col("q") * 5))


_KNOBS = ", ".join(f"('{f}', {', '.join(map(str, k))})" for f, k in T.KNOBS.items())


@query("knob_table", f"SELECT o_orderkey AS job, k.* FROM (SELECT o_orderkey, {V._list(list(T.KNOBS))}[o_orderkey % 7 + 1] AS format FROM orders) JOIN (SELECT * FROM (VALUES {_KNOBS}) AS t(format, lo, hi, mild, harsh)) k USING (format)")
def knob_table(spark, d):
    """The knob of each order's format."""
    fmt = F.element_at(F.array(*map(F.lit, T.KNOBS)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return V.read(spark, d, "orders").select(F.col("o_orderkey").alias("job"), fmt.alias("format")).join(F.broadcast(T.knobs(spark)), "format").select("job", "format", "lo", "hi", "mild", "harsh")


@query("knob_colour_steps", R + "SELECT DISTINCT c AS colors, CASE WHEN c > 64 THEN ceil(log2((c + 1) / 65.0))::INT ELSE 0 END AS steps FROM (SELECT q * 5 + 2 AS c FROM v_recipes)")
def knob_colour_steps(spark, d):
    r = V.recipes(spark, d).select((F.col("q") * 5 + 2).alias("colors")).distinct()
    return r.select("colors", T.colour_steps(F.col("colors")).cast("int").alias("steps"))


@query("knob_anchor", R + "SELECT DISTINCT format, q, CASE WHEN mild > 200 THEN 200 ELSE mild END AS mild, CASE WHEN 150 <= mild THEN 200 ELSE 150 END AS harsh FROM (SELECT format, q, CASE WHEN q > 10 THEN q * 4 ELSE 30 END AS mild FROM v_recipes WHERE format = 'gif')")
def knob_anchor(spark, d):
    """A user's own loss is where the search begins; the harsh probe moves to the end when it is passed."""
    r = V.recipes(spark, d).where("format = 'gif'").select("format", "q").distinct()
    mild = F.when(F.col("q") > 10, F.col("q") * 4).otherwise(F.lit(30))
    return r.select("format", "q", F.least(F.lit(200), mild).alias("mild"), F.when(mild >= 150, 200).otherwise(150).alias("harsh"))


@query("knob_value", R + "SELECT DISTINCT format, q, CASE format WHEN 'gif' THEN q WHEN 'apng' THEN greatest(64, 256 >> (q % 3)::INT) WHEN 'png' THEN CASE WHEN q % 3 = 0 THEN 0 ELSE greatest(64, 256 >> (q % 3)::INT) END ELSE least(100, greatest(1, 100 - q)) END::BIGINT AS value FROM v_recipes")
def knob_value(spark, d):
    r = V.recipes(spark, d).select("format", "q").distinct()
    return r.select("format", "q", T.knob_value(F.col("format"), F.col("q")).alias("value"))


@query("reported_size", V.over("v_blobs") + "SELECT b.doc_id, CASE WHEN l.quality = 0 AND b.doc_id % 4 <> 0 THEN 2147483647 ELSE b.size END AS bytes FROM v_blobs b LEFT JOIN labels l ON l.doc_id = b.doc_id")
def reported_size(spark, d):
    """A file that breaks a rule other than its size can't win: it counts as the largest number."""
    checks = V.read(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "gif.size-limit").otherwise("gif.disposal").alias("rule"), (F.col("quality") != 0).alias("ok"))
    b = V.blobs(spark, d).select("doc_id", "size").join(checks, "doc_id", "left")
    return b.select("doc_id", F.when(~F.coalesce("ok", F.lit(True)) & ~F.coalesce(F.col("rule").endswith(".size-limit"), F.lit(False)), F.lit(2147483647).cast("long")).otherwise(F.col("size")).alias("bytes"))


@query("fit_labels", f"WITH {_LADDER_TABLE}, {_ASKED} SELECT job, ladder, idx, {_LABEL} AS label FROM asked JOIN ladders USING (ladder)")
def fit_labels(spark, d):
    return chosen(spark, d).select("job", "ladder", "idx", T.label(F.col("fps"), F.col("colors"), F.col("px")).alias("label"))


@query("variant_key", R + "SELECT k1, k2, k3, k4, dense_rank() OVER (PARTITION BY k1 ORDER BY fps, box_w, box_h) AS shared FROM v_recipes")
def variant_key(spark, d):
    """Rungs of a clip that share rate and size share their intermediate frames."""
    w = Window.partitionBy("k1").orderBy("fps", "box_w", "box_h")
    return V.recipes(spark, d).select("k1", "k2", "k3", "k4", F.dense_rank().over(w).cast("long").alias("shared"))
