"""Job and recipe queries: hashes, progress, events, presets, validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import recipes as C
from ..functions.numbers import div
from ..operators import events as E
from ..sources import views as V
from .registry import query

L = V.over("v_log")
R = V.over("v_recipes")


@query("recipe_hash", R + """SELECT k1, k2, k3, k4, sha256('{"v":1,"sources":' || CASE WHEN n % 3 = 0 THEN 'null' ELSE '["s' || h || '"]' END || ',"ops":[{"kind":"crop","params":{"h":' || h || ',"k2":null,"v":7,"w":' || w || '}},{"kind":"flip"}' || CASE WHEN n % 2 = 0 THEN ',{"kind":"delay","params":{"ms":' || q || ',"note":"a\\u003cb"}}' ELSE '' END || '],"output":{"format":"' || format || '","fps":' || q || ',"fitKeepFps":true}}') AS hash FROM v_recipes""")
def recipe_hash(spark, d):
    """Members in any order, with or without a version, zero values and null parameters: one hash."""
    r = V.recipes(spark, d)
    ops = F.concat(
        F.lit('[{"params":{"w":'), F.col("w"), F.lit(',"v":7,"h":'), F.col("h"), F.lit(',"k2":null},"kind":"crop"},{"kind":"flip","params":null}'),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit(',{"kind":"delay","params":{"note":"a<b","ms":'), F.col("q"), F.lit("}}"))).otherwise(""), F.lit("]"),
    )
    version = F.when(F.col("n") % 5 == 0, F.lit('"v":0,')).otherwise("")
    sources = F.when(F.col("n") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('"sources":["s'), F.col("h"), F.lit('"],')))
    raw = F.concat(F.lit("{"), version, F.lit('"output":{"fitKeepFps":true,"width":0,"fps":'), F.col("q"), F.lit('.0,"lossless":false,"format":"'), F.col("format"), F.lit('"}, '), sources, F.lit('"ops":'), ops, F.lit("}"))
    return r.select("k1", "k2", "k3", "k4", F.sha2(C.canonical(raw), 256).alias("hash"))


@query("still_key", R + """SELECT k1, k2, k3, k4, sha256('{"v":1,"sources":["s' || h || '"],"ops":[{"kind":"rotate","params":{"degrees":90}}],"output":{"format":"' || format || '","width":' || w || ',"fps":' || q || '}}' || '|t=' || printf('%.3f', floor(start * 1000 + 0.5) / 1000) || '|w=' || box_w) AS key FROM v_recipes""")
def still_key(spark, d):
    """Previews that differ in nothing that shows have one key: colours and loops don't count."""
    r = V.recipes(spark, d)
    raw = F.concat(F.lit('{"output":{"colors":64,"fps":'), F.col("q"), F.lit('.0,"width":'), F.col("w"), F.lit(',"loop":'), F.col("n"), F.lit(',"format":"'), F.col("format"), F.lit('"},"ops":[{"kind":"rotate","params":{"degrees":90.0}}],"sources":["s'), F.col("h"), F.lit('"]}'))
    t = F.floor(F.col("start") * 1000 + 0.5) / 1000
    return r.select("k1", "k2", "k3", "k4", C.still_key(raw, t, F.col("box_w")).alias("key"))


@query("result_key", "SELECT doc_id, sha256(sha256(coalesce(text, '')) || chr(10) || '3' || chr(10) || '7') AS key FROM documents")
def result_key(spark, d):
    t = V.read(spark, d, "documents")
    return t.select("doc_id", C.result_key(F.sha2(F.coalesce("text", F.lit("")), 256), 3, 7).alias("key"))


_VALID = "CASE WHEN sources = 0 THEN 'sources' WHEN NOT regexp_full_match(hash, '[0-9a-f]{64}') THEN 'hash' WHEN format NOT IN ('gif', 'webp', 'apng', 'avif', 'png', 'jpeg', 'frames') THEN 'format' WHEN target NOT IN ('', 'emote', 'sticker', 'attachment', 'attachment-50', 'attachment-100', 'attachment-500') THEN 'target' END"
_TARGETS = ["emote", "sticker", "attachment", "attachment-50", "attachment-500", "", "banner"]


@query("recipe_validate", V.over("v_blobs") + f"SELECT doc_id, {_VALID} AS error FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN upper(hash) ELSE hash END AS hash, ext AS format, doc_id % 11 AS sources, {V._list(_TARGETS)}[doc_id % 7 + 1] AS target FROM v_blobs)")
def recipe_validate(spark, d):
    b = V.blobs(spark, d)
    hash_ = F.when(F.col("doc_id") % 9 == 0, F.upper("hash")).otherwise(F.col("hash"))
    target = F.element_at(F.array(*map(F.lit, _TARGETS)), (F.col("doc_id") % 7 + 1).cast("int"))
    return b.select("doc_id", C.recipe_error(F.col("doc_id") % 11, hash_, F.col("ext"), target).alias("error"))


@query("preset_defaults", f"SELECT o_orderkey AS job, t.* FROM (SELECT o_orderkey, {V._list([p[0] for p in C.PRESETS])}[o_orderkey % 5 + 1] AS preset FROM orders) JOIN (SELECT * FROM (VALUES ('emote', 'gif', 'emote', 128, 128, 25.0::DOUBLE, 262144::BIGINT), ('sticker', 'apng', 'sticker', 320, 320, 25.0, 524288), ('chat', 'gif', 'attachment', NULL, NULL, NULL, NULL), ('optimize', 'gif', '', NULL, NULL, NULL, NULL), ('frames', 'frames', '', NULL, NULL, NULL, NULL)) AS t(preset, format, target, width, height, fps, fit_bytes)) t USING (preset)")
def preset_defaults(spark, d):
    """What each order's preset stands for; presets are a table of fixed size."""
    name = F.element_at(F.array(*[F.lit(p[0]) for p in C.PRESETS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return V.read(spark, d, "orders").select(F.col("o_orderkey").alias("job"), name.alias("preset")).join(F.broadcast(C.presets(spark)), "preset").select("job", "preset", "format", "target", "width", "height", "fps", "fit_bytes")


@query("event_coalesce", L.replace("WITH ", "WITH RECURSIVE ") + """, e AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq) AS i FROM v_log),
run AS (SELECT job, seq, ts_ms, stage, i, true AS sent, ts_ms AS last_ms, stage AS last_stage FROM e WHERE i = 1
 UNION ALL SELECT e.job, e.seq, e.ts_ms, e.stage, e.i, e.stage <> r.last_stage OR e.ts_ms - r.last_ms >= 100, CASE WHEN e.stage <> r.last_stage OR e.ts_ms - r.last_ms >= 100 THEN e.ts_ms ELSE r.last_ms END, e.stage FROM run r JOIN e ON e.job = r.job AND e.i = r.i + 1)
SELECT job, seq, ts_ms, stage FROM run WHERE sent""")
def event_coalesce(spark, d):
    return E.coalesce_events(V.log(spark, d)).select("job", "seq", "ts_ms", "stage")


@query("event_buffer", L + "SELECT job, seq, ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS r FROM v_log) WHERE r <= 32")
def event_buffer(spark, d):
    return E.last_events(V.log(spark, d), E.BUFFER).select("job", "seq", "ts_ms")


@query("progress_monotone", L + "SELECT job, seq, stage, max(percent) OVER (PARTITION BY job, stage ORDER BY seq) AS percent FROM v_log")
def progress_monotone(spark, d):
    w = Window.partitionBy("job", "stage").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return V.log(spark, d).select("job", "seq", "stage", F.max("percent").over(w).alias("percent"))


@query("progress_fraction", L + "SELECT job, seq, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (percent - 10) / 80.0::DOUBLE)) AS fraction, 1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + seq / 8.0::DOUBLE) AS fit FROM v_log")
def progress_fraction(spark, d):
    return V.log(spark, d).select("job", "seq", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("percent") - 10) / F.lit(80.0))).alias("fraction"), (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("seq") / F.lit(8.0))).alias("fit"))


@query("progress_parse", L + "SELECT job, seq, last_value(ms IGNORE NULLS) OVER (PARTITION BY job ORDER BY seq) AS out_ms FROM (SELECT job, seq, CASE percent % 5 WHEN 0 THEN NULL WHEN 4 THEN ts_ms // 1000 ELSE ts_ms END AS ms FROM v_log)")
def progress_parse(spark, d):
    """Encoder progress as text blocks: N/A, microseconds, the line named ms with microseconds, with milliseconds, and without a clock beside it."""
    log = V.log(spark, d)
    k, t = F.col("percent") % 5, F.col("ts_ms")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(F.lit("out_time="), two(div(t, 3_600_000)), F.lit(":"), two(div(t, 60_000) % 60), F.lit(":"), two(div(t, 1000) % 60), F.lit("."), F.lpad((t % 1000).cast("string"), 3, "0"), F.lit("000\n"))
    line = F.when(k == 0, F.lit("out_time_us=N/A\nout_time_ms=N/A\n")).when(k == 1, F.concat(F.lit("out_time_us="), t * 1000, F.lit("\n"))).when(k == 2, F.concat(F.lit("out_time_ms="), t * 1000, F.lit("\n"), clock)).when(k == 3, F.concat(F.lit("out_time_ms="), t, F.lit("\n"), clock)).otherwise(F.concat(F.lit("out_time_ms="), t, F.lit("\n")))
    blocks = log.select("job", "seq", F.concat(F.lit("frame=1\n"), line, F.lit("progress=continue")).alias("block"))
    return E.parse_progress(blocks).select("job", "seq", "out_ms")


@query("file_facts", R + "SELECT k1, k2, k3, k4, CASE WHEN n % 3 = 0 THEN q * 10 ELSE q * 9 END AS frames, CASE WHEN duration > 0 THEN (CASE WHEN n % 3 = 0 THEN q * 10 ELSE q * 9 END) / duration END AS fps FROM v_recipes")
def file_facts(spark, d):
    """What a report measured wins over what was planned; the rate follows."""
    r = V.recipes(spark, d).withColumn("frames", F.coalesce(F.when(F.col("n") % 3 == 0, F.col("q") * 10), F.col("q") * 9))
    return r.select("k1", "k2", "k3", "k4", "frames", F.when(F.col("duration") > 0, F.col("frames") / F.col("duration")).alias("fps"))


@query("job_states", V.over("v_jobs") + "SELECT state, count(*) AS jobs, sum(size)::BIGINT AS bytes, sum(size)::BIGINT // count(*) AS mean FROM v_jobs GROUP BY state")
def job_states(spark, d):
    j = V.job_rows(spark, d).groupBy("state").agg(F.count("*").alias("jobs"), F.sum("size").alias("bytes"))
    return j.withColumn("mean", div("bytes", "jobs"))
