"""Stream choice and alpha reconciliation as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pixels as X
from ..operators import probing as O
from ..sources import views as V
from .registry import query

_FMT, _TITLES = ["yuv420p", "gray", "GRAY10le", "yuv444p"], ["", "Alpha", " color", ""]


@query("stream_match", f"""WITH s AS (SELECT l_orderkey AS clip, l_linenumber AS i, l_partkey AS p, l_suppkey AS k, l_quantity::BIGINT AS q, CASE WHEN l_shipdate IS NULL OR l_suppkey % 7 = 0 THEN 'audio' ELSE 'video' END AS type FROM lineitem),
v AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY i, p, k, q) - 1 AS v, 64 * (1 + k % 2) AS w, q % 3 AS frames, (lower({_FMT}[p % 4 + 1]) LIKE 'gray%') AS gray, {_TITLES}[q % 4 + 1] = 'Alpha' AS titled, p % 5 = 0 AS cover FROM s WHERE type = 'video'),
c AS (SELECT DISTINCT clip, coalesce((SELECT arg_max(v, frames * 1000 - v) FROM v x WHERE x.clip = v.clip AND NOT gray AND NOT titled), (SELECT arg_max(v, frames * 1000 - v) FROM v x WHERE x.clip = v.clip AND NOT titled),
  (SELECT min(v) FROM v x WHERE x.clip = v.clip AND NOT cover), 0) AS color FROM v)
SELECT c.clip, color, (SELECT min(a.v) FROM v a JOIN v m ON m.clip = a.clip AND m.v = c.color WHERE a.clip = c.clip AND (a.gray OR a.titled) AND a.v <> color AND a.w = m.w AND (a.frames = 0 OR m.frames = 0 OR a.frames = m.frames)) AS alpha FROM c""")
def stream_match(spark, d):
    """An order is a file, its lines are the streams: the picture and the alpha plane that belongs to it."""
    s = V.read(spark, d, "lineitem")
    one_of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    q = F.col("l_quantity").cast("long")
    streams = s.select(
        F.col("l_orderkey").alias("clip"), F.struct("l_linenumber", "l_partkey", "l_suppkey", q).alias("index"), F.when(F.col("l_shipdate").isNull() | (F.col("l_suppkey") % 7 == 0), "audio").otherwise("video").alias("type"),
        (64 * (1 + F.col("l_suppkey") % 2)).alias("width"), F.lit(64).alias("height"), (q % 3).alias("frames"), one_of(_FMT, F.col("l_partkey") % 4).alias("pix_fmt"), one_of(_TITLES, q % 4).alias("title"), (F.col("l_partkey") % 5 == 0).alias("cover"),
    )
    return O.match_streams(streams)


@query("alpha_reconcile", V.over("v_pixels") + """, s AS (SELECT clip * 1000 + frame_idx AS clip, min(a) < 255 AS scanned FROM v_pixels GROUP BY clip, frame_idx HAVING frame_idx % 7 <> 3), t AS (SELECT DISTINCT clip * 1000 + frame_idx AS clip, frame_idx % 3 <> 0 AS stated FROM v_pixels WHERE frame_idx % 11 <> 5)
SELECT coalesce(s.clip, t.clip) AS clip, stated, scanned, coalesce(scanned, stated) AS found FROM s FULL JOIN t ON s.clip = t.clip WHERE scanned IS DISTINCT FROM stated""")
def alpha_reconcile(spark, d):
    """What pixels show against what containers state: a row where they differ."""
    px, number = V.channels(spark, d), (F.col("clip") * 1000 + F.col("frame_idx")).alias("clip")
    stated = px.where("frame_idx % 11 <> 5").select(number, (F.col("frame_idx") % 3 != 0).alias("has_alpha")).distinct()
    # Frames are scanned one by one: from a thousand frames on, numbers of different clips meet.
    scanned = X.alpha_scan(px.where("frame_idx % 7 <> 3"), ("clip", "frame_idx")).select(number, "has_alpha")
    return O.reconcile_alpha(scanned, stated)


_SEQ_H, _SEQ_S = 40, 5


@query("sequence_probe", V.over("v_frames") + f""", s AS (SELECT clip, frame_idx AS i, CASE WHEN event_id % 97 = 0 THEN 64 ELSE 128 + clip % 3 END AS w, CASE WHEN event_id % 89 = 0 THEN 200 ELSE 96 END AS h, event_id % 4 = 1 AS may, CASE WHEN clip % 5 <> 0 THEN event_id % 24 = 1 END AS alpha, count(*) OVER (PARTITION BY clip) AS n FROM v_frames),
k AS (SELECT DISTINCT clip, n, CASE WHEN n < 2 THEN 0 ELSE j * (n - 1) // (least(n, {_SEQ_H}) - 1) END AS i FROM (SELECT DISTINCT clip, n FROM s), (SELECT unnest(range({_SEQ_H})) AS j) WHERE j < n),
l AS (SELECT s.*, row_number() OVER (PARTITION BY clip, may ORDER BY i) - 1 AS r, count(*) OVER (PARTITION BY clip, may) AS m FROM s JOIN k USING (clip, n, i)),
a AS (SELECT clip, count(*) AS scans, count(alpha) AS read, count(*) FILTER (alpha) AS clear FROM l WHERE may AND r IN (SELECT CASE WHEN l.m < 2 THEN 0 ELSE j * (l.m - 1) // (least(l.m, {_SEQ_S}) - 1) END FROM (SELECT unnest(range({_SEQ_S})) AS j) WHERE j < l.m) GROUP BY clip)
SELECT clip, any_value(n) AS frames, max(w) AS width, max(h) AS height, min(w) <> max(w) OR min(h) <> max(h) AS mixed, coalesce(any_value(clear) > 0 OR (any_value(scans) > 0 AND any_value(read) = 0), false) AS has_alpha FROM l LEFT JOIN a USING (clip) GROUP BY clip""")
def sequence_probe(spark, d):
    """Size, mix of sizes and alpha of image sequences from an even sample of their frames."""
    e = F.col("event_id")
    f = V.frames(spark, d).select(
        "clip", "frame_idx", F.when(e % 97 == 0, 64).otherwise(128 + F.col("clip") % 3).alias("width"), F.when(e % 89 == 0, 200).otherwise(96).alias("height"),
        (e % 4 == 1).alias("may_alpha"), F.when(F.col("clip") % 5 != 0, e % 24 == 1).alias("alpha"),
    )
    return O.probe_sequences(f, _SEQ_H, _SEQ_S)
