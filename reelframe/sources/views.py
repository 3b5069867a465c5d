"""Clip-shaped views of the star-schema tables, and their SQL twins.

The tables hold no media, so each operator runs on rows that have the shape of clips,
frames, pixels, blobs, recipes or jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXTENSIONS = ["gif", "PNG", "webp", "jpeg", "json", "seq", "", "superlongext"]
BLOB_EXTENSIONS = ["gif", "png", "webp", "jpg", "apng", "avif", "mp4", "bin"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task sorts.
ROWS = 500_000


def placed(table: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """Rows by ``key``, in more parts the longer the table is, so that what a task sorts doesn't grow with it.

    Short tables stay where they are: the first window or grouping by ``key`` places them.
    """
    parts = -(-table.count() // rows)
    return table.repartition(parts, key) if parts > table.sparkSession.sparkContext.defaultParallelism else table


def micros(ts):
    return F.unix_micros(ts.cast("timestamp"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """clip, frame_idx, pts_us, dur_us, value: a user's events play 36,000 times faster."""
    ev = read(spark, d, "events").select("event_id", F.col("user_id").alias("clip"), "value", micros(F.col("ts")).alias("us"))
    order = Window.partitionBy("clip").orderBy("us", "event_id")
    per = Window.partitionBy("clip")
    out = placed(ev, "clip").select("clip", (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), ((F.col("us") - F.min("us").over(per)) / 36000).cast("long").alias("pts_us"), "event_id", "value")
    return out.withColumn("dur_us", F.lead("pts_us").over(Window.partitionBy("clip").orderBy("frame_idx")) - F.col("pts_us"))


def clips(spark: SparkSession, d: str) -> DataFrame:
    """clip, frames, duration (s), fps: one row a clip; still clips have no rate."""
    ev = read(spark, d, "events").select("user_id", micros(F.col("ts")).alias("us"))
    span = ((F.max("us") - F.min("us")) / 36000).cast("long")
    out = ev.groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("frames"), span.alias("span_us"))
    return out.select("clip", "frames", (F.col("span_us") / F.lit(1e6)).alias("duration"), (F.lit(5.0) + F.pmod("clip", F.lit(50))).alias("fps"))


def channels(spark: SparkSession, d: str) -> DataFrame:
    """clip, frame_idx, x, y, r, g, b, a: an embedding is a frame of 4 x 4 RGBA pixels."""
    e = read(spark, d, "embeddings")
    idx = e.select("vec_id", F.col("label").cast("long").alias("clip"), "embedding", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("frame_idx"))
    lane = F.transform("embedding", lambda v: F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 1024).cast("int")))
    px = idx.select("clip", "frame_idx", lane.alias("v")).select("clip", "frame_idx", "v", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    return px.select("clip", "frame_idx", (F.col("p") % 4).alias("x"), F.floor(F.col("p") / 4).cast("int").alias("y"), *[F.element_at("v", F.col("p") * 4 + k).alias(c) for k, c in enumerate("rgba", 1)])


def blobs(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    ext = F.element_at(F.array(*map(F.lit, BLOB_EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return t.select("doc_id", F.sha2(text, 256).alias("hash"), F.concat("source", F.lit("/"), "lang", F.lit("_"), "doc_id", F.lit("."), ext).alias("name"), ext.alias("ext"), F.octet_length(text).cast("long").alias("size"), F.col("doc_id").alias("uploaded"), (F.col("doc_id") % 8).cast("int").alias("info_version"), "lang", "source")


def names(spark: SparkSession, d: str) -> DataFrame:
    """page_id, tail, ext, name: file names made from URLs."""
    p = read(spark, d, "pages")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("page_id") % 8 + 1).cast("int"))
    tail = F.element_at(F.split("url", "/"), -1)
    return p.select("page_id", "url", tail.alias("tail"), ext.alias("ext"), F.concat(tail, F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext))).alias("name"))


def recipes(spark: SparkSession, d: str) -> DataFrame:
    """One clip and the numbers of its operations a row."""
    part = read(spark, d, "part").select("p_partkey", "p_size")
    line = read(spark, d, "lineitem")
    j = line.join(part, line["l_partkey"] == part["p_partkey"])
    q = F.col("l_quantity").cast("int")
    fmt = F.element_at(F.array(*map(F.lit, ["gif", "webp", "apng", "avif", "png", "jpeg"])), (F.col("l_suppkey") % 6 + 1).cast("int"))
    return j.select(
        F.col("l_orderkey").alias("k1"), F.col("l_partkey").alias("k2"), F.col("l_suppkey").alias("k3"), F.col("l_linenumber").alias("k4"),
        (16 + F.col("p_partkey") % 1905).alias("w"), (16 + F.col("p_size") * 21).cast("long").alias("h"),
        (F.lit(1.0) + F.col("l_partkey") % 59 + (F.col("l_suppkey") % 4) * F.lit(0.25)).alias("fps"),
        (q * F.lit(0.25)).alias("duration"), q.cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n"),
        (F.lit(0.5) + F.col("l_discount") * 20).alias("speed"), (F.col("l_tax") * 10).alias("start"),
        (16 + F.col("l_suppkey") * 7 % 640).alias("box_w"), (16 + F.col("l_orderkey") * 3 % 480).alias("box_h"), fmt.alias("format"),
    )


def job_rows(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    state = F.element_at(F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("running"), F.lit("P"), F.lit("failed")), F.col("o_orderstatus"))
    return o.select(F.col("o_orderkey").alias("job"), micros(F.col("o_orderdate")).alias("created_us"), state.alias("state"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_custkey").alias("owner"))


def curve(spark: SparkSession, d: str) -> DataFrame:
    """clip, rung, base: an order's lines are the rungs of a ladder; size(knob) = base * (1000 - 4 knob) / 1000."""
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("base"), "l_linenumber", "l_partkey", "l_suppkey")
    w = Window.partitionBy("clip").orderBy("l_linenumber", "l_partkey", "l_suppkey", "base")
    return placed(line, "clip").select("clip", (F.row_number().over(w) - 1).cast("long").alias("rung"), "base")


def log(spark: SparkSession, d: str) -> DataFrame:
    """job, seq, ts_ms, stage, percent: a conversation is a job's event log."""
    c = read(spark, d, "conversations")
    step = F.char_length(F.coalesce("text", F.lit(""))) % 80
    w = Window.partitionBy("job").orderBy("turn", "role", "len")
    out = c.select(F.col("conv_id").alias("job"), "turn", "role", step.cast("long").alias("step"), F.char_length(F.coalesce("text", F.lit(""))).alias("len"))
    return placed(out, "job").select("job", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ts_ms"), F.col("role").alias("stage"), (F.col("step") * 5 / 4).cast("long").alias("percent"))


def delays(spark: SparkSession, d: str) -> DataFrame:
    """clip, i, delay: an order's lines as frames with delays in centiseconds."""
    line = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip"), "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("base"), F.col("l_quantity").cast("long").alias("q"))
    w = Window.partitionBy("clip").orderBy("l_linenumber", "l_partkey", "l_suppkey", "base")
    return placed(line, "clip").select("clip", (F.row_number().over(w) - 1).cast("long").alias("i"), F.when(F.col("q") == 50, F.lit(65530)).when(F.col("q") == 49, F.lit(-4)).otherwise(F.col("q") % 12).cast("long").alias("delay"))


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


SQL = {
    "v_frames": """v_frames AS (SELECT *, lead(pts_us) OVER (PARTITION BY clip ORDER BY frame_idx) - pts_us AS dur_us FROM
 (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 36000 AS pts_us, event_id, value FROM events))""",
    "v_clips": """v_clips AS (SELECT user_id AS clip, count(*) AS frames, ((max(epoch_us(ts)) - min(epoch_us(ts))) // 36000) / 1e6 AS duration, 5.0::DOUBLE + user_id % 50 AS fps FROM events GROUP BY user_id)""",
    "v_pixels": """v_pixels AS (SELECT clip, frame_idx, (p % 4)::INT AS x, (p // 4)::INT AS y, v[p * 4 + 1] AS r, v[p * 4 + 2] AS g, v[p * 4 + 3] AS b, v[p * 4 + 4] AS a FROM
 (SELECT label::BIGINT AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, [least(255, floor(abs(e::DOUBLE) * 1024)::INT) FOR e IN embedding] AS v, unnest(range(16)) AS p FROM embeddings))""",
    "v_blobs": f"""v_blobs AS (SELECT doc_id, sha256(coalesce(text, '')) AS hash, source || '/' || lang || '_' || doc_id || '.' || ext AS name, ext, strlen(coalesce(text, ''))::BIGINT AS size, doc_id AS uploaded, (doc_id % 8)::INT AS info_version, lang, source FROM
 (SELECT *, {_list(BLOB_EXTENSIONS)}[doc_id % 8 + 1] AS ext FROM documents))""",
    "v_names": f"""v_names AS (SELECT page_id, url, tail, ext, tail || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS name FROM
 (SELECT page_id, url, string_split(url, '/')[-1] AS tail, {_list(EXTENSIONS)}[page_id % 8 + 1] AS ext FROM pages))""",
    "v_recipes": """v_recipes AS (SELECT l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3, l_linenumber AS k4, 16 + p_partkey % 1905 AS w, (16 + p_size * 21)::BIGINT AS h,
 1.0::DOUBLE + l_partkey % 59 + (l_suppkey % 4) * 0.25::DOUBLE AS fps, l_quantity::INT * 0.25::DOUBLE AS duration, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS n, 0.5::DOUBLE + l_discount * 20 AS speed, l_tax * 10 AS start,
 16 + l_suppkey * 7 % 640 AS box_w, 16 + l_orderkey * 3 % 480 AS box_h, ['gif', 'webp', 'apng', 'avif', 'png', 'jpeg'][l_suppkey % 6 + 1] AS format FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "v_jobs": """v_jobs AS (SELECT o_orderkey AS job, epoch_us(o_orderdate::TIMESTAMP) AS created_us, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS state, floor(o_totalprice)::BIGINT AS size, o_custkey AS owner FROM orders)""",
    "v_curve": """v_curve AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY l_linenumber, l_partkey, l_suppkey, base) - 1 AS rung, base FROM
 (SELECT l_orderkey AS clip, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT AS base FROM lineitem))""",
    "v_log": """v_log AS (SELECT conv_id AS job, row_number() OVER w - 1 AS seq, sum(step) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS ts_ms, role AS stage, step * 5 // 4 AS percent FROM
 (SELECT *, length(coalesce(text, '')) AS len, (length(coalesce(text, '')) % 80)::BIGINT AS step FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, len))""",
    "v_delays": """v_delays AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY l_linenumber, l_partkey, l_suppkey, base) - 1 AS i, CASE WHEN q = 50 THEN 65530 WHEN q = 49 THEN -4 ELSE q % 12 END::BIGINT AS delay FROM
 (SELECT l_orderkey AS clip, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, round(l_extendedprice * 100)::BIGINT AS base FROM lineitem))""",
}


def over(*views: str) -> str:
    """The WITH clause that defines ``views``."""
    return "WITH " + ",\n".join(SQL[v] for v in views) + "\n"
