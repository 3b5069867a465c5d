"""Store queries: blobs, names, sequences, results, sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import storage as S
from ..sources import views as V
from .registry import query

B = V.over("v_blobs")
NAMES = V.over("v_names")


@query("blob_dedupe", B + "SELECT hash, min(uploaded) AS uploaded, min_by(name, uploaded) AS name, max(uploaded) AS touched, count(*) AS puts FROM v_blobs GROUP BY hash")
def blob_dedupe(spark, d):
    return S.put_blobs(V.blobs(spark, d))


@query("blob_lookup", B + "SELECT w.hash, b.name, b.size, CASE WHEN b.info_version = 6 THEN b.lang END AS info FROM (SELECT DISTINCT hash FROM v_blobs) w JOIN v_blobs b ON b.hash = w.hash WHERE b.ext <> 'bin'")
def blob_lookup(spark, d):
    b = V.blobs(spark, d)
    return S.get_blobs(b, b.select("hash").distinct())


@query("sequence_hash", B + """, s AS (SELECT source, lang, string_agg(hash, '' ORDER BY name, doc_id) AS h, count(*) AS frames FROM v_blobs GROUP BY source, lang)
SELECT source, lang, frames, sha256(unhex(h)) AS id FROM s WHERE frames BETWEEN 2 AND 5000""")
def sequence_hash(spark, d):
    return S.sequence_ids(V.blobs(spark, d), ["source", "lang"])


@query("sequence_listing", "SELECT ext, count(*) AS frames, min(i) AS first, max(i) AS last FROM (SELECT regexp_extract(f, '^(\\d{6})\\.(\\w+)$', 2) AS ext, try_cast(regexp_extract(f, '^(\\d{6})\\.(\\w+)$', 1) AS BIGINT) AS i FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '' END || lpad(p_partkey::VARCHAR, 6, '0') || '.' || CASE WHEN p_size % 2 = 0 THEN 'png' ELSE 'jpg' END AS f FROM part)) WHERE ext <> '' GROUP BY ext")
def sequence_listing(spark, d):
    p = V.read(spark, d, "part")
    f = F.concat(F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(""), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("."), F.when(F.col("p_size") % 2 == 0, "png").otherwise("jpg"))
    return S.sequence_listing(p.select(f.alias("file")))


@query("natural_sort", NAMES + """, runs AS (SELECT page_id, tail, regexp_extract_all(tail, '\\d+|\\D+') AS r FROM v_names)
SELECT page_id, row_number() OVER (ORDER BY [CASE WHEN regexp_matches(x, '^\\d') THEN '0' || lpad(length(regexp_replace(x, '^0+(.)', '\\1'))::VARCHAR, 6, '0') || regexp_replace(x, '^0+(.)', '\\1') ELSE '1' || lower(x) END FOR x IN r], tail, page_id) AS place FROM runs""")
def natural_sort(spark, d):
    """Every name's place in the global order: counted inside range partitions, their bases from prefix sums."""
    n = V.names(spark, d).select("page_id", N.natural_key(F.col("tail")).alias("key"), F.lit(1).cast("long").alias("one"))
    return S.running_total(n, ["key", "page_id"], "one", "place").select("page_id", "place")


_MAGIC = "CASE page_id % 8 WHEN 0 THEN '474946383961' WHEN 1 THEN '89504e470d0a1a0a' WHEN 2 THEN '52494646000000005745425056503858' WHEN 3 THEN 'ffd8ffe0' WHEN 4 THEN '000000206674797061766966' WHEN 5 THEN '424d3600' ELSE '' END"
_SNIFF = "CASE WHEN h LIKE '89504e470d0a1a0a%' THEN 'png' WHEN h LIKE 'ffd8ff%' THEN 'jpeg' WHEN h LIKE '47494638%' THEN 'gif' WHEN h[17:24] = '57454250' THEN 'webp' WHEN h LIKE '424d%' THEN 'bmp' WHEN h[9:24] IN ('6674797061766966', '6674797061766973') THEN 'avif' END"


def _content():
    k = F.col("page_id") % 8
    magic = F.when(k == 0, "474946383961").when(k == 1, "89504e470d0a1a0a").when(k == 2, "52494646000000005745425056503858").when(k == 3, "ffd8ffe0").when(k == 4, "000000206674797061766966").when(k == 5, "424d3600").otherwise("")
    return F.concat(F.unhex(magic), F.encode(F.substring(F.coalesce("html", F.lit("")), 1, 512), "utf-8"))


@query("sniff_format", f"SELECT page_id, {_SNIFF} AS format FROM (SELECT page_id, {_MAGIC} || lower(hex(encode(coalesce(html, '')[1:512]))) AS h FROM pages)")
def sniff_format(spark, d):
    return V.read(spark, d, "pages").select("page_id", N.sniff(_content()).alias("format"))


@query("sequence_eligibility", NAMES + f""", s AS (SELECT n.page_id, lower(ext) AS e, {_SNIFF} AS f, name FROM v_names n JOIN (SELECT page_id, {_MAGIC} AS h FROM pages) p USING (page_id))
SELECT page_id, CASE WHEN e IN ('gif', 'avif') THEN NULL WHEN e IN ('png', 'jpg', 'jpeg', 'webp', 'bmp', 'tiff', 'tif') THEN name WHEN f IN ('gif', 'avif') OR f IS NULL THEN NULL ELSE name || '.' || f END AS frame_name FROM s""")
def sequence_eligibility(spark, d):
    n = V.names(spark, d)
    c = V.read(spark, d, "pages").select("page_id", N.sniff(_content()).alias("f"))
    e = F.lower("ext")
    out = F.when(e.isin("gif", "avif"), None).when(e.isin(*N.SEQUENCE), F.col("name")).when(F.col("f").isNull() | F.col("f").isin("gif", "avif"), None).otherwise(F.concat("name", F.lit("."), "f"))
    return n.join(c, "page_id").select("page_id", out.alias("frame_name"))


@query("sanitize_names", NAMES + "SELECT page_id, CASE WHEN lower(ext) = 'json' THEN 'jsonfile' WHEN lower(ext) = 'seq' THEN 'seqfile' WHEN regexp_full_match(lower(ext), '[a-z0-9]{1,8}') THEN lower(ext) ELSE 'bin' END AS ext, CASE WHEN trim(name) IN ('', '.', '..') THEN 'upload' ELSE name[1:200] END AS name FROM v_names")
def sanitize_names(spark, d):
    return V.names(spark, d).select("page_id", N.sanitize_ext(F.col("ext")).alias("ext"), N.sanitize_name(F.concat(F.lit("dir\\"), "url", F.lit("/"), "name")).alias("name"))


@query("content_type", B + "SELECT ext, CASE ext WHEN 'gif' THEN 'image/gif' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' WHEN 'jpg' THEN 'image/jpeg' WHEN 'apng' THEN 'image/apng' WHEN 'avif' THEN 'image/avif' WHEN 'mp4' THEN 'video/mp4' ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM v_blobs GROUP BY ext")
def content_type(spark, d):
    return V.blobs(spark, d).groupBy("ext").agg(F.count("*").alias("n")).select("ext", N.content_type(F.col("ext")).alias("mime"), "n")


@query("download_name", B + "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN stem || '.gif' ELSE stem || '-alt' || doc_id % 4 || '.gif' END AS name FROM (SELECT doc_id, regexp_replace(string_split(name, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem FROM v_blobs)")
def download_name(spark, d):
    b = V.blobs(spark, d).select("doc_id", N.stem(F.element_at(F.split("name", "/"), -1)).alias("stem"))
    return b.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("stem", F.lit(".gif"))).otherwise(F.concat("stem", F.lit("-alt"), F.col("doc_id") % 4, F.lit(".gif"))).alias("name"))


@query("commit_first_wins", B + "SELECT hash, min_by(name, doc_id) AS name, min(doc_id) AS doc_id FROM v_blobs b WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM v_blobs o WHERE o.doc_id % 2 = 0 AND o.hash = b.hash) GROUP BY hash")
def commit_first_wins(spark, d):
    b = V.blobs(spark, d)
    return S.commit_new(b.where("doc_id % 2 = 1"), b.where("doc_id % 2 = 0"), "hash", "doc_id").select("hash", "name", "doc_id")


@query("manifest_valid", B + "SELECT source, count(*) AS files, sum(size)::BIGINT AS bytes FROM v_blobs WHERE hash <> '' GROUP BY source HAVING count(*) FILTER (ext <> 'bin') >= 1")
def manifest_valid(spark, d):
    b = V.blobs(spark, d)
    return b.where("hash <> ''").groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("ext") != "bin").alias("ok")).where("ok >= 1").drop("ok")


@query("from_result", B + "SELECT hash, name, size FROM v_blobs WHERE ext NOT IN ('bin', 'mp4') AND doc_id % 2 = 0 UNION SELECT hash, name, size FROM v_blobs WHERE doc_id % 2 = 1")
def from_result(spark, d):
    """Result files taken back as sources; archives are refused."""
    b = V.blobs(spark, d).select("hash", "name", "size", "ext", "doc_id")
    taken = b.where("doc_id % 2 = 0").where(~F.col("ext").isin("bin", "mp4"))
    return taken.unionByName(b.where("doc_id % 2 = 1")).select("hash", "name", "size").distinct()


@query("result_groups", B + "SELECT source, doc_id, kind, place FROM (SELECT source, doc_id, kind, row_number() OVER (PARTITION BY source, kind ORDER BY size, doc_id) AS place FROM (SELECT *, ['output', 'alternative', 'frame', 'archive'][doc_id % 4 + 1] AS kind FROM v_blobs)) WHERE CASE kind WHEN 'output' THEN place = 1 WHEN 'alternative' THEN place <= 2 WHEN 'archive' THEN place = 1 ELSE true END")
def result_groups(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["output", "alternative", "frame", "archive"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return S.result_groups(V.blobs(spark, d).withColumn("kind", kind)).select("source", "doc_id", "kind", "place")


J = V.over("v_jobs")


@query("memo_split", J + "SELECT job, CASE WHEN EXISTS (SELECT 1 FROM v_jobs c WHERE c.state = 'done' AND c.size % 1000 = j.size % 1000 AND c.owner = j.owner) THEN 'cached' ELSE 'render' END AS way FROM v_jobs j WHERE state <> 'done'")
def memo_split(spark, d):
    j = V.job_rows(spark, d).withColumn("key", F.col("size") % 1000)
    return S.memo_split(j.where("state <> 'done'"), j.where("state = 'done'"), ["key", "owner"]).select("job", "way")


@query("lru_evict", J + "SELECT job FROM (SELECT job, row_number() OVER (ORDER BY created_us DESC, job DESC) AS r FROM v_jobs) WHERE r > 500")
def lru_evict(spark, d):
    """Everything but the 500 used last: the bound is a top-k, the rest an anti-join."""
    return S.lru_evicted(V.job_rows(spark, d), ["created_us", "job"], 500).select("job")


@query("sweep_ttl", J + "SELECT job, CASE WHEN age > 30 * 86400000000 THEN 'expired' ELSE 'orphan' END AS why FROM (SELECT *, (SELECT max(created_us) FROM v_jobs) - created_us AS age FROM v_jobs) WHERE age > 3600000000 AND (age > 30 * 86400000000 OR state = 'failed')")
def sweep_ttl(spark, d):
    return S.sweep_ttl(V.job_rows(spark, d), 30 * 86_400_000_000, 3_600_000_000).select("job", "why")


@query("sweep_size", J + "SELECT job, size FROM (SELECT job, size, (SELECT sum(size) FROM v_jobs) - sum(size) OVER (ORDER BY created_us, job) + size AS before FROM v_jobs) WHERE before > 1000000000")
def sweep_size(spark, d):
    """Oldest first until what is left fits the cap."""
    return S.sweep_size(V.job_rows(spark, d), ["created_us", "job"], 1_000_000_000).select("job", "size")


@query("admission", J + "SELECT owner, job, taken <= 2000000 AS admitted FROM (SELECT owner, job, sum(size) OVER (PARTITION BY owner ORDER BY created_us, job) AS taken FROM v_jobs)")
def admission(spark, d):
    w = Window.partitionBy("owner").orderBy("created_us", "job").rowsBetween(Window.unboundedPreceding, 0)
    return V.job_rows(spark, d).select("owner", "job", (F.sum("size").over(w) <= 2000000).alias("admitted"))


@query("job_prune", J + "SELECT job FROM v_jobs WHERE state IN ('done', 'failed') AND created_us < (SELECT max(created_us) FROM v_jobs) - 3600000000 AND (SELECT count(*) FROM v_jobs) > 200")
def job_prune(spark, d):
    return S.prune_jobs(V.job_rows(spark, d), 200, 3_600_000_000).select("job")
