"""Content-addressed storage, results, retention and admission as table operations."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INFO_VERSION = 6


def put_blobs(blobs: DataFrame) -> DataFrame:
    """One row a content hash: the first upload's name and time, the last touch, the number of puts."""
    return blobs.groupBy("hash").agg(F.min("uploaded").alias("uploaded"), F.min_by("name", "uploaded").alias("name"), F.max("uploaded").alias("touched"), F.count("*").alias("puts"))


def get_blobs(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blobs by hash; probe results of another version are hidden, so that they are made anew."""
    found = blobs.where("ext <> 'bin'").join(wanted, "hash", "left_semi")
    return found.select("hash", "name", "size", F.when(F.col("info_version") == INFO_VERSION, F.col("lang")).alias("info"))


def sequence_ids(frames: DataFrame, key: list[str]) -> DataFrame:
    """A sequence's id: the hash over its frames' raw digests in order. A sequence has 2 to 5000 frames, so the list is bounded."""
    n = frames.groupBy(*key).agg(F.count("*").alias("frames")).where(F.col("frames").between(2, 5000))
    listed = frames.join(n.drop("frames"), key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("name", "doc_id", "hash"))).alias("f"), F.count("*").alias("frames"))
    return listed.select(*key, "frames", F.sha2(F.unhex(F.concat_ws("", F.transform("f", lambda x: x["hash"]))), 256).alias("id"))


def sequence_listing(files: DataFrame) -> DataFrame:
    """Frames of a sequence folder by extension; strays are left out. More than one row: mixed, an error."""
    pattern = r"^(\d{6})\.(\w+)$"
    f = files.select(F.regexp_extract("file", pattern, 2).alias("ext"), F.regexp_extract("file", pattern, 1).alias("i")).where("ext <> ''")
    return f.groupBy("ext").agg(F.count("*").alias("frames"), F.min(F.col("i").cast("long")).alias("first"), F.max(F.col("i").cast("long")).alias("last"))


def commit_new(staged: DataFrame, present: DataFrame, key: str, order: str) -> DataFrame:
    """Staged rows whose key isn't there yet; of several the first wins."""
    new = staged.join(present.select(key), key, "left_anti")
    cols = [c for c in new.columns if c != key]
    return new.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("row")).select(key, "row.*")


def publish(df: DataFrame, path: str) -> None:
    """Write a result where readers see it whole or not at all: stage beside it, then rename; an existing result stays."""
    spark = df.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    staging = jvm.org.apache.hadoop.fs.Path(f"{path}.staging-{id(df):x}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        return
    df.write.parquet(staging.toString())
    if fs.exists(target) or not fs.rename(staging, target):
        fs.delete(staging, True)


def result_groups(files: DataFrame) -> DataFrame:
    """Primary file, up to two alternatives, all frames and one archive of each result, smallest first."""
    w = Window.partitionBy("source", "kind").orderBy("size", "doc_id")
    most = F.when(F.col("kind") == "alternative", 2).when(F.col("kind").isin("output", "archive"), 1)
    return files.withColumn("place", F.row_number().over(w)).where(most.isNull() | (F.col("place") <= most))


def memo_split(asked: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """``way``: cached where a finished result has the key, else render."""
    have = done.select(*key).distinct().withColumn("hit", F.lit(True))
    return asked.join(have, key, "left").withColumn("way", F.when(F.col("hit"), "cached").otherwise("render")).drop("hit")


def lru_evicted(rows: DataFrame, order: list[str], keep: int) -> DataFrame:
    """Rows beyond the ``keep`` last used. The kept ones are a top-k of fixed size, so they may be broadcast."""
    kept = rows.orderBy(*[F.desc(c) for c in order]).limit(keep).select(*order)
    return rows.join(F.broadcast(kept), order, "left_anti")


def sweep_ttl(rows: DataFrame, ttl_us: int, grace_us: int) -> DataFrame:
    now = rows.agg(F.max("created_us").alias("now"))
    age = F.col("now") - F.col("created_us")
    aged = rows.join(F.broadcast(now)).withColumn("age", age)
    why = F.when(F.col("age") > ttl_us, "expired").when(F.col("state") == "failed", "orphan")
    return aged.withColumn("why", why).where((F.col("age") > grace_us) & F.col("why").isNotNull())


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where the session names none, one of a local session's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/reelframe-{label}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def running_total(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to each row in a global order, without one task that holds all rows.

    Rows are range-partitioned and written with their partition's number, so that totals and
    rows agree whatever is run again; totals of the partitions, one row each, give every
    partition its base, and windows run inside partitions. Ties in ``order`` must be broken by
    it. Columns of ``rows`` may have any other name than ``out``.
    """
    spark, taken = rows.sparkSession, {c.lower() for c in rows.columns}
    part, base, last, total = (next(n for n in (f"{b}{'_' * k}" for k in range(1, len(taken) + 2)) if n not in taken) for b in ("part", "base", "last", "total"))
    at = f"{shared_folder(spark, 'ranges')}/rows"
    ranged = rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    ranged.write.parquet(at)
    held = spark.read.schema(ranged.schema).parquet(at)
    totals = held.groupBy(part).agg(F.max(F.struct(*order)).alias(last), F.sum(value).alias(total))
    bases = totals.select(part, (F.sum(total).over(Window.orderBy(last)) - F.col(total)).alias(base))
    inside = held.withColumn(out, F.sum(value).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(F.broadcast(bases), part).withColumn(out, F.col(out) + F.col(base)).drop(part, base)


def sweep_size(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """Rows to remove, oldest first, until at most ``cap`` bytes are left."""
    total = rows.agg(F.sum("size").alias("total"))
    run = running_total(rows, order, "size", "upto").join(F.broadcast(total))
    return run.where(F.col("total") - F.col("upto") + F.col("size") > cap)


def prune_jobs(jobs: DataFrame, most: int, age_us: int) -> DataFrame:
    """Finished jobs over an age, once the table holds more than ``most`` jobs."""
    facts = jobs.agg(F.count("*").alias("n"), F.max("created_us").alias("now"))
    return jobs.join(F.broadcast(facts)).where((F.col("n") > most) & F.col("state").isin("done", "failed") & (F.col("created_us") < F.col("now") - age_us))
