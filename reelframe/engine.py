"""The engine's front door: ingest, plan, render, lint and fit over many clips at once.

All methods are lazy: they take and return DataFrames. Errors are values in an ``error``
column; nothing raises for a single bad row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names, planning, recipes
from .operators import fit, media, storage, temporal

PIPELINE_VERSION, RULES_VERSION = 1, 1


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def ingest(self, path: str, present: DataFrame | None = None) -> DataFrame:
        """Files under ``path`` as sources (hash, name, ext, format, size), one row a content; known hashes are left out."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        name = names.sanitize_name(F.col("path"))
        rows = files.select(F.sha2("content", 256).alias("hash"), name.alias("name"), names.sniff(F.col("content")).alias("format"), F.col("length").alias("size"), F.col("modificationTime").alias("uploaded"))
        rows = rows.withColumn("ext", names.sanitize_ext(F.regexp_extract("name", r"\.([^.]*)$", 1)))
        if present is not None:
            rows = rows.join(present.select("hash"), "hash", "left_anti")
        return rows.groupBy("hash").agg(F.min_by(F.struct("name", "ext", "format", "size", "uploaded"), "uploaded").alias("s")).select("hash", "s.*")

    def plan(self, clips: DataFrame) -> DataFrame:
        """Output size, rate, frames and error of recipes (w, h, fps, duration, start, speed, box_w, box_h, fit, format)."""
        w, h = planning.scaled_size(F.col("w"), F.col("h"), F.col("box_w"), F.col("box_h"), F.col("fit"))
        out = clips.withColumns({"out_w": w, "out_h": h, "out_fps": planning.snap_fps(F.col("fps"), F.lit(None).cast("double"), F.col("format")), "out_duration": (F.col("duration") - F.col("start")) / F.col("speed")})
        out = out.withColumn("out_frames", temporal.frame_count(F.col("out_duration"), F.col("out_fps")))
        error = F.when(F.col("start") >= F.col("duration"), F.lit("trim")).otherwise(planning.plan_error(F.col("out_w"), F.col("out_h"), F.col("speed"), F.col("out_frames")))
        return out.withColumn("error", error)

    def split_cached(self, asked: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(to render, cached) by result key; ``asked`` has a canonicalisable ``recipe`` JSON column."""
        keyed = asked.withColumn("key", recipes.result_key(F.sha2(recipes.canonical(F.col("recipe")), 256), PIPELINE_VERSION, RULES_VERSION))
        return keyed.join(done.select("key"), "key", "left_anti"), keyed.join(done.select("key"), "key", "left_semi")

    def resample(self, frames: DataFrame, fps: float, keep: list[str]) -> DataFrame:
        return temporal.resample(frames, F.lit(fps), keep)

    def render(self, pixels: DataFrame, w: int, h: int, fmt: str, target: str = "") -> DataFrame:
        """One file a clip with the findings of its rules: clip, format, content, ok, errors."""
        files = media.encode_clips(pixels, w, h, fmt)
        found = media.lint_files(files, target).groupBy("clip").agg(F.count_if(~F.col("ok") & (F.col("level") == "error")).alias("errors"))
        return files.join(found, "clip").withColumn("ok", F.col("errors") == 0)

    def lint(self, files: DataFrame, target: str = "") -> DataFrame:
        return media.lint_files(files, target)

    def mend(self, files: DataFrame) -> DataFrame:
        return media.fix_files(files)

    def probe(self, files: DataFrame) -> DataFrame:
        return media.facts(files)

    def fit(self, curve: DataFrame, target: int) -> DataFrame:
        """Winner and alternatives of each clip's ladder of rungs (clip, rung, base)."""
        return fit.winners(fit.rung_outcomes(curve, F.lit(target)))

    def commit(self, result: DataFrame, path: str) -> None:
        storage.publish(result, path)
