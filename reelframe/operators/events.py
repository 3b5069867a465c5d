"""Job events: coalescing, buffers, progress text; a batch and a streaming form of the stateful one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_MS = 100
#: Events that a subscriber's buffer holds.
BUFFER = 32
SCHEMA = "job long, seq long, ts_ms long, stage string, percent long"


def published(rows: pd.DataFrame, last_ms: int | None, last_stage: str | None) -> tuple[list[bool], int | None, str | None]:
    """Which events go out: a change of stage, or at least LEAST_MS since the last that did."""
    out = []
    for ms, stage in zip(rows["ts_ms"], rows["stage"], strict=True):
        go = last_ms is None or stage != last_stage or ms - last_ms >= LEAST_MS
        if go:
            last_ms = ms
        last_stage = stage
        out.append(go)
    return out, last_ms, last_stage


def coalesce_events(events: DataFrame) -> DataFrame:
    """The events that are published, per job in order of seq.

    What goes out depends on what went out before, which no window can say; events stream
    through sorted partitions and the state is one job's, so a long job needs no more memory.
    """
    dealt = events.select("job", "seq", "ts_ms", "stage", "percent").repartition("job").sortWithinPartitions("job", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, ms, stage = None, None, None
        for f in frames:
            keep = []
            for key, rows in f.groupby("job", sort=False):
                if key != job:
                    job, ms, stage = key, None, None
                on, ms, stage = published(rows, ms, stage)
                keep += on
            yield f[keep]

    return dealt.mapInPandas(run, SCHEMA)


def last_events(events: DataFrame, n: int) -> DataFrame:
    """A subscriber's buffer: the newest ``n`` events of each job."""
    w = Window.partitionBy("job").orderBy(F.desc("seq"))
    return events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def parse_progress(blocks: DataFrame) -> DataFrame:
    """out_ms of key=value blocks; a block without a time keeps the one before.

    out_time_us counts first. out_time_ms holds microseconds in spite of its name, unless the
    clock time in the same block is nearer to it as milliseconds; the clock alone counts last.
    """
    number = lambda key: F.expr(f"try_cast(regexp_extract(block, '(?m)^{key}=(-?[0-9]+)$', 1) AS BIGINT)")
    part = lambda i: F.expr(f"try_cast(regexp_extract(block, '(?m)^out_time=([0-9]+):([0-9]+):([0-9]+)[.]?([0-9]*)', {i}) AS BIGINT)")
    micros = F.expr("try_cast(rpad(regexp_extract(block, '(?m)^out_time=([0-9]+):([0-9]+):([0-9]+)[.]?([0-9]*)', 4), 6, '0') AS BIGINT)")
    rows = blocks.withColumns({"us": number("out_time_us"), "ms": number("out_time_ms"), "clock": ((part(1) * 60 + part(2)) * 60 + part(3)) * 1_000_000 + micros})
    as_millis = (F.col("clock") > 0) & (F.abs(F.col("ms") * 1000 - F.col("clock")) < F.abs(F.col("ms") - F.col("clock")))
    whole = lambda c: F.expr(f"{c} div 1000")
    at = F.when(F.col("us").isNotNull(), whole("us")).when(F.col("ms").isNotNull(), F.when(as_millis, F.col("ms")).otherwise(whole("ms"))).otherwise(whole("clock"))
    w = Window.partitionBy("job").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("job", "seq", F.last(at, ignorenulls=True).over(w).alias("out_ms"))
