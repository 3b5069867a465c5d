"""Streaming forms as queries: tables replayed file by file, the sink read back and held against the batch statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import views as V
from ..streaming import events as S
from ..streaming.replay import replay
from .jobs import L
from .registry import ORACLES, query

BATCHES = 6


def _log(spark, d):
    """A job's log in files of three events each, the rest in the last one."""
    return V.log(spark, d).withColumn("file", F.least(F.floor(F.col("seq") / 3), F.lit(BATCHES - 1)).cast("int"))


@query("stream_coalesce", ORACLES["event_coalesce"])
def stream_coalesce(spark, d):
    """Event coalescing with a job's state carried over micro-batches gives what the batch form gives."""
    return replay(_log(spark, d), "file", BATCHES, S.coalesce_stream).select("job", "seq", "ts_ms", "stage")


@query("stream_monotone", ORACLES["progress_monotone"])
def stream_monotone(spark, d):
    return replay(_log(spark, d), "file", BATCHES, S.monotone_stream).select("job", "seq", "stage", "percent")


#: The month of events comes in files of three days; every eleventh event up to three files late.
_FILES, _WIDTH_H, _LATE_H = 10, 6, 12


@query("stream_rates", f"""WITH e AS (SELECT event_id, event_type AS stage, epoch_ms(ts) AS ts_ms, least({_FILES - 1}, (day(ts) - 1) // 3 + CASE WHEN event_id % 11 = 0 THEN event_id % 4 ELSE 0 END) AS file FROM events),
seen AS (SELECT file, max(max(ts_ms)) OVER (ORDER BY file) - {_LATE_H * 3600000} AS mark FROM e GROUP BY file),
w AS (SELECT e.*, ts_ms // {_WIDTH_H * 3600000} * {_WIDTH_H * 3600000} AS start_ms, coalesce((SELECT max(mark) FROM seen WHERE seen.file <= e.file - 2), 0) AS mark FROM e)
SELECT start_ms, stage, count(*) AS events FROM w WHERE start_ms + {_WIDTH_H * 3600000} > mark GROUP BY start_ms, stage HAVING start_ms + {_WIDTH_H * 3600000} <= (SELECT max(mark) FROM seen)""")
def stream_rates(spark, d):
    """Events a stage and window under a watermark: events that come after their window was closed are left out.

    A micro-batch drops what lies before the mark that the batches before the last one left,
    and a window goes out once the mark has passed its end.
    """
    day = F.floor((F.dayofmonth("ts") - 1) / 3)
    file = F.least(F.lit(_FILES - 1), day + F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 4).otherwise(0)).cast("int")
    rows = V.read(spark, d, "events").select(F.col("event_type").alias("stage"), F.floor(V.micros(F.col("ts")) / 1000).cast("long").alias("ts_ms"), file.alias("file"))
    out = replay(rows, "file", _FILES, lambda e: S.stage_rates(e, f"{_LATE_H} hours", f"{_WIDTH_H} hours"))
    return out.select(F.unix_millis("window.start").alias("start_ms"), "stage", "events")
