"""Job events as a stream: coalescing with state per job, and windowed rates with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import SCHEMA, published

COLUMNS = ["job", "seq", "ts_ms", "stage", "percent"]
#: A state goes when the events' own time has passed its last one by this; events later than that are left out.
IDLE_MS = 3_600_000


def _timed(events: DataFrame) -> DataFrame:
    """Events with their own time, which states time out by: a stream that has read all it has ends, whatever the clock says.

    A stream's mark begins at time 0 and leaves out what isn't behind it; a log may begin there.
    """
    return events.select(*COLUMNS, F.timestamp_millis(F.col("ts_ms") + 1).alias("at")).withWatermark("at", f"{IDLE_MS // 1000} seconds")


def _hold(state: GroupState, rows: pd.DataFrame) -> None:
    state.setTimeoutTimestamp(max(int(rows["ts_ms"].max()), state.getCurrentWatermarkMs()) + IDLE_MS)


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A job's rows by seq; most come in one batch and in order, and pandas takes longest for what is done a job."""
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    return rows if rows["seq"].is_monotonic_increasing else rows.sort_values("seq")


def coalesce_stream(events: DataFrame) -> DataFrame:
    """The streaming form of ``operators.events.coalesce_events``: the state of a job is the time and stage that went out last.

    Events of a micro-batch are taken in order of seq; a job's state goes an hour after its last event.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(batches)
        ms, stage = state.get if state.exists else (None, None)
        keep, ms, stage = published(rows, ms, stage)
        state.update((int(ms), stage))
        _hold(state, rows)
        yield rows.loc[keep, COLUMNS]

    return _timed(events).groupBy("job").applyInPandasWithState(step, SCHEMA, "ms long, stage string", "append", GroupStateTimeout.EventTimeTimeout)


def stage_rates(events: DataFrame, late: str = "1 minute", width: str = "10 seconds") -> DataFrame:
    """Events per stage and tumbling window; events later than ``late`` are left out."""
    timed = events.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "stage").agg(F.count("*").alias("events"))


def monotone_stream(events: DataFrame) -> DataFrame:
    """Percents that never fall within a job's stage, with the highest so far as state: the streaming form of a running maximum."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(batches)
        most = rows["percent"].cummax()
        if state.exists:
            most = most.clip(lower=state.get[0])
        state.update((int(most.iloc[-1]),))
        _hold(state, rows)
        yield rows.assign(percent=most)[COLUMNS]

    return _timed(events).groupBy("job", "stage").applyInPandasWithState(step, SCHEMA, "percent long", "append", GroupStateTimeout.EventTimeTimeout)
