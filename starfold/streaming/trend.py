"""The sliding biweight trend of streams (an extension): each key's rows are held for about a window, not for ever.

A row's trend takes the usable rows half a window to either side, within its segment. It can be told
once the watermark is past the row's time plus half a window: a timer of the key says when. What no later row can
reach leaves the state, so an idle key has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from starfold.operators.kernels import biweight_trend

_BUFFER = T.StructType([T.StructField("us", T.LongType()), T.StructField("cadence", T.LongType()), T.StructField("flux", T.DoubleType()), T.StructField("told", T.BooleanType())])
RESULT = "target_id long, cadence long, time_us long, flux_detrended double, trend double"


def due_ms(time_us, half_us: int):
    """The watermark, in milliseconds, from which on a row's window is whole."""
    return (time_us + half_us) // 1000 + 1


def trends(us: np.ndarray, flux: np.ndarray, wanted: np.ndarray, half_us: int, gap_us: int) -> np.ndarray:
    """The trend at the ``wanted`` rows, which are in the order of time; a gap longer than ``gap_us`` parts segments."""
    out = np.empty(len(wanted))
    segment = np.concatenate([[0], np.cumsum(np.diff(us) > gap_us)])
    for s in np.unique(segment[wanted]):
        rows = np.flatnonzero(segment == s)
        mine = segment[wanted] == s
        at = wanted[mine] - rows[0]
        t = us[rows].astype(float)
        out[mine] = biweight_trend(t, flux[rows], np.ones(len(rows), bool), 2.0 * half_us, at)[at]
    return np.where(out > 0, out, 1.0)


class SlidingTrend(StatefulProcessor):
    def __init__(self, half_us: int, gap_us: int):
        self.half_us, self.gap_us = half_us, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", _BUFFER)
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("at", T.LongType())]))

    def _wake(self, at: int) -> None:
        """One timer a key: the earliest."""
        now = self.timer.get()
        if now is not None and now[0] <= at:
            return
        if now is not None:
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for part in rows:
            part = part[part["flux"].notna() & np.isfinite(part["flux"])]
            if len(part):
                self.buffer.appendList([(int(u), int(c), float(x), False) for u, c, x in zip(part["time_us"], part["cadence"], part["flux"], strict=True)])
                least = int(part["time_us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self._wake(int(due_ms(first, self.half_us)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        held = sorted(tuple(r) for r in self.buffer.get())
        us, cadence = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
        flux, told = np.array([r[2] for r in held], float), np.array([r[3] for r in held], bool)
        ready = ~told & (due_ms(us, self.half_us) <= watermark)
        wanted = np.flatnonzero(ready)
        waiting = us[~told & ~ready]
        if len(waiting):
            keep = np.flatnonzero(us >= waiting[0] - self.half_us)
            self.buffer.put([(*held[i][:3], bool(told[i] or ready[i])) for i in keep])
            self._wake(int(due_ms(int(waiting[0]), self.half_us)))
        else:
            self.buffer.clear()
        if len(wanted):
            trend = trends(us, flux, wanted, self.half_us, self.gap_us)
            yield pd.DataFrame({"target_id": key[0], "cadence": cadence[wanted], "time_us": us[wanted], "flux_detrended": flux[wanted] / trend, "trend": trend})

    def close(self) -> None:
        pass


def sliding_trend(stream: DataFrame, window_us: int, gap_us: int, delay: str) -> DataFrame:
    """(target_id, cadence, time_us, flux_detrended, trend) of a stream of (target_id, cadence, ts, flux), each row once its window is whole.

    ``ts`` is a timestamp; rows later than ``delay`` behind the latest are dropped. Rows with a null key, time or flux, or one that
    isn't finite, take no part. Rows of one time count each; repeated rows count as often as they come. Run it with ``append_to_end``.
    """
    rows = stream.filter("target_id IS NOT NULL AND ts IS NOT NULL").select("target_id", "cadence", "ts", F.unix_micros("ts").alias("time_us"), "flux").withWatermark("ts", delay)
    processor = SlidingTrend(window_us // 2, gap_us)
    return rows.groupBy("target_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
