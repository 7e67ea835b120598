"""Low-disk alerts as a stream: each volume's last notice and snooze are its state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86400.0
OUTPUT = "volume string, seq long, at double, state string"


class Alerts(StatefulProcessor):
    """The state machine of one volume, reading by reading.

    Rows have kind ``reading`` (free, threshold, enabled) or ``snooze`` (days). A reading is
    disabled, failed (nothing measured), ok (enough free), snoozed, debounced (notified
    less than ``debounce_s`` before) or notify, which is the notice that later ones are
    measured by. A snooze lasts from its time on; a later one takes its place. When it is
    over, a timer takes it out of the state.
    """

    def __init__(self, debounce_s: float):
        self.debounce_s = debounce_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_notified", "at double")
        self.snooze = handle.getValueState("snoozed_until", "at double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        last = self.last.get()[0] if self.last.exists() else None
        until = self.snooze.get()[0] if self.snooze.exists() else None
        before, out = (last, until), []
        batch = pd.concat(list(rows)).sort_values(["at", "seq"])  # what one micro-batch holds of the volume
        for seq, at, kind, free, threshold, enabled, days in zip(*(batch[c] for c in ("seq", "at", "kind", "free", "threshold", "enabled", "days")), strict=True):
            if kind == "snooze":
                until = at + days * DAY
                continue
            if not enabled:
                what = "disabled"
            elif pd.isna(free):
                what = "failed"
            elif free >= threshold:
                what = "ok"
            elif until is not None and at < until:
                what = "snoozed"
            elif last is not None and at - last < self.debounce_s:
                what = "debounced"
            else:
                what, last = "notify", float(at)
            out.append((key[0], int(seq), float(at), what))
        if last is not None and last != before[0]:
            self.last.update((last,))
        if until is not None and until != before[1]:
            self.snooze.update((float(until),))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(until * 1000))
        yield pd.DataFrame(out, columns=["volume", "seq", "at", "state"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        if self.snooze.exists() and self.snooze.get()[0] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.snooze.clear()
        yield pd.DataFrame({"volume": pd.Series(dtype=str), "seq": pd.Series(dtype="int64"), "at": pd.Series(dtype="float64"), "state": pd.Series(dtype=str)})

    def close(self) -> None:
        """Nothing is held open."""


def alerts(readings: DataFrame, debounce_s: float, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """(volume, seq, at, state) of each reading of a stream (volume string, seq, at, kind, free, threshold, enabled, days, ``time_col`` timestamp).

    ``at`` are the seconds of ``time_col``. Rows of a volume go by time, then seq, within a
    micro-batch; those more than ``late`` behind the latest seen so far are left out.
    Needs the state store STORE.
    """
    marked = readings.withWatermark(time_col, late)
    return marked.groupBy("volume").transformWithStateInPandas(Alerts(debounce_s), OUTPUT, "Append", "EventTime")
