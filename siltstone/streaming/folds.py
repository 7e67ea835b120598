"""Streaming forms of the event-log fold and of burst sessions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState



def fold_stream(events: DataFrame) -> DataFrame:
    """The last done event of each (batch_id, original_path) so far, as an update stream.

    The state of a key is one struct, its greatest sequence number deciding.
    """
    done = events.filter(F.col("phase") == "done")
    rest = [c for c in events.columns if c not in ("batch_id", "original_path", "seq")]
    last = done.groupBy("batch_id", "original_path").agg(F.max(F.struct("seq", *rest)).alias("e"))
    return last.select("batch_id", "original_path", "e.seq", *(F.col(f"e.{c}").alias(c) for c in rest))


def session_stream(events: DataFrame, key: str, time_col: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions per key: events no further apart than the gap; late ones count until the watermark passes."""
    w = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_stream(events: DataFrame, time_col: str, kind: str, value: str, late: str = "1 day") -> DataFrame:
    """Tumbling days per kind with a watermark."""
    w = events.withWatermark(time_col, late).groupBy(F.window(time_col, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("day"), kind, "n", "total")


def alert_stream(readings: DataFrame, debounce_s: float) -> DataFrame:
    """Low-disk alerts of (volume, at, free, threshold): each volume's last notice is its state.

    A reading below the threshold notifies unless the volume was notified less than
    ``debounce_s`` seconds before.
    """

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["at", "free"])
        out = []
        for at, free, threshold in zip(rows["at"], rows["free"], rows["threshold"], strict=True):
            if free >= threshold:
                what = "ok"
            elif last is not None and at - last < debounce_s:
                what = "debounced"
            else:
                what, last = "notify", float(at)
            out.append((key[0], float(at), what))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["volume", "at", "state"])

    return readings.groupBy("volume").applyInPandasWithState(step, "volume string, at double, state string", "last double", "append", "NoTimeout")
