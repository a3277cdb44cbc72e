"""The same indices on streams: event-time windows with a watermark, and per-satellite state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rms(stream: DataFrame, time: str, keys: list[str], value: str, window: str = "1 hour", late: str = "2 minutes") -> DataFrame:
    """Root mean square by window; rows later than late are dropped once the watermark has passed their window."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys)
    return rows.agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "rms", "n")


def passes_of(stream: DataFrame, time: str, keys: list[str], gap: str = "10 minutes", late: str = "2 minutes") -> DataFrame:
    """Satellite passes as session windows: start, end and rows."""
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def live_smoothed(stream: DataFrame, key: str, time: str, code: str, phase: str, idle_ms: int = 600_000) -> DataFrame:
    """Carrier-smoothed code with the arc's running sum as state: (key, time, smoothed). An arc ends after idle_ms without rows.

    Rows of one trigger are taken in order of time; a row older than the last one
    of its key is left out.
    """

    def step(found: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, -1)
        pdf = pd.concat(list(batches)).sort_values(time)
        stamps = pdf[time].astype("datetime64[us]").astype("int64")
        pdf = pdf[stamps > last]
        sums = total + (pdf[code] + pdf[phase]).cumsum()
        counts = n + pd.Series(range(1, len(pdf) + 1), index=pdf.index)
        if len(pdf):
            state.update((int(counts.iloc[-1]), float(sums.iloc[-1]), int(stamps[pdf.index].iloc[-1])))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: found[0], time: pdf[time], "smoothed": sums / counts - pdf[phase]})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} {kinds[time]}, smoothed double", "n long, total double, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)
