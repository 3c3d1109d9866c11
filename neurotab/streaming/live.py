"""The batch operators on streams: window features, gap-closed bouts, and carried state by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_means(stream: DataFrame, keys: Sequence[str], time: str, value: str, width: str, step: str, late: str) -> DataFrame:
    """Rows, mean and population variance of each window; rows later than ``late`` behind the newest are dropped."""
    w = stream.withWatermark(time, late).groupBy(*keys, F.window(time, width, step).alias("win"))
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def live_bouts(stream: DataFrame, keys: Sequence[str], time: str, gap: str, late: str) -> DataFrame:
    """Bouts of rows no more than ``gap`` apart."""
    s = stream.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("bout"))
    return s.agg(F.count("*").alias("n")).select(*keys, F.col("bout.start").alias("start"), F.col("bout.end").alias("end"), "n")


def live_entries(stream: DataFrame, key: str, time: str, label: str, idle_ms: int = 3_600_000) -> DataFrame:
    """key, time, label, entry of each row whose label differs from the key's last one; a key idle too long starts anew.

    The state of a key is its last label and its number of entries.
    """
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, time, label)}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, n = state.get if state.exists else (None, 0)
        for pdf in batches:
            out = []
            for t, x in sorted(zip(pdf[time], pdf[label])):
                if x != last:
                    last, n = x, n + 1
                    out.append((k[0], t, x, n))
            yield pd.DataFrame(out, columns=[key, time, label, "entry"])
        state.update((last, n))
        state.setTimeoutDuration(idle_ms)

    schema = f"{key} {kinds[key]}, {time} {kinds[time]}, {label} {kinds[label]}, entry long"
    return stream.groupBy(key).applyInPandasWithState(step, schema, f"last {kinds[label]}, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_spikes(stream: DataFrame, key: str, time: str, dead: float, idle_ms: int = 3_600_000) -> DataFrame:
    """key and time of rows kept greedily more than ``dead`` apart, across batches."""
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, time)}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in batches:
            kept = []
            for t in sorted(pdf[time]):
                if last is None or t - last > dead:
                    last = float(t)
                    kept.append(t)
            yield pd.DataFrame({key: [k[0]] * len(kept), time: kept})
        if last is not None:
            state.update((last,))
            state.setTimeoutDuration(idle_ms)

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} {kinds[time]}", "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)
