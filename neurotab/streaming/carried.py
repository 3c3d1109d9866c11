"""Live state by key that doesn't depend on the order of arrival: position, zone entries and kept spikes in event time.

Rows wait in the key's state until the watermark has passed their time, and are then
taken in order of time, so rows of one key that come in several frames, batches or
out of order give the same results as a sorted table. Timers are those of event time:
one lets waiting rows go, one ends a key that has been idle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "time timestamp, x double, y double, label string, entry long, step double, spike boolean"


class Carried(StatefulProcessor):
    """State of a key: rows that wait; last time, place, label, number of entries and last kept spike of the rows taken."""

    def __init__(self, key: str, kind: str, dead_s: float, idle_s: float):
        self.key, self.kind, self.dead_s, self.idle_s = key, kind, dead_s, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "time timestamp, x double, y double, label string, spike boolean")
        self.last = handle.getValueState("last", "time timestamp, x double, y double, label string, entries long, spike timestamp")

    def _row(self, r) -> tuple:
        clean = lambda v: None if pd.isna(v) else v
        return pd.Timestamp(r.time).to_pydatetime(), clean(r.x), clean(r.y), clean(r.label), bool(clean(r.spike))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            new = [self._row(r) for r in frame.itertuples(index=False) if not pd.isna(r.time)]
            if new:
                self.waiting.appendList(new)
                for at in {int(r[0].timestamp() * 1000) for r in new}:
                    self.handle.registerTimer(at + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ripe = sorted((r for r in rows if r[0].timestamp() * 1000 < mark), key=lambda r: (r[0], r[3] is not None, r[3] or "", r[1] or 0.0, r[2] or 0.0, r[4]))
        if ripe:
            left = [r for r in rows if r[0].timestamp() * 1000 >= mark]
            self.waiting.clear()
            if left:
                self.waiting.put(left)
            yield self._taken(key, ripe)
            self.handle.registerTimer(int((ripe[-1][0].timestamp() + self.idle_s) * 1000) + 1)
        elif self.last.exists() and not rows and (self.last.get()[0].timestamp() + self.idle_s) * 1000 < mark:
            self.last.clear()

    def _taken(self, key, rows: list[tuple]) -> pd.DataFrame:
        time, x, y, label, entries, spike = tuple(self.last.get()) if self.last.exists() else (None, None, None, None, 0, None)
        out = []
        for t, rx, ry, zone, fires in rows:
            if time is not None and (t - time).total_seconds() > self.idle_s:
                x = y = label = spike = None
                entries = 0
            step = ((rx - x) ** 2 + (ry - y) ** 2) ** 0.5 if None not in (rx, ry, x, y) else None
            entered = zone is not None and zone != label
            entries += entered
            kept = fires and (spike is None or (t - spike).total_seconds() > self.dead_s)
            out.append((key[0], t, rx, ry, zone, entries if entered else None, step, kept))
            time, label, spike = t, zone if zone is not None else label, t if kept else spike
            x, y = (rx, ry) if None not in (rx, ry) else (x, y)
        self.last.update((time, x, y, label, entries, spike))
        return pd.DataFrame(out, columns=[self.key, "time", "x", "y", "label", "entry", "step", "spike"]).astype({"entry": "Int64"})

    def close(self) -> None:
        pass


def carried(stream: DataFrame, key: str, time: str, x: str, y: str, label: str, spike: str, late: str, dead_s: float, idle_s: float = 3600.0) -> DataFrame:
    """key, time, x, y, label, entry, step, spike of each row once the watermark (``late`` behind the newest time) has passed it.

    entry is the number of the zone entry where the row begins one (its label differs
    from the last known one), step the distance from the last known place, spike
    whether the row fires and is kept: more than ``dead_s`` after the last one kept. A
    key idle for longer than ``idle_s`` starts anew, and its state goes. Rows without a
    time are dropped, as are those later than the watermark.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key), F.col(time).alias("time"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(label).cast("string").alias("label"), F.col(spike).cast("boolean").alias("spike"))
    rows = rows.withWatermark("time", late)
    return rows.groupBy(key).transformWithStateInPandas(Carried(key, kind, dead_s, idle_s), f"{key} {kind}, {OUT}", "append", "eventTime")
