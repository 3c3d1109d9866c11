"""Behaviour tracks: steps, motion states, sessions, zones, from one row a frame (keys, frame, x, y)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab.operators import cloud
from neurotab.operators import sequence as seq


def steps(df: DataFrame, keys: Sequence[str], order: Sequence[str], fps: float, scale: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """df with ``dist`` to the place before (0 in the first frame) and ``speed``; missing places keep the last known one, leading ones go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = seq.carry_forward(seq.carry_forward(df, keys, order, x, x), keys, order, y, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    dist = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) * scale, F.lit(0.0))
    return d.withColumn("dist", dist).withColumn("speed", F.col("dist") * fps)


def motion_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], width: int = 30, freeze: float = 2.0, slow: float = 15.0) -> DataFrame:
    """``motion`` by the smoothed speed: Freezing, Immobility or Mobility."""
    d = seq.centred_mean(df, keys, order, "speed", width, "_s")
    return d.withColumn("motion", F.when(F.col("_s") < freeze, "Freezing").when(F.col("_s") < slow, "Immobility").otherwise("Mobility")).drop("_s")


def sessions(df: DataFrame, keys: Sequence[str], fps: float) -> DataFrame:
    """Duration, total distance and mean speed of each session, from rows of steps()."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("dist").alias("distance"), F.avg("speed").alias("mean_speed"))
    return g.select(*keys, (F.col("n") / fps).alias("duration"), "distance", "mean_speed")


def zone_summary(df: DataFrame, keys: Sequence[str], order: Sequence[str], fps: float, zone: str = "zone", first: str | None = None) -> DataFrame:
    """Duration, distance and entries of each zone; ``first`` is the zone before the first frame."""
    before = F.lag(zone, 1, first).over(Window.partitionBy(*keys).orderBy(*order))
    enters = (~F.col(zone).eqNullSafe(before)) if first is not None else (F.col(zone) != before)
    d = df.withColumn("_e", F.coalesce(enters, F.lit(False)).cast("int"))
    g = d.groupBy(*keys, zone).agg(F.count("*").alias("n"), F.sum("dist").alias("distance"), F.sum("_e").alias("entries"))
    return g.select(*keys, zone, (F.col("n") / fps).alias("duration"), "distance", "entries")


def maze(track: DataFrame, zones: DataFrame, keys: Sequence[str], frame: str, fps: float, scale: float, centre: str = "Center") -> DataFrame:
    """One row a session: duration, distance, mean speed, arm entries in order, alternation."""
    d = cloud.zone_of(steps(track, keys, [frame], fps, scale), zones, keys, frame)
    arms = seq.entries(d.where(F.col("zone") != centre), keys, [frame], "zone")
    a = seq.alternation(arms, keys, [frame], "zone")
    path = arms.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(frame, "zone"))), lambda s: s.zone), " > ").alias("arm_sequence"))
    out = sessions(d, keys, fps).join(a, list(keys), "left").join(path, list(keys), "left")
    return out.withColumn("alternation_pct", F.bround("alternation_pct", 4))


def open_field(track: DataFrame, keys: Sequence[str], frame: str, fps: float, scale: float, ratio: float = 0.5) -> DataFrame:
    """Sessions with duration, distance and entries of the centre rectangle of each key's bounding box."""
    box = cloud.centre_zone(track, keys, ratio)
    d = steps(track, keys, [frame], fps, scale).join(box, list(keys))
    inside = F.col("x").between(F.col("left"), F.col("right")) & F.col("y").between(F.col("low"), F.col("high"))
    d = d.withColumn("zone", F.when(inside, "Center").otherwise("Periphery"))
    centre = zone_summary(d, keys, [frame], fps).where("zone = 'Center'").select(*keys, F.col("duration").alias("centre_duration"), F.col("distance").alias("centre_distance"), F.col("entries").alias("centre_entries"))
    return sessions(d, keys, fps).join(centre, list(keys), "left")
