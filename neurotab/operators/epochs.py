"""Epoched EEG: desynchronisation against baseline, time-frequency power, trigger artefacts, channel order.

Epochs are rows (keys, channel, epoch, rel_t, value); a kernel sees one epoch of
one channel, and averages over epochs are Spark aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.operators.signal import morlet_power, welch_psd


def near_any(c: Column, codes: Sequence[float]) -> Column:
    """Whether a value is within 1e-8 + 1e-5 * |code| of any code."""
    return F.exists(F.array(*map(F.lit, codes)), lambda k: F.abs(c - k) <= 1e-8 + 1e-5 * F.abs(k))


def blank_triggers(df: DataFrame, trigger: str, values: Sequence[str], codes: Sequence[float]) -> DataFrame:
    """All values of rows whose trigger is near a code become 0."""
    hit = near_any(F.col(trigger), codes)
    return df.withColumns({v: F.when(hit, 0.0).otherwise(F.col(v)) for v in values})


def cut_epochs(samples: DataFrame, triggers: DataFrame, keys: Sequence[str], time: str, low: float, high: float) -> DataFrame:
    """Samples of each trigger from low to high, limits included, as rel_t; epochs that reach past the recording are dropped."""
    from neurotab.operators.ranges import interval_join

    span = samples.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    whole = triggers.join(span, list(keys)).where((F.col("at") + low >= F.col("_a")) & (F.col("at") + high <= F.col("_b"))).drop("_a", "_b")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1
    j = interval_join(whole.withColumn("epoch", number), samples, keys, "at", time, -low, high + 1e-9)
    return j.withColumnRenamed("rel", "rel_t").drop("at")


def spectra(epochs: DataFrame, keys: Sequence[str], time: str, value: str, fs: float, width: int, overlap: float) -> DataFrame:
    """keys, freq and ``power`` averaged over the epochs of each key."""
    kinds = ", ".join(f"{c} {epochs.schema[c].dataType.simpleString()}" for c in keys)

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f, p = welch_psd(pdf.sort_values(time)[value].to_numpy(float), fs, width, overlap)
        return pd.DataFrame({**{c: [v] * len(f) for c, v in zip(keys, key)}, "freq": f, "power": p})

    each = epochs.groupBy(*keys, "epoch").applyInPandas(kernel, f"{kinds}, freq double, power double")
    return each.groupBy(*keys, "freq").agg(F.avg("power").alias("power"))


def desynchronisation(task: DataFrame, rest: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """Band power by trapezoid of two tables of spectra, and the change in percent; 0 where the baseline is 0; ERD if negative, else ERS."""
    from neurotab.operators.sequence import trapezoid

    area = lambda d, out: trapezoid(d.where(F.col("freq").between(low, high)), keys, "freq", "power", out)
    j = area(task, "task").join(area(rest, "base"), list(keys))
    change = F.when(F.col("base") == 0, 0.0).otherwise((F.col("task") - F.col("base")) / F.col("base") * 100.0)
    return j.withColumn("change_pct", change).withColumn("kind", F.when(F.col("change_pct") < 0, "ERD").otherwise("ERS"))


def time_frequency(epochs: DataFrame, keys: Sequence[str], time: str, value: str, fs: float, freqs: Sequence[float], base: tuple[float, float]) -> DataFrame:
    """keys, freq, rel_t and log10 of mean Morlet power over its mean in the baseline span; the real epoch time is kept."""
    kinds = ", ".join(f"{c} {epochs.schema[c].dataType.simpleString()}" for c in keys)
    fr = list(map(float, freqs))

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        p = morlet_power(pdf[value].to_numpy(float), fs, fr)
        n = len(pdf)
        return pd.DataFrame({**{c: [v] * (n * len(fr)) for c, v in zip(keys, key)}, "freq": np.repeat(fr, n), "rel_t": np.tile(pdf[time].to_numpy(float), len(fr)), "power": p.ravel()})

    each = epochs.groupBy(*keys, "epoch").applyInPandas(kernel, f"{kinds}, freq double, rel_t double, power double")
    mean = each.groupBy(*keys, "freq", "rel_t").agg(F.avg("power").alias("power"))
    w = Window.partitionBy(*keys, "freq")
    level = F.avg(F.when(F.col("rel_t").between(*base), F.col("power"))).over(w)
    return mean.withColumn("ersp", F.log10(F.col("power") / level))


def swap_hemispheres(df: DataFrame, channel: str, pairs: Sequence[tuple[str, str]], right: Column) -> DataFrame:
    """Channel names exchanged pairwise where the stimulated side is right."""
    to = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    other = F.create_map(*(F.lit(v) for kv in to.items() for v in kv))[F.col(channel)]
    return df.withColumn(channel, F.when(right, F.coalesce(other, F.col(channel))).otherwise(F.col(channel)))
