"""Joins on distance and time, made equi-joins by buckets.

A condition like ``low <= t < high`` alone is a nested loop. Here both sides get
buckets of a fixed width, a row of the interval side once for each bucket that it
touches, and the condition is checked inside buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.sources.shared import parts, settled


def interval_join(events: DataFrame, samples: DataFrame, keys: Sequence[str], at: str, time: str, before: float, after: float, width: float | None = None) -> DataFrame:
    """Samples with at - before <= time < at + after for each event, with ``rel`` = time - at."""
    width = width or (before + after)
    low, high = F.floor((F.col(at) - before) / width), F.floor((F.col(at) + after) / width)
    e = events.withColumn("_b", F.explode(F.sequence(low, high)))
    s = samples.withColumn("_b", F.floor(F.col(time) / width))
    j = e.join(s, [*keys, "_b"]).withColumn("rel", F.col(time) - F.col(at))
    return j.where((F.col("rel") >= -before) & (F.col("rel") < after)).drop("_b")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """For each left row the values of the latest right row at or before it: one union, one window, no pairs."""
    tagged = F.struct(*values)
    a = left.select(*keys, F.col(time), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(tagged).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(*keys, F.col(time), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), tagged.alias("_r"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    u = a.union(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return u.select("_l.*", *(F.col(f"_r.{v}").alias(v) for v in values))


def _cells(df: DataFrame, size: float, around: bool, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    cell = [F.floor(F.col(c) / size) for c in names]
    if not around:
        return df.withColumn("_cell", F.xxhash64(*cell))
    out = df
    for i, c in enumerate(cell):
        out = out.withColumn(f"_c{i}", F.explode(F.sequence(c - 1, c + 1)))
    return out.withColumn("_cell", F.xxhash64(*(F.col(f"_c{i}") for i in range(len(names))))).drop(*(f"_c{i}" for i in range(len(names))))


def radius_join(left: DataFrame, right: DataFrame, radius: float, strict: bool = False, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """All (left, right) within the radius, by cells of its size; right columns get the suffix _r. ``dist`` is their distance."""
    r = right.select(*(F.col(c).alias(f"{c}_r") for c in right.columns))
    r = _cells(r, radius, False, [f"{c}_r" for c in names])
    j = _cells(left, radius, True, names).join(r, "_cell")
    d2 = sum(((F.col(c) - F.col(f"{c}_r")) * (F.col(c) - F.col(f"{c}_r")) for c in names), F.lit(0.0))
    dist = F.sqrt(d2)
    return j.withColumn("dist", dist).where(dist < radius if strict else dist <= radius).drop("_cell")


def _finite(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(c) < float("inf")) for c in names))


def _fitting(df: DataFrame, size: float, names: Sequence[str], each: int) -> float:
    """The size, halved until the pairs that share a cell are at most ``each`` a row of df (or cells hold one place each)."""
    for _ in range(40):
        cells = df.groupBy(*(F.floor(F.col(c) / size) for c in names)).agg(F.count("*").alias("n"))
        pairs, rows = cells.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum("n")).first()
        if pairs is None or pairs <= each * rows:
            break
        size /= 2
    return size


def knn_join(left: DataFrame, right: DataFrame, key: str, right_key: str, k: int, start: float, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The k nearest right rows of each left row, or all if there are fewer, with ``rank`` and ``dist``.

    A ring of cells is searched; a left row is settled if its k-th distance lies
    within the ring, and the rest is searched again with cells twice as wide. The
    first cells are ``start`` wide, or narrower where so many right rows share cells
    that pairs would grow with their square; of right rows at one place only the k
    first by key can be among the nearest, so no others are searched. Rows
    without key or with a place that isn't finite have no neighbour and are no
    neighbours; with no right row the result has no row.
    """
    finite = _finite(names)
    right = right.where(finite)
    n = right.count()
    if not n:
        return radius_join(left.where(finite & F.col(key).isNotNull()), right, start, names=names).withColumn("rank", F.lit(1))
    here = Window.partitionBy(*(F.col(c) + 0.0 for c in names)).orderBy(right_key)  # -0.0 + 0.0 is 0.0
    right = settled(right.withColumn("_r", F.row_number().over(here)).where(F.col("_r") <= k).drop("_r"))
    size, done = _fitting(right, start, names, 4 * k), None
    # rows are numbered, so rows that repeat a key have k neighbours each
    open_ = settled(left.where(finite & F.col(key).isNotNull()).withColumn("_row", F.monotonically_increasing_id()))
    order = Window.partitionBy("_row").orderBy("dist", f"{right_key}_r")
    while True:
        near = radius_join(open_, right, size, names=names).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = near.withColumn("_n", F.count("*").over(Window.partitionBy("_row")))
        found = settled(near.where(F.col("_n") >= min(k, n)).drop("_n"))
        done = found if done is None else done.union(found)
        open_ = settled(open_.join(found.select("_row").distinct(), "_row", "left_anti").select(*left.columns, "_row"))
        if not open_.limit(1).count():
            return done.drop("_row")
        size *= 2


def first_within(left: DataFrame, right: DataFrame, radius: float, key: str, right_key: str, n: int, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(key, <right_key>_r): of the right rows within the radius of a left key the n smallest by key, without forming the others.

    Right rows come in order of their key, in slices that double; a left key takes
    part until it has n. Where many rows lie within the radius the first slices
    settle a key, so pairs don't grow with the square of a dense place.
    """
    hit = f"{right_key}_r"
    r = right.where(_finite(names) & F.col(right_key).isNotNull()).select(F.col(right_key).alias(hit), *(F.col(c).alias(f"{c}_r") for c in names))
    ranges = min(parts(r, 1_000), 2_000)
    r = settled(r.repartitionByRange(ranges, hit).withColumn("_range", F.spark_partition_id()))
    kind = F.array().cast(f"array<{right.schema[right_key].dataType.simpleString()}>")
    open_, done, low, high = left.where(_finite(names) & F.col(key).isNotNull()).select(key, *names).withColumn("_ids", kind), [], 0, 1
    while low < ranges:
        part = r.where((F.col("_range") >= low) & (F.col("_range") < high))
        # the smaller side goes to all cells around
        if part.count() < open_.count():
            j = _cells(open_, radius, False, names).join(_cells(part, radius, True, [f"{c}_r" for c in names]), "_cell")
        else:
            j = _cells(open_, radius, True, names).join(_cells(part, radius, False, [f"{c}_r" for c in names]), "_cell")
        d2 = sum(((F.col(c) - F.col(f"{c}_r")) * (F.col(c) - F.col(f"{c}_r")) for c in names), F.lit(0.0))
        g = j.where(F.sqrt(d2) <= radius).groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_set(hit)).alias("_new"))
        now = settled(open_.join(g, F.col(key) == F.col("_key"), "left").select(key, *names, F.slice(F.concat("_ids", F.coalesce("_new", kind)), 1, n).alias("_ids")))
        done.append(now.where(F.size("_ids") >= n))
        open_ = now.where(F.size("_ids") < n)
        if not open_.limit(1).count():
            break
        low, high = high, min(2 * high, ranges)
        if low == high:
            break
    return reduce(DataFrame.unionByName, [*done, open_]).select(key, F.explode("_ids").alias(hit)).distinct()


def pad_groups(hits: DataFrame, key: str, right_key: str, n: int) -> DataFrame:
    """The first n hits of each key by right_key; short groups repeat their first hit."""
    ids = F.slice(F.array_sort(F.collect_set(right_key)), 1, n)
    g = hits.groupBy(key).agg(ids.alias("_ids"))
    full = F.concat("_ids", F.array_repeat(F.col("_ids")[0], n - F.size("_ids")))
    return g.select(key, F.posexplode(full).alias("slot", right_key))


def surface_nodes(df: DataFrame, x: str, y: str, n: int) -> list[tuple[float, float]]:
    """The n x n nodes of an even grid over the range of x and y; none for an empty table."""
    r = tuple(df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first())
    if None in r:
        return []
    return [(float(a), float(b)) for a in np.linspace(r[0], r[1], n) for b in np.linspace(r[2], r[3], n)]


def kernel_surface(df: DataFrame, x: str, y: str, z: str, nodes: Sequence[tuple[float, float]], sigma: float = 4.0) -> DataFrame:
    """(x, y, z): at each node the mean of all known z, weighted by a Gaussian of the distance; null where all weights vanish.

    The nodes are the query set, whose size doesn't depend on the table. A task adds
    up weights block by block and emits one row a node, so nothing else is shuffled.
    Rows with a null or NaN in a column don't count.
    """
    at = np.array(nodes, float).reshape(-1, 2)

    def sums(batches):
        total = np.zeros((2, len(at)))
        for batch in batches:
            p = batch.to_numpy(float)
            for b in range(0, len(p), 512):
                q = p[b : b + 512]
                w = np.exp(-((q[:, :1] - at[:, 0]) ** 2 + (q[:, 1:2] - at[:, 1]) ** 2) / (2 * sigma * sigma))
                total += [w.sum(0), q[:, 2] @ w]
        yield pd.DataFrame({"x": at[:, 0], "y": at[:, 1], "w": total[0], "wz": total[1]})

    known = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip((x, y, z), ("x", "y", "z")))).dropna()
    parts = known.mapInPandas(sums, "x double, y double, w double, wz double")
    total = parts.groupBy("x", "y").agg(F.sum("w").alias("w"), F.sum("wz").alias("wz"))
    return total.select("x", "y", F.when(F.col("w") > 0, F.col("wz") / F.col("w")).alias("z"))
