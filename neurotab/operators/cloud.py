"""Point clouds and voxels: unit sphere, farthest points, components, principal axes, zones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab.operators.signal import whole_groups
from neurotab.sources.shared import settled


def unit_sphere(df: DataFrame, keys: Sequence[str], names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Points centred by key and divided by the largest norm + 1e-6."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in names})
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))
    return d.withColumn("_r", F.max(norm).over(w) + 1e-6).withColumns({c: F.col(c) / F.col("_r") for c in names}).drop("_r")


def farthest_points(df: DataFrame, key: str, id: str, n: int, seed: int, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """n points of each cloud, each farthest from those before, from a seeded start; rank 0 is the start. Ties go to the smaller id.

    All points stay in the choice and no cloud is gathered: a round joins the chosen
    points, one small row a key, and takes the farthest by an aggregation. Rows with a
    null or NaN coordinate are no points.
    """
    d = df.select(key, id, *(F.col(c).cast("double").alias(c) for c in names)).where(_all([F.col(c).isNotNull() & ~F.isnan(c) for c in names]))
    state = settled(d.repartitionByRange(key, id).withColumn("_p", F.spark_partition_id()))
    # the start is the at-th id: its part is known from the parts' counts, its place is counted there
    of_key, by_part = Window.partitionBy(key), Window.partitionBy(key).orderBy("_p")

    @F.pandas_udf("long")
    def drawn(size: pd.Series) -> pd.Series:
        return pd.Series([int(np.random.default_rng(seed).integers(k)) for k in size])

    parts = state.groupBy(key, "_p").agg(F.count("*").alias("_c")).withColumn("_n", F.sum("_c").over(of_key)).withColumn("_b", F.sum("_c").over(by_part) - F.col("_c"))
    at = parts.withColumn("_at", drawn("_n") - F.col("_b")).where("_at >= 0 and _at < _c").select(F.col(key).alias("_k"), F.col("_p").alias("_o"), "_at", "_n")
    held = state.join(F.broadcast(at), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_o")))
    start = held.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_p").orderBy(id))).where("_i = _at + 1")
    point = F.struct(id, *names)
    chosen = settled(start.select(F.col(key).alias("_k"), "_n", F.array(point).alias("_q")))

    state, folded = state.drop("_p").withColumn("_d", F.lit(float("inf"))), 0
    same = F.col(key).eqNullSafe(F.col("_k"))
    for i in range(1, n):
        new = chosen.select("_k", F.slice("_q", folded + 1, i - folded).alias("_new"))
        near = F.array_min(F.transform("_new", lambda q: sum(((F.col(c) - q[c]) * (F.col(c) - q[c]) for c in names[1:]), (F.col(names[0]) - q[names[0]]) * (F.col(names[0]) - q[names[0]]))))
        now = state.join(F.broadcast(new), same).select(key, id, *names, F.least("_d", near).alias("_d"))
        if i - folded == 8:
            state, folded = settled(now), i
            now = state
        far = now.groupBy(key).agg(F.min(F.struct((-F.col("_d")).alias("_m"), id, *names)).alias("_f"))
        chosen = settled(chosen.join(far, same).select("_k", "_n", F.array_append("_q", F.struct(*(F.col(f"_f.{c}").alias(c) for c in (id, *names)))).alias("_q")))
    ranked = chosen.select(F.col("_k").alias(key), "_n", F.posexplode("_q").alias("rank", "_q")).where((F.col("rank") < F.col("_n")) & (F.col("rank") < n))
    return ranked.select(key, F.col(f"_q.{id}").alias(id), F.col("rank").cast("long").alias("rank"))


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n nodes the smallest one that links a-b reach: each round takes the smaller label for both ends and for their labels, then the label of that label."""
    label = np.arange(n)
    while True:
        new, least = label.copy(), np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def voxel_components(df: DataFrame, key: str, places: Sequence[str] = ("i", "j", "k"), diagonal: bool = False) -> DataFrame:
    """df (distinct voxels or pixels) with ``component``: smallest number of a voxel that faces (or also corners) reach.

    Blocks of about 4,096 places are labelled in tasks, many blocks a call. What touches
    across blocks is a much smaller graph: its labels spread by joins, each round to
    the neighbours, to the voxel that the label is of and then along the label's own
    label, with a checkpoint each round.
    No image is gathered in one task. A voxel with a missing key or place is alone.
    """
    side = max(2, round(4096 ** (1 / len(places))))
    steps = [()]
    for _ in places:
        steps = [(*s, v) for s in steps for v in (-1, 0, 1)]
    steps = [s for s in steps if any(s) and (diagonal or sum(map(abs, s)) == 1)]
    block = lambda c: F.floor(c / F.lit(side))
    cells = df.select("*", F.xxhash64(key, *places).alias("_id"), _all([F.col(c).isNotNull() for c in (key, *places)]).alias("_whole"))
    for i, p in enumerate(places):
        cells = cells.withColumns({f"_b{i}": block(F.col(p)), f"_l{i}": F.coalesce(F.pmod(F.col(p), F.lit(side)).cast("long"), F.lit(0))})
    names = [key, *(f"_b{i}" for i in range(len(places)))]
    out = [*df.columns, "_whole", "_root", "_edge"]

    def run(batches):
        for table, first in whole_groups(batches, names):
            at = np.flatnonzero(table["_whole"].to_numpy())
            local = [table[f"_l{i}"].to_numpy()[at] for i in range(len(places))]
            code, shift = (np.cumsum(first) - 1)[at], np.zeros(len(steps), np.int64)
            for i, v in enumerate(local):  # one empty place around each block
                code, shift = code * (side + 2) + v + 1, shift * (side + 2) + np.array([s[i] for s in steps])
            order = np.argsort(code)
            held, a, b = code[order], [], []
            for m in shift:
                k = np.minimum(np.searchsorted(held, code + m), max(len(at) - 1, 0))
                hit = np.flatnonzero(held[k] == code + m)
                a.append(hit)
                b.append(order[k[hit]])
            label = _joined(len(at), np.concatenate(a), np.concatenate(b))
            root = table["_id"].to_numpy().copy()
            least = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(least, label, root[at])
            root[at] = least[label]
            edge = np.zeros(len(root), bool)
            edge[at] = np.any([(v == 0) | (v == side - 1) for v in local], axis=0)
            yield from table.append_column("_root", pa.array(root)).append_column("_edge", pa.array(edge)).select(out).to_batches()

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    placed = settled(cells.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, f"{kinds}, _whole boolean, _root long, _edge boolean"))
    edge = placed.where("_edge")
    half = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps if s > tuple(-v for v in s))))
    over = ~_all([block(F.col(p)) == block(F.col(p) + F.col("_m")[i]) for i, p in enumerate(places)])
    shifted = edge.withColumn("_m", half).where(over).select(F.col(key).alias("_key"), *((F.col(p) + F.col("_m")[i]).alias(f"_{p}") for i, p in enumerate(places)), F.col("_root").alias("_from"))
    match = (F.col(key) == F.col("_key")) & _all([F.col(p) == F.col(f"_{p}") for p in places])
    pairs = edge.join(shifted, match).where("_root <> _from").select("_root", "_from").distinct()
    both = F.explode(F.array(F.struct(F.col("_root").alias("a"), F.col("_from").alias("b")), F.struct(F.col("_from").alias("a"), F.col("_root").alias("b"))))
    edges = settled(pairs.select(both.alias("_e")).select("_e.a", "_e.b").distinct())
    label = edges.select(F.col("a").alias("_id")).distinct().withColumn("component", F.col("_id"))
    while True:
        near = edges.join(label, edges.a == label["_id"]).groupBy(F.col("b").alias("_id")).agg(F.min("component").alias("_n"))
        hop = label.join(near, "_id").select("_id", "component", F.least("component", "_n").alias("_h"))
        both = F.explode(F.array(F.struct(F.col("_id").alias("t"), "_h"), F.struct(F.col("component").alias("t"), "_h")))  # also for the label's own voxel
        low = hop.select("component", both.alias("_e")).groupBy("_e.t").agg(F.min("_e._h").alias("_g"))
        jump = low.select(F.col("t").alias("_j"), F.col("_g").alias("_c"))
        new = label.join(low, F.col("_id") == F.col("t")).join(jump, F.col("_g") == F.col("_j")).select("_id", F.least("_g", "_c").alias("new"), "component")
        new = settled(new)
        changed = new.where("new <> component").limit(1).count()
        label = new.select("_id", F.col("new").alias("component"))
        if not changed:
            found = placed.join(label, F.col("_root") == F.col("_id"), "left")
            return found.select(*df.columns, F.coalesce("component", "_root").alias("component"))


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def principal_axis(df: DataFrame, keys: Sequence[str], names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Centre, first principal axis and lowest point (by the last coordinate) of each key: nine sums and a 3 x 3 eigenproblem a key."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    g = df.groupBy(*keys).agg(*(F.avg(c).alias(f"m_{c}") for c in names), F.min_by(F.struct(*names), F.col(names[-1])).alias("tip"), F.array(*(F.covar_pop(a, b) for a, b in pairs)).alias("_cov"))
    where = [(i, j) for i in range(len(names)) for j in range(i, len(names))]

    @F.pandas_udf("array<double>")
    def axis(cov: pd.Series) -> pd.Series:
        out = []
        for c in cov:
            m = np.zeros((len(names), len(names)))
            for (i, j), v in zip(where, c):
                m[i, j] = m[j, i] = v
            v = np.linalg.eigh(m)[1][:, -1]
            out.append((v * np.sign(v[np.abs(v).argmax()])).tolist())
        return pd.Series(out)

    return g.withColumn("axis", axis("_cov")).drop("_cov")


def zone_of(track: DataFrame, zones: DataFrame, keys: Sequence[str], order: str, x: str = "x", y: str = "y") -> DataFrame:
    """First zone by priority that holds the place of each row; rows outside keep the zone before."""
    best = zones.groupBy(*keys, x, y).agg(F.min_by("zone", "priority").alias("_z"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return track.join(best, [*keys, x, y], "left").withColumn("zone", F.last("_z", ignorenulls=True).over(w)).drop("_z")


def centre_zone(df: DataFrame, keys: Sequence[str], ratio: float, x: str = "x", y: str = "y") -> DataFrame:
    """Centre rectangle of ``ratio`` of the bounding box of each key."""
    g = df.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    side = lambda a, b, s: (F.col(a) + F.col(b)) / 2.0 + s * (F.col(b) - F.col(a)) * ratio / 2.0
    return g.select(*keys, side("x0", "x1", -1.0).alias("left"), side("x0", "x1", 1.0).alias("right"), side("y0", "y1", -1.0).alias("low"), side("y0", "y1", 1.0).alias("high"))


def region_coverage(pixels: DataFrame, masks: dict[str, DataFrame], at: Sequence[str], keys: Sequence[str], least: float = 0.2) -> DataFrame:
    """Of each region: pixels, share_<mask> that lies in a mask, <mask> whether that is more than ``least``, and all_positive."""
    d = pixels
    for name, mask in masks.items():
        d = d.join(mask.select(*at).distinct().withColumn(f"_{name}", F.lit(1.0)), list(at), "left")
    share = {name: F.avg(F.coalesce(f"_{name}", F.lit(0.0))) for name in masks}
    every = F.lit(True)
    for c in share.values():
        every = every & (c > least)
    flags = [x for name, c in share.items() for x in (c.alias(f"share_{name}"), (c > least).alias(name))]
    return d.groupBy(*keys).agg(F.count("*").alias("n"), *flags, every.alias("all_positive"))


def puncta_summary(puncta: DataFrame, tissue: DataFrame, keys: Sequence[str], area: str, intensity: str, near: str, pixels: str) -> DataFrame:
    """Of each image of ``tissue``: number of puncta, mean area and intensity, density per tissue pixel, share of puncta near a partner; 0 without puncta or tissue."""
    g = puncta.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(area).alias("mean_area"), F.avg(intensity).alias("mean_intensity"), F.avg(F.coalesce(F.col(near), F.lit(False)).cast("double")).alias("coloc_ratio"))
    j = tissue.select(*keys, pixels).join(g, list(keys), "left").fillna(0, ["n", "mean_area", "mean_intensity", "coloc_ratio"])
    return j.withColumn("density", F.when(F.col(pixels) > 0, F.col("n") / F.col(pixels)).otherwise(0.0)).drop(pixels)


def field_quality(points: DataFrame, keys: Sequence[str], value: str, mean: str, label: str, least: int = 1, labels: Sequence[int] = (-1, 0, 1)) -> DataFrame:
    """Checks of each key's points: n, r (correlation of the interpolated value with the mean over nearest nodes), missing values, labels that aren't known, and ok.

    ok: at least ``least`` points, no missing value, only known labels.
    """
    gone = F.col(value).isNull() | F.isnan(F.col(value).cast("double"))
    odd = ~F.coalesce(F.col(label).isin(*labels), F.lit(False))
    g = points.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(F.when(~gone, F.col(value)), mean).alias("r"), F.count(F.when(gone, 1)).alias("missing"), F.count(F.when(odd, 1)).alias("unknown_labels"))
    return g.withColumn("ok", (F.col("n") >= least) & (F.col("missing") == 0) & (F.col("unknown_labels") == 0))
