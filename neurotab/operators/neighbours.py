"""Exact nearest neighbours in any number of columns, and oversampling between them.

Points go to the cell of their nearest pivot, a few points spread out at random. By
the triangle inequality no point of a cell lies nearer to a query than the distance
from the query to its pivot less the cell's radius, and no point of the cell whose
distance to the pivot differs more from the query's than the query's kth distance so
far. So a query first asks its own cell, which bounds its kth distance, and then only
the cells, and in them the rings, that this bound reaches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab.operators.order import before
from neurotab.sources.shared import settled

PAIRS = 1 << 22  # of queries and points compared at once, about
CHUNK = 1 << 17  # of those whose exact distance is taken at once


def _numbered(df: DataFrame, id: str, names: Sequence[str], prefix: str, within: str | None) -> DataFrame:
    point = F.array(*(F.col(c).cast("double") for c in names))
    whole = ~F.exists(point, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    group = F.xxhash64(F.col(within).cast("string")) if within else F.lit(0).cast("long")
    return df.select(F.monotonically_increasing_id().alias(f"{prefix}n"), F.col(id).alias(f"{prefix}id"), group.alias(f"{prefix}g"), point.alias(f"{prefix}x")).where(whole)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, which are exact for equal points."""
    return np.sqrt(sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(a.shape[1])))


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to those of b, as ``_distances`` has them."""
    return np.sqrt(sum((a[:, k] - b[:, k]) ** 2 for k in range(a.shape[1])))


def _points(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _placed(points: DataFrame, prefix: str, pivots: np.ndarray) -> DataFrame:
    """points with the number of their nearest pivot, their cell (of that pivot and their group) and the distance to the pivot."""

    def run(batches):
        for b in batches:
            d = _distances(_points(b.column(f"{prefix}x"), pivots.shape[1]), pivots) if b.num_rows else np.empty((0, len(pivots)))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, f"{prefix}pivot", f"{prefix}far"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{kinds}, {prefix}pivot int, {prefix}far double").withColumn(f"{prefix}cell", F.xxhash64(f"{prefix}g", f"{prefix}pivot"))


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, names: Sequence[str], k: int, itself: bool = True, within: str | None = None, pivots: int = 64, split: int = 20_000, seed: int = 0) -> DataFrame:
    """left_id, right_id (with _r), distance and rank of the k nearest rows of right for each row of left; ties go to the smaller id.

    ``itself`` False leaves out rows of the same id; with ``within``, a column of few
    values (classes), rows meet those of their own value only. Rows of left that repeat an id
    get k rows each. Rows with a missing or infinite coordinate take no part. Cells of
    more than ``split`` points are cut by hash, so that none is one task.
    """
    d = len(names)
    one, two = settled(_numbered(left, left_id, names, "l", within)), settled(_numbered(right, right_id, names, "r", within))
    centres = [r.rx for r in two.select("rx").distinct().orderBy(F.xxhash64(F.lit(seed), "rx"), "rx").limit(pivots).collect()]
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((left, left_id), (right, right_id))}
    result = f"ln long, lid {kinds[left_id]}, rn long, rid {kinds[right_id]}, distance double"
    if not centres:
        out = left.sparkSession.createDataFrame([], result)
        return out.select(F.col("lid").alias(left_id), F.col("rid").alias(f"{right_id}_r"), "distance", F.lit(0).alias("rank"))
    p = np.array(centres)
    points = settled(_placed(two, "r", p))
    cells = {r.rcell: r for r in points.groupBy("rcell", "rg", "rpivot").agg(F.count("*").alias("n"), F.min("rfar").alias("low"), F.max("rfar").alias("high")).collect()}  # a row a pivot and class
    parts = {c: -(-r.n // split) for c, r in cells.items()}
    shards = F.broadcast(left.sparkSession.createDataFrame([(c, n) for c, n in parts.items()], "rcell long, parts int"))  # a row a pivot and class
    points = points.join(shards, "rcell").withColumn("shard", F.pmod(F.xxhash64("rn"), F.col("parts")).cast("int")).drop("parts")
    queries = settled(_placed(one, "l", p))

    def compare(key, q: pa.Table, r: pa.Table) -> pa.Table:
        """The k nearest of one shard for each query of one cell; the bound, where there is one, leaves out rings."""
        out = []
        if q.num_rows and r.num_rows:
            r = r.sort_by("rfar")
            rx, far, rn, rid = _points(r["rx"], d), r["rfar"].to_numpy(), r["rn"].to_numpy(), r["rid"].to_pylist()
            order = np.empty(len(rid), np.int64)
            order[sorted(range(len(rid)), key=rid.__getitem__)] = np.arange(len(rid))
            lid = q["lid"].to_pylist()
            places = {}
            if not itself:
                for j, v in enumerate(rid):
                    places.setdefault(v, []).append(j)
            qx, bound, to = _points(q["lx"], d), q["bound"].to_numpy(), q["to"].to_numpy()
            block = max(1, PAIRS // len(rx))
            q2, r2 = (qx * qx).sum(1), (rx * rx).sum(1)
            off = 1e-12 * (q2.max() + r2.max())  # more than squared distances by products can err
            for a in range(0, len(qx), block):
                here = slice(a, a + block)
                slack = bound[here] * (1 + 1e-9) + 1e-12
                ring = slice(np.searchsorted(far, (to[here] - slack).min()), np.searchsorted(far, (to[here] + slack).max(), "right"))
                if ring.stop <= ring.start:
                    continue
                about = q2[here, None] + r2[ring] - 2 * (qx[here] @ rx[ring].T)
                if not itself:
                    for i, own in enumerate(lid[here]):
                        about[i, [j - ring.start for j in places.get(own, ()) if ring.start <= j < ring.stop]] = np.inf
                # products choose who can be among the k nearest, differences decide
                limit = np.partition(about, k - 1, 1)[:, k - 1] if k < about.shape[1] else np.full(len(about), np.inf)
                i, j = np.nonzero((about <= np.minimum(limit, slack * slack)[:, None] + 2 * off) & (about < np.inf))
                x = np.concatenate([_paired(qx[a + i[c : c + CHUNK]], rx[ring.start + j[c : c + CHUNK]]) for c in range(0, len(i), CHUNK)] or [np.empty(0)])
                kept = x <= slack[i]
                i, j, x = i[kept], j[kept] + ring.start, x[kept]
                by = np.lexsort((order[j], x, i))
                i, j, x = i[by], j[by], x[by]
                first_k = np.arange(len(i)) - np.searchsorted(i, i) < k
                out += zip((a + i[first_k]).tolist(), j[first_k].tolist(), x[first_k].tolist())
        at = [o[0] for o in out]
        columns = [q["ln"].take(pa.array(at, pa.int64())), q["lid"].take(pa.array(at, pa.int64())), pa.array([int(rn[o[1]]) for o in out], pa.int64()), r["rid"].take(pa.array([o[1] for o in out], pa.int64())), pa.array([float(o[2]) for o in out], pa.float64())]
        return pa.table(columns, ["ln", "lid", "rn", "rid", "distance"])

    def asked(q: DataFrame) -> DataFrame:
        """Queries (with lcell, bound, to) against every shard of that cell."""
        q = q.join(shards.withColumnRenamed("rcell", "lcell"), "lcell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        q = q.withColumn("slice", F.pmod(F.xxhash64("ln"), F.lit(slices)).cast("int"))  # both sides of a cogroup need keys of one type
        return q.groupBy("lcell", "shard", "slice").cogroup(points.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).groupBy("rcell", "shard", "slice")).applyInArrow(compare, result)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("ln").orderBy("distance", "rid", "rn")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    n = queries.count()
    slices = max(1, -(-n // (split * max(1, len(cells)))))  # queries of a cell, too, are cut
    first = settled(best(asked(queries.withColumns({"bound": F.lit(float("inf")), "to": F.col("lfar")}))))
    bounds = first.groupBy("ln").agg(F.max("distance").alias("b"), F.count("*").alias("c")).select("ln", F.when(F.col("c") >= k, F.col("b")).otherwise(F.lit(float("inf"))).alias("bound"))
    known = queries.join(bounds, "ln", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    limits = [(c, r.rg, r.rpivot, r.low, r.high) for c, r in sorted(cells.items())]

    def others(batches):
        for b in batches:
            x, bound, own, group = _points(b.column("lx"), d), b.column("bound").to_numpy(), b.column("lcell").to_numpy(), b.column("lg").to_numpy()
            to = _distances(x, p) if len(x) else np.empty((0, len(p)))
            slack = bound * (1 + 1e-9) + 1e-12
            for c, g, pivot, low, high in limits:
                at = np.flatnonzero((own != c) & (group == g) & (to[:, pivot] - slack <= high) & (to[:, pivot] + slack >= low))
                if len(at):
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column("ln").take(take), b.column("lid").take(take), b.column("lx").take(take), pa.array([c] * len(at), pa.int64()), pa.array(bound[at]), pa.array(to[at, pivot])], ["ln", "lid", "lx", "lcell", "bound", "to"])

    more = known.mapInArrow(others, f"ln long, lid {kinds[left_id]}, lx array<double>, lcell long, bound double, to double")
    every = best(first.drop("rank").unionByName(asked(more)))
    return every.select(F.col("lid").alias(left_id), F.col("rid").alias(f"{right_id}_r"), "distance", "rank")


def noisy_copies(df: DataFrame, names: Sequence[str], id: str, label: str, n: int, scale: float = 0.05, seed: int = 0) -> DataFrame:
    """df and about n noisy copies (synthetic): each class gets the same expected number, noise is scale * population deviation of a column (1 where it has none).

    A row of a class of m rows gets copies by a seeded hash, n / (classes * m) on average.
    """
    sizes = df.groupBy(label).agg(F.count("*").alias("_m"))
    sd = df.agg(*(F.stddev_pop(c).alias(c) for c in names)).first()
    classes = sizes.count()
    rate = F.lit(float(n)) / (F.lit(float(max(classes, 1))) * F.col("_m"))
    u = F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int")
    d = df.select(id, label, *names).join(F.broadcast(sizes), label).withColumn("_c", copies).where("_c > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_c"))))  # a row a class
    noise = {c: F.col(c) + F.randn(seed + j) * (scale * (sd[c] if sd[c] and np.isfinite(sd[c]) else 1.0)) for j, c in enumerate(names)}
    made = d.withColumns(noise).select(id, label, *names, F.lit(True).alias("synthetic"))
    return df.select(id, label, *names).withColumn("synthetic", F.lit(False)).unionByName(made)


def proportional_copies(df: DataFrame, names: Sequence[str], id: str, label: str, target: int, scale: float = 0.05, seed: int = 0) -> DataFrame:
    """df and noisy copies that bring it to about ``target`` rows, each class keeping its share; noise is scale * the class's population deviation of a column."""
    n = df.count()
    rate = max(target - n, 0) / n if n else 0.0
    spread = df.groupBy(label).agg(*(F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"_s_{c}") for c in names))  # a row a class
    u = F.pmod(F.xxhash64(F.lit(seed), id), F.lit(1 << 30)) / float(1 << 30)
    copies = int(rate) + (u < rate - int(rate)).cast("int")
    d = df.select(id, label, *names).join(F.broadcast(spread), label).withColumn("_c", copies).where("_c > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_c"))))
    made = d.withColumns({c: F.col(c) + F.randn(seed + j) * scale * F.col(f"_s_{c}") for j, c in enumerate(names)})
    return df.select(id, label, *names).withColumn("synthetic", F.lit(False)).unionByName(made.select(id, label, *names, F.lit(True).alias("synthetic")))


def mad_copies(df: DataFrame, names: Sequence[str], copies: int, scale: float = 0.05, seed: int = 0) -> DataFrame:
    """Rows (copy 0) and ``copies`` of each with noise of scale * 1.4826 * the column's median absolute deviation."""
    middle = df.agg(*(F.median(c).alias(c) for c in names)).first()
    mad = df.agg(*(F.median(F.abs(F.col(c) - F.lit(middle[c]))).alias(c) for c in names)).first()
    d = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    return d.withColumns({c: F.when(F.col("copy") == 0, F.col(c)).otherwise(F.col(c) + F.randn(seed + j) * (scale * 1.4826 * (mad[c] or 0.0))) for j, c in enumerate(names)})


def pseudo_samples(df: DataFrame, names: Sequence[str], group: str, n: int, seed: int = 0) -> DataFrame:
    """group, sample and values of n made samples of each group: normal around its mean with its sample deviation (0 with one row)."""
    g = df.groupBy(group).agg(*(F.avg(c).alias(f"_m_{c}") for c in names), *(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_s_{c}") for c in names))
    g = g.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return g.select(group, "sample", *((F.col(f"_m_{c}") + F.randn(seed + j) * F.col(f"_s_{c}")).alias(c) for j, c in enumerate(names)))


def oversample(df: DataFrame, names: Sequence[str], id: str, label: str, k: int = 5, noise: int = 0, seed: int = 0) -> DataFrame:
    """df and synthetic rows that bring every class to the largest one: points between a row and one of its nearest of its class.

    Neighbours are min(k, rows of the smallest class of two or more - 1), in all the
    columns. Where a class has one row, and so no neighbour, ``noise`` noisy copies of
    all classes stand in instead (``noisy_copies``); if that is 0, such a class stays
    as it is. A row's points go to its neighbours in turn; ids are those of the rows
    that they start from.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row a class
    base = df.select(id, label, *names).withColumn("synthetic", F.lit(False))
    if sizes and noise and min(sizes.values()) < 2:
        return noisy_copies(df, names, id, label, noise, seed=seed)
    most, near = max(sizes.values(), default=0), min(k, min((n for n in sizes.values() if n > 1), default=2) - 1)
    wanted = {cls: divmod(most - n, n) for cls, n in sizes.items() if n not in (1, most)}
    if not wanted:
        return base
    # rows of a class in a fixed order by hash; each makes the same number of points, and the first ones one more
    kind = df.schema[label].dataType.simpleString()
    plan = df.sparkSession.createDataFrame([(cls, each, extra) for cls, (each, extra) in wanted.items()], f"_g {kind}, _each int, _extra int")
    own = settled(df.join(F.broadcast(plan), F.col(label) == F.col("_g")).select(F.monotonically_increasing_id().alias("_n"), id, label, *names, "_each", "_extra"))  # a row a class
    pairs = nearest(own, own, "_n", "_n", names, near, itself=False, within=label, seed=seed)
    place = before(own.select("_n", label, "_each", "_extra", F.xxhash64(F.lit(seed), "_n").alias("_h")), [], [label, "_h", "_n"], {"_b": F.lit(1.0)})
    starts = place.groupBy(label).agg(F.min("_b").alias("_s"))  # a row a class
    place = place.join(F.broadcast(starts), label).withColumn("_b", F.col("_b") - F.col("_s"))
    made = place.withColumn("_c", F.col("_each") + F.when(F.col("_b") < F.col("_extra"), 1).otherwise(0)).where("_c > 0").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
    made = made.select("_n", "_i", (F.pmod(F.xxhash64(F.lit(seed + 1), "_n") + F.col("_i"), F.lit(near)) + 1).cast("int").alias("rank"))
    j = made.join(pairs.select("_n", "rank", "_n_r"), ["_n", "rank"]).join(own.select("_n", *names).toDF("_n_r", *(f"{c}_r" for c in names)), "_n_r").join(own, "_n")
    u = F.pmod(F.xxhash64(F.lit(seed + 2), "_n", "_i"), F.lit(1 << 30)) / float(1 << 30)
    return base.unionByName(j.select(id, label, *((F.col(c) + u * (F.col(f"{c}_r") - F.col(c))).alias(c) for c in names), F.lit(True).alias("synthetic")))

