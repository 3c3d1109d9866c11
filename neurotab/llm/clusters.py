"""Centroid clusters of integer vectors by an incremental distance matrix.

A vector's components become integers, and its exact integer dot products with all
centroids are kept beside it in a written table. A round moves few components of
few centroids, so each dot product is updated by the nonzero changes of its
centroid's components only, and the nearest centroid is the argmin of
``|c|^2 - 2 * dot`` anew. All arithmetic is in integers, so results don't depend on
how rows are dealt out.

Cases: vectors that are null, of another length, or hold null or non-finite
components are left out, as are those with a component of ``LARGEST`` or more after
scaling, whose distances need not fit into a long. Rows that repeat a vec_id are
vectors of their own; a row without vec_id is never a first centroid. Ties in the
order of first centroids go to the smaller vector. Fewer vectors than centroids
give fewer centroids, an empty table no rows. Sums that don't fit into a long are
null. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import Scratch, ship

LARGEST = 1 << 27
STATE = "vec_id long, x array<int>, dots array<long>, cluster int, distance long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id, x of the vectors that are kept."""
    v = F.transform("embedding", lambda c: F.lit(float(scale)) * c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.size("v") == size)
    fits = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return rows.where(fits).select("vec_id", F.transform("v", lambda c: F.floor(c).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest digests of their ids, one a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id is not null").select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k)
    return np.array([r.x for r in found.collect()], dtype=np.int64)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32)), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _nearest(ids, x: np.ndarray, dots: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    apart = lengths - 2 * dots
    cluster = apart.argmin(1)  # the first of equal ones
    distance = (x * x).sum(1) + apart[np.arange(len(x)), cluster]
    columns = [ids, _lists(x, pa.int32()), _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "x", "dots", "cluster", "distance"])


def start(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Dot products of every vector with every centroid, and its nearest one."""
    lengths = (centroids * centroids).sum(1)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"), centroids.shape[1])
            yield _nearest(b.column("vec_id"), x, x @ centroids.T, lengths)

    return rows.mapInArrow(run, STATE)


def update(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The same after centroids have moved: dot products change by the components that did."""
    moved = [(k, np.flatnonzero(d), d[d != 0]) for k, d in enumerate(new - old) if d.any()]
    lengths = (new * new).sum(1)

    def run(batches):
        for b in batches:
            x, dots = _matrix(b.column("x"), new.shape[1]), _matrix(b.column("dots"), len(new))
            for k, at, by in moved:
                dots[:, k] += x[:, at] @ by
            yield _nearest(b.column("vec_id"), x, dots, lengths)

    return state.mapInArrow(run, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: exact floors of the means of their vectors; those without vectors stay."""
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row a centroid
        new[r.cluster] = [r[f"s{i}"] // r.n for i in range(centroids.shape[1])]
    return new


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of (vec_id, embedding) that is kept."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "clusters")
    rows = integers(vectors, size, scale)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    state = scratch.cut(start(rows, centroids))
    for _ in range(rounds):
        moved = means(state, centroids)
        before, state = state, scratch.cut(update(state, centroids, moved))
        centroids = moved
        scratch.drop(before)
    total = lambda c: F.expr(f"try_cast(sum(cast({c} as decimal(20, 0))) as long)")
    inertia = {r.cluster: r.own for r in state.groupBy("cluster").agg(total("distance").alias("own")).collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    whole = whole if whole is not None and whole < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = spark.createDataFrame([(c, inertia.get(c), whole, d) for c, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def oracle(k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2") -> str:
    """The same in SQL, a step a round."""
    floor = "(s - ((s % n) + n) % n) // n"
    near = """SELECT vec_id, row, k, d FROM (SELECT vec_id, row, k, d, row_number() OVER (PARTITION BY row ORDER BY d, k) r
      FROM (SELECT x.row, any_value(x.vec_id) vec_id, c.k, sum((x.x-c.x)*(x.x-c.x))::bigint d FROM x JOIN {c} c USING (i) GROUP BY x.row, c.k)) WHERE r=1"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})")
        steps.append(f"s{r} AS (SELECT a.k, x.i, sum(x.x)::bigint s, count(*)::bigint n FROM a{r} a JOIN x USING (row) GROUP BY a.k, x.i)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce({floor}, c.x)::bigint x FROM c{r} c LEFT JOIN s{r} s ON s.k=c.k AND s.i=c.i)")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () "row", vec_id, list_transform(embedding, lambda c: floor({scale}*c::double)::bigint) x FROM embeddings
  WHERE len(embedding)={size} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c)))=0),
x AS MATERIALIZED (SELECT "row", vec_id, unnest(range(1, {size + 1})) i, unnest(x) x FROM kept),
f AS (SELECT "row", row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::varchar), x)-1 k FROM kept WHERE vec_id IS NOT NULL QUALIFY k<{k}),
c0 AS MATERIALIZED (SELECT f.k, x.i, x.x FROM f JOIN x USING (row)),
{", ".join(steps)},
last AS MATERIALIZED ({near.format(c=f"c{rounds}")}),
digest AS (SELECT k, sha256(string_agg(x::varchar, ',' ORDER BY i)) h FROM c{rounds} GROUP BY k)
SELECT vec_id, k::int AS cluster, d distance, (sum(d) OVER (PARTITION BY k))::bigint cluster_inertia, (sum(d) OVER ())::bigint inertia, h centroid_sha256 FROM last JOIN digest USING (k)"""
