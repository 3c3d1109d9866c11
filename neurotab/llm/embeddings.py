"""Near-duplicate vectors by counting collisions of random projections.

A trial draws one-dimensional projections. All of them but the last put vectors
in cells of one width; of the vectors of a cell, two collide if each lies in the
window around the other by the last one (a join forms the pairs of a cell and keeps
those in the window; nothing is sorted). One projection alone
can't tell a cosine of 0.9 from none: its spread differs by a factor of 3.2 only,
so pairs would grow with the square of the input. A trial therefore has as many
projections as bring the chance of two unrelated vectors under one in the number
of vectors, and as many trials are made as give a pair at the threshold
``EXPECTED`` collisions on average. Pairs with ``LEAST`` collisions or more are
verified in double precision; at 9 expected, a pair at the threshold itself has
fewer than two with probability 0.0012, and closer pairs have more.

Equal vectors are one class and meet others through its smallest vec_id.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are kept. Vectors of different length don't link. A row
without vec_id has no component, is kept, and counts as a link of equal vectors
only. Rows that repeat a vec_id are links of each other if their vectors link; in
linking further they are one. Extra columns are dropped.
"""

from __future__ import annotations

from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import Scratch, components, ship

CELL, WINDOW, EXPECTED, LEAST = 4.0, 3.0, 9.0, 2  # widths in standard deviations of the difference at the threshold


def same_cell(width: float) -> float:
    """Chance that two places whose difference is normal with deviation 1 lie in one cell of that width, at a random shift."""
    return erf(width / sqrt(2)) - sqrt(2 / pi) / width * (1 - exp(-width * width / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Projections for cells in a trial, and trials, for n vectors."""
    near, unrelated = same_cell(CELL), same_cell(CELL * sqrt(1 - threshold))
    cells = max(1, ceil(log(max(n, 2)) / -log(unrelated)))
    return cells, ceil(EXPECTED / (near**cells * erf(WINDOW / sqrt(2))))


def trials(reps: DataFrame, cells: int, n_trials: int, threshold: float, seed: int) -> DataFrame:
    """id, key (trial and cells), x (last projection, in deviations) of each vector in each trial."""

    def run(batches):
        drawn = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                k = np.flatnonzero(sizes == d)
                v = np.stack([np.asarray(lists[i].as_py()) for i in k.tolist()])
                if d not in drawn:
                    r = np.random.default_rng([seed, d])
                    drawn[d] = r.standard_normal((n_trials, cells + 1, d)), r.random((n_trials, cells)) * CELL, r.integers(1, 1 << 62, (n_trials, cells)) | 1
                ways, shift, odd = drawn[d]
                for t in range(n_trials):
                    x = v @ ways[t].T / sqrt(2 - 2 * threshold)
                    cell = np.floor((x[:, :-1] + shift[t]) / CELL).astype(np.int64)
                    key = (cell * odd[t]).sum(1) * 0x9E3779B1 + t * 0x7F4A7C15 + d
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(key), pa.array(x[:, -1])], ["id", "key", "x"])

    return reps.select("id", "unit").mapInArrow(run, "id long, key long, x double")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    v = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    usable = F.coalesce((F.size("v") > 0) & ~odd, F.lit(False))
    rows = rows.withColumn("v", F.when(usable & (norm > 0) & (norm < float("inf")), F.col("v")))
    classes = scratch.cut(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    named = classes.where("id is not null").withColumn("unit", F.transform("v", lambda c: c / norm))
    reps = scratch.cut(named.groupBy("id").agg(F.min(F.struct("v", "unit")).alias("r")).select("id", F.col("r.unit").alias("unit")))
    cells, n_trials = plan(reps.count(), threshold)
    hits = trials(reps, cells, n_trials, threshold, seed)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    hits = scratch.cut(hits.repartition(n, "key"))
    one, two = hits.toDF("a", "key", "x"), hits.toDF("b", "key", "y")
    collide = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.abs(F.col("x") - F.col("y")) <= WINDOW))
    counted = collide.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)
    both = counted.join(reps.toDF("a", "p"), "a").join(reps.toDF("b", "q"), "b")
    cosine = F.aggregate(F.zip_with("p", "q", lambda x, y: x * y), F.lit(0.0), lambda s, c: s + c)
    links = scratch.cut(both.where((F.size("p") == F.size("q")) & (cosine >= threshold)).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    scratch.drop(hits)
    reached = components(scratch, links)
    sizes = classes.where("id is not null").groupBy("id").agg(F.sum("copies").alias("copies"))
    ends = links.union(links.select("dst", "src"))
    linked = ends.join(sizes.toDF("dst", "copies"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("copies").alias("others"))
    per_class = classes.join(linked, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left")
    per_class = per_class.select("v", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(per_class, "v", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CASE WHEN len(embedding)>0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c)))=0 THEN list_transform(embedding, lambda c: c::double) END e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda c: c/sqrt(list_dot_product(e,e))) e FROM v WHERE e IS NOT NULL AND list_dot_product(e,e)>0),
l AS (SELECT a.vec_id a, b.vec_id b FROM u a JOIN u b ON a.vec_id<>b.vec_id AND len(a.e)=len(b.e) WHERE list_dot_product(a.e,b.e)>=0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b=l.a),
c AS (SELECT a, min(b) m FROM r GROUP BY a), n AS (SELECT a, count(*) k FROM l GROUP BY a)
SELECT vec_id, coalesce(k,0)::bigint n_links, least(vec_id, coalesce(m, vec_id)) component_id, vec_id=least(vec_id, coalesce(m, vec_id)) kept
FROM v LEFT JOIN c ON vec_id=c.a LEFT JOIN n ON vec_id=n.a"""
