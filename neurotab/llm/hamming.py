"""Exact k nearest binary codes by multi-index hashing.

A code of ``BITS`` bits is cut into segments, and each distinct code is listed
under the value of each segment. Two codes at distance d agree in some segment up
to d / segments bits, so after probing all values up to radius r in every segment,
every code within segments * (r + 1) - 1 has been met. A query's radius grows by
one in each round until its kth verified distance lies under that bound, so the
result is exact and most queries stop early. Queries are answered by distinct
code; a code that many rows share is kept once, with its k + 1 smallest ids.

Cases: rows without code are neither queries nor found; a query with fewer than k
other rows gets all of them. A row isn't its own neighbour; rows that repeat an id
count as one. Ties in distance go to the smaller id. Extra columns are dropped.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.llm.common import Scratch

BITS = 64


def sign_code(vector: str) -> Column:
    """Signs of the first 64 components as one long; null if the vector is null, empty or has a null or NaN component."""
    bits = F.transform(F.slice(vector, 1, BITS), lambda c, i: F.when(c > 0, F.call_function("shiftleft", F.expr("1L"), i)).otherwise(F.expr("0L")))
    whole = (F.size(vector) > 0) & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c))
    return F.when(whole, F.aggregate(bits, F.expr("0L"), lambda a, b: a.bitwiseOR(b)))


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k nearest (id, code) of rows for each (id, code) of queries."""
    scratch = Scratch(rows.sparkSession, "hamming")
    rows = rows.select("id", "code")
    by_id = Window.partitionBy("code").orderBy("id")
    first = rows.where("id is not null and code is not null").distinct().withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    codes = scratch.cut(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    total = codes.count()
    width = 16 if log2(max(total, 1)) >= 12 else 8
    segments, low = BITS // width, (1 << width) - 1
    piece = lambda c: F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned(c, s * width).bitwiseAND(F.lit(low)).alias("val")) for s in range(segments))))
    index = scratch.cut(codes.select("code", F.col("ids")[0].alias("id"), piece("code").alias("p")).select("p.seg", "p.val", "code", "id"))
    flips = F.broadcast(rows.sparkSession.range(1 << width).select(F.col("id").alias("flip"), F.bit_count("id").alias("radius")))  # 65,536 rows at most

    asked = scratch.cut(queries.where("id is not null and code is not null").select("id", "code").distinct())
    best = None
    open_ = scratch.cut(asked.select(F.col("code").alias("q")).distinct().withColumn("radius", F.lit(0)))
    done = []
    for radius in range(width + 1):
        probes = open_.select("q", "radius", piece("q").alias("p")).join(flips, "radius").select("q", F.col("p.seg").alias("seg"), F.col("p.val").bitwiseXOR(F.col("flip")).alias("val"))
        met = probes.join(index, ["seg", "val"]).select("q", "code", "id", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"))
        if best is not None:
            met = met.union(best)
        near = Window.partitionBy("q").orderBy("distance", "id")
        # a pair is met once for each segment that agrees; a query needs k codes besides its own
        top = met.distinct().withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
        held = F.count("*").over(Window.partitionBy("q"))
        last = F.max("distance").over(Window.partitionBy("q"))
        state = scratch.cut(
            top.withColumn("done", ((held > k) & (last <= segments * (radius + 1) - 1)) | F.lit(radius == width)).select("q", "code", "id", "distance", "done")
        )
        done.append(state.where("done").drop("done"))
        best = state.where("not done").drop("done")
        finished = state.where("done").select("q").distinct()
        open_ = scratch.cut(open_.select("q").join(finished, "q", "left_anti").withColumn("radius", F.lit(radius + 1)))
        if not open_.limit(1).count():
            break
    answers = done[0]
    for d in done[1:]:
        answers = answers.union(d)
    found = answers.select("q", "code", "distance").join(codes, "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    ranked = asked.join(found, asked.code == found.q).where("id <> neighbor_id")
    order = Window.partitionBy("id", "code").orderBy("distance", "neighbor_id")
    out = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("id").alias("query_id"), F.col("rank").cast("long").alias("rank"), "neighbor_id", F.col("distance").cast("long").alias("distance"))


ORACLE = """
WITH c AS (SELECT DISTINCT vec_id id, list_sum(list_transform(range(0, len(embedding)), lambda i: CASE WHEN embedding[i+1]>0 THEN (1::hugeint << i) ELSE 0::hugeint END))::hugeint code
  FROM embeddings WHERE len(embedding)>0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x)))=0 AND vec_id IS NOT NULL)
SELECT query_id, rank, neighbor_id, distance FROM (
  SELECT q.id query_id, c.id neighbor_id, bit_count(xor(q.code, c.code))::bigint distance, row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.code, c.code)), c.id) rank
  FROM c q JOIN c ON q.id<>c.id WHERE q.id%100=0) WHERE rank<=10"""
