"""Training batches from length buckets whose borders waste least padding.

Texts longer than ``max_length`` are cut into pieces of that length and a rest.
The histogram of all piece lengths, at most max_length rows, goes to the driver,
where dynamic programming finds the bucket borders with the least total padding.
In a bucket every sequence is padded to its border, so a batch of the token budget
holds budget / border of them. Batches are numbered through without gathering a
bucket: its rows are dealt to parts by hash, numbered inside each part, and moved
on by the sizes of the parts before.

Cases: null and empty texts have one piece of length 0 without bucket and batch.
Rows that repeat a doc_id are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.llm.common import Scratch

PART = 50_000


def words(text: str = "text") -> Column:
    """Number of words, split at ASCII blanks."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def borders(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` ranges of the ascending lengths, with the least sum of count * (upper end - length)."""
    if not lengths:
        return []
    x, c = np.asarray(lengths, np.float64), np.concatenate([[0.0], np.cumsum(counts)])
    n = len(x)
    best, back = np.full(n + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(buckets, n)):
        # padded size of sequences i .. j - 1 in one bucket that ends at x[j - 1]
        cost = best[:, None] + (c[None, 1:] - c[:, None]) * x[None, :]
        cost[np.tril_indices(n + 1, -1, n)] = np.inf
        cost[np.arange(1, n + 1), np.arange(n)] = np.inf
        origin = cost.argmin(0)
        back.append(origin)
        best = np.concatenate([[np.inf], cost[origin, np.arange(n)]])
        back[-1] = origin
        if len(back) == 1:
            totals = [best[n]]
        else:
            totals.append(best[n])
    k, at, out = int(np.argmin(totals)), n, []
    while k >= 0:
        out.append(int(x[at - 1]))
        at, k = int(back[k][at - 1]), k - 1
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, max_length: int = 2048, budget: int = 16_384, buckets: int = 16) -> DataFrame:
    """doc_id, piece, length, bucket (padded length), batch (in the bucket), slot (in the batch), for each piece of a document."""
    scratch = Scratch(docs.sparkSession, "packing")
    size = words() if length is None else length.cast("long")
    whole = docs.select("doc_id", F.coalesce(size, F.lit(0)).alias("size"))
    last = F.greatest(F.ceil(F.col("size") / float(max_length)).cast("int") - 1, F.lit(0))
    pieces = whole.select("doc_id", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = scratch.cut(pieces.select("doc_id", F.col("piece").cast("long").alias("piece"), F.least(F.col("size") - F.col("piece") * max_length, F.lit(max_length)).cast("long").alias("length")))
    histogram = sorted((r["length"], r["n"]) for r in pieces.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect())  # max_length rows at most
    ends = borders([x for x, _ in histogram], [n for _, n in histogram], buckets)
    empty = pieces.where("length = 0").select("doc_id", "piece", "length", *(F.lit(None).cast("long").alias(c) for c in ("bucket", "batch", "slot")))
    if not ends:
        return empty
    in_bucket = {e: sum(n for x, n in histogram if low < x <= e) for low, e in zip([0, *ends], ends)}
    choose = lambda value: _first([(F.col("length") <= e, F.lit(value(e)).cast("long")) for e in ends])
    order = F.xxhash64("doc_id", "piece")
    dealt = pieces.where("length > 0").select("*", choose(lambda e: e).alias("bucket"), choose(lambda e: max(1, budget // e)).alias("room"), F.pmod(order, choose(lambda e: -(-in_bucket[e] // PART))).alias("part"))
    parts = dealt.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    at = F.row_number().over(Window.partitionBy("bucket", "part").orderBy(order, "doc_id", "piece")) - 1
    numbered = dealt.withColumn("at", at).join(moved, ["bucket", "part"]).withColumn("at", F.col("at") + F.col("moved"))
    full = numbered.select("doc_id", "piece", "length", "bucket", F.floor(F.col("at") / F.col("room")).cast("long").alias("batch"), (F.col("at") % F.col("room")).cast("long").alias("slot"))
    return full.union(empty)


def _first(cases) -> Column:
    out = F.when(*cases[0])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out
