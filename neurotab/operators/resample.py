"""Bootstrap intervals from exact multinomial weights, without rows times draws.

A draw with replacement from a stratum gives its distinct scores multinomial
weights. Scores are counted first and cut into ranges. The weights of a stratum's
ranges are one multinomial split of its rows, which every task draws anew from the
same seed and the sizes of the ranges; inside a range the rest of the split is drawn
for all draws at once in arrays. So each score costs one number a draw, in memory of
its range only, and results depend on the seed and the ranges, not on tasks.

A range gives sums for each draw. What needs an order, as the AUC, adds up over
ranges afterwards: a range's positives lie above all negatives of ranges below it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4_000_000  # weights in memory at once


def _split(seed: int, key: int, stratum: int, sizes: np.ndarray, draws: int) -> np.ndarray:
    """Rows of each range in each draw of a stratum: draws x ranges."""
    total = int(sizes.sum())
    if not total:
        return np.zeros((draws, len(sizes)), np.int64)
    return np.random.default_rng([seed, key & 0xFFFFFFFF, stratum, 0]).multinomial(total, sizes / total, size=draws)


def scored_draws(df: DataFrame, keys: Sequence[str], y: str, p: str, draws: int, seed: int, ranges: int = 64) -> DataFrame:
    """keys, draw, auc, brier of each stratified draw of (y, p): positives and negatives keep their numbers.

    keys is a key of few values (classes, models): of each its ranges' sizes reach the
    driver. Keys with one class only have no rows. Missing values are skipped.
    """
    whole = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("_k", F.xxhash64(F.lit(0), *keys))
    edges = sorted(set(whole.approxQuantile(p, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    part = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col(p))) if edges else F.lit(0)
    cells = whole.groupBy(*keys, "_k", part.alias("_part"), F.col(p).cast("double").alias("_p")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.count("*").alias("_all"))
    sizes: dict[int, np.ndarray] = {}
    for r in cells.groupBy("_k", "_part").agg(F.sum("_pos").alias("pos"), F.sum("_all").alias("n")).collect():  # keys x ranges
        sizes.setdefault(r._k, np.zeros((2, len(edges) + 1), np.int64))[:, r._part] = r.pos, r.n - r.pos

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_p")
        k, at = table["_k"][0].as_py(), table["_part"][0].as_py()
        pos, score = table["_pos"].to_numpy(), table["_p"].to_numpy()
        counts = np.stack([pos, table["_all"].to_numpy() - pos])
        takes = [_split(seed, k, s, sizes[k][s], draws)[:, at] for s in (0, 1)]
        rngs = [np.random.default_rng([seed, k & 0xFFFFFFFF, s, 1 + at]) for s in (0, 1)]
        out = {"n_pos": takes[0], "n_neg": takes[1], "inner": np.zeros(draws), "loss": np.zeros(draws)}
        step = max(1, CELLS // len(pos))
        for a in range(0, draws, step):
            w = [rngs[s].multinomial(takes[s][a : a + step], counts[s] / counts[s].sum()) if counts[s].sum() else np.zeros((len(takes[s][a : a + step]), len(pos)), np.int64) for s in (0, 1)]
            out["inner"][a : a + step] = (w[0] * (np.cumsum(w[1], 1) - w[1] / 2)).sum(1)
            out["loss"][a : a + step] = w[0] @ (1 - score) ** 2 + w[1] @ score**2
        columns = {c: pa.array([table[c][0].as_py()] * draws, table.schema.field(c).type) for c in keys}
        return pa.table(columns | {"draw": pa.array(np.arange(draws), pa.int32()), "part": pa.array([at] * draws, pa.int32())} | {c: pa.array(v) for c, v in out.items()})

    both = [k for k, s in sizes.items() if s.sum(1).all()]
    sums = cells.where(F.col("_k").isin(both) if both else F.lit(False)).groupBy(*keys, "_k", "_part").applyInArrow(run, ", ".join(filter(None, [kinds, "draw int, part int, n_pos long, n_neg long, inner double, loss double"])))
    below = F.coalesce(F.sum("n_neg").over(Window.partitionBy(*keys, "draw").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = sums.withColumn("_u", F.col("inner") + F.col("n_pos") * below).groupBy(*keys, "draw").agg(F.sum("_u").alias("u"), F.sum("n_pos").alias("pos"), F.sum("n_neg").alias("neg"), F.sum("loss").alias("loss"))
    return total.select(*keys, "draw", (F.col("u") / (F.col("pos") * F.col("neg"))).alias("auc"), (F.col("loss") / (F.col("pos") + F.col("neg"))).alias("brier"))


def mean_draws(df: DataFrame, keys: Sequence[str], group: str, value: str, draws: int, seed: int, ranges: int = 64) -> DataFrame:
    """keys, group, draw, mean, n of each draw with replacement from each group of each key; as ``scored_draws``, by distinct values."""
    by = [*keys, group]
    whole = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).withColumn("_k", F.xxhash64(F.lit(1), *by))
    part = F.pmod(F.xxhash64(value), F.lit(ranges)).cast("int")
    cells = whole.groupBy(*by, "_k", part.alias("_part"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    sizes: dict[int, np.ndarray] = {}
    for r in cells.groupBy("_k", "_part").agg(F.sum("_n").alias("n")).collect():  # keys x groups x ranges
        sizes.setdefault(r._k, np.zeros(ranges, np.int64))[r._part] = r.n
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_v")
        k, at = table["_k"][0].as_py(), table["_part"][0].as_py()
        n, v = table["_n"].to_numpy(), table["_v"].to_numpy()
        take = _split(seed, k, 0, sizes[k], draws)[:, at]
        rng, total = np.random.default_rng([seed, k & 0xFFFFFFFF, 0, 1 + at]), np.zeros(draws)
        step = max(1, CELLS // len(n))
        for a in range(0, draws, step):
            total[a : a + step] = rng.multinomial(take[a : a + step], n / n.sum()) @ v
        columns = {c: pa.array([table[c][0].as_py()] * draws, table.schema.field(c).type) for c in by}
        return pa.table(columns | {"draw": pa.array(np.arange(draws), pa.int32()), "total": pa.array(total), "n": pa.array(take)})

    sums = cells.groupBy(*by, "_k", "_part").applyInArrow(run, f"{kinds}, draw int, total double, n long")
    return sums.groupBy(*by, "draw").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def difference_interval(df: DataFrame, keys: Sequence[str], group: str, one: str, two: str, value: str, draws: int = 3000, seed: int = 0, least_rows: int = 2, least_draws: int = 200, level: float = 0.95) -> DataFrame:
    """keys, n_one, n_two, diff and the percentile interval (ci_lo, ci_hi, n_draws) of mean(one) - mean(two) for each key that has both groups.

    The interval is null where a group has under ``least_rows`` rows or fewer than ``least_draws`` draws are valid.
    """
    pick = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    whole = df.where(F.col(group).isin(one, two) & F.col(value).isNotNull())
    seen = whole.groupBy(*keys).agg(pick(F.count, one).alias("n_one"), pick(F.count, two).alias("n_two"), (pick(F.avg, one) - pick(F.avg, two)).alias("diff"))
    m = mean_draws(whole, keys, group, value, draws, seed)
    d = m.groupBy(*keys, "draw").agg((F.max(F.when(F.col(group) == one, F.col("mean"))) - F.max(F.when(F.col(group) == two, F.col("mean")))).alias("d"))
    out = (1 - level) / 2
    q = d.groupBy(*keys).agg(F.percentile("d", F.array(F.lit(out), F.lit(1 - out))).alias("_q"), F.count("d").alias("n_draws"))
    j = seen.where((F.col("n_one") > 0) & (F.col("n_two") > 0)).join(q, list(keys), "left") if keys else seen.where("n_one > 0 and n_two > 0").join(F.broadcast(q), F.lit(True))  # one row a side
    ok = (F.col("n_draws") >= least_draws) & (F.least("n_one", "n_two") >= least_rows)
    return j.select(*keys, "n_one", "n_two", "diff", *(F.when(ok, F.col("_q")[i]).alias(c) for i, c in enumerate(("ci_lo", "ci_hi"))), F.coalesce("n_draws", F.lit(0)).alias("n_draws"))


def metric_intervals(df: DataFrame, keys: Sequence[str], y: str, p: str, fold: str, draws: int = 3000, seed: int = 0, least_draws: int = 400, level: float = 0.95) -> DataFrame:
    """keys, metric (auc or brier), value, ci_lo, ci_hi, ci_source, n, n_pos, n_neg.

    The interval is that of stratified bootstrap draws (source ``bootstrap``); where
    fewer than ``least_draws`` are valid it is the same quantiles of the metric over
    folds (source ``folds``), and null (source ``none``) without two valid folds.
    """
    from neurotab.operators.evaluate import auc

    out = (1 - level) / 2
    quantiles = lambda c: F.percentile(c, F.array(F.lit(out), F.lit(1 - out)))
    loss = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))

    def values(by):
        losses = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(F.avg(loss).alias("brier"))
        a = auc(df, y, p, by).select(*by, "auc", "n_pos", "n_neg")
        return (a.join(losses, list(by)) if by else a.join(F.broadcast(losses), F.lit(True))).unpivot([*by, "n_pos", "n_neg"], ["auc", "brier"], "metric", "value")

    drawn = scored_draws(df, keys, y, p, draws, seed).unpivot([*keys, "draw"], ["auc", "brier"], "metric", "value")
    boot = drawn.groupBy(*keys, "metric").agg(quantiles("value").alias("_b"), F.count("value").alias("_nb"))
    folds = values([*keys, fold]).groupBy(*keys, "metric").agg(quantiles("value").alias("_f"), F.count("value").alias("_nf"))
    j = values(keys).join(boot, [*keys, "metric"], "left").join(folds, [*keys, "metric"], "left")
    source = F.when(F.col("_nb") >= least_draws, "bootstrap").when(F.col("_nf") >= 2, "folds").otherwise("none")
    ends = [F.when(source == "bootstrap", F.col("_b")[i]).when(source == "folds", F.col("_f")[i]).alias(c) for i, c in enumerate(("ci_lo", "ci_hi"))]
    return j.select(*keys, "metric", "value", *ends, source.alias("ci_source"), (F.col("n_pos") + F.col("n_neg")).cast("long").alias("n"), F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"))
