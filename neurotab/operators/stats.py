"""Grouped tests and effect sizes: Spark sums first, p-values from the statistic columns afterwards.

p-values come from ``p_student`` and ``p_chi2``, pandas UDFs over one row per test,
and ``p_normal``, a column expression. Missing values are skipped throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from neurotab.operators.order import before, least_from_here
from neurotab.sources.shared import parts, settled


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function by the modified Lentz method, elementwise."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    return h


def _log_gamma(x):
    from math import lgamma

    return np.vectorize(lgamma, otypes=[float])(x)


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function, elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    with np.errstate(all="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
        direct = front * _beta_fraction(a, b, x) / a
        turned = 1 - front * _beta_fraction(b, a, 1 - x) / b
    out = np.where(x < (a + 1) / (a + b + 2), direct, turned)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def upper_gamma(a, x):
    """Regularised upper incomplete gamma function for one shape: series below a + 1, continued fraction above."""
    from math import exp, lgamma, log

    if x <= 0:
        return 1.0
    scale = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b)
        c = b + k / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


@F.pandas_udf(DoubleType())
def p_student(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    p = incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return pd.Series(p).where(t.notna() & df.notna() & (df > 0))


@F.pandas_udf(DoubleType())
def p_chi2(h: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution."""
    return pd.Series([None if pd.isna(x) or pd.isna(k) or k <= 0 else upper_gamma(k / 2, x / 2) for x, k in zip(h, df)], dtype=float)


def p_normal(z: Column) -> Column:
    """Two-sided p of a normal statistic; erfc by a rational approximation with error under 1.2e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368):  # fixed values of the approximation
        poly = poly * t + c
    return t * F.exp(-x * x - 1.26551223 + t * poly)


def welch(df: DataFrame, keys: Sequence[str], group: Column, value: str) -> DataFrame:
    """Welch t statistic and degrees of freedom of value where group holds against where it doesn't."""
    pick = lambda on: F.when(group if on else ~group, F.col(value))
    g = df.groupBy(*keys).agg(*(f(pick(on)).alias(f"{n}{s}") for s, on in (("1", True), ("0", False)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    e1, e0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    ok = (F.col("n1") > 1) & (F.col("n0") > 1) & (e1 + e0 > 0)
    t = F.when(ok, (F.col("m1") - F.col("m0")) / F.sqrt(e1 + e0))
    dof = F.when(ok, (e1 + e0) * (e1 + e0) / (e1 * e1 / (F.col("n1") - 1) + e0 * e0 / (F.col("n0") - 1)))
    return g.select(*keys, "n1", "n0", (F.col("m1") - F.col("m0")).alias("diff"), t.alias("t"), dof.alias("df"))


def ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """df with ``rank`` (average of ties), ``_tie`` (sum of t ** 3 - t over all ties) and ``total`` rows, by key.

    Values are counted first, so running sums go over a key's distinct values, in ranges where there is no key.
    """
    c = F.col("_c").cast("double")
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    v = before(v, keys, [value], {"_below": c, "_ties": c * c * c - c})
    v = v.select(*keys, value, (F.col("_below") + (c + 1) / 2.0).alias("rank"), F.col("all__ties").alias("_tie"), F.col("all__below").cast("long").alias("total"))
    return df.join(v, [*keys, value])


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction and its degrees of freedom; groups of under two rows make it null."""
    g = ranked(df, keys, value).groupBy(*keys, group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.first("_tie").alias("tie"), F.first("total").alias("total"))
    h = g.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.first("tie").alias("tie"), F.first("total").cast("double").alias("total"), F.count("*").alias("k"), F.min("n").alias("least"))
    n = F.col("total")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)
    return h.select(*keys, F.when((F.col("least") >= 2) & (F.col("tie") < n * n * n - n), raw / (1 - F.col("tie") / (n * n * n - n))).alias("h"), (F.col("k") - 1).alias("df"))


def rank_sums(df: DataFrame, keys: Sequence[str], group: Column, value: str) -> DataFrame:
    """keys, r1 (rank sum of the group), n1, n0 and tie."""
    r = ranked(df.withColumn("_g", group), keys, value)
    return r.groupBy(*keys).agg(F.sum(F.when(F.col("_g"), F.col("rank"))).alias("r1"), F.count(F.when(F.col("_g"), 1)).cast("double").alias("n1"), F.count(F.when(~F.col("_g"), 1)).cast("double").alias("n0"), F.first("_tie").alias("tie"))


def rank_sum(df: DataFrame, keys: Sequence[str], group: Column, value: str) -> DataFrame:
    """Mann-Whitney U of the group, its normal statistic with tie and continuity correction, Cliff's delta."""
    n1, n0 = F.col("n1"), F.col("n0")
    u, n = F.col("r1") - n1 * (n1 + 1) / 2.0, n1 + n0
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("tie") / F.when(n > 1, n * (n - 1))))
    z = F.when((n1 > 0) & (n0 > 0) & (sd > 0), (F.abs(u - n1 * n0 / 2.0) - 0.5) / sd)
    return rank_sums(df, keys, group, value).select(*keys, u.alias("u"), F.greatest(z, F.lit(0.0)).alias("z"), F.when((n1 > 0) & (n0 > 0), 2.0 * u / (n1 * n0) - 1.0).alias("delta"))


def signed_rank_sums(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """keys, w_plus, w_minus, n and tie (sum of t ** 3 - t) of the ranks of |a - b| without zeros."""
    d = df.withColumn("_d", F.col(a) - F.col(b)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    side = lambda on: F.sum(F.when(on, F.col("rank")).otherwise(0.0))
    return ranked(d, keys, "_a").groupBy(*keys).agg(side(F.col("_d") > 0).alias("w_plus"), side(F.col("_d") < 0).alias("w_minus"), F.count("*").cast("double").alias("n"), F.first("_tie").alias("tie"))


def signed_rank(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Wilcoxon signed-rank sums of a - b without zeros, and the normal statistic with tie correction."""
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie") / 48.0)
    return signed_rank_sums(df, keys, a, b).select(*keys, "w_plus", "w_minus", F.when(sd > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / sd).alias("z"))


def paired(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Paired t, its degrees of freedom, mean difference under the sign rule, and Cohen's d with the pooled deviation.

    The mean difference counts as 0 unless both means have the same sign.
    """
    d = F.col(after) - F.col(before)
    both = df.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    g = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.avg(before).alias("mb"), F.avg(after).alias("ma"), F.var_samp(before).alias("vb"), F.var_samp(after).alias("va"))
    diff = F.when(F.signum("mb") == F.signum("ma"), F.col("ma") - F.col("mb")).otherwise(0.0)
    pooled = F.sqrt((F.col("vb") + F.col("va")) / 2.0)
    return g.select(*keys, "n", F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"), diff.alias("diff"), F.when(pooled > 0, diff / pooled).alias("d"))


def ks_normal(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of the values, standardised by mean and sample deviation, to the normal distribution; 1 where they are constant, null with one value.

    ``exact.normality`` gives the p-value, with the population deviation.
    """
    every = Window.partitionBy(*keys)
    sd = F.stddev_samp(value).over(every)
    z = F.when(sd > 0, (F.col(value) - F.avg(value).over(every)) / sd)
    d = df.where(F.col(value).isNotNull()).select(*keys, z.alias("_z"), sd.alias("_s"), F.row_number().over(Window.partitionBy(*keys).orderBy(value)).alias("_i"), F.count("*").over(every).alias("_n"))
    tail = p_normal(F.col("_z")) / 2.0
    cdf = F.when(F.col("_z") >= 0, 1.0 - tail).otherwise(tail)
    gap = F.greatest(F.abs(F.col("_i") / F.col("_n") - cdf), F.abs(cdf - (F.col("_i") - 1) / F.col("_n")))
    return d.groupBy(*keys).agg(F.coalesce(F.max(gap), F.max(F.when(F.col("_s") == 0, F.lit(1.0)))).alias("distance"), F.count("*").alias("n"))


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q", clip: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """False discovery rate of each p; null stays null and isn't counted.

    p values are counted first, so equal ones share the largest of their places, and running sums go over distinct values, in ranges where there is no key.
    """
    v = before(df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c")), keys, [p], {"_below": F.col("_c").cast("double")})
    v = v.withColumn("_r", F.col(p) * F.col("all__below") / (F.col("_below") + F.col("_c")))
    q = least_from_here(v, keys, [p], "_r", "_q").select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(p).alias("_p"), "_q")
    same = F.col(p) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    j = df.join(q, same, "left")
    return j.withColumn(out, F.least("_q", F.lit(1.0)) if clip else F.col("_q")).withColumn(out, F.when(F.col(p).isNotNull(), F.col(out))).select(*df.columns, out)


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, least: int = 5) -> DataFrame:
    """Rank correlation of complete pairs and its t statistic; null under ``least`` pairs."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    one = ranked(both, keys, "_a").withColumnRenamed("rank", "_ra").drop("_tie", "total")
    two = ranked(one, keys, "_b")
    g = two.groupBy(*keys).agg(F.corr("_ra", "rank").alias("_rho"), F.count("*").alias("n"))
    rho = F.when(F.col("n") >= least, F.col("_rho"))
    return g.select(*keys, "n", rho.alias("rho"), F.when(F.abs(rho) < 1, rho * F.sqrt((F.col("n") - 2) / (1 - rho * rho))).alias("t"))


def numbered(df: DataFrame, by: Sequence[str], id: str) -> DataFrame:
    """df with ``_i`` (int), the row's number from 0 in its stratum by id, and ``_n``, the stratum's rows; no stratum is one task.

    Rows go to ranges of (stratum, id); a window runs inside each, and what the ranges
    before add comes from one row a range and stratum.
    """
    d = settled(df.repartitionByRange(parts(df), *by, id).withColumn("_p", F.spark_partition_id()))
    counts = d.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    of, up_to = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*by, "_p", F.coalesce(F.sum("_c").over(up_to), F.lit(0)).alias("_b"), F.sum("_c").over(of).alias("_n"))
    inside = d.withColumn("_r", F.row_number().over(Window.partitionBy("_p", *by).orderBy(id)) - 1)
    return inside.join(first, [*by, "_p"]).withColumn("_i", (F.col("_r") + F.col("_b")).cast("int")).drop("_p", "_r", "_b")


def bootstrap(df: DataFrame, keys: Sequence[str], strata: Sequence[str], id: str, draws: int, seed: int) -> DataFrame:
    """Rows of every replicate: as many of each stratum as it has, drawn with replacement by a seeded hash.

    Each slot of each replicate picks a row number of its stratum; the join is on
    (stratum, number), so the work is draws times rows and needs no gathering.
    """
    by = [*keys, *strata]
    rows = numbered(df, by, id)
    slots = rows.select(*by, "_i", "_n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = slots.select(*by, "rep", F.pmod(F.xxhash64(F.lit(seed), "rep", "_i", *by), F.col("_n")).cast("int").alias("_i"))
    return pick.join(rows.drop("_n"), [*by, "_i"]).drop("_i")


def bootstrap_means(df: DataFrame, keys: Sequence[str], strata: Sequence[str], id: str, value: str, draws: int, seed: int) -> DataFrame:
    """keys, strata, rep, mean of value over the rows of ``bootstrap`` with the same seed, for up to some hundred draws; missing values are skipped.

    Picks don't become rows: a task packs those of its slots into arrays of four bytes a
    pick, by blocks of 2^16 row numbers, and each block adds them up by its own values.
    """
    by = [*keys, *strata]
    rows = numbered(df.select(*by, id, F.col(value).cast("double").alias("_v")), by, id).withColumn("_s", F.xxhash64(*by))
    picks = F.array(*(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "_i", *by), F.col("_n")) for r in range(draws)))

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()))
            size += len(held[-1][1])
            if size >= 1 << 22:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    def out(held):
        s, p = (np.concatenate(v) for v in zip(*held))
        codes, at = np.unique(s, return_inverse=True)
        code = np.repeat(at, draws)
        rep = np.tile(np.arange(draws), len(s))
        group = code << 32 | p >> 16
        order = np.argsort(group, kind="stable")
        packed = (rep << 16 | p & 0xFFFF).astype(np.uint32)[order]
        groups, first = np.unique(group[order], return_index=True)
        arrays = [packed[a:b].tobytes() for a, b in zip(first, [*first[1:], len(packed)])]
        return pa.RecordBatch.from_arrays([pa.array(codes[groups >> 32]), pa.array(groups & 0xFFFFFFFF, pa.int64()), pa.array(arrays, pa.binary())], ["_s", "_block", "picks"])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        at, v = left["_i"].to_numpy() & 0xFFFF, left["_v"].to_numpy()
        values, there = np.zeros(1 << 16), np.zeros(1 << 16)
        values[at], there[at] = np.nan_to_num(v, nan=0.0), ~np.isnan(v)
        total, n = np.zeros(draws), np.zeros(draws)
        for x in right["picks"].to_pylist():
            p = np.frombuffer(x, np.uint32)
            rep, p = p >> 16, p & 0xFFFF
            total += np.bincount(rep, values[p], draws)
            n += np.bincount(rep, there[p], draws)
        own = {c: pa.array([left[c][0].as_py()] * draws, left.schema.field(c).type) for c in by}
        return pa.table(own | {"rep": pa.array(np.arange(draws), pa.int32()), "total": pa.array(total), "n": pa.array(n.astype(np.int64))})

    packed = rows.select("_s", picks.alias("picks")).mapInArrow(pack, "_s long, _block long, picks binary")
    blocks = rows.select(*by, "_s", F.shiftright("_i", 16).cast("long").alias("_block"), "_i", F.when(~F.isnan("_v"), F.col("_v")).alias("_v"))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    sums = blocks.groupBy("_s", "_block").cogroup(packed.groupBy("_s", "_block")).applyInArrow(add, f"{kinds}, rep int, total double, n long")
    total = sums.groupBy(*by, "rep").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return total.select(*by, "rep", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"))
