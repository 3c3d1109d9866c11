"""Exact p-values of rank tests, normality, the choice of a paired test, and tables of what is significant.

Ranks, sums and counts are Spark's; a p-value is a function of one row a test. Null
distributions are counts of subset sums: of 1..n for signed ranks, of subsets of one
size of 1..n for rank sums. They are built once a worker and size, for at most
``LARGEST`` values; beyond that, or with ties, the normal approximation stands in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from neurotab.operators.stats import p_normal, p_student, rank_sums, signed_rank_sums

LARGEST = 50


@cache
def subset_sums(n: int) -> np.ndarray:
    """Cumulative share of the subsets of 1..n by their sum."""
    counts = np.ones(1)
    for i in range(1, n + 1):
        counts = np.pad(counts, (0, i)) + np.pad(counts, (i, 0))
    return np.cumsum(counts) / 2.0**n


@cache
def sized_subset_sums(n: int, size: int) -> np.ndarray:
    """Cumulative share of the subsets of 1..n of one size by their sum."""
    counts = np.zeros((size + 1, n * (n + 1) // 2 + 1))
    counts[0, 0] = 1
    for i in range(1, n + 1):
        counts[1:, i:] += counts[:-1, : counts.shape[1] - i].copy()
    return np.cumsum(counts[size]) / counts[size].sum()


@F.pandas_udf(DoubleType())
def p_signed_rank(w: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of the smaller signed-rank sum of n differences without ties."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else min(1.0, 2 * subset_sums(int(b))[int(a)]) for a, b in zip(w, n)], dtype=float)


@F.pandas_udf(DoubleType())
def p_rank_sum(u: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
    """Two-sided p of Mann-Whitney's U of n1 against n0 values without ties."""

    def one(a, m, k):
        if pd.isna(a) or m < 1 or k < 1:
            return None
        low = min(a, m * k - a)
        return min(1.0, 2 * sized_subset_sums(int(m + k), int(m))[int(low + m * (m + 1) / 2)])

    return pd.Series([one(*r) for r in zip(u, n1, n0)], dtype=float)


def kolmogorov(d: float, n: int) -> float:
    """P(D >= d) of n values by the power of Durbin's matrix (Marsaglia, Tsang and Wang, 2003); by the limit with Stephens' correction over 4,000 values or far in the tail."""
    if n < 1 or not d == d:
        return float("nan")
    if d >= 1:
        return 0.0
    s = d * d * n
    if n > 4000 or s > 18:
        t = d * (np.sqrt(n) + 0.12 + 0.11 / np.sqrt(n))
        k = np.arange(1, 101)
        return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * t * t)), 0, 1))
    k = int(n * d) + 1
    h, m = k - n * d, 2 * k - 1
    at = np.arange(m)
    a = (at[:, None] - at[None, :] + 1 >= 0).astype(float)
    a[:, 0] -= h ** (at + 1)
    a[-1, :] -= h ** (m - at)
    a[-1, 0] += (2 * h - 1) ** m if 2 * h > 1 else 0
    factorial = np.cumsum(np.log(np.maximum(np.arange(m + 1), 1)))
    below = at[:, None] - at[None, :] + 1
    a *= np.where(below >= 0, np.exp(-factorial[np.maximum(below, 0)]), 1.0)  # entries are divided by (i - j + 1)!
    power, log, left = np.eye(m), 0.0, n
    base, base_log = a, 0.0
    while left:
        if left & 1:
            power, log = power @ base, log + base_log
        left >>= 1
        if left:
            base, base_log = base @ base, 2 * base_log
        for name in ("power", "base"):
            top = (power if name == "power" else base).max()
            if name == "power" and top > 1e100:
                power, log = power / top, log + np.log(top)
            elif name == "base" and top > 1e100:
                base, base_log = base / top, base_log + np.log(top)
    log += np.sum(np.log(np.arange(1, n + 1) / n))
    return float(np.clip(1 - power[k - 1, k - 1] * np.exp(log), 0, 1))


@F.pandas_udf(DoubleType())
def p_kolmogorov(d: pd.Series, n: pd.Series) -> pd.Series:
    """p of a Kolmogorov-Smirnov distance to a given distribution."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else kolmogorov(float(a), int(b)) for a, b in zip(d, n)], dtype=float)


def normality(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, distance, p: Kolmogorov-Smirnov test of the values, standardised by mean and population deviation, against the normal distribution.

    Constant values (deviation under 1e-8) aren't normal: p is 0, the distance null.
    Missing values are skipped. Values are counted before they are ordered.
    """
    from pyspark.sql import Window

    v = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    every = Window.partitionBy(*keys)
    n = F.sum("_c").over(every)
    v = v.withColumn("_n", n).withColumn("_m", F.sum(F.col("_v") * F.col("_c")).over(every) / F.col("_n"))
    v = v.withColumn("_s", F.sqrt(F.sum(F.col("_c") * (F.col("_v") - F.col("_m")) * (F.col("_v") - F.col("_m"))).over(every) / F.col("_n")))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    flat = F.col("_s") <= 1e-8
    z = (F.col("_v") - F.col("_m")) / F.when(~flat, F.col("_s"))
    tail = p_normal(z) / 2.0
    v = v.withColumn("_upto", upto).withColumn("_f", F.when(z >= 0, 1.0 - tail).otherwise(tail))
    gap = F.greatest(F.abs(F.col("_upto") / F.col("_n") - F.col("_f")), F.abs(F.col("_f") - (F.col("_upto") - F.col("_c")) / F.col("_n")))
    g = v.groupBy(*keys).agg(F.first("_n").alias("n"), F.max(gap).alias("distance"))
    return g.withColumn("p", F.coalesce(p_kolmogorov("distance", "n"), F.lit(0.0)))


def wilcoxon(df: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """keys, w (smaller rank sum), n (differences that aren't zero), exact, p of the two-sided signed-rank test; p is 1 where all differences are zero.

    Exact up to ``LARGEST`` differences without ties, else normal without continuity correction.
    """
    both = df.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    sums = signed_rank_sums(both, keys, after, before)
    n, w = F.col("n"), F.least("w_plus", "w_minus")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tie") / 48.0)
    exact = (n <= LARGEST) & (F.col("tie") == 0)
    t = sums.select(*keys, w.alias("w"), "n", exact.alias("exact"), F.least(p_normal((w - n * (n + 1) / 4.0) / sd), F.lit(1.0)).alias("_p"))
    t = t.withColumn("p", F.coalesce(p_signed_rank(F.when(F.col("exact"), F.col("w")), "n"), "_p"))
    j = both.groupBy(*keys).agg(F.count("*").alias("_pairs")).join(t, list(keys), "left") if keys else t
    return j.select(*keys, "w", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("exact", F.lit(True)).alias("exact"), F.coalesce("p", F.lit(1.0)).alias("p"))


def mann_whitney(df: DataFrame, keys: Sequence[str], group: Column, value: str) -> DataFrame:
    """keys, u, n1, n0, exact, p of the two-sided rank-sum test of the group against the rest; p is null where one of them is empty.

    Exact up to ``LARGEST`` values without ties, else normal with tie and continuity correction; constant values give p = 1.
    """
    n1, n0 = F.col("n1"), F.col("n0")
    u, n = F.col("r1") - n1 * (n1 + 1) / 2.0, n1 + n0
    sd = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.col("tie") / F.when(n > 1, n * (n - 1))))
    z = F.greatest((F.abs(u - n1 * n0 / 2.0) - 0.5) / F.when(sd > 0, sd), F.lit(0.0))
    exact = (n <= LARGEST) & (F.col("tie") == 0)
    t = rank_sums(df, keys, group, value).select(*keys, u.alias("u"), "n1", "n0", exact.alias("exact"), F.least(p_normal(z), F.lit(1.0)).alias("_p"))
    p = F.when((n1 > 0) & (n0 > 0), F.coalesce(p_rank_sum(F.when(F.col("exact"), F.col("u")), "n1", "n0"), "_p"))
    return t.select(*keys, "u", n1.cast("long").alias("n1"), n0.cast("long").alias("n0"), "exact", p.alias("p"))


def paired_test(df: DataFrame, keys: Sequence[str], before: str, after: str, normal: float = 0.05) -> DataFrame:
    """keys, n, test (t or wilcoxon), p: paired t where both columns look normal, else the signed-rank test.

    Of the t test, p is 0 where all differences are the same but not zero, and null where they are zero or there is one pair.
    """
    both = df.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    d = (F.col(after) - F.col(before)).cast("double")
    t = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"))
    t = t.withColumn("_t", F.when(F.col("_s") > 0, F.col("_m") / (F.col("_s") / F.sqrt("n"))))
    t = t.withColumn("_pt", F.when((F.col("_s") == 0) & (F.col("_m") != 0), 0.0).otherwise(p_student("_t", (F.col("n") - 1).cast("double"))))
    looks = [normality(both, keys, c).select(*keys, F.col("p").alias(f"_{side}")) for side, c in (("b", before), ("a", after))]
    j = t.join(looks[0], list(keys)).join(looks[1], list(keys)).join(wilcoxon(both, keys, before, after).select(*keys, F.col("p").alias("_pw")), list(keys))
    both_normal = (F.col("_b") > normal) & (F.col("_a") > normal)
    return j.select(*keys, "n", F.when(both_normal, "t").otherwise("wilcoxon").alias("test"), F.when(both_normal, F.col("_pt")).otherwise(F.col("_pw")).alias("p"))


def significance(df: DataFrame, keys: Sequence[str], before: str, after: str, p_below: float = 0.05, least_d: float = 0.5, sign_rule: bool = True) -> DataFrame:
    """keys, n, test, p, sig_diff and effect_d: one cell of a significance matrix for each key.

    sig_diff is the mean difference where p is under the threshold, else 0; under the
    sign rule it is 0, too, unless both means have the same sign. effect_d is Cohen's d
    (pooled sample deviation, mean difference always under the sign rule, 0 without
    deviation), and 0 below its threshold.
    """
    both = df.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    g = both.groupBy(*keys).agg(F.avg(before).alias("_mb"), F.avg(after).alias("_ma"), F.var_samp(before).alias("_vb"), F.var_samp(after).alias("_va"))
    diff, same = F.col("_ma") - F.col("_mb"), F.signum("_ma") * F.signum("_mb") > 0
    pooled = F.sqrt((F.col("_vb") + F.col("_va")) / 2.0)
    d = F.when(same & (pooled > 0), diff / pooled).otherwise(0.0)
    j = paired_test(both, keys, before, after).join(g, list(keys))
    kept = (F.col("p") < p_below) & same if sign_rule else F.col("p") < p_below
    return j.select(*keys, "n", "test", "p", F.when(kept, diff).otherwise(0.0).alias("sig_diff"), F.when(F.abs(d) >= least_d, d).otherwise(0.0).alias("effect_d"))


def matrix(cells: DataFrame, row: str, column: str, names: Sequence[str], value: str) -> DataFrame:
    """One row for each ``row``, a column for each name: the cells of a significance matrix side by side; 0 where there is none."""
    return cells.groupBy(row).pivot(column, list(names)).agg(F.first(value)).na.fill(0.0, list(names))
