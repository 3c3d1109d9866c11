"""Running sums and minima over a whole ordered table in two passes, without one task for all rows.

Rows go to ranges of the order; a window runs inside each range, and what the ranges
before (or behind) add comes from one row a range. With keys, whose rows are ordered
each for themselves, windows by key do the same in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.sources.shared import settled


def ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df with ``_range``: numbers of ranges of the order, which rise with it and stay the same whenever they are read."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return settled(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))


def before(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """df with ``<name>`` (sum over the rows before in order; 0 at the first) and ``all_<name>`` (sum over all rows) for each name, by key.

    Rows that tie in order are taken in any order, so an order without ties is wanted.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    if keys:
        back = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        every = Window.partitionBy(*keys)
        return df.withColumns({n: zero(F.sum(c).over(back)) for n, c in sums.items()} | {f"all_{n}": F.sum(c).over(every) for n, c in sums.items()})
    d = ranges(df, order)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    # one row a range
    back = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = totals.select("_range", *(zero(F.sum(f"_t_{n}").over(back)).alias(f"_o_{n}") for n in sums), *(F.sum(f"_t_{n}").over(every).alias(f"all_{n}") for n in sums))
    d = d.withColumns({n: zero(F.sum(c).over(inside)) for n, c in sums.items()}).join(F.broadcast(offsets), "_range")
    return d.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums}).drop("_range", *(f"_o_{n}" for n in sums))


def least_from_here(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """df with ``out``: the least value of this row and of those behind it in order, by key."""
    if keys:
        return df.withColumn(out, F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)))
    d = ranges(df, order)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    # one row a range
    behind = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    later = d.groupBy("_range").agg(F.min(value).alias("_l")).select("_range", F.min("_l").over(behind).alias("_l"))
    return d.withColumn(out, F.min(value).over(inside)).join(F.broadcast(later), "_range").withColumn(out, F.least(out, "_l")).drop("_range", "_l")
