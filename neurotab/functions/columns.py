"""Small column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """NaN and infinite values of the named double columns become null, so Spark's null rules equal skip-missing rules."""
    return df.withColumns(
        {n: F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(F.col(n).cast("double")) for n in names}
    )


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, null where bottom is 0."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double"))


def r6(c: Column) -> Column:
    """Rounded to six decimals as double, the form in which results are compared."""
    return F.round(c.cast("double"), 6)


def unit_vector(names: list[str], eps: float = 1e-6) -> list[Column]:
    """The components over the length plus eps."""
    length = F.sqrt(sum((F.col(c).cast("double") * F.col(c).cast("double") for c in names), F.lit(0.0)))
    return [(F.col(c).cast("double") / (length + eps)).alias(c) for c in names]


def fill_median(df: DataFrame, names: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Missing and infinite values become the median of their column (by key), and 0 where it has no value."""
    d = nan_to_null(df, *names)
    middle = d.groupBy(*keys).agg(*(F.median(c).alias(f"_m_{c}") for c in names))
    j = d.join(middle, list(keys), "left") if keys else d.join(F.broadcast(middle), F.lit(True))  # one row
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}"), F.lit(0.0)) for c in names}).select(*df.columns)
