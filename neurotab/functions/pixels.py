"""Pixel columns: HSV in 8-bit ranges (hue 0 to 180), grey, colour masks, stain density, tissue.

Works on one row a pixel with columns r, g, b of 0 to 255; masks are column
expressions, so metrics are one grouped aggregation over a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colour ranges as (low, high) of hue, saturation and value.
RANGES = {
    "red": [((0, 50, 50), (10, 255, 255)), ((170, 50, 50), (180, 255, 255))],
    "green": [((35, 40, 40), (85, 255, 255))],
    "brown": [((5, 40, 20), (30, 255, 220))],
}
#: Third row of the inverse of the usual hematoxylin, eosin and DAB stain matrix.
DAB = (-0.55783, -0.13428, 1.57338)


def unpack(images: DataFrame) -> DataFrame:
    """origin, y, x, r, g, b of each pixel of image rows (height, width, nChannels, data in BGR)."""
    width, channels = F.col("width"), F.col("nChannels")
    lines = images.where("height > 0 and width > 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    line = F.hex(F.substring(F.col("data"), (F.col("y") * width * channels + 1).cast("int"), (width * channels).cast("int")))
    p = lines.select("origin", "y", width, channels, line.alias("_h")).withColumn("x", F.explode(F.sequence(F.lit(0), width - 1)))
    at = lambda c: F.conv(F.substring(F.col("_h"), (F.col("x") * channels + c) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return p.select("origin", "y", "x", at(2).alias("r"), at(1).alias("g"), at(0).alias("b"))


def grey() -> Column:
    return F.round(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))


def hsv() -> tuple[Column, Column, Column]:
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, 60 * (g - b) / d).when(top == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    return F.round(F.when(h < 0, h + 360).otherwise(h) / 2), F.round(F.when(top == 0, 0.0).otherwise(d / top * 255)), top


def colour_mask(colour: str) -> Column:
    h = hsv()
    inside = [[(c >= lo) & (c <= hi) for c, lo, hi in zip(h, low, high)] for low, high in RANGES[colour]]
    each = [a & b & c for a, b, c in inside]
    out = each[0]
    for e in each[1:]:
        out = out | e
    return out


def stain_density() -> Column:
    """Optical density of DAB, at least 0."""
    od = [-F.log10((F.col(c) + 1.0) / 256.0) for c in "rgb"]
    return F.greatest(sum((w * o for w, o in zip(DAB, od)), F.lit(0.0)), F.lit(0.0))


def tissue(bright: bool = True) -> Column:
    return grey() < 245 if bright else grey() > 10


def marker_metrics(pixels: DataFrame, keys: list[str], mask: Column, value: Column, bright: bool = True) -> DataFrame:
    """Tissue and positive pixels, area ratio, mean and integrated value of the positive ones."""
    on = mask & tissue(bright)
    g = pixels.groupBy(*keys).agg(F.count(F.when(tissue(bright), 1)).alias("tissue"), F.count(F.when(on, 1)).alias("positive"), F.avg(F.when(on, value)).alias("mean"), F.sum(F.when(on, value)).alias("integrated"))
    return g.withColumn("area_ratio", F.col("positive") / (F.col("tissue") + 1e-9))


def stain_score(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean density, integrated density and H-score (1 weak + 2 medium + 3 strong per 100 tissue pixels); limits are the 70th, 85th and 95th percentile of tissue."""
    d = pixels.where(tissue()).withColumn("_d", stain_density())
    limits = d.groupBy(*keys).agg(F.percentile("_d", F.array(F.lit(0.70), F.lit(0.85), F.lit(0.95))).alias("_l"))
    j = d.join(limits, keys)
    level = F.when(F.col("_d") >= F.col("_l")[2], 3).when(F.col("_d") >= F.col("_l")[1], 2).when(F.col("_d") >= F.col("_l")[0], 1).otherwise(0)
    return j.groupBy(*keys).agg(F.avg("_d").alias("mean_density"), F.sum(F.when(level > 0, F.col("_d"))).alias("integrated"), (F.sum(level) / F.count("*") * 100.0).alias("h_score"))


def raw_density() -> Column:
    """Optical density of DAB with its sign."""
    return sum((w * -F.log10((F.col(c) + 1.0) / 256.0) for w, c in zip(DAB, "rgb")), F.lit(0.0))


def polarised(pixels: DataFrame, keys: list[str], bright: bool = True, least: float = 1e-4) -> DataFrame:
    """pixels with ``signal`` and ``method``: the density of the sign whose 99th percentile in tissue is larger (density+, the first of equal ones, or density-), at least 0.

    Where neither percentile is over ``least`` the density has no range: then the
    signal is how dark the pixel is, 1 - grey / 255 (method grey).
    """
    d = pixels.withColumn("_d", raw_density())
    p99 = lambda c: F.percentile(F.when(tissue(bright), c), F.lit(0.99))
    q = d.groupBy(*keys).agg(p99(F.col("_d")).alias("_up"), p99(-F.col("_d")).alias("_down"))
    method = F.when(F.coalesce(F.greatest("_up", "_down"), F.lit(0.0)) <= least, "grey").when(F.col("_up") >= F.col("_down"), "density+").otherwise("density-")
    j = d.join(q, keys).withColumn("method", method)
    value = F.when(F.col("method") == "grey", 1 - grey() / 255.0).otherwise(F.greatest(F.when(F.col("method") == "density+", F.col("_d")).otherwise(-F.col("_d")), F.lit(0.0)))
    return j.withColumn("signal", value).drop("_d", "_up", "_down")


def red_green(pixels: DataFrame, keys: list[str], bright: bool = False) -> DataFrame:
    """Area ratio, mean and integrated grey of red and of green tissue pixels (0 where there are none), and the ratios of their areas and integrals (eps 1e-6)."""
    on = {c: colour_mask(c) & tissue(bright) for c in ("red", "green")}
    sums = [f for c in on for f in (F.count(F.when(on[c], 1)).alias(f"_n_{c}"), F.coalesce(F.avg(F.when(on[c], grey())), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.sum(F.when(on[c], grey())), F.lit(0.0)).alias(f"{c}_integrated"))]
    g = pixels.groupBy(*keys).agg(F.count(F.when(tissue(bright), 1)).alias("tissue"), *sums)
    g = g.withColumns({f"{c}_area_ratio": F.col(f"_n_{c}") / (F.col("tissue") + 1e-9) for c in on})
    both = {"rg_area": F.col("_n_red") / (F.col("_n_green") + 1e-6), "rg_intensity": F.col("red_integrated") / (F.col("green_integrated") + 1e-6)}
    return g.withColumns(both).drop("_n_red", "_n_green")
