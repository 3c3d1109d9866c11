"""Abundance tables in long form: quality, fold changes, ranked features, flows, concordance, correlation graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.sources.shared import parts, settled


def relative_deviation(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sample deviation over mean, in percent; null where the mean is 0 or one value is there."""
    m = F.avg(value)
    return df.groupBy(*keys).agg(F.when(m != 0, F.stddev_samp(value) / m * 100.0).alias("rsd"), F.count(value).alias("n"))


def missing_rate(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Share of missing values by key, and over all rows as the row whose keys are null."""
    return df.rollup(*keys).agg(F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.count("*").alias("n"), F.grouping_id().alias("level")).where((F.col("level") == 0) | (F.col("level") == 2 ** len(keys) - 1)).drop("level")


def present_features(df: DataFrame, feature: str, value: str, least: int = 2) -> DataFrame:
    """Rows of features with at least ``least`` non-missing values."""
    ok = df.groupBy(feature).agg(F.count(value).alias("_n")).where(F.col("_n") >= least).select(feature)
    return df.join(ok, feature, "left_semi")


def fold_change(df: DataFrame, keys: Sequence[str], group: Column, value: str, eps: float = 1e-9, logged: bool = False) -> DataFrame:
    """log2 ratio of group means (difference of means for logged data)."""
    a, b = F.avg(F.when(group, F.col(value))), F.avg(F.when(~group, F.col(value)))
    return df.groupBy(*keys).agg(a.alias("mean_1"), b.alias("mean_0"), (a - b if logged else F.log2((a + eps) / (b + eps))).alias("log2fc"))


def top_distinct(df: DataFrame, name: str, order: Sequence[Column], k: int) -> DataFrame:
    """The k best rows of different names."""
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(*order))).where("_r = 1").drop("_r")
    return first.orderBy(*order).limit(k)


def edge_threshold(edges: DataFrame, weight: str, target: int, low: float = 0.70, high: float = 0.88, empty: float = 0.80) -> float:
    """The target-th largest |weight| under 0.999999, kept between low and high; ``empty`` without edges."""
    top = edges.select(F.abs(weight).alias("w")).where("w < 0.999999").orderBy(F.desc("w")).limit(target).agg(F.min("w")).first()[0]
    return empty if top is None else min(max(top, low), high)


def flows(df: DataFrame, source: str, middle: str, target: str, k: int) -> DataFrame:
    """Counts of (source, middle, target) where the middles beyond the k most frequent are Other."""
    best = df.groupBy(middle).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), middle).limit(k).select(F.col(middle).alias("_m"))
    j = df.join(F.broadcast(best), F.col(middle) == F.col("_m"), "left")
    return j.groupBy(source, F.when(F.col("_m").isNull(), "Other").otherwise(F.col("_m")).alias(middle), target).agg(F.count("*").alias("n"))


def pathway_evidence(members: DataFrame, hits: DataFrame, pathway: str, member: str, name: str, most: int = 5, names: DataFrame | None = None) -> DataFrame:
    """Distinct members and hits of each pathway with any hit, their share, and up to five supporting names in order.

    ``names`` has a row for each member and its name where members don't carry them;
    members without one are left out, and only hits are joined with their names.
    """
    h = hits.select(F.col(member)).distinct().withColumn("_hit", F.lit(True))
    # dealt by member before anything is told apart: pairs hardly repeat inside a part of a file
    m = members.repartition(parts(members), member)
    if names is None:
        m = m.dropDuplicates([pathway, member])
    else:
        m = m.select(pathway, member).distinct().join(names, member, "left_semi")
    j = m.join(h, member, "left")
    hit = j.where("_hit") if names is None else j.where("_hit").join(names.select(member, name), member)
    # names of the smallest members only are kept while aggregating, so a pathway of any size stays small
    best = hit.select(pathway, name).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(pathway).orderBy(name))).where(F.col("_r") <= most)
    support = best.groupBy(pathway).agg(F.array_join(F.array_sort(F.collect_list(name)), ";").alias("support"))
    g = j.groupBy(pathway).agg(F.count("*").alias("n_members"), F.count("_hit").alias("n_hits"))
    return g.where("n_hits > 0").withColumn("share", F.col("n_hits") / F.col("n_members")).join(support, pathway)


def concordance(a: DataFrame, b: DataFrame, feature: str, p: str, effect: str, alpha: float = 0.05) -> DataFrame:
    """Significant features of two analyses over the same features: counts, Jaccard, overlap shares, sign agreement, correlation of effects."""
    j = a.select(feature, F.col(p).alias("pa"), F.col(effect).alias("ea")).join(b.select(feature, F.col(p).alias("pb"), F.col(effect).alias("eb")), feature)
    sa, sb = F.coalesce(F.col("pa") < alpha, F.lit(False)), F.coalesce(F.col("pb") < alpha, F.lit(False))
    n = lambda c: F.count(F.when(c, 1))
    g = j.agg(F.count("*").alias("n"), n(sa).alias("n_a"), n(sb).alias("n_b"), n(sa & sb).alias("both"), n(sa | sb).alias("either"), n(F.signum("ea") == F.signum("eb")).alias("same_sign"), F.corr("ea", "eb").alias("r"))
    return g.withColumn("jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")))


def correlations(df: DataFrame, row: str, feature: str, value: str) -> DataFrame:
    """Pearson correlation of every pair of features (src < dst) over the rows that have both."""
    a = df.select(row, F.col(feature).alias("src"), F.col(value).alias("_x"))
    b = df.select(row, F.col(feature).alias("dst"), F.col(value).alias("_y"))
    return a.join(b, row).where("src < dst").groupBy("src", "dst").agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def class_density(edges: DataFrame, nodes: DataFrame, node: str, cls: str) -> DataFrame:
    """Edges between two classes (or inside one) over the pairs that are possible."""
    size = nodes.groupBy(F.col(cls).alias("c")).agg(F.count("*").alias("n"))
    of = nodes.select(F.col(node).alias("_n"), F.col(cls).alias("_c"))
    e = edges.join(of.toDF("src", "ca"), "src").join(of.toDF("dst", "cb"), "dst")
    g = e.groupBy(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b")).agg(F.count("*").alias("n_edges"))
    j = g.join(size.toDF("class_a", "na"), "class_a").join(size.toDF("class_b", "nb"), "class_b")
    pairs = F.when(F.col("class_a") == F.col("class_b"), F.col("na") * (F.col("na") - 1) / 2.0).otherwise(F.col("na") * F.col("nb") * 1.0)
    return j.select("class_a", "class_b", "n_edges", F.when(pairs > 0, F.col("n_edges") / pairs).alias("density"))


def merge_tables(a: DataFrame, b: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """Features of both long tables; samples in both get the mean of what exists.

    Rows go to parts by feature before they are summed, in as many parts as the tables
    need: (feature, sample) hardly repeats inside a part of a file, so sums made there
    would be as many as its rows.
    """
    of = lambda d, side: d.select(feature, sample, value, F.lit(side).alias("_side")).where(F.col(feature).isNotNull())
    u = of(a, 0).unionByName(of(b, 1))
    g = u.repartition(parts(u), feature).groupBy(feature, sample).agg(F.avg(value).alias(value), F.min("_side").alias("_low"), F.max("_side").alias("_high"))
    w = Window.partitionBy(feature)
    both = g.withColumns({"_low": F.min("_low").over(w), "_high": F.max("_high").over(w)}).where("_low < _high")
    return both.select(feature, sample, value)


def sample_exactly(df: DataFrame, keys: Sequence[str], id: str, n: int, seed: int) -> DataFrame:
    """n rows of each key: without replacement if it has so many, else all and some of them again.

    Counts of ranges of the hash, 65,536 a key, say which ranges hold a key's n
    smallest hashes; only rows of these are put in order.
    """
    d = df.withColumns({"_h": F.xxhash64(F.lit(seed), id), "_r": F.shiftright(F.xxhash64(F.lit(seed), id), 48)})
    key = F.struct(*(F.col(k).alias(f"_{i}") for i, k in enumerate(keys))).alias("_key")
    before = Window.partitionBy("_key").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(key, "_r").agg(F.count("*").alias("_c")).withColumns({"_b": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy("_key"))})
    cut = settled(sizes.where(F.col("_b") < n).groupBy("_key").agg(F.max("_r").alias("_last"), F.first("_n").alias("_n")))
    few = cut.limit(10_001).count() <= 10_000  # a row a key
    d = d.join(F.broadcast(cut) if few else cut, key.eqNullSafe(F.col("_key")) & (F.col("_r") <= F.col("_last")))
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_key").orderBy("_h", id)) - 1).where(F.col("_i") < n)
    # row i of m stands for slots i, i + m, i + 2m .. under n
    copies = F.floor((n - 1 - F.col("_i")) / F.col("_n")) + 1
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1))).withColumn("slot", (F.col("_i") + F.col("_k") * F.col("_n")).cast("long"))
    return d.select(*df.columns, "slot")


def significant(df: DataFrame, p: str, vip: str, p_below: float = 0.05, vip_least: float = 1.0, classes: Sequence[str] = (), regulation: str | None = None) -> DataFrame:
    """Rows with p < p_below and vip >= vip_least; null classes are Unclassified, a regulation other than Up or Down is NA."""
    d = df.where((F.col(p) < p_below) & (F.col(vip) >= vip_least)).withColumns({c: F.coalesce(F.col(c), F.lit("Unclassified")) for c in classes})
    if regulation is None:
        return d
    word = F.initcap(F.trim(regulation))
    return d.withColumn(regulation, F.when(word.isin("Up", "Down"), word).otherwise("NA"))


def top_edges(edges: DataFrame, weight: str, k: int) -> DataFrame:
    """The k edges of largest magnitude, equal ones by their ends."""
    return edges.where(F.col(weight).isNotNull()).orderBy(F.desc(F.abs(weight)), "src", "dst").limit(k)


def selection_frequency(df: DataFrame, feature: str, fold: str, folds: int) -> DataFrame:
    """Number and share of folds that chose a feature; a feature chosen twice in a fold counts once."""
    g = df.select(feature, fold).distinct().groupBy(feature).agg(F.count(fold).alias("n"))
    return g.withColumn("frequency", F.col("n") / F.lit(folds))


def rsd_filter(df: DataFrame, feature: str, value: str, qc: Column, below: float = 30.0) -> DataFrame:
    """Rows of features whose deviation over the QC rows is known and under the limit (percent)."""
    ok = relative_deviation(df.where(qc), [feature], value).where(F.col("rsd").isNotNull() & (F.col("rsd") < below)).select(feature)
    return df.join(ok, feature, "left_semi")


def mean_se(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean and standard error (sample deviation over the root of n; null with one value) by key."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(n)).alias("se"))


def joined_correlation(a: DataFrame, b: DataFrame, keys: Sequence[str], value_a: str, value_b: str) -> DataFrame:
    """n and Pearson r of two tables' values over the keys that both have, each key's mean where it repeats."""
    of = lambda d, v, c: d.groupBy(*keys).agg(F.avg(v).alias(c))
    return of(a, value_a, "_a").join(of(b, value_b, "_b"), list(keys)).where("_a is not null and _b is not null").agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("r"))


def profile(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Summaries of the same conditions side by side: conditions that all of them have, their columns named part_column."""
    out = None
    for name, part in parts.items():
        named = part.select(*keys, *(F.col(c).alias(f"{name}_{c}") for c in part.columns if c not in keys))
        out = named if out is None else out.join(named, list(keys))
    return out


def top_variance(df: DataFrame, feature: str, value: str, k: int) -> DataFrame:
    """The k features of largest sample variance, equal ones by name."""
    return df.groupBy(feature).agg(F.var_samp(value).alias("variance")).where("variance is not null").orderBy(F.desc("variance"), feature).limit(k)


def centroid_distances(df: DataFrame, group: str, names: Sequence[str], reference: str) -> DataFrame:
    """Rows with ``own`` and ``to_reference``: distances to the centre of their group and of the reference group."""
    centres = df.groupBy(group).agg(*(F.avg(c).alias(f"_c_{c}") for c in names))  # a row a group
    origin = centres.where(F.col(group) == reference).select(*(F.col(f"_c_{c}").alias(f"_r_{c}") for c in names))
    far = lambda p: F.sqrt(sum(((F.col(c) - F.col(f"{p}{c}")) * (F.col(c) - F.col(f"{p}{c}")) for c in names), F.lit(0.0)))
    j = df.join(F.broadcast(centres), group).join(F.broadcast(origin), F.lit(True), "left")
    return j.withColumns({"own": far("_c_"), "to_reference": far("_r_")}).drop(*(f"_{p}_{c}" for p in "cr" for c in names))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key in an order, with ``place``: as the leftmost two of a group on a component, or a module's best by p."""
    from pyspark.sql import Window

    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
