"""Evaluation of scores against labels from sorted distinct scores: (score, rows, positives).

Scores are counted before they are ordered, so running sums go over distinct scores,
in ranges where there is no key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurotab.operators.order import before


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def score_counts(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("p")).agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("pos"))


def curve(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Threshold, true and false positive rate, precision and recall at each distinct score, from the highest."""
    c = before(score_counts(df, y, p, keys), keys, ["p"], {"_pos": F.col("pos"), "_neg": F.col("n") - F.col("pos")})
    all_p, all_n = F.col("all__pos"), F.col("all__neg")
    tp, fp = all_p - F.col("_pos"), all_n - F.col("_neg")
    return c.select(*keys, F.col("p").alias("threshold"), "n", "pos", tp.alias("tp"), fp.alias("fp"), (tp / all_p).alias("tpr"), (fp / F.when(all_n > 0, all_n)).alias("fpr"), (tp / (tp + fp)).alias("precision"))


def auc(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by rank sums (ties count half) and average precision; null with one class only."""
    neg = F.col("n") - F.col("pos")
    c = before(score_counts(df, y, p, keys), keys, ["p"], {"_pos": F.col("pos"), "_neg": neg})
    tp, reached = F.col("all__pos") - F.col("_pos"), F.col("all__pos") + F.col("all__neg") - F.col("_pos") - F.col("_neg")
    g = c.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("_neg") + neg / 2.0)).alias("_u"), F.sum("pos").alias("n_pos"), F.sum(neg).alias("n_neg"), F.sum(F.col("pos") * tp / reached).alias("_ap"))
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select(*keys, F.when(ok, F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), F.when(ok, F.col("_ap") / F.col("n_pos")).alias("ap"), "n_pos", "n_neg")


def reliability(df: DataFrame, y: str, p: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, mean score and share of positives in equal bins of the score, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"))


def merge_bins(edges: list[float], counts: list[int], least: int) -> list[float]:
    """Edges of bins merged from the left until each has ``least`` rows; a short last bin joins the one before."""
    out, held = [edges[0]], 0
    for right, n in zip(edges[1:], counts):
        held += n
        if held >= least:
            out.append(right)
            held = 0
    if held or out[-1] != edges[-1]:
        out[-1 if len(out) > 1 else len(out) :] = [edges[-1]]
    return out


def brier_ece(df: DataFrame, y: str, p: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    r = reliability(df.withColumn("_s", (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))), y, p, bins, keys)
    e = r.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("share"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    s = df.groupBy(*keys).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))
    return e.join(s, list(keys)) if keys else e.crossJoin(s)


def calibration_line(df: DataFrame, y: str, p: str, steps: int = 25) -> tuple[float, float]:
    """Slope and intercept of the logistic regression of y on logit(p), by Newton steps over five Spark sums each."""
    a, b = 0.0, 0.0
    d = df.select(F.col(y).cast("double").alias("y"), logit(F.col(p)).alias("x")).cache()
    for _ in range(steps):
        m = sigmoid(a * F.col("x") + b)
        w = m * (1 - m)
        r = d.agg(F.sum((F.col("y") - m) * F.col("x")), F.sum(F.col("y") - m), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("x")), F.sum(w)).first()
        det = r[2] * r[4] - r[3] * r[3] if r[0] is not None else 0
        if not det:
            break
        da, db = (r[4] * r[0] - r[3] * r[1]) / det, (r[2] * r[1] - r[3] * r[0]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    d.unpersist()
    return a, b


def decision_curve(df: DataFrame, y: str, p: str, thresholds: Sequence[float], clip: bool = False) -> DataFrame:
    """Net benefit of acting on p >= threshold, on everyone, on no one.

    One pass: every row goes to the highest threshold that it reaches, and counts
    are added up from above, so no pair of row and threshold is formed.
    """
    ts = sorted(thresholds)
    k = F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: t <= F.col(p)))
    reached = df.groupBy(k.alias("_k")).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("double")).alias("_pos"))
    grid = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "_g int, threshold double")
    # as many rows as thresholds on both sides
    j = grid.join(F.broadcast(reached), F.lit(True))
    g = j.groupBy("threshold").agg(F.sum(F.when(F.col("_k") >= F.col("_g"), F.col("_pos")).otherwise(0.0)).alias("tp"), F.sum(F.when(F.col("_k") >= F.col("_g"), F.col("_n") - F.col("_pos")).otherwise(0.0)).alias("fp"), F.sum("_n").cast("double").alias("n"), F.sum("_pos").alias("pos"))
    odds = F.col("threshold") / (1 - F.col("threshold"))
    net = F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds
    treat = F.col("pos") / F.col("n") - (F.col("n") - F.col("pos")) / F.col("n") * odds
    if clip:
        net, treat = F.greatest(net, F.lit(0.0)), F.greatest(treat, F.lit(0.0))
    return g.select("threshold", net.alias("net_benefit_model"), treat.alias("net_benefit_all"), F.lit(0.0).alias("net_benefit_none"))


def folds(df: DataFrame, id: str, label: str, k: int, seed: int, repeats: int = 1) -> DataFrame:
    """Stratified fold of each row in each repeat: rows of a class dealt round by a seeded hash of their id."""
    d = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    w = Window.partitionBy("repeat", label).orderBy(F.xxhash64(F.lit(seed), "repeat", id), id)
    return d.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def regression_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """R2, MAE and RMSE; R2 is null where y is constant."""
    e = F.col(y) - F.col(p)
    g = df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_v"), F.count("*").alias("n"))
    return g.select(*keys, F.when(F.col("_v") > 0, 1 - F.col("_mse") / F.col("_v")).alias("r2"), "mae", F.sqrt("_mse").alias("rmse"), "n")


def normalise(df: DataFrame, keys: Sequence[str], p: str, out: str) -> DataFrame:
    """Class probabilities clipped to [0, 1] and scaled to sum 1 by key; a sum of 0 divides by 1."""
    c = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    total = F.sum(c).over(Window.partitionBy(*keys))
    return df.withColumn(out, c / F.when(total > 0, total).otherwise(1.0))


def class_counts(df: DataFrame, label: str, wanted: int = 5) -> DataFrame:
    """label, n, smallest (rows of the smallest class) and the number of folds that these allow, ``wanted`` at most; missing labels don't count."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    # one row for each class, so the window is small
    smallest = F.min("n").over(Window.partitionBy(F.lit(1)))
    return n.withColumn("smallest", smallest).withColumn("folds", F.least(F.col("smallest"), F.lit(wanted)))


def with_risk(clinical: DataFrame, scores: DataFrame, key: str, risk: str = "risk", healthy: str = "p_NC") -> DataFrame:
    """All clinical rows with their out-of-fold scores; where the scores have no risk it is 1 minus the healthy probability."""
    given = F.col(risk) if risk in scores.columns else F.lit(None).cast("double")
    return clinical.join(scores.withColumn(risk, F.coalesce(given, 1 - F.col(healthy))), key, "left")


def softmax(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Shares exp(v) / sum(exp(v)) over the rows of a key, from differences to its largest value."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def calibration_table(df: DataFrame, y: str, p: str, how: str = "uniform", bins: int = 10, least: int = 1) -> DataFrame:
    """low, high, n, mean_p, share of each bin of the score.

    Bins are [low, high), the last one closed: equal widths over 0 to 1 (uniform),
    equal shares of rows (quantile), or equal widths merged from the left until each
    has ``least`` rows (adaptive, by ``merge_bins`` over the counts of bins). Otherwise
    bins of fewer than ``least`` rows are left out.
    """
    d = df.where(F.col(y).isNotNull() & F.col(p).between(0.0, 1.0))
    edges = [i / bins for i in range(bins + 1)]
    if how == "quantile":
        inner = d.agg(F.percentile(p, F.array(*(F.lit(e) for e in edges))).alias("q")).first().q
        edges = sorted(set(inner)) if inner else edges
        edges = edges if len(edges) > 1 else [edges[0], edges[0]]

    def placed(edges: Sequence[float]) -> DataFrame:
        at = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges[1:-1])), lambda e: e <= F.col(p))) if len(edges) > 2 else F.lit(0)
        return d.withColumn("_bin", at)

    if how == "adaptive":
        counts = {r["_bin"]: r["count"] for r in placed(edges).groupBy("_bin").count().collect()}  # a row a bin
        edges = merge_bins(edges, [counts.get(i, 0) for i in range(bins)], least)
    ends = [F.element_at(F.array(*(F.lit(float(e)) for e in edges)), F.col("_bin") + i) for i in (1, 2)]
    g = placed(edges).groupBy("_bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"))
    return g.where(F.lit(how == "adaptive") | (F.col("n") >= least)).select(ends[0].alias("low"), ends[1].alias("high"), "n", "mean_p", "share")


def interval_table(metrics: DataFrame, name: str, value: str, low: str, high: str, names: Sequence[str]) -> DataFrame:
    """place, name, value, low, high and their text, ordered as the list of names; metrics that aren't in it come after, those without a value are left out."""
    from neurotab.functions.text import place_in

    text = F.format_string("%.3f (%.3f, %.3f)", F.col(value), F.col(low), F.col(high))
    w = Window.partitionBy(F.lit(0)).orderBy(place_in(F.col(name), names), name)  # a row a metric
    return metrics.where(F.col(value).isNotNull()).select(F.row_number().over(w).alias("place"), name, value, low, high, F.when(F.col(low).isNotNull() & F.col(high).isNotNull(), text).otherwise(F.format_string("%.3f", F.col(value))).alias("text"))
