"""Model fitting on Spark ML and on Spark sums: PCA, clusters, linear models, covariance networks, augmentation.

What reaches the driver is sized by features or clusters, never by rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population covariance of complete rows, in one pass of p * (p + 1) / 2 + p sums."""
    ok = df.where(F.concat(*(F.col(c).isNotNull().cast("string") for c in names)).contains("false") == F.lit(False)) if names else df
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    r = ok.agg(F.count("*"), *(F.avg(c) for c in names), *(F.covar_pop(names[i], names[j]) for i, j in pairs)).first()
    cov = np.zeros((len(names), len(names)))
    for (i, j), v in zip(pairs, r[1 + len(names) :]):
        cov[i, j] = cov[j, i] = v or 0.0
    return r[0], np.array([m or 0.0 for m in r[1 : 1 + len(names)]]), cov


def linear(names: Sequence[str], weights: Sequence[float], centre: Sequence[float] | None = None) -> Column:
    """Sum of weight * (column - centre) as one expression."""
    out = F.lit(0.0)
    for c, w, m in zip(names, weights, centre if centre is not None else [0.0] * len(names)):
        out = out + float(w) * (F.col(c) - float(m))
    return out


def pca(df: DataFrame, names: Sequence[str], k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores pc1 .. pck as columns, loadings (p, k), and variances of all components. The sign makes each largest loading positive."""
    _, mean, cov = moments(df, names)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order[:k]]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return df.withColumns({f"pc{i + 1}": linear(names, vectors[:, i], mean) for i in range(vectors.shape[1])}), vectors, values


def outliers(df: DataFrame, names: Sequence[str], k: int, level: float = 0.99) -> DataFrame:
    """Hotelling T2 of k components, squared residual Q, and flags over their empirical quantiles."""
    _, mean, cov = moments(df, names)
    d, _, values = pca(df, names, k)
    t2 = sum((F.col(f"pc{i + 1}") * F.col(f"pc{i + 1}") / float(max(values[i], 1e-300)) for i in range(k)), F.lit(0.0))
    total = sum(((F.col(c) - float(m)) * (F.col(c) - float(m)) for c, m in zip(names, mean)), F.lit(0.0))
    kept = sum((F.col(f"pc{i + 1}") * F.col(f"pc{i + 1}") for i in range(k)), F.lit(0.0))
    d = d.withColumn("t2", t2).withColumn("q", F.greatest(total - kept, F.lit(0.0)))
    limits = d.agg(F.percentile("t2", F.lit(level)), F.percentile("q", F.lit(level))).first()
    return d.withColumn("t2_out", F.col("t2") > limits[0]).withColumn("q_out", F.col("q") > limits[1])


def kmeans(df: DataFrame, names: Sequence[str], k: int, seed: int = 0, out: str = "cluster") -> DataFrame:
    """KMeans labels renumbered by size, the largest 0; one cluster if there are fewer than 5 * k rows."""
    from pyspark.ml.clustering import KMeans

    if df.limit(5 * k).count() < 5 * k:
        return df.withColumn(out, F.lit(0))
    v = VectorAssembler(inputCols=list(names), outputCol="_v", handleInvalid="skip").transform(df)
    d = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_k").fit(v).transform(v)
    sizes = d.groupBy("_k").agg(F.count("*").alias("_n")).select("_k", (F.row_number().over(Window.orderBy(F.desc("_n"), "_k")) - 1).alias(out))
    return d.join(F.broadcast(sizes), "_k").drop("_k", "_v")


def mixture(df: DataFrame, names: Sequence[str], k: int, seed: int = 0, out: str = "state") -> DataFrame:
    from pyspark.ml.clustering import GaussianMixture

    v = VectorAssembler(inputCols=list(names), outputCol="_v", handleInvalid="skip").transform(df)
    return GaussianMixture(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(v).transform(v).drop("_v", "probability")


def prepared(names: Sequence[str]) -> list:
    """Median imputing, assembling and standardising, as pipeline stages that end in ``features``."""
    filled = [f"{c}_filled" for c in names]
    return [
        Imputer(strategy="median", inputCols=list(names), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True),
    ]


def elastic_net(df: DataFrame, names: Sequence[str], label: str, c: float = 1.0, l1_ratio: float = 0.5, iterations: int = 100):
    """Fitted pipeline of multinomial logistic regression; ``c`` weighs the loss sum, so the penalty is 1 / (c * n)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    n = df.count()
    model = LogisticRegression(labelCol=label, elasticNetParam=l1_ratio, regParam=1.0 / (c * n), standardization=False, maxIter=iterations)
    return Pipeline(stages=[*prepared(names), model]).fit(df)


def out_of_fold(df: DataFrame, names: Sequence[str], label: str, fold: str, k: int, **how) -> DataFrame:
    """df with ``p``, the probability of class 1 from the model of the other folds."""
    from pyspark.ml.functions import vector_to_array

    parts = []
    for i in range(k):
        model = elastic_net(df.where(F.col(fold) != i), names, label, **how)
        scored = model.transform(df.where(F.col(fold) == i))
        parts.append(scored.select(*df.columns, vector_to_array("probability")[1].alias("p")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def select_features(df: DataFrame, names: Sequence[str], label: str, least: int, c: float = 0.1) -> list[str]:
    """Features with a non-zero L1 coefficient; filled up to ``least`` by largest variance."""
    model = elastic_net(df, names, label, c=c, l1_ratio=1.0).stages[-1]
    weight = np.abs(model.coefficientMatrix.toArray()).max(0)
    chosen = [n for n, w in sorted(zip(names, weight), key=lambda x: -x[1]) if w > 0]
    if len(chosen) < least:
        _, _, cov = moments(df, names)
        chosen += [n for n, _ in sorted(zip(names, np.diag(cov)), key=lambda x: -x[1]) if n not in chosen][: least - len(chosen)]
    return chosen


def ols_hc3(df: DataFrame, y: str, names: Sequence[str]) -> list[dict]:
    """Coefficients with HC3 standard errors: Gram sums, a p * p inverse on the driver, a second pass for leverage and meat."""
    cols = ["_one", *names]
    d = df.where(" and ".join(f"`{c}` is not null" for c in [y, *names])).withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]

    def symmetric(values):
        m = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(pairs, values):
            m[i, j] = m[j, i] = v
        return m

    r = d.agg(*(F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs), *(F.sum(F.col(c) * F.col(y)) for c in cols), F.count("*")).first()
    inverse = np.linalg.inv(symmetric(r[: len(pairs)]))
    beta = inverse @ np.array(r[len(pairs) : -1])
    leverage = sum((float(inverse[i, j]) * F.col(a) * F.col(b) for i, a in enumerate(cols) for j, b in enumerate(cols)), F.lit(0.0))
    e = (F.col(y) - linear(cols, beta)) / (1 - leverage)
    meat = symmetric(d.agg(*(F.sum(e * e * F.col(cols[i]) * F.col(cols[j])) for i, j in pairs)).first())
    se = np.sqrt(np.diag(inverse @ meat @ inverse))
    return [{"term": "intercept" if c == "_one" else c, "coef": float(b), "se": float(s), "t": float(b / s) if s else None, "df": float(r[-1] - len(cols))} for c, b, s in zip(cols, beta, se)]


def partial_correlations(df: DataFrame, names: Sequence[str]) -> list[tuple[str, str, float]]:
    """Partial correlations from the inverse of the Ledoit-Wolf shrunk covariance, by strength."""
    n, mean, cov = moments(df, names)
    p, mu = len(names), float(np.trace(cov)) / len(names)
    # sum over rows of ||x x' - S||^2 = sum ||x||^4 - n ||S||^2
    square = sum(((F.col(c) - float(m)) * (F.col(c) - float(m)) for c, m in zip(names, mean)), F.lit(0.0))
    fourth = df.agg(F.avg(square * square)).first()[0]
    d2 = float(((cov - mu * np.eye(p)) ** 2).sum())
    b2 = min((fourth - float((cov**2).sum())) / n, d2)
    a = b2 / d2 if d2 else 0.0
    precision = np.linalg.inv(a * mu * np.eye(p) + (1 - a) * cov)
    s = np.sqrt(np.diag(precision))
    out = [(names[i], names[j], float(-precision[i, j] / (s[i] * s[j]))) for i in range(p) for j in range(i + 1, p)]
    return sorted(out, key=lambda e: -abs(e[2]))


def jitter(df: DataFrame, keys: Sequence[str], names: Sequence[str], copies: int, seed: int, scale: float = 0.1) -> DataFrame:
    """Rows (copy 0) and ``copies`` noisy ones of each, with noise of scale * sample deviation by key."""
    w = Window.partitionBy(*keys)
    d = df.withColumns({f"_s_{c}": F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0)) for c in names})
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    noisy = {c: F.col(c) + F.when(F.col("copy") > 0, F.randn(seed + i) * scale * F.col(f"_s_{c}")).otherwise(0.0) for i, c in enumerate(names)}
    return d.withColumns(noisy).drop(*(f"_s_{c}" for c in names))


def contributions(df: DataFrame, names: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    """feature and mean |coefficient * z|, strongest first; z by population deviation."""
    _, mean, cov = moments(df, names)
    sd = np.sqrt(np.diag(cov)) + 1e-12
    r = df.agg(*(F.avg(F.abs(float(b / s) * (F.col(c) - float(m)))).alias(c) for c, b, m, s in zip(names, coefficients, mean, sd)))
    return r.unpivot([], list(names), "feature", "mean_abs").orderBy(F.desc("mean_abs"))


def grid_search(df: DataFrame, names: Sequence[str], label: str, cs: Sequence[float], ratios: Sequence[float], fold: str, parallelism: int = 4):
    """Cross-validated elastic net over penalties and L1 ratios, on a given fold column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    n = df.count()
    model = LogisticRegression(labelCol=label, standardization=False)
    grid = ParamGridBuilder().addGrid(model.regParam, [1.0 / (c * n) for c in cs]).addGrid(model.elasticNetParam, list(ratios)).build()
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="logLoss")
    folds = df.agg(F.max(fold)).first()[0] + 1
    return CrossValidator(estimator=Pipeline(stages=[*prepared(names), model]), estimatorParamMaps=grid, evaluator=judge, foldCol=fold, numFolds=folds, parallelism=parallelism).fit(df)


def forest(df: DataFrame, names: Sequence[str], label: str, kind: str = "regression", trees: int = 100, depth: int = 8, seed: int = 0):
    """Fitted pipeline of a random forest after median imputing; classes are weighted by their inverse share."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor

    if kind == "regression":
        model = RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    else:
        n = F.count("*").over(Window.partitionBy(label))
        df = df.withColumn("_weight", df.count() / n)
        model = RandomForestClassifier(labelCol=label, weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*prepared(names), model]).fit(df)


def chained_impute(df: DataFrame, names: Sequence[str], rounds: int = 2) -> DataFrame:
    """Missing values by linear regression on the other columns, column after column, from medians on."""
    medians = df.agg(*(F.percentile(c, F.lit(0.5)).alias(c) for c in names)).first()
    d = df.withColumns({f"_m_{c}": F.col(c).isNull() for c in names}).withColumns({c: F.coalesce(c, F.lit(medians[c])) for c in names})
    for _ in range(rounds):
        for c in names:
            others = [o for o in names if o != c]
            if d.where(F.col(f"_m_{c}")).limit(1).count():
                fit = {t["term"]: t["coef"] for t in ols_hc3(d.where(~F.col(f"_m_{c}")), c, others)}
                d = d.withColumn(c, F.when(F.col(f"_m_{c}"), F.lit(fit["intercept"]) + linear(others, [fit[o] for o in others])).otherwise(F.col(c)))
    return d.drop(*(f"_m_{c}" for c in names))


def calibrate(df: DataFrame, y: str, p: str, method: str = "platt", out: str = "calibrated") -> DataFrame:
    """Scores mapped by a logistic curve on their logit, or by isotonic regression."""
    from neurotab.operators.evaluate import calibration_line, logit, sigmoid

    if method == "platt":
        a, b = calibration_line(df, y, p)
        return df.withColumn(out, sigmoid(a * logit(F.col(p)) + b))
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=p, labelCol=y, predictionCol=out).fit(df).transform(df)


def quadratic(df: DataFrame, x: str, y: str) -> dict:
    """Least-squares a x^2 + b x + c from power sums, and the vertex -b / 2a."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(*(F.sum(F.pow(F.col(x), F.lit(float(i)))) for i in range(5)), *(F.sum(F.pow(F.col(x), F.lit(float(i))) * F.col(y)) for i in range(3))).first()
    m = np.array([[s[i + j] for j in (2, 1, 0)] for i in (2, 1, 0)], float)
    a, b, c = np.linalg.solve(m, np.array([s[5 + i] for i in (2, 1, 0)], float))
    return {"a": a, "b": b, "c": c, "vertex": -b / (2 * a) if a else None}


def best_by_anova(df: DataFrame, names: Sequence[str], label: str, k: int) -> list[str]:
    """The k features of largest ANOVA F."""
    from pyspark.ml.feature import UnivariateFeatureSelector

    v = VectorAssembler(inputCols=list(names), outputCol="_v", handleInvalid="skip").transform(df)
    s = UnivariateFeatureSelector(featuresCol="_v", labelCol=label, selectionMode="numTopFeatures", outputCol="_s").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return [names[i] for i in s.fit(v).selectedFeatures]


def modules(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """feature and module of a correlation graph (src, dst, rho) by power iteration on |rho|."""
    from pyspark.ml.clustering import PowerIterationClustering

    w = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.abs("rho").alias("weight")).where("weight > 0")
    return PowerIterationClustering(k=k, weightCol="weight").assignClusters(w).select(F.col("id").alias("feature"), F.col("cluster").alias("module"))


def module_scores(df: DataFrame, members: DataFrame, sample: str, feature: str, value: str) -> DataFrame:
    """Mean z (sample deviation) of a module's features in each sample."""
    w = Window.partitionBy(feature)
    z = (F.col(value) - F.avg(value).over(w)) / F.when(F.stddev_samp(value).over(w) > 0, F.stddev_samp(value).over(w))
    return df.withColumn("_z", z).join(members, feature).groupBy(sample, "module").agg(F.avg("_z").alias("score"))


def influence(df: DataFrame, id: str, y: str, p: str) -> DataFrame:
    """Change of the AUC when each row is left out, from rank sums: no refit and no pair of rows."""
    from neurotab.operators.evaluate import score_counts
    from neurotab.operators.order import before

    neg = F.col("n") - F.col("pos")
    c = before(score_counts(df, y, p), [], ["p"], {"_neg": neg, "_pos": F.col("pos")})
    c = c.select(F.col("p").alias("_p"), "pos", (F.col("_neg") + neg / 2.0).alias("nb"), (F.col("_pos") + F.col("pos") / 2.0).alias("pb"), F.col("all__pos").alias("n_p"), F.col("all__neg").alias("n_n"))
    whole = c.agg(F.sum(F.col("pos") * F.col("nb")).alias("u_all"))
    j = df.join(c.drop("pos"), F.col(p) == F.col("_p")).join(F.broadcast(whole), F.lit(True))  # one row
    less = F.when(F.col(y) == 1, F.col("nb")).otherwise(F.col("n_p") - F.col("pb"))
    pairs = F.when(F.col(y) == 1, (F.col("n_p") - 1) * F.col("n_n")).otherwise(F.col("n_p") * (F.col("n_n") - 1))
    return j.select(id, F.when(pairs > 0, (F.col("u_all") - less) / pairs - F.col("u_all") / (F.col("n_p") * F.col("n_n"))).alias("change"))


def joint_scaled(parts: dict[str, DataFrame], names: Sequence[str], name: str = "segment") -> DataFrame:
    """All segments as one table with z-scores by the mean and population deviation of all their rows together; a constant column is 0. What is fitted on it (PCA, states) then shares one scale."""
    out = None
    for part, df in parts.items():
        named = df.withColumn(name, F.lit(part))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    s = out.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names)).first()
    return out.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / s[f"s_{c}"] if s[f"s_{c}"] else F.when(F.col(c).isNotNull(), 0.0) for c in names})
