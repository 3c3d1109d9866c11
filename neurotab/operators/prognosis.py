"""Regression of an outcome as one composed job: derived outcome, split, chained imputing, encoding, a grid of forests, held-out errors.

Everything that is learned (medians, chains, scales, categories, forests) is learned
from the training rows alone. The chain of imputing regressions is fitted by sums,
and the held-out rows go through the same steps as columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab.operators.evaluate import regression_metrics

UNIT = 1 << 30


def derived(df: DataFrame, outcome: str, before: str, after: str) -> DataFrame:
    """df with its outcome: the column if it is there, else after - before; an error if neither is."""
    if outcome in df.columns:
        return df.withColumn(outcome, F.col(outcome).cast("double"))
    if before in df.columns and after in df.columns:
        return df.withColumn(outcome, (F.col(after) - F.col(before)).cast("double"))
    raise ValueError(f"{outcome} isn't there and can't be derived from {before} and {after}")


def dealt(id: str, seed: int) -> Column:
    """A number in [0, 1) by a seeded hash of the id: the same share of every stratum lies under a limit, in expectation."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id)), F.lit(UNIT)) / float(UNIT)


def missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


@dataclass
class ChainedImputer:
    """Missing values by linear regressions on the other columns, one after another, for some rounds, from medians on.

    ``fit`` learns medians and, round by round, each column's coefficients from the
    rows where it is known; ``transform`` repeats these steps. A column without any
    value counts as 0.
    """

    names: Sequence[str]
    rounds: int = 5
    medians: list[float] = field(default_factory=list)
    steps: list[tuple[int, np.ndarray]] = field(default_factory=list)

    def _start(self, df: DataFrame) -> DataFrame:
        marks = {f"_m{i}": missing(c) for i, c in enumerate(self.names)}
        return df.withColumns(marks).withColumns({c: F.when(F.col(f"_m{i}"), F.lit(m)).otherwise(F.col(c).cast("double")) for i, (c, m) in enumerate(zip(self.names, self.medians))})

    def _step(self, df: DataFrame, i: int, beta: np.ndarray) -> DataFrame:
        others = [c for j, c in enumerate(self.names) if j != i]
        value = sum((float(b) * F.col(c) for b, c in zip(beta[1:], others)), F.lit(float(beta[0])))
        return df.withColumn(self.names[i], F.when(F.col(f"_m{i}"), value).otherwise(F.col(self.names[i])))

    def fit(self, df: DataFrame) -> ChainedImputer:
        known = [F.when(~missing(c), F.col(c)) for c in self.names]
        r = df.agg(*(F.median(k).alias(f"m{i}") for i, k in enumerate(known)), *((F.count("*") - F.count(k)).alias(f"n{i}") for i, k in enumerate(known))).first()
        self.medians = [float(r[f"m{i}"] or 0.0) for i in range(len(self.names))]
        d, self.steps = self._start(df).cache(), []
        holes = [i for i in range(len(self.names)) if r[f"n{i}"]]
        for _ in range(self.rounds):
            for i in holes:
                others = [F.lit(1.0), *(F.col(c) for j, c in enumerate(self.names) if j != i)]
                on = d.where(~F.col(f"_m{i}"))
                k = len(others)
                s = on.agg(*(F.sum(others[a] * others[b]) for a in range(k) for b in range(k)), *(F.sum(others[a] * F.col(self.names[i])) for a in range(k))).first()
                if s[0] is None:
                    continue
                m = np.array(s[: k * k], float).reshape(k, k)
                beta = np.linalg.lstsq(m + 1e-9 * np.trace(m) / k * np.eye(k), np.array(s[k * k :], float), rcond=None)[0]
                self.steps.append((i, beta))
                d = self._step(d, i, beta)
        d.unpersist()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        d = self._start(df)
        for i, beta in self.steps:
            d = self._step(d, i, beta)
        return d.drop(*(f"_m{i}" for i in range(len(self.names))))


def encoded(numbers: Sequence[str], categories: Sequence[str]) -> list:
    """Stages: z-scores of numbers, one-hot columns of categories, in which a level that training hasn't seen is all zeros."""
    index = [StringIndexer(inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in categories]
    one = OneHotEncoder(inputCols=[f"_i_{c}" for c in categories], outputCols=[f"_o_{c}" for c in categories], handleInvalid="keep", dropLast=True) if categories else None
    scaled = [VectorAssembler(inputCols=list(numbers), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True)]
    parts = ["_z", *(f"_o_{c}" for c in categories)]
    return [*index, *([one] if one else []), *scaled, VectorAssembler(inputCols=parts, outputCol="features")]


def most_frequent(df: DataFrame, categories: Sequence[str]) -> dict[str, str]:
    """The most frequent level of each category, the smallest of equals."""
    out = {}
    for c in categories:
        r = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").first()
        out[c] = r.c if r else ""
    return out


@dataclass
class Prognosis:
    imputer: ChainedImputer
    levels: dict[str, str]
    model: PipelineModel
    best: dict[str, int]
    score: float

    def predict(self, df: DataFrame) -> DataFrame:
        """df with ``prediction``."""
        d = self.imputer.transform(df).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in self.levels.items()})
        return self.model.transform(d).drop("_raw", "_z", "features", *(f"{p}{c}" for c in self.levels for p in ("_i_", "_o_")))


def train(df: DataFrame, id: str, outcome: str, numbers: Sequence[str], categories: Sequence[str], trees: Sequence[int] = (50, 100, 150, 200), depths: Sequence[int] = tuple(range(3, 11)), leaves: Sequence[int] = (1, 2, 3, 4, 5), folds: int = 5, rounds: int = 5, seed: int = 42, parallelism: int = 4) -> Prognosis:
    """The forest of the grid with the best mean R2 over folds of df, fitted anew on all of it.

    ``leaves`` are least rows of a leaf; a forest here has no least size of a split,
    of which twice that is the nearest.
    """
    imputer = ChainedImputer(list(numbers), rounds).fit(df)
    levels = most_frequent(df, categories)
    d = imputer.transform(df).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in levels.items()})
    d = d.where(F.col(outcome).isNotNull()).withColumn("_fold", F.floor(dealt(id, seed + 1) * folds).cast("int")).cache()
    prepared = Pipeline(stages=encoded(numbers, categories)).fit(d)  # scales and levels of the training rows
    rf = RandomForestRegressor(labelCol=outcome, seed=seed)
    grid = ParamGridBuilder().addGrid(rf.numTrees, list(trees)).addGrid(rf.maxDepth, list(depths)).addGrid(rf.minInstancesPerNode, list(leaves)).build()
    judge = RegressionEvaluator(labelCol=outcome, metricName="r2")
    found = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=judge, foldCol="_fold", numFolds=folds, parallelism=parallelism).fit(prepared.transform(d))
    best = max(range(len(grid)), key=lambda i: found.avgMetrics[i])
    d.unpersist()
    chosen = {p.name: int(v) for p, v in grid[best].items()}
    return Prognosis(imputer, levels, PipelineModel(stages=[prepared, found.bestModel]), chosen, float(found.avgMetrics[best]))


def train_validate(df: DataFrame, id: str, outcome: str, before: str, after: str, numbers: Sequence[str], categories: Sequence[str], test: float = 0.2, seed: int = 42, **grid) -> tuple[Prognosis, DataFrame, DataFrame]:
    """The model of the training rows, the errors (r2, mae, rmse, n) on held-out ones, and their predictions (id, y_true, y_pred).

    Rows are held out by a hash of their id, so each stratum gives the same share of
    its rows in expectation. Rows without outcome take no part.
    """
    whole = derived(df, outcome, before, after).where(F.col(outcome).isNotNull())
    held = dealt(id, seed) < test
    model = train(whole.where(~held), id, outcome, numbers, categories, seed=seed, **grid)
    predictions = model.predict(whole.where(held)).select(id, F.col(outcome).alias("y_true"), F.col("prediction").alias("y_pred"))
    return model, regression_metrics(predictions, "y_true", "y_pred"), predictions
