"""Hidden states: Gaussian HMM by EM over Spark, decoding, stationary shares, labels by meaning.

The expectation step runs by chunks of a sequence (``scan``) and emits sums sized by
states and features; Spark adds them up, and the driver holds only the model.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from neurotab.operators import scan


def fit_hmm(df: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[str], k: int, steps: int = 30, seed: int = 0, tol: float = 1e-4) -> dict:
    """start, trans, means, covs, log-likelihood. Starts from quantiles of the first feature; states are ordered by their mean of it."""
    cols, p = list(names), len(names)
    d = df.select(*keys, *order, *cols).dropna(subset=cols)
    chunks = scan.packed(d, keys, order, cols)
    q = d.agg(*(F.percentile(c, F.array(*(F.lit((i + 0.5) / k) for i in range(k)))) for c in cols), *(F.var_pop(c) for c in cols)).first()
    means = np.array([[q[j][i] if j == 0 else np.median(q[j]) for j in range(p)] for i in range(k)])
    floor = 1e-6 * np.diag([v or 1.0 for v in q[p:]]) + 1e-12 * np.eye(p)
    covs = np.array([np.diag([max(v or 1.0, 1e-9) for v in q[p:]])] * k)
    start, trans, before = np.full(k, 1 / k), np.full((k, k), 0.1 / max(k - 1, 1)) + np.eye(k) * (0.9 - 0.1 / max(k - 1, 1)), -np.inf
    for _ in range(steps):
        v = scan.expectations(chunks, keys, cols, {"start": start, "trans": trans, "means": means, "covs": covs})
        cut = np.cumsum([k, k * k, k, k * p, k * p * p])
        s, moves, n, first, second = np.split(v[:-1], cut[:-1])
        n = np.maximum(n, 1e-12)
        start, trans = s / s.sum(), moves.reshape(k, k) / np.maximum(moves.reshape(k, k).sum(1, keepdims=True), 1e-12)
        means = first.reshape(k, p) / n[:, None]
        covs = second.reshape(k, p, p) / n[:, None, None] - np.einsum("ki,kj->kij", means, means) + floor
        if v[-1] - before < tol * abs(v[-1]):
            break
        before = v[-1]
    o = np.argsort(means[:, 0])
    return {"start": start[o], "trans": trans[np.ix_(o, o)], "means": means[o], "covs": covs[o], "loglik": float(v[-1])}


def decode_hmm(df: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[str], model: dict) -> DataFrame:
    """keys, order, ``state`` of the most probable path, ``posterior`` of that state."""
    return scan.decode(df, keys, order, names, model)


def joint_states(parts: dict[str, DataFrame], keys: Sequence[str], order: Sequence[str], names: Sequence[str], k: int, steps: int = 30) -> tuple[dict, DataFrame]:
    """A model fitted to all segments on one scale (``joint_scaled``), each segment of a key a sequence of its own, and their decoded rows with ``segment``."""
    from neurotab.operators.models import joint_scaled

    scaled = joint_scaled({n: d.select(*keys, *order, *names) for n, d in parts.items()}, names)
    model = fit_hmm(scaled, [*keys, "segment"], order, names, k, steps)
    return model, decode_hmm(scaled, [*keys, "segment"], order, names, model)


def stationary(trans: DataFrame, keys: Sequence[str], source: str = "from_state", target: str = "to_state", prob: str = "prob") -> DataFrame:
    """Stationary share of each state of a transition table and its energy -ln(share + 1e-9); one small matrix a key."""
    kinds = ", ".join(f"{c} {trans.schema[c].dataType.simpleString()}" for c in keys)
    state = trans.schema[source].dataType.simpleString()

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf[source], *pdf[target]})
        t = pdf.pivot_table(index=source, columns=target, values=prob, fill_value=0.0).reindex(index=names, columns=names, fill_value=0.0).to_numpy()
        t = t / np.where(t.sum(1, keepdims=True) > 0, t.sum(1, keepdims=True), 1)
        values, vectors = np.linalg.eig(t.T)
        pi = np.clip(np.abs(np.real(vectors[:, np.argmin(abs(values - 1))])), 0, None)
        pi = pi / pi.sum()
        return pd.DataFrame({**{c: [v] * len(names) for c, v in zip(keys, key)}, "state": names, "share": pi, "energy": -np.log(pi + 1e-9)})

    return trans.groupBy(*keys).applyInPandas(kernel, f"{kinds}, state {state}, share double, energy double")


def name_states(df: DataFrame, keys: Sequence[str], state: str, gamma: str, sync: str) -> DataFrame:
    """state and ``label``: the state of the highest mean gamma is S3, of those left the highest mean sync is S2, the rest S1."""
    m = df.groupBy(*keys, state).agg(F.avg(gamma).alias("_g"), F.avg(sync).alias("_s"))
    m = m.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_g"), state)))
    m = m.withColumn("_q", F.row_number().over(Window.partitionBy(*keys, F.col("_r") == 1).orderBy(F.desc("_s"), state)))
    return m.select(*keys, state, F.when(F.col("_r") == 1, "S3").when(F.col("_q") == 1, "S2").otherwise("S1").alias("label"))
