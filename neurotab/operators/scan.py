"""Sequential rules over long keys by scans: each chunk of rows becomes a small map, maps are folded by key, then chunks run on their own.

A key's rows are cut to chunks of ``size`` rows by range partitions, so no key is one
task. What a chunk does to the state before it is a map of fixed form: for the
refractory rule the last kept time by entry, for hidden states the k x k products of
the forward recursion and of the most probable path. Folding a key's maps reads one
row a chunk and gives every chunk the state before it (and behind it).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.sources.shared import settled

BITS = 14  # rows of a chunk: 2 ** BITS


def packed(df: DataFrame, keys: Sequence[str], order: Sequence[str], more: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """keys, chunk, rows: the rows (order and more) of each chunk as an array in order; chunks of a key are numbered in order."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    d = df.select(*keys, *order, *more).repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    d = settled(d.withColumn("_at", F.monotonically_increasing_id()))
    rows = F.array_sort(F.collect_list(F.struct("_at", *order, *more)))
    return settled(d.groupBy(*keys, F.shiftright("_at", bits).alias("chunk")).agg(rows.alias("rows")))


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def _each(batches, names: Sequence[str]):
    """(batch, i, columns of the i-th row's array as NumPy arrays)."""
    for b in batches:
        rows = b.column("rows")
        for i in range(b.num_rows):
            values = rows[i].values
            yield b, i, [values.field(c).to_numpy(zero_copy_only=False) for c in names]


def _keyed(b: pa.RecordBatch, i: int, names: Sequence[str]) -> dict:
    return {c: b.column(c).slice(i, 1) for c in names}


def kept_after(t: np.ndarray, dead: float, last: float) -> np.ndarray:
    """Places kept of sorted times: each more than dead after the last one kept, the first after ``last``."""
    follow = np.searchsorted(t - dead, t, "right")
    follow = np.maximum(follow, np.arange(1, len(t) + 1))
    while len(t) and (wrong := np.flatnonzero((follow < len(t)) & ~(t[np.minimum(follow, len(t) - 1)] - t > dead))).size:
        follow[wrong] += 1
    i, out = int(np.argmax(t - last > dead)) if len(t) and t[-1] - last > dead else len(t), []
    while i < len(t):
        out.append(i)
        i = follow[i]
    return np.array(out, np.int64)


def exits(t: np.ndarray, dead: float) -> tuple[np.ndarray, np.ndarray]:
    """The map of a chunk: times that may be kept first, and for each the last one kept then.

    The first kept is the first one more than dead after a time before the chunk, so it lies within dead of the chunk's start or is the next one.
    """
    n = min(int(np.argmax(t - t[0] > dead)) + 1 if t[-1] - t[0] > dead else len(t), len(t))
    last = np.empty(len(t))
    follow = np.searchsorted(t - dead, t, "right")
    for i in range(len(t) - 1, -1, -1):
        j = max(int(follow[i]), i + 1)
        while j < len(t) and not t[j] - t[i] > dead:
            j += 1
        last[i] = t[i] if j >= len(t) else last[j]
    return t[:n], last[:n]


def refractory(df: DataFrame, keys: Sequence[str], time: str, dead: float, bits: int = BITS) -> DataFrame:
    """keys and time of the rows kept greedily: each more than ``dead`` after the last one kept. Missing times are skipped; of equal times one is kept (none where dead is negative would drop any)."""
    d = df.select(*keys, F.col(time).cast("double").alias("_t")).where(F.col("_t").isNotNull() & ~F.isnan("_t"))
    chunks = packed(d, keys, ["_t"], bits=bits)
    kinds = _kinds(chunks, keys)

    def summarise(batches):
        for b in batches:
            maps = [exits(t, dead) for _, _, (t,) in _each([b], ["_t"])]
            lists = {c: pa.array([m[i] for m in maps], pa.list_(pa.float64())) for i, c in enumerate(("entry", "exit"))}
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in [*keys, "chunk"]} | lists)

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, out = pdf.sort_values("chunk"), -np.inf, []
        for entry, exit_ in zip(pdf["entry"], pdf["exit"]):
            out.append(last)
            first = np.flatnonzero(np.asarray(entry) - last > dead)
            last = exit_[first[0]] if len(first) else last
        return pd.DataFrame({**{c: [v] * len(out) for c, v in zip(keys, key)}, "chunk": pdf["chunk"].to_numpy(), "last": out})

    maps = chunks.mapInArrow(summarise, ", ".join(filter(None, [kinds, "chunk long, entry array<double>, exit array<double>"])))
    before = maps.groupBy(*keys).applyInPandas(fold, ", ".join(filter(None, [kinds, "chunk long, last double"])))

    def walk(batches):
        for b in batches:
            before_ = b.column("last").to_pylist()
            kept = [t[kept_after(t, dead, before_[i])] for _, i, (t,) in _each([b], ["_t"])]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(k) for k in kept]))
            yield pa.RecordBatch.from_pydict({c: b.column(c).take(at) for c in keys} | {time: pa.array(np.concatenate([np.zeros(0), *kept]))})

    return chunks.join(before, [*keys, "chunk"]).mapInArrow(walk, ", ".join(filter(None, [kinds, f"{time} double"])))


# hidden states


def log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log density of each row of x under each state's normal distribution."""
    out = np.empty((len(x), len(means)))
    for k, (m, c) in enumerate(zip(means, covs)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, k] = -0.5 * ((z**2).sum(0) + len(m) * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
    return out


def products(logb: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """A chunk's map: product of trans @ diag(b) over its rows, scaled, with the log of its scale, and the max-plus product of their logs."""
    k = len(trans)
    with np.errstate(divide="ignore"):
        logt = np.log(trans)
    forward, scale, best = np.eye(k), 0.0, np.where(np.eye(k) > 0, 0.0, -np.inf)
    top = logb.max(1)
    b = np.exp(logb - top[:, None])
    for t in range(len(logb)):
        forward = forward @ trans * b[t]
        s = max(forward.sum(), 1e-300)
        forward, scale = forward / s, scale + np.log(s) + top[t]
        best = (best[:, :, None] + logt[None]).max(1) + logb[t]
    return forward, scale, best


def begun(logb: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """The same for a key's first chunk, from the start shares: every row of the maps is the one vector."""
    k = len(trans)
    with np.errstate(divide="ignore"):
        first = np.log(start) + logb[0]
    top = logb[0].max()
    a = start * np.exp(logb[0] - top)
    s = max(a.sum(), 1e-300)
    rest, scale, best = products(logb[1:], trans)
    row, plus = a / s @ rest, (first[:, None] + best).max(0)
    return np.tile(row, (k, 1)), scale + np.log(s) + top, np.tile(plus, (k, 1))


def fold_maps(maps: list[tuple[np.ndarray, float, np.ndarray]]) -> list[dict]:
    """Of each chunk of a key in order: before (forward shares), delta (best scores before), after (backward weights), end (state of the best path at its end); and the log-likelihood at the first."""
    k = len(maps[0][0])
    before, delta, total, out = np.full(k, 1 / k), np.zeros(k), 0.0, []
    for n, (f, scale, best) in enumerate(maps):
        out.append({"before": before, "delta": delta, "loglik": 0.0})
        row = f[0] if n == 0 else before @ f
        plus = best[0] if n == 0 else (delta[:, None] + best).max(0)
        s = max(row.sum(), 1e-300)
        before, total = row / s, total + scale + np.log(s)
        delta = plus - plus.max()
        total_best = plus
    out[0]["loglik"] = total
    after, end = np.ones(k), int(total_best.argmax())
    for n in range(len(maps) - 1, -1, -1):
        out[n] |= {"after": after, "end": end}
        f, _, best = maps[n]
        after = f @ after
        after = after / max(after.sum(), 1e-300)
        if n:
            end = int((out[n]["delta"] + best[:, end]).argmax())
    return out


def posteriors(logb: np.ndarray, before: np.ndarray | None, after: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of states of each row of a chunk, and expected transitions into its rows; before is None for a key's first chunk."""
    n, k = logb.shape
    b = np.exp(logb - logb.max(1)[:, None])
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    a = (start if before is None else before @ trans) * b[0]
    alpha[0] = a / max(a.sum(), 1e-300)
    for t in range(1, n):
        a = alpha[t - 1] @ trans * b[t]
        alpha[t] = a / max(a.sum(), 1e-300)
    beta[-1] = after / max(after.sum(), 1e-300)
    for t in range(n - 2, -1, -1):
        a = trans @ (b[t + 1] * beta[t + 1])
        beta[t] = a / max(a.sum(), 1e-300)
    g = alpha * beta
    g /= np.maximum(g.sum(1, keepdims=True), 1e-300)
    into, moves = b * beta, np.zeros((k, k))
    sources = alpha[:-1] if before is None else np.concatenate([before[None], alpha[:-1]])
    targets = into[1:] if before is None else into
    x = sources[:, :, None] * trans[None] * targets[:, None, :]
    if len(x):
        moves = (x / np.maximum(x.sum((1, 2), keepdims=True), 1e-300)).sum(0)
    return g, moves


def best_path(logb: np.ndarray, delta: np.ndarray | None, end: int, start: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """States of a chunk's rows on the key's most probable path, which ends the chunk in ``end``."""
    with np.errstate(divide="ignore"):
        s, t = np.log(start), np.log(trans)
    score = (s if delta is None else (delta[:, None] + t).max(0)) + logb[0]
    back = np.zeros(logb.shape, int)
    for i in range(1, len(logb)):
        step = score[:, None] + t
        back[i] = step.argmax(0)
        score = step.max(0) + logb[i]
    path = np.empty(len(logb), int)
    path[-1] = end
    for i in range(len(logb) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def messages(chunks: DataFrame, keys: Sequence[str], names: Sequence[str], model: dict) -> DataFrame:
    """keys, chunk, first, before, delta, after, end, loglik of each chunk under a model of start, trans, means, covs."""
    kinds = _kinds(chunks, keys)
    firsts = chunks.groupBy(*keys).agg(F.min("chunk").alias("_first"))
    marked = (chunks.join(firsts, list(keys)) if keys else chunks.join(F.broadcast(firsts), F.lit(True))).withColumn("first", F.col("chunk") == F.col("_first"))  # one row without keys

    def summarise(batches):
        for b, i, x in _each(batches, names):
            logb = log_density(np.stack(x, 1).astype(float), model["means"], model["covs"])
            f, scale, best = begun(logb, model["start"], model["trans"]) if b.column("first")[i].as_py() else products(logb, model["trans"])
            yield pa.RecordBatch.from_pydict(_keyed(b, i, [*keys, "chunk", "first"]) | {"f": pa.array([f.ravel()]), "scale": pa.array([scale]), "best": pa.array([best.ravel()])})

    k = len(model["trans"])

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        out = fold_maps([(np.reshape(f, (k, k)), s, np.reshape(b, (k, k))) for f, s, b in zip(pdf["f"], pdf["scale"], pdf["best"])])
        return pd.DataFrame({**{c: [v] * len(out) for c, v in zip(keys, key)}, "chunk": pdf["chunk"].to_numpy(), "first": pdf["first"].to_numpy(), **{c: [o[c] for o in out] for c in ("before", "delta", "after", "end", "loglik")}})

    maps = marked.mapInArrow(summarise, ", ".join(filter(None, [kinds, "chunk long, first boolean, f array<double>, scale double, best array<double>"])))
    return maps.groupBy(*keys).applyInPandas(fold, ", ".join(filter(None, [kinds, "chunk long, first boolean, before array<double>, delta array<double>, after array<double>, end int, loglik double"])))


def expectations(chunks: DataFrame, keys: Sequence[str], names: Sequence[str], model: dict) -> np.ndarray:
    """Sums of the expectation step over all chunks: start shares, transitions, weights, first and second moments, log-likelihood."""
    k, p = model["means"].shape

    def run(batches):
        total = np.zeros(k + k * k + k + k * p + k * p * p + 1)
        for b, i, x in _each(batches, names):
            x = np.stack(x, 1).astype(float)
            first = b.column("first")[i].as_py()
            g, moves = posteriors(log_density(x, model["means"], model["covs"]), None if first else np.array(b.column("before")[i].as_py()), np.array(b.column("after")[i].as_py()), model["start"], model["trans"])
            second = np.einsum("nk,ni,nj->kij", g, x, x)
            total += np.concatenate([g[0] if first else np.zeros(k), moves.ravel(), g.sum(0), (g.T @ x).ravel(), second.ravel(), [b.column("loglik")[i].as_py()]])
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(total)), pa.int32()), "v": pa.array(total)})

    with_ends = chunks.join(messages(chunks, keys, names, model), [*keys, "chunk"])
    got = with_ends.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # sized by states and features
    return np.array([r.v for r in got])


def decode(df: DataFrame, keys: Sequence[str], order: Sequence[str], names: Sequence[str], model: dict, bits: int = BITS) -> DataFrame:
    """keys, order, ``state`` of the most probable path, ``posterior`` of that state; rows with a missing feature are left out."""
    chunks = packed(df.dropna(subset=list(names)), keys, order, names, bits)
    kinds = _kinds(df, [*keys, *order])

    def run(batches):
        for b, i, x in _each(batches, names):
            logb = log_density(np.stack(x, 1).astype(float), model["means"], model["covs"])
            first = b.column("first")[i].as_py()
            of = lambda c: None if first else np.array(b.column(c)[i].as_py())
            path = best_path(logb, of("delta"), b.column("end")[i].as_py(), model["start"], model["trans"])
            g, _ = posteriors(logb, of("before"), np.array(b.column("after")[i].as_py()), model["start"], model["trans"])
            values = b.column("rows")[i].values
            columns = {c: pa.array([b.column(c)[i].as_py()] * len(path), b.schema.field(c).type) for c in keys} | {c: values.field(c) for c in order}
            yield pa.RecordBatch.from_pydict(columns | {"state": pa.array(path), "posterior": pa.array(g[np.arange(len(path)), path])})

    return chunks.join(messages(chunks, keys, names, model), [*keys, "chunk"]).mapInArrow(run, f"{kinds}, state long, posterior double")
