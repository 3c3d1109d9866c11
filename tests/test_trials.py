"""Exact tests, resampling, ordered sums, scans, neighbours and prognosis against plain versions."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurotab.operators import evaluate, exact, neighbours, order, prognosis, ranges, resample, scan, sequence, states, stats


def _ranks(v):
    s = sorted(v)
    return [sum(i + 1 for i, x in enumerate(s) if x == a) / s.count(a) for a in v]


def test_signed_rank_equals_enumeration(spark):
    r = random.Random(3)
    rows, want = [], {}
    for k in range(1, 13):
        d = [r.gauss(0.4, 1) for _ in range(k)]
        rows += [(k, 0.0, x) for x in d] + [(k, 1.0, 1.0), (k, None, 1.0)]
        rank = _ranks([abs(x) for x in d])
        w = min(sum(a for a, x in zip(rank, d) if x > 0), sum(a for a, x in zip(rank, d) if x < 0))
        low = sum(sum(c) <= w for n in range(k + 1) for c in itertools.combinations(range(1, k + 1), n))
        want[k] = min(1.0, 2 * low / 2**k)
    rows += [(99, 2.0, 2.0)] * 3 + [(98, 0.0, 1.0)] * 4
    got = {x.k: x for x in exact.wilcoxon(spark.createDataFrame(rows, "k int, a double, b double"), ["k"], "a", "b").collect()}
    assert {k: got[k].p for k in want} == pytest.approx(want)
    assert got[99].p == 1.0 and got[99].n == 0 and not got[98].exact and 0 < got[98].p < 0.1
    assert exact.wilcoxon(spark.createDataFrame([], "k int, a double, b double"), ["k"], "a", "b").count() == 0


def test_rank_sum_equals_enumeration(spark):
    r = random.Random(4)
    rows, want = [], {}
    for k, (m, n) in enumerate([(1, 1), (2, 5), (4, 4), (3, 9), (6, 6)]):
        v = [r.random() for _ in range(m + n)]
        rows += [(k, i < m, x) for i, x in enumerate(v)]
        rank = _ranks(v)
        u = sum(rank[:m]) - m * (m + 1) / 2
        us = [sum(c) - m * (m + 1) / 2 for c in itertools.combinations(range(1, m + n + 1), m)]
        want[k] = min(1.0, 2 * sum(x <= min(u, m * n - u) for x in us) / len(us))
    rows += [(50, True, 1.0), (51, True, 1.0), (51, False, 1.0)]
    got = {x.k: x for x in exact.mann_whitney(spark.createDataFrame(rows, "k int, g boolean, v double"), ["k"], F.col("g"), "v").collect()}
    assert {k: got[k].p for k in want} == pytest.approx(want)
    assert got[50].p is None and got[51].p == 1.0


def test_kolmogorov_distribution():
    assert exact.kolmogorov(0.7, 1) == pytest.approx(2 * (1 - 0.7))  # one value: P(D < d) = 2d - 1
    assert exact.kolmogorov(0.4, 2) == pytest.approx(1 - 2 * (2 * 0.4 - 0.5) ** 2)  # two values, 1/4 <= d <= 1/2
    assert exact.kolmogorov(0.274, 10) == pytest.approx(1 - 0.6284796154565043, abs=1e-9)  # the published example
    r, n = np.random.default_rng(1), 30
    u = np.sort(r.random((40_000, n)), 1)
    d = np.maximum(np.arange(1, n + 1) / n - u, u - np.arange(n) / n).max(1)
    for at in (0.1, 0.17, 0.25, 0.35):
        assert exact.kolmogorov(at, n) == pytest.approx((d >= at).mean(), abs=0.01)
    assert exact.kolmogorov(0.03, 3999) == pytest.approx(exact.kolmogorov(0.03, 4001), abs=2e-4)


def test_choice_of_test_and_significance(spark):
    r = np.random.default_rng(5)
    rows = [("t", "a", i, float(x), float(x + 1 + e)) for i, (x, e) in enumerate(zip(r.normal(5, 1, 40), r.normal(0, 0.2, 40)))]
    rows += [("w", "a", i, float(i**6), float(i**6) + 1 + i / 10) for i in range(1, 40)] + [("c", "a", i, 3.0, 3.0) for i in range(9)]
    rows += [("s", "a", i, float(-1 + x), float(1 + x)) for i, x in enumerate(r.normal(0, 0.1, 20))] + [("t", "b", 1, 1.0, None)]
    df = spark.createDataFrame(rows, "band string, channel string, i long, x double, y double")
    got = {(g.band, g.channel): g for g in exact.significance(df, ["band", "channel"], "x", "y").collect()}
    assert got["t", "a"].test == "t" and got["t", "a"].p < 1e-6 and got["t", "a"].sig_diff == pytest.approx(1, abs=0.1) and got["t", "a"].effect_d > 0.5
    assert got["w", "a"].test == "wilcoxon" and got["w", "a"].p < 1e-6 and got["w", "a"].effect_d == 0
    assert got["c", "a"].test == "wilcoxon" and got["c", "a"].p == 1.0 and got["c", "a"].sig_diff == 0
    assert got["s", "a"].sig_diff == 0 and got["s", "a"].effect_d == 0  # means of different sign
    assert ("t", "b") not in got
    without = {g.band: g for g in exact.significance(df, ["band"], "x", "y", sign_rule=False).collect()}
    assert without["s"].sig_diff == pytest.approx(2, abs=0.1) and without["s"].effect_d == 0
    m = {x.band: x.a for x in exact.matrix(exact.significance(df, ["band", "channel"], "x", "y"), "band", "channel", ["a"], "sig_diff").collect()}
    assert set(m) == {"t", "w", "c", "s"} and m["c"] == 0
    flat = exact.normality(df.where("band = 'c'"), ["band"], "x").first()
    assert flat.p == 0.0 and flat.distance is None
    assert stats.ks_normal(df.where("band = 'c'"), ["band"], "x").first().distance == 1.0


def test_draws_are_exact_multinomials(spark):
    """Means and deviations over draws are those of the plain bootstrap, whatever the number of ranges."""
    r = np.random.default_rng(7)
    y = r.random(400) < 0.4
    p = np.round(np.clip(r.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    df = spark.createDataFrame(pd.DataFrame({"k": "m", "y": y.astype(int), "p": p})).repartition(5)

    def plain_auc(yy, pp):
        a, b = pp[yy], pp[~yy]
        return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))

    pos, neg = np.flatnonzero(y), np.flatnonzero(~y)
    plain = []
    for _ in range(1500):
        i = np.concatenate([r.choice(pos, len(pos)), r.choice(neg, len(neg))])
        plain.append((plain_auc(y[i], p[i]), np.mean((p[i] - y[i]) ** 2)))
    plain = np.array(plain)
    for parts in (1, 16):
        got = resample.scored_draws(df, ["k"], "y", "p", 1500, 3, ranges=parts).toPandas()
        assert len(got) == 1500
        for c, name in enumerate(("auc", "brier")):
            assert got[name].mean() == pytest.approx(plain[:, c].mean(), abs=4 * plain[:, c].std() / 30)
            assert got[name].std() == pytest.approx(plain[:, c].std(), rel=0.12)
    again = resample.scored_draws(df, ["k"], "y", "p", 1500, 3, ranges=16).toPandas()
    assert np.allclose(np.sort(again.auc), np.sort(got.auc))


def test_metric_intervals_fall_back_to_folds(spark):
    rows = [(m, i, i % 2, (i * 7 % 10) / 10 + (0.2 if i % 2 else 0), i % 3) for m in ("a", "b") for i in range(60)] + [("c", i, 1, 0.5, 0) for i in range(5)]
    df = spark.createDataFrame(rows, "m string, i long, y int, p double, f int")
    got = {(g.m, g.metric): g for g in resample.metric_intervals(df, ["m"], "y", "p", "f", draws=500).collect()}
    assert got["a", "auc"].ci_source == "bootstrap" and got["a", "auc"].ci_lo < got["a", "auc"].value < got["a", "auc"].ci_hi and got["a", "auc"].n == 60
    few = {(g.m, g.metric): g for g in resample.metric_intervals(df, ["m"], "y", "p", "f", draws=399).collect()}
    assert few["a", "auc"].ci_source == "folds" and few["a", "auc"].ci_lo is not None
    assert got["c", "auc"].value is None and got["c", "auc"].ci_source == "none" and got["c", "auc"].ci_lo is None
    assert resample.metric_intervals(df, [], "y", "p", "f", draws=450).count() == 2


def test_difference_intervals(spark):
    r = np.random.default_rng(9)
    rows = [("u", "R", float(x)) for x in r.normal(3, 1, 80)] + [("u", "N", float(x)) for x in r.normal(1, 1, 60)] + [("v", "R", 1.0), ("v", "N", 2.0), ("v", "N", 3.0), ("w", "R", 1.0), ("u", "R", None)]
    got = {g.k: g for g in resample.difference_interval(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "R", "N", "v", draws=2000).collect()}
    assert set(got) == {"u", "v"} and got["v"].ci_lo is None and got["v"].diff == -1.5
    se = math.sqrt(1 / 80 + 1 / 60)
    assert got["u"].n_one == 80 and got["u"].ci_hi - got["u"].ci_lo == pytest.approx(2 * 1.96 * se, rel=0.25) and got["u"].n_draws == 2000
    short = resample.difference_interval(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "R", "N", "v", draws=199).where("k = 'u'").first()
    assert short.ci_lo is None


def test_running_sums_without_a_key(spark):
    r = random.Random(2)
    v = [r.randint(0, 10**6) for _ in range(3000)]
    df = spark.createDataFrame([(i, x, float(x % 11)) for i, x in enumerate(sorted(set(v)))], "i long, x long, w double").repartition(6)
    got = order.before(df, [], ["x"], {"s": F.col("w")}).toPandas().sort_values("x")
    assert got.s.tolist() == [0.0, *np.cumsum(got.w)[:-1]] and (got.all_s == got.w.sum()).all()
    least = order.least_from_here(df, [], ["x"], "w", "m").toPandas().sort_values("x")
    assert least.m.tolist() == np.minimum.accumulate(least.w.to_numpy()[::-1])[::-1].tolist()
    assert order.before(df.limit(0), [], ["x"], {"s": F.col("w")}).count() == 0


def test_auc_and_fdr_without_a_key_equal_those_with_one(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(1, r.randint(0, 1), round(r.random(), 2)) for _ in range(2000)], "k int, y int, p double").repartition(7)
    a, b = evaluate.auc(df, "y", "p").first(), evaluate.auc(df, "y", "p", ["k"]).first()
    assert a.auc == pytest.approx(b.auc) and a.ap == pytest.approx(b.ap) and a.n_pos == b.n_pos
    assert evaluate.curve(df, "y", "p").count() == evaluate.curve(df, "y", "p", ["k"]).count()
    p = [0.01, 0.02, 0.02, 0.9, None, 0.04]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    q = {x.i: x.q for x in stats.benjamini_hochberg(t, "p").collect()}
    assert q[4] is None and [q[i] for i in (0, 1, 2, 5, 3)] == pytest.approx([0.1 / 3, 0.1 / 3, 0.1 / 3, 0.05, 0.9])
    ranks = {x.i: x["rank"] for x in stats.ranked(t, [], "p").collect()}
    assert ranks == {0: 1.0, 1: 2.5, 2: 2.5, 5: 4.0, 3: 5.0}


def test_refractory_over_chunks(spark):
    r = random.Random(11)
    rows = [(k, round(float(t), 3)) for k in (1, 2) for t in np.cumsum([r.expovariate(3) for _ in range(900)])] + [(3, 1.0)] * 40 + [(4, None), (5, 2.0)]
    df = spark.createDataFrame(rows, "k int, t double").repartition(5)
    want = []
    for k in {k for k, _ in rows}:
        last = -math.inf
        for t in sorted(t for j, t in rows if j == k and t is not None):
            if t - last > 1.0:
                want.append((k, t))
                last = t
    for bits in (3, 14):
        assert sorted(tuple(x) for x in scan.refractory(df, ["k"], "t", 1.0, bits).collect()) == sorted(want)
    assert sequence.refractory(df, ["k"], "t", 1.0).count() == len(want)


def test_hidden_states_over_chunks(spark):
    r = np.random.default_rng(12)
    n, state, x = 700, 0, []
    for _ in range(n):
        state = state if r.random() < 0.95 else r.integers(3)
        x.append((state * 3 + r.normal(), -state + r.normal()))
    df = spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(x)] + [(2, i, *map(float, v)) for i, v in enumerate(x[:150])] + [(3, 0, 1.0, None)], "k int, i int, a double, b double").repartition(4)
    model = {"start": np.array([0.5, 0.3, 0.2]), "trans": np.full((3, 3), 0.05) + np.eye(3) * 0.85, "means": np.array([[0.0, 0], [3, -1], [6, -2]]), "covs": np.array([np.eye(2)] * 3)}
    whole = scan.decode(df, ["k"], ["i"], ["a", "b"], model, bits=20).toPandas().sort_values(["k", "i"])
    cut = scan.decode(df, ["k"], ["i"], ["a", "b"], model, bits=4).toPandas().sort_values(["k", "i"])
    assert len(cut) == 850 and cut.state.tolist() == whole.state.tolist() and np.allclose(cut.posterior, whole.posterior)
    # the whole sequence by hand
    logb = scan.log_density(np.array(x), model["means"], model["covs"])
    assert cut[cut.k == 1].state.tolist() == scan.best_path(logb, None, int(_best_end(logb, model)), model["start"], model["trans"]).tolist()
    a, b = (scan.expectations(scan.packed(df.dropna(), ["k"], ["i"], ["a", "b"], bits), ["k"], ["a", "b"], model) for bits in (4, 20))
    assert np.allclose(a, b, rtol=1e-8)
    alpha, ll = model["start"] * np.exp(logb[0]), 0.0
    for t in range(n):
        alpha = alpha if t == 0 else (alpha @ model["trans"]) * np.exp(logb[t])
        ll, alpha = ll + np.log(alpha.sum()), alpha / alpha.sum()
    one = scan.expectations(scan.packed(df.where("k = 1"), ["k"], ["i"], ["a", "b"], 5), ["k"], ["a", "b"], model)
    assert one[-1] == pytest.approx(ll)
    early, late = (states.fit_hmm(df, ["k"], ["i"], ["a", "b"], 3, steps=n) for n in (2, 6))
    assert late["loglik"] > early["loglik"] and np.allclose(late["trans"].sum(1), 1)


def test_states_of_segments_on_one_scale(spark):
    r = np.random.default_rng(3)
    of = lambda shift: spark.createDataFrame([(1, i, float(r.normal() + shift + 500 * (i % 40 >= 20))) for i in range(120)], "k int, i int, a double")
    model, got = states.joint_states({"pre": of(0), "post": of(1)}, ["k"], ["i"], ["a"], 2, steps=4)
    assert abs(model["means"][:, 0]).max() < 1.2 and got.count() == 240
    assert {(x.segment, x.state) for x in got.where("i % 40 >= 20").select("segment", "state").distinct().collect()} == {("pre", 1), ("post", 1)}


def _best_end(logb, model):
    score = np.log(model["start"]) + logb[0]
    for t in range(1, len(logb)):
        score = (score[:, None] + np.log(model["trans"])).max(0) + logb[t]
    return score.argmax()


@pytest.mark.parametrize("split, pivots", [(20_000, 8), (7, 5), (20_000, 90)])
def test_nearest_in_many_columns(spark, split, pivots):
    r = np.random.default_rng(13)
    names = [f"c{i}" for i in range(6)]
    a, b = r.normal(size=(60, 6)), r.normal(size=(150, 6))
    b[100:130] = b[0]  # a crowd of equal points
    left = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)] + [(3, *map(float, a[9])), (70, *[None] * 6)], "id long, " + ", ".join(f"{c} double" for c in names))
    right = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(b)] + [(500, *[math.inf] * 6)], left.schema)
    got = neighbours.nearest(left, right, "id", "id", names, 4, pivots=pivots, split=split).collect()
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    want = {(i, k + 1, int(j)) for i in range(60) for k, j in enumerate(np.lexsort((np.arange(150), d[i]))[:4])}
    twice = {(3, k + 1, int(j)) for k, j in enumerate(np.lexsort((np.arange(150), d[9]))[:4])}
    assert {(g.id, g["rank"], g.id_r) for g in got} == want | twice and len(got) == 61 * 4
    self_ = neighbours.nearest(right, right, "id", "id", names, 2, itself=False, pivots=pivots, split=split).collect()
    assert all(g.id != g.id_r for g in self_) and len(self_) == 300
    assert neighbours.nearest(left, right.limit(0), "id", "id", names, 2).count() == 0


def test_oversampling_in_many_columns_and_its_fallback(spark):
    r = np.random.default_rng(14)
    names = [f"c{i}" for i in range(5)]
    rows = [(i, "big", *map(float, r.normal(size=5))) for i in range(40)] + [(100 + i, "small", *map(float, 9 + r.normal(size=5))) for i in range(7)]
    df = spark.createDataFrame(rows, "id long, g string, " + ", ".join(f"{c} double" for c in names))
    got = neighbours.oversample(df, names, "id", "g").toPandas()
    assert got.groupby("g").size().to_dict() == {"big": 40, "small": 40}
    low, high = (np.array([x[2:] for x in rows if x[1] == "small"]).min(0), np.array([x[2:] for x in rows if x[1] == "small"]).max(0))
    made = got[got.synthetic][names].to_numpy()
    assert (made >= low - 1e-9).all() and (made <= high + 1e-9).all() and len(np.unique(made, axis=0)) == 33
    lone = df.unionByName(df.where("id = 0").withColumn("g", F.lit("one")))
    assert neighbours.oversample(lone, names, "id", "g", noise=300).where("synthetic").groupBy("g").count().count() == 3
    made = neighbours.oversample(lone, names, "id", "g", noise=300).where("synthetic").groupBy("g").count().collect()
    assert all(abs(m["count"] - 100) <= 40 for m in made)
    assert neighbours.oversample(df.limit(0), names, "id", "g").count() == 0


def test_knn_join_with_repeated_keys(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 5.0, 5.0, 5.0)], "id long, x double, y double, z double")
    b = spark.createDataFrame([(i, float(i), float(i), float(i)) for i in range(8)], a.schema)
    got = sorted((r.x, r["rank"], r.id_r) for r in ranges.knn_join(a, b, "id", "id", 3, 0.5).collect())
    assert got == [(0.0, 1, 0), (0.0, 2, 1), (0.0, 3, 2), (5.0, 1, 5), (5.0, 2, 4), (5.0, 3, 6)]


def test_prognosis(spark):
    r = np.random.default_rng(15)
    rows = []
    for i in range(600):
        a, b, kind = r.normal(), r.normal(), ["x", "y", "z"][i % 3] if i % 41 else None
        pre = 10 + a
        post = pre + 3 * (kind == "x") + 2 * (a > 0) + 0.1 * r.normal()
        rows.append((i, pre if i % 9 else None, float(a + 0.01 * b), kind, float(post) if i % 50 else None, pre))
    df = spark.createDataFrame([(i, None if p is None else float(p), a, k, q, float(b)) for i, p, a, k, q, b in rows], "id long, pre double, a double, kind string, post double, base double")
    model, errors, predictions = prognosis.train_validate(df, "id", "delta", "base", "post", ["pre", "a"], ["kind"], trees=(20,), depths=(2, 5), leaves=(1, 3), folds=3, rounds=2)
    e = errors.first()
    assert e.r2 > 0.9 and e.n == predictions.count() and 70 < e.n < 170 and e.rmse >= e.mae and model.best["maxDepth"] == 5
    odd = spark.createDataFrame([(1, None, None, "never seen", None, None)], df.schema)
    assert model.predict(odd).first().prediction is not None
    with pytest.raises(ValueError):
        prognosis.derived(df.drop("post"), "delta", "base", "post")
    filled = prognosis.ChainedImputer(["pre", "a"], 3).fit(df)
    got = filled.transform(df).where("id % 9 = 0").selectExpr("avg(abs(pre - 10 - a)) e").first().e
    assert got < 0.05


def test_neighbours_far_from_the_origin_are_decided_by_differences(spark):
    """Squared distances by products err here by more than the points are apart; blocks are bounded by pairs, not by queries."""
    rng = np.random.default_rng(6)
    p = 1e6 + np.concatenate([rng.normal(0, 1e-3, (150, 4)), np.zeros((20, 4))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id int, a double, b double, c double, d double")
    got = {(r.id, r["rank"]): r.id_r for r in neighbours.nearest(df, df, "id", "id", list("abcd"), 3, pivots=4).collect()}
    for i, v in enumerate(p):
        d = np.sqrt(sum((p[:, k] - v[k]) ** 2 for k in range(4)))
        assert [got[i, r] for r in (1, 2, 3)] == list(np.lexsort((np.arange(len(p)), d))[:3])
    assert neighbours.PAIRS * 8 <= 64 << 20
