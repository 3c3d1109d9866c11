"""Tests of lookups, splits, surfaces, cluster quality and the fitted models against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurotab.operators import evaluate, lookup, models, neighbours, ranges, signal


def test_labels_fall_back_and_later_tables_win(spark):
    df = spark.createDataFrame([("NC1",), ("HS2 ",), (None,)], "SampleID string")
    one = spark.createDataFrame([("NC1", "a"), ("HS2", " b "), ("", "x"), (None, "y")], "sample_id string, label string")
    two = spark.createDataFrame([("NC1", "c"), ("HS2", None)], "ID string, Group string")
    other = spark.createDataFrame([("NC1",)], "ID string")
    got = {r.SampleID: r["group"] for r in lookup.with_labels(df, "SampleID", [one, two, other], F.lit("UNK")).collect()}
    assert got == {"NC1": "c", "HS2 ": "b", None: "UNK"}
    assert lookup.label_map([other]) is None
    assert {r.g for r in lookup.with_labels(df, "SampleID", [other], F.lit("P"), "g").collect()} == {"P"}


def test_side_file_prefers_its_own_stem(spark):
    df = spark.createDataFrame([("d", "v2"), ("d", "v9"), ("e", "v1")], "folder string, stem string")
    files = spark.createDataFrame([("d", "v1", "v1_roi"), ("d", "v2", "v2_roi")], "folder string, stem string, name string")
    got = {(r.folder, r.stem): r.roi for r in lookup.side_file(df, files, "folder", "stem", "name", "roi").collect()}
    assert got == {("d", "v2"): "v2_roi", ("d", "v9"): "v1_roi", ("e", "v1"): None}


def test_splits(spark):
    df = spark.createDataFrame([("A1", "x"), ("B3", "y"), ("B4", None), ("C", "x")], "id string, centre string")
    assert [r.split for r in lookup.leave_out(df, "centre", "x").orderBy("id").collect()] == ["val", "train", "train", "val"]
    assert [r.split for r in lookup.split_by_suffix(df, "id", {1: "train", 3: "test", 4: "ext"}).orderBy("id").collect()] == ["train", "test", "ext", None]
    ids = spark.range(5000)
    a = lookup.split_random(ids, "id", 0.2, 7).where("split = 'val'")
    b = lookup.split_random(ids.where("id < 2500"), "id", 0.2, 7).where("split = 'val'")
    assert 900 < a.count() < 1100 and a.where("id < 2500").exceptAll(b).count() == 0


def test_kernel_surface(spark):
    rows = [(0.0, 0.0, 1.0), (4.0, 0.0, 3.0), (None, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double").repartition(3)
    got = {(r.x, r.y): r.z for r in ranges.kernel_surface(df, "x", "y", "z", [(0.0, 0.0), (2.0, 5.0), (1e6, 0.0)]).collect()}
    w = math.exp(-0.5)
    assert got[(0.0, 0.0)] == pytest.approx((1 + 3 * w) / (1 + w)) and got[(2.0, 5.0)] == pytest.approx(2.0) and got[(1e6, 0.0)] is None
    assert ranges.surface_nodes(df.where("false"), "x", "y", 3) == [] and len(ranges.surface_nodes(df, "x", "y", 3)) == 9


def test_interval_violations_across_stretches(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 200_000, 4000))
    df = spark.createDataFrame([("a", int(x)) for x in t] + [("b", 5)], "k string, i long")
    got = {r.k: r for r in signal.interval_violations(df, ["k"], "i", 20000.0).collect()}
    assert got["a"].n_spikes == 4000 and got["a"].isi_violation == pytest.approx((np.diff(t) / 20000 < 1.5e-3).mean() * 100)
    assert got["b"].isi_violation == 0.0
    assert signal.interval_violations(df.where("k = 'b'"), ["k"], "i", 20000.0, few=None).first().isi_violation is None


def test_signal_to_noise(spark):
    w = np.random.default_rng(1).normal(size=(40, 12)) + np.sin(np.arange(12)) * 5
    waves = spark.createDataFrame([(0, r.tolist()) for r in w] + [(1, [2.0] * 12)], "c int, waveform array<double>")
    got = {r.c: r for r in signal.signal_to_noise(waves, ["c"]).collect()}
    m = w.mean(0)
    noise = np.median((w - m).std(0))
    want = [(w.max(1) - w.min(1)).mean() / (2 * w[:, :2].std()), (m.max() - m.min()) / (2 * noise), (m.max() - m.min()) / noise, abs(m).max() / w[:, :5].std()]
    assert list(got[0])[1:] == pytest.approx(want, rel=1e-9)
    assert got[1].snr_baseline == math.inf and got[1].snr_single is None and got[1].snr_peak is None
    spikes = spark.createDataFrame([(0, 1.0), (2, 1.0)], "c int, i double")
    assert math.isnan({r.c: r for r in signal.cluster_quality(spikes, waves, ["c"], "i", 100.0).collect()}[2].snr_peak)


def _line(spark, n=120):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(2, n))
    return spark.createDataFrame([(i, float(a), float(b), float(2 * a - b), float(a + 0.3 * b > 0)) for i, (a, b) in enumerate(zip(x, z))], "id long, x double, z double, y double, cls double")


def test_grid_search_and_forests_learn(spark):
    df = _line(spark)
    found = models.grid_search(evaluate.folds(df.withColumnRenamed("cls", "label"), "id", "label", 3, 1), ["x", "z"], "label", [0.01, 10.0], [0.5], "fold")
    assert len(found.avgMetrics) == 2 and found.avgMetrics[1] < found.avgMetrics[0]
    fit = models.forest(df, ["x", "z"], "y", trees=30).transform(df)
    assert evaluate.regression_metrics(fit, "y", "prediction").first().r2 > 0.85
    kind = models.forest(df, ["x", "z"], "cls", "classification", trees=20).transform(df)
    assert kind.where("prediction = cls").count() > 110


def test_chained_impute_restores_a_linear_column(spark):
    df = _line(spark).withColumn("y", F.when(F.col("id") % 10 != 0, F.col("y")))
    got = models.chained_impute(df, ["x", "z", "y"]).where("id % 10 = 0").selectExpr("max(abs(y - (2 * x - z))) e").first().e
    assert got < 1e-6


def test_oversampling_fills_small_classes_between_neighbours(spark):
    rows = [(i, "big", float(i), 0.0, 0.0) for i in range(20)] + [(100 + i, "small", float(i), 1.0, 2.0) for i in range(6)] + [(200, "one", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, z double")
    got = neighbours.oversample(df, ["x", "y", "z"], "id", "g", k=5)
    new = got.where("synthetic")
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"big": 20, "small": 20, "one": 1}
    assert new.where("g = 'small' and y = 1 and z = 2 and x between 0 and 5").count() == 14


def test_modules_find_two_blocks(spark):
    edges = [(a, b, 0.9) for s in (range(0, 4), range(10, 14)) for a in s for b in s if a < b] + [(0, 10, -0.01)]
    m = {r.feature: r.module for r in models.modules(spark.createDataFrame(edges, "src long, dst long, rho double"), 2).collect()}
    assert len({m[i] for i in range(4)}) == 1 and len({m[i] for i in range(10, 14)}) == 1 and m[0] != m[10]
    members = spark.createDataFrame([("a", 0), ("b", 0)], "f string, module int")
    long = spark.createDataFrame([(s, f, float(v)) for s, a, b in ((1, 0, 4), (2, 2, 0)) for f, v in (("a", a), ("b", b))], "s int, f string, v double")
    assert [r.score for r in models.module_scores(long, members, "s", "f", "v").orderBy("s").collect()] == pytest.approx([0.0, 0.0])


def test_isotonic_calibration_is_monotone(spark):
    df = spark.createDataFrame([(0.0, 0.1), (1.0, 0.2), (0.0, 0.3), (1.0, 0.9)], "y double, p double")
    got = [r.calibrated for r in models.calibrate(df, "y", "p", "isotonic").orderBy("p").collect()]
    assert got == pytest.approx([0.0, 0.5, 0.5, 1.0])
