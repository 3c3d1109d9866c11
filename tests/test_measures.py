"""Measures on small tables with odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurotab.functions import columns, pixels, text
from neurotab.operators import cloud, evaluate, models, neighbours, omics, sequence, signal
from neurotab.sources import tables


def test_segments_by_six_bounds(spark):
    df = spark.createDataFrame([(float(t),) for t in (-61, -60, -1, 0, 179, 180, 780)], "t double")
    bounds = {"pre": (-60, 0), "stim": (0, 180), "post": (180, 780)}
    got = sorted((r.t, r.segment) for r in sequence.segments_by_bounds(df, "t", bounds).collect())
    assert got == [(-60.0, "pre"), (-1.0, "pre"), (0.0, "stim"), (179.0, "stim"), (180.0, "post")]
    with pytest.raises(ValueError, match="missing for post"):
        sequence.segments_by_bounds(df, "t", {"pre": (0, 1), "stim": (1, 2)})
    with pytest.raises(ValueError, match="before they start: stim"):
        sequence.segments_by_bounds(df, "t", bounds | {"stim": (5, 1)})


def test_segments_in_order_on_one_axis(spark):
    of = lambda *t: spark.createDataFrame([(1, float(x)) for x in t], "k int, t double")
    got = sequence.in_order({"pre": of(0, 1), "stim": of(0, 2).withColumn("extra", F.lit(7)), "post": of(0, 1)}, ["k"], "t", 1.0)
    assert sorted((r.t, r.segment, r.extra) for r in got.collect()) == [(0.0, "pre", None), (1.0, "pre", None), (2.0, "stim", 7), (4.0, "stim", 7), (5.0, "post", None), (6.0, "post", None)]


def test_transition_tables(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("abxab")] + [(2, 0, "a")], "k int, i int, s string")
    got = {(r.k, r.from_state, r.to_state): (r.n, r.prob) for r in sequence.transition_table(df, ["k"], ["i"], "s", ["a", "b"]).collect()}
    assert len(got) == 8 and got[1, "a", "b"] == (2, 1.0) and got[1, "b", "a"] == (1, 1.0) and got[1, "b", "b"] == (0, 0.0) and got[2, "a", "a"] == (0, 0.0)
    eps = {(r.k, r.from_state, r.to_state): r.prob for r in sequence.transition_table(df, ["k"], ["i"], "s", ["a", "b"], 1.0).collect()}
    assert eps[1, "a", "b"] == pytest.approx(2 / 3) and eps[2, "a", "a"] == 0


def test_even_picks_and_change(spark):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(10)] + [(2, i, 1.0) for i in range(2)], "k int, i long, v double")
    got = sorted((r.k, r.i) for r in sequence.pick_evenly(df, ["k"], "i", 4).collect())
    assert got == [(1, 0), (1, 3), (1, 6), (1, 9), (2, 0), (2, 1)]
    t = df.withColumn("t", F.col("i") - 5.0)
    c = {r.k: r for r in sequence.change_index(t, ["k"], "t", "v", 2.0).collect()}
    assert c[1].change == pytest.approx(51 - 6) and c[1].early_gradient == pytest.approx(12) and c[2].change is None and c[2].early_gradient is None


def test_adaptive_calibration_bins(spark):
    rows = [(i % 2, p) for i, p in enumerate([0.01] * 3 + [0.12] * 4 + [0.31] * 2 + [0.5] * 9 + [0.99, 1.0])] + [(None, 0.5), (1, None), (1, 1.5)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = sorted((r.low, r.high, r.n) for r in evaluate.calibration_table(df, "y", "p", "adaptive", 10, 5).collect())
    assert got == [(0.0, 0.2, 7), (0.2, 1.0, 13)] or (sum(g[2] for g in got) == 20 and all(g[2] >= 5 for g in got) and got[0][0] == 0.0 and got[-1][1] == 1.0)
    assert sum(r.n for r in evaluate.calibration_table(df, "y", "p", "quantile", 4).collect()) == 20
    assert [r.n for r in evaluate.calibration_table(df, "y", "p", "uniform", 2, 12).collect()] == []
    assert evaluate.calibration_table(df.limit(0), "y", "p", "quantile").count() == 0


def test_interval_table_orders_and_writes(spark):
    df = spark.createDataFrame([("b", 0.5, 0.4, 0.6), ("z", 0.1, None, None), ("a", 0.25, 0.2, 0.3), ("n", None, 0.0, 1.0)], "m string, v double, lo double, hi double")
    got = [(r.place, r.m, r.text) for r in evaluate.interval_table(df, "m", "v", "lo", "hi", ["a", "b"]).orderBy("place").collect()]
    assert got == [(1, "a", "0.250 (0.200, 0.300)"), (2, "b", "0.500 (0.400, 0.600)"), (3, "z", "0.100")]


def test_fills_filters_and_checks(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 3.0), (2, None), (2, float("nan")), (2, float("inf"))], "k int, v double")
    assert sorted(r.v for r in columns.fill_median(df, ["v"], ("k",)).collect()) == [0.0, 0.0, 0.0, 1.0, 2.0, 3.0]
    assert sorted(r.v for r in columns.fill_median(df, ["v"]).collect()) == [1.0, 2.0, 2.0, 2.0, 2.0, 3.0]
    q = spark.createDataFrame([("a", "QC", 10.0), ("a", "QC", 11.0), ("b", "QC", 1.0), ("b", "QC", 9.0), ("c", "QC", 1.0), ("a", "NC", 99.0)], "f string, g string, v double")
    assert {r.f for r in omics.rsd_filter(q, "f", "v", F.col("g") == "QC").collect()} == {"a"}
    p = spark.createDataFrame([(1, 1.0, 2.0, 0), (1, 2.0, 4.0, 1), (2, None, 1.0, 7), (2, 1.0, 1.0, None)], "k int, v double, m double, y int")
    got = {r.k: r for r in cloud.field_quality(p, ["k"], "v", "m", "y").collect()}
    assert got[1].ok and got[1].r == pytest.approx(1) and not got[2].ok and (got[2].missing, got[2].unknown_labels) == (1, 2)
    z = models.joint_scaled({"x": spark.createDataFrame([(1.0, 5.0)], "a double, b double"), "y": spark.createDataFrame([(3.0, 5.0)], "a double, b double")}, ["a", "b"])
    assert sorted((r.segment, r.a, r.b) for r in z.collect()) == [("x", -1.0, 0.0), ("y", 1.0, 0.0)]
    s = evaluate.softmax(spark.createDataFrame([(1, 1000.0), (1, 1000.0), (2, -5.0)], "k int, v double"), ["k"], "v", "w")
    assert sorted(r.w for r in s.collect()) == [0.5, 0.5, 1.0]
    far = omics.centroid_distances(spark.createDataFrame([("QC", 0.0), ("a", 3.0), ("a", 5.0)], "g string, x double"), "g", ["x"], "QC")
    assert sorted((r.x, r.own, r.to_reference) for r in far.collect()) == [(0.0, 0.0, 0.0), (3.0, 1.0, 3.0), (5.0, 1.0, 5.0)]


def test_augmentation_by_class_deviation_and_group(spark):
    rows = [(i, "a", float(i), 0.0) for i in range(200)] + [(1000 + i, "b", 5.0, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    got = {r.g: r.n for r in neighbours.proportional_copies(df, ["x", "y"], "id", "g", 600).where("synthetic").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert abs(got["a"] - 280) < 40 and abs(got["b"] - 70) < 25
    same = neighbours.proportional_copies(df, ["x", "y"], "id", "g", 600).where("synthetic and g = 'b'").select("x", "y").distinct().collect()
    assert [tuple(r) for r in same] == [(5.0, 1.0)]  # a class without spread is copied as it is
    mad = neighbours.mad_copies(df, ["x", "y"], 3, 0.1)
    assert mad.count() == 1000 and mad.where("copy = 0").count() == 250 and mad.where("y <> 0 and y <> 1").count() == 0
    made = neighbours.pseudo_samples(df, ["x", "y"], "g", 500).groupBy("g").agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.count("*").alias("n")).collect()
    a = {r.g: r for r in made}
    assert a["a"].n == 500 and abs(a["a"].m - 99.5) < 10 and abs(a["a"].s - 57.9) < 8 and a["b"].m == 5.0
    assert neighbours.proportional_copies(df.limit(0), ["x"], "id", "g", 10).count() == 0


def test_trace_columns_and_aligned_times(spark, tmp_path):
    (tmp_path / "three.csv").write_text("a,b,c\n0,1,10\n0,2,20\n\n0,3,bad\n")
    (tmp_path / "one.csv").write_text("5\n6\n")
    third = sorted((r.recording_id.rsplit("/", 1)[1], r.t_sec, r.value) for r in tables.read_headerless_trace(spark, str(tmp_path), "third", 2.0).collect())
    assert third == [("one.csv", 0.0, 5.0), ("one.csv", 0.5, 6.0), ("three.csv", 0.0, 10.0), ("three.csv", 0.5, 20.0)]
    last = tables.read_headerless_trace(spark, str(tmp_path / "three.csv"), "last").collect()
    assert [(r.t_sec, r.value) for r in last] == [(None, 10.0), (None, 20.0)]
    with pytest.raises(ValueError):
        tables.read_headerless_trace(spark, str(tmp_path), "fifth")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "wide.csv").write_text("time_from_stim_s,ch1,ch2\n0,1,2\n1,3,4\n2,5,6\n")
    assert sorted((r.t_sec, r.channel, r.value) for r in tables.read_wide_signal(spark, str(tmp_path / "w"), before=2).collect()) == [(0, "ch1", 1), (0, "ch2", 2), (1, "ch1", 3), (1, "ch2", 4)]
    i = spark.createDataFrame([(0,), (4,)], "i long")
    assert [r.i for r in tables.aligned(i, "i", 1.0, fs=2.0).collect()] == [-1.0, 1.0]
    assert [r.i for r in tables.aligned(i, "i", 10.0, width=2.0, step=0.5).collect()] == [-9.0, -7.0]
    f, p = np.arange(6.0), np.ones(6)
    assert signal.band_power(f, p, 1, 4) == 3 and signal.band_power(f, p, 1, 4, "strict") == 1


def test_polarity_and_colour_ratios(spark):
    brown, white, red, green = (120, 70, 30), (255, 255, 255), (200, 20, 20), (30, 200, 30)
    rows = [("a", *brown)] * 50 + [("a", *white)] * 50 + [("b", *white)] * 5 + [("c", *red)] * 4 + [("c", *green)] * 2 + [("c", 0, 0, 0)]
    p = spark.createDataFrame(rows, "o string, r int, g int, b int")
    got = {(r.o, r.method) for r in pixels.polarised(p, ["o"]).select("o", "method").distinct().collect()}
    assert ("b", "grey") in got and ("a", "density+") in got
    assert pixels.polarised(p, ["o"]).where("signal < 0").count() == 0
    c = {r.o: r for r in pixels.red_green(p, ["o"]).collect()}["c"]
    assert c.tissue == 6 and c.red_area_ratio == pytest.approx(4 / 6) and c.rg_area == pytest.approx(2, abs=1e-5) and c.green_mean > c.red_mean
    a = {r.o: r for r in pixels.red_green(p, ["o"]).collect()}["a"]
    assert a.green_mean == 0 and a.rg_area > 1 or a.rg_area == 0


def test_sexes_first_rows_and_point_layouts(spark):
    s = spark.createDataFrame([(x,) for x in (" M", "Female", "男", "0", "x", None)], "s string").select(text.sex01(F.col("s")).alias("v"))
    assert [r.v for r in s.collect()] == [1, 0, 1, 0, None, None]
    df = spark.createDataFrame([("g", 3.0, 1), ("g", 1.0, 2), ("g", 2.0, 3), ("h", 9.0, 4)], "g string, pc1 double, i int")
    assert sorted((r.i, r.place) for r in omics.first_by(df, ["g"], [F.col("pc1")], 2).collect()) == [(2, 1), (3, 2), (4, 1)]
    a = spark.createDataFrame([("p", [1.0, 2.0, 3.0], 0.5, [7, 8])], "patient string, coords array<double>, e_field double, anatomy array<int>")
    assert tuple(tables.point_features(a).first()) == ("p", 1.0, 2.0, 3.0, [0.5, 7.0, 8.0])
    b = spark.createDataFrame([("p", [1.0, 2.0, 3.0, 4.0]), ("q", [1.0, 2.0])], "patient string, points array<double>")
    assert [tuple(r) for r in tables.point_features(b).orderBy("patient").collect()] == [("p", 1.0, 2.0, 3.0, [4.0]), ("q", 1.0, 2.0, None, [])]
    with pytest.raises(ValueError):
        tables.point_features(df)
