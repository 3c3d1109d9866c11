"""Summaries, labels from names, and the signal operators that SQL doesn't express."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurotab.functions import text
from neurotab.operators import cloud, evaluate, omics, sequence, signal, windows


def test_fir_by_chunks_equals_whole(spark):
    x = np.random.default_rng(5).normal(size=3000)
    h = signal.fir_bandpass(5, 15, 100.0, 51)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(3000), "v": x}))
    got = signal.fir_filter(df, ["k"], "i", "v", h, 700).toPandas().sort_values("i").filtered.to_numpy()
    assert len(got) == 3000 and np.allclose(got[25:-25], np.convolve(x, h, "valid"))
    short = signal.fir_filter(df.where("i < 3"), ["k"], "i", "v", h).count()
    assert short == 3


def test_clean_lfp_fills_and_thins(spark):
    i = np.arange(8000)
    x = np.sin(2 * np.pi * 20 * i / 2000.0 + 0.1)
    x[1000:1004] = 0
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": i, "v": x}))
    got = signal.clean_lfp(df, ["k"], "i", "v", 2000.0, size=3000).toPandas().sort_values("i")
    assert got.i.tolist() == list(range(2000))
    want = np.sin(2 * np.pi * 20 * i[::4] / 2000.0 + 0.1)
    assert abs(got.cleaned.to_numpy() - want)[300:-300].max() < 0.1
    none = signal.clean_lfp(df.where("i < 40").withColumn("v", F.lit(0.0)), ["k"], "i", "v", 2000.0).toPandas()
    assert len(none) == 10 and none.cleaned.isna().all()


def test_synchrony_is_mean_coherence(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(3, 200))
    rows = [(1, c, i, float(x[c, i])) for c in range(3) for i in range(200)] + [(2, 0, i, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, c int, i int, v double")
    got = {g.k: g for g in windows.synchrony(df, ["k"], "c", "i", "v", 50.0, 200, 200, {"b": (5.0, 20.0)}).collect()}
    want = np.mean([signal.coherence(x[a], x[b], 50.0, 100, 5.0, 20.0) for a, b in ((0, 1), (0, 2), (1, 2))])
    assert got[1].sync_b == pytest.approx(want) and got[1].n_channels == 3 and got[2].sync_b is None


def test_population_skips_tables_without_columns(spark):
    a = spark.createDataFrame([(1, 51), (2, 50)], "cluster int, spike_count int")
    b = spark.createDataFrame([(1, 99, 0.5)], "cluster int, spike_count int, rate double")
    got = {r.neuron_id: r.rate for r in signal.population({"a": a, "b": b, "c": a.drop("cluster")}).collect()}
    assert got == {"a_c1": None, "b_c1": 0.5}
    with pytest.raises(ValueError):
        signal.population({"c": a.drop("cluster")})


def test_stage_without_length_has_no_rate(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, None)], "k int, t double")
    got = signal.stage_rates(df, ["k"], "t", {"a": (0, 1), "b": (1, 1)}).first()
    assert (got.n_a, got.rate_a, got.n_b, got.rate_b) == (1, 1.0, 0, None)


def test_labels_from_names(spark):
    df = spark.createDataFrame([("HS_d3_cortex",), ("d4",), (None,)], "n string")
    got = text.name_parts(df, "n", {"group": "^([A-Z]+)", "day": r"d(\d+)", "region": "_([a-z]+)$"}).collect()
    assert [(r.group, r.day, r.region) for r in got] == [("HS", "3", "cortex")]
    g = df.select(text.group_by_words(F.col("n"), {"c": ("CORTEX",), "h": ("hs",)}, "x").alias("g"), text.place_in(F.col("n"), ["d4"]).alias("o")).collect()
    assert [(r.g, r.o) for r in g] == [("c", 2), ("x", 1), ("x", 2)]


def test_significant_rows(spark):
    df = spark.createDataFrame([(0.01, 1.0, None, " up "), (0.05, 2.0, "a", "Up"), (0.01, 0.9, "a", "down"), (0.02, 3.0, "b", "flat"), (None, 3.0, "b", "up")], "p double, vip double, c string, r string")
    got = sorted(tuple(r) for r in omics.significant(df, "p", "vip", classes=["c"], regulation="r").collect())
    assert got == [(0.01, 1.0, "Unclassified", "Up"), (0.02, 3.0, "b", "NA")]


def test_edges_classes_and_risk(spark):
    e = spark.createDataFrame([(1, 2, 0.1), (1, 3, -0.9), (2, 3, 0.5), (3, 4, None)], "src int, dst int, w double")
    assert [r.w for r in omics.top_edges(e, "w", 2).collect()] == [-0.9, 0.5]
    assert evaluate.class_counts(e.limit(0), "src").count() == 0
    c = spark.createDataFrame([(1,), (2,)], "id int")
    s = spark.createDataFrame([(1, 0.25)], "id int, p_NC double")
    assert {r.id: r.risk for r in evaluate.with_risk(c, s, "id").collect()} == {1: 0.75, 2: None}


def test_post_goes_after_pre(spark):
    pre = spark.createDataFrame([(1, 0.0), (1, 5.0)], "k int, t double")
    post = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, t double")
    got = sorted((r.k, r.t, r.segment) for r in sequence.append_after(pre, post, ["k"], "t").collect())
    assert got == [(1, 0.0, "pre"), (1, 5.0, "pre"), (1, 6.0, "post"), (2, 1.0, "post")]


def test_region_without_mask_and_image_without_puncta(spark):
    p = spark.createDataFrame([(1, y, 0, "r") for y in range(5)], "im int, y int, x int, r string")
    got = cloud.region_coverage(p, {"m": p.where("y < 1"), "o": p.where("y < 2")}, ["im", "y", "x"], ["im", "r"]).first()
    assert (got.n, got.share_m, got.m, got.o, got.all_positive) == (5, pytest.approx(0.2), False, True, False)
    puncta = spark.createDataFrame([], "im int, area double, light double, near boolean")
    none = cloud.puncta_summary(puncta, p.select("im", F.lit(0).alias("px")).distinct(), ["im"], "area", "light", "near", "px").first()
    assert (none.n, none.mean_area, none.density, none.coloc_ratio) == (0, 0.0, 0.0, 0.0)


def test_wide_odd_band_has_all_sections():
    """Order 3 over 1 to 150 Hz: three sections, half the power at both limits, nothing lost in the middle."""
    sections = signal.butterworth_sections(3, 1.0, 150.0, 2000.0)
    assert len(sections) == 3
    gain = [abs(np.prod([np.polyval(b, z) / np.polyval(a, z) for b, a in sections])) for z in np.exp(2j * np.pi * np.array([1.0, 20.0, 150.0, 0.1, 900.0]) / 2000.0)]
    assert gain[:3] == pytest.approx([0.5**0.5, 1.0, 0.5**0.5], abs=1e-4) and max(gain[3:]) < 0.01
