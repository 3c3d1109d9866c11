"""Closed-form and invariance tests of operators that SQL doesn't express."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurotab.functions import pixels, text
from neurotab.operators import cloud, epochs, evaluate, models, omics, ranges, sequence, signal, states, stats
from neurotab.sources import binary, tables
from neurotab.streaming import live


def test_alternation_of_a_known_sequence(spark):
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate("12313")] + [("b", 0, "1"), ("b", 1, "2")], "k string, i int, s string")
    got = {r.k: r.alternation_pct for r in sequence.alternation(df, ["k"], ["i"], "s").collect()}
    assert got["a"] == pytest.approx(200 / 3) and got["b"] == 0


def test_refractory_keeps_greedily(spark):
    t = [0.0, 1.0, 1.9, 2.5, 4.0, 9.0, 9.5]
    got = sorted(r.t for r in sequence.refractory(spark.createDataFrame([(1, x) for x in t], "k int, t double"), ["k"], "t", 2.0).collect())
    assert got == [0.0, 2.5, 9.0]


def test_p_values(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (-3.5, 2.0)], "t double, df double")
    p = [r.p for r in df.select(stats.p_student("t", "df").alias("p")).collect()]
    assert p == pytest.approx([0.07338803, 1.0, 0.07282735], abs=1e-6)
    assert stats.upper_gamma(1.0, 2.0) == pytest.approx(math.exp(-2)) and stats.upper_gamma(0.5, 3.84146 / 2) == pytest.approx(0.05, abs=1e-5)
    z = spark.createDataFrame([(1.959964,)], "z double").select(stats.p_normal(F.col("z")).alias("p")).first().p
    assert z == pytest.approx(0.05, abs=1e-6)


def test_false_discovery_rate(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, None, 0.5])], "i int, p double")
    got = {r.i: r.q for r in stats.benjamini_hochberg(df, "p").collect()}
    assert got[0] == pytest.approx(0.04) and got[1] == got[2] == pytest.approx(0.16 / 3) and got[3] is None and got[4] == 0.5


def test_bootstrap_keeps_strata(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, g int")
    b = stats.bootstrap(df, [], ["g"], "id", 5, 1)
    assert {(r.rep, r.g): r["count"] for r in b.groupBy("rep", "g").count().collect()} == {(r, g): 10 for r in range(5) for g in range(3)}


def test_bootstrap_means_are_those_of_its_rows(spark):
    """Numbers of ranges go on from each other as one window's would, and packed picks give the means of the rows picked."""
    rows = [(i * 7919 % 10_007, "abc"[i % 10 // 4], None if i % 50 == 0 else float(i % 37)) for i in range(10_000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = {r.id: (r._i, r._n) for r in stats.numbered(df, ["g"], "id").collect()}
    for g in "abc":
        ids = sorted(i for i, h, _ in rows if h == g)
        assert [got[i] for i in ids] == [(k, len(ids)) for k in range(len(ids))]
    means = stats.bootstrap_means(df, [], ["g"], "id", "v", 7, 3)
    want = {(r.g, r.rep): r.m for r in stats.bootstrap(df, [], ["g"], "id", 7, 3).groupBy("g", "rep").agg(F.avg("v").alias("m")).collect()}
    assert {(r.g, r.rep): pytest.approx(r["mean"], rel=1e-12) for r in means.collect()} == want and len(want) == 21


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert evaluate.auc(df, "y", "p").first().auc == 0.5
    assert evaluate.auc(df.where("y = 1"), "y", "p").first().auc is None
    assert evaluate.merge_bins([0, 0.1, 0.2, 0.3, 1], [5, 1, 4, 2], 5) == [0, 0.1, 1]


def test_folds_cover_each_row_once_a_repeat(spark):
    f = evaluate.folds(spark.range(40).withColumn("y", F.col("id") % 4), "id", "y", 5, 3, repeats=2)
    assert f.groupBy("repeat", "y", "fold").count().agg(F.max("count"), F.min("count")).first() == (2, 2)


def test_knn_settles_far_points(spark):
    r = np.random.default_rng(0)
    x, y = r.random((30, 3)), r.random((40, 3)) * 5
    a = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, x double, y double, z double")
    b = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "id int, x double, y double, z double")
    got = ranges.knn_join(a, b, "id", "id", 3, 0.2).toPandas().sort_values(["id", "rank"])
    want = np.sort(np.sqrt(((x[:, None] - y) ** 2).sum(2)), 1)[:, :3]
    assert np.allclose(got.dist.to_numpy().reshape(30, 3), want)


def test_chunked_bandpass_equals_whole(spark):
    n, fs = 4000, 100.0
    x = np.sin(np.arange(n) / fs * 2 * np.pi * 10) + np.random.default_rng(1).normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(n), "v": x}))
    a = signal.bandpass(df, ["k"], "i", "v", fs, 5, 15, 2, size=1500).toPandas().sort_values("i").filtered.to_numpy()
    b = signal.zero_phase(x, signal.butterworth_sections(2, 5, 15, fs))
    assert len(a) == n and np.abs(a - b)[200:-200].max() < 1e-6
    tone = signal.zero_phase(np.sin(np.arange(n) / fs * 2 * np.pi * 10), signal.butterworth_sections(2, 5, 15, fs))
    assert abs(tone[500:-500]).max() == pytest.approx(1, abs=0.1)
    assert abs(signal.zero_phase(np.sin(np.arange(n) / fs * 2 * np.pi * 40), signal.butterworth_sections(2, 5, 15, fs))[500:-500]).max() < 0.05


def test_spectra_and_complexity():
    fs, t = 200.0, np.arange(4000) / 200.0
    f, p = signal.welch_psd(np.sin(2 * np.pi * 20 * t), fs, 400)
    assert signal.band_power(f, p, 15, 25) == pytest.approx(0.5, rel=0.05) and signal.band_power(f, p, 40, 60) < 1e-6
    assert signal.lempel_ziv(np.zeros(64)) == 7 and signal.lempel_ziv(np.array([0, 1, 1, 0, 1])) == 4 and signal.lempel_ziv(np.random.default_rng(0).random(512) > 0.5) > 40
    slow = np.sin(2 * np.pi * 2 * t)
    coupled, flat = (1 + slow) / 2, np.ones_like(t)
    phase = np.angle(signal.hilbert(slow))
    assert signal.coupling(phase, coupled) > 10 * signal.coupling(phase, flat)
    assert signal.coherence(slow, slow, fs, 400, 1, 4) == pytest.approx(1)
    assert signal.morlet_power(np.sin(2 * np.pi * 20 * t), fs, [10, 20])[1, 2000] > 50 * signal.morlet_power(np.sin(2 * np.pi * 20 * t), fs, [10, 20])[0, 2000]


def test_planted_spikes(spark):
    fs, n = 20000, 40000
    x = np.random.default_rng(0).normal(0, 0.05, n)
    for i in (10000, 15000, 22000, 30000):
        x[i : i + 5] -= 0.8
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": np.arange(n), "v": x}))
    s = signal.detect_spikes(df, ["k"], "i", "v", 8.0, 30)
    assert sorted(r.i for r in s.collect()) == [10000, 15000, 22000, 30000]
    assert signal.waveforms(s, df, ["k"], "i", "v", 10, 20).count() == 4


def test_desynchronisation(spark):
    t = np.arange(-2, 5, 1 / 100)
    rows = [pd.DataFrame({"ch": "C3", "epoch": e, "rel_t": t, "value": np.where(t < 0, 2.0, 1.0) * np.sin(2 * np.pi * 10 * t)}) for e in range(3)]
    df = spark.createDataFrame(pd.concat(rows))
    part = lambda c: epochs.spectra(df.where(c), ["ch"], "rel_t", "value", 100.0, 100, 0.5)
    r = epochs.desynchronisation(part("rel_t >= 0"), part("rel_t < 0"), ["ch"], 8, 12).first()
    assert r.change_pct == pytest.approx(-75, abs=3) and r.kind == "ERD"
    e = epochs.time_frequency(df, ["ch"], "rel_t", "value", 100.0, [10.0], (-1.5, -0.5)).where("rel_t between 1 and 3").agg(F.avg("ersp")).first()[0]
    assert e == pytest.approx(math.log10(0.25), abs=0.05)


def test_hidden_states(spark):
    r = np.random.default_rng(2)
    state = np.repeat([0, 1, 0, 1, 1, 0], 40)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "i": range(240), "a": state * 4 + r.normal(size=240), "b": r.normal(size=240)}))
    m = states.fit_hmm(df, ["k"], ["i"], ["a", "b"], 2)
    got = states.decode_hmm(df, ["k"], ["i"], ["a", "b"], m).toPandas().sort_values("i").state.to_numpy()
    assert (got == state).mean() > 0.97 and m["means"][0, 0] < m["means"][1, 0]
    t = spark.createDataFrame([(1, "a", "a", 0.5), (1, "a", "b", 0.5), (1, "b", "a", 1.0)], "k int, from_state string, to_state string, prob double")
    assert {x.state: round(x.share, 6) for x in states.stationary(t, ["k"]).collect()} == {"a": 0.666667, "b": 0.333333}


def test_models(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 3)) @ np.diag([3, 1, 0.2])
    df = spark.createDataFrame([(i, *map(float, v), int(v[0] > 0)) for i, v in enumerate(x)], "id int, a double, b double, c double, y int")
    scores, loadings, values = models.pca(df, ["a", "b", "c"], 2)
    assert abs(loadings[0, 0]) > 0.99 and values[0] == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True))[-1])
    assert models.outliers(df, ["a", "b", "c"], 2).agg(F.avg("t2")).first()[0] == pytest.approx(2)
    line = {t["term"]: t for t in models.ols_hc3(df.withColumn("o", 2 * F.col("a") - F.col("b") + 1 + F.col("c")), "o", ["a", "b"])}
    assert line["a"]["coef"] == pytest.approx(2, abs=0.05) and line["a"]["se"] < 0.05
    oof = models.out_of_fold(evaluate.folds(df, "id", "y", 2, 1), ["a", "b"], "y", "fold", 2, iterations=20)
    assert oof.count() == 200 and evaluate.auc(oof, "y", "p").first().auc > 0.95
    assert models.select_features(df, ["a", "b", "c"], "y", 2)[0] == "a"
    assert models.jitter(df, ["y"], ["a"], 2, 1).count() == 600


def test_clouds(spark):
    vox = [(1, i, 0, 0) for i in range(12)] + [(1, 5, 7, 7), (1, 6, 8, 7)]
    c = cloud.voxel_components(spark.createDataFrame(vox, "v int, i int, j int, k int"), "v").groupBy("component").count()
    assert sorted(r["count"] for r in c.collect()) == [1, 1, 12]
    line = spark.createDataFrame([(1, float(i), float(i), 0.1 * i) for i in range(20)], "p int, x double, y double, z double")
    a = cloud.principal_axis(line, ["p"]).first()
    assert a.axis[0] == pytest.approx(a.axis[1]) and a.tip.z == 0
    far = cloud.farthest_points(line.withColumn("id", F.col("x").cast("long")), "p", "id", 3, 0).collect()
    start = next(r.id for r in far if r["rank"] == 0)
    assert len({r.id for r in far}) == 3 and next(r.id for r in far if r["rank"] == 1) == (0 if start >= 10 else 19)


def test_farthest_points_of_a_large_cloud(spark):
    """No point is thinned away and ties go to the smaller id, whatever the size; a small cloud gives all its points."""
    big = 1_000_500
    pdf = pd.DataFrame({"id": np.arange(big), "x": (np.arange(big) * 7919 % 1000003) / 1000003, "y": (np.arange(big) * 104729 % 999983) / 999983, "z": (np.arange(big) * 31 % 1000) / 1000})
    i = F.col("id")
    cloud_of = spark.range(big).select(F.lit(1).alias("p"), "id", (i * 7919 % 1000003 / 1000003).alias("x"), (i * 104729 % 999983 / 999983).alias("y"), (i * 31 % 1000 / 1000).alias("z"))
    few = spark.createDataFrame([(None, 5, 0.0, 0.0, 0.0), (None, 7, 1.0, 0.0, 0.0)], "p int, id long, x double, y double, z double")
    got = cloud.farthest_points(cloud_of.union(few), "p", "id", 11, 3).orderBy("rank").collect()
    x = pdf[["x", "y", "z"]].to_numpy()
    at, nearest, want = int(np.random.default_rng(3).integers(big)), np.full(big, np.inf), []
    for _ in range(11):
        want.append(at)
        nearest = np.minimum(nearest, ((x - x[at]) ** 2).sum(1))
        at = int(nearest.argmax())
    assert [r.id for r in got if r.p == 1] == want and sorted(r.id for r in got if r.p is None) == [5, 7]


def test_samples_of_exact_size(spark):
    df = spark.createDataFrame([(1, i) for i in range(3)] + [(2, i) for i in range(9)], "k int, id int")
    s = omics.sample_exactly(df, ["k"], "id", 5, 1).groupBy("k").agg(F.count("*"), F.count_distinct("id")).collect()
    assert {tuple(r) for r in s} == {(1, 5, 3), (2, 5, 5)}


def test_pixels(spark):
    image = spark.createDataFrame([("a", 1, 3, 3, bytearray([0, 0, 200, 0, 180, 0, 255, 255, 255]))], "origin string, height int, width int, nChannels int, data binary")
    p = pixels.unpack(image)
    assert [(r.r, r.g, r.b) for r in p.orderBy("x").collect()] == [(200, 0, 0), (0, 180, 0), (255, 255, 255)]
    m = pixels.marker_metrics(p, ["origin"], pixels.colour_mask("red"), pixels.grey()).first()
    assert m.tissue == 2 and m.positive == 1


def test_notes(spark):
    df = spark.createDataFrame([("发病时间 2023年5月6日8时30分　 NIHSS: 12 分", "是"), ("none", "maybe")], "t string, b string")
    r = df.select(text.first_match(F.col("t"), text.NIHSS).alias("n"), text.timestamp(F.lit("2023年5月6日8时30分")).alias("at"), text.binary(F.col("b")).alias("b"), text.group_day(F.lit("Day14 x")).alias("d")).collect()
    assert r[0].n == "12" and str(r[0]["at"]) == "2023-05-06 08:30:00" and r[0].b == 1 and r[1].n is None and r[1].b is None and r[0].d == "Day 14"


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Filtered (1) Timestamps,Filtered (1) Values\n0.0,1.5\n0.1,x\n")
    assert [(r.t_sec, r.value) for r in tables.read_trace(spark, str(tmp_path / "t.csv")).orderBy("t_sec").collect()] == [(0.0, 1.5), (0.1, None)]
    assert tables.read_headerless_trace(spark, str(tmp_path / "t.csv")).count() == 1
    with pytest.raises(ValueError):
        tables.read_trace(spark, str(tmp_path / "t.csv"), "absent")
    wide = spark.createDataFrame([("m1", "a", 1.0, 2.0, 3.0, "x"), ("m1", "b", 1.0, 2.0, 3.0, "4")], "Metabolites string, ID string, NC1 double, HS1 double, QC1 double, ZS1 string")
    a = tables.abundance(wide).collect()
    assert {r.feature for r in a} == {"m1", "m1__2"} and {r.group for r in a} == {"NC", "HS", "ZS"} and sum(r.value is None for r in a) == 1
    np.arange(12, dtype="<i2").tofile(tmp_path / "x.bin")
    spark.dataSource.register(binary.InterleavedSource)
    got = spark.read.format("interleaved").options(path=str(tmp_path / "x.bin"), channels=4, samples=2).load()
    assert [tuple(r) for r in got.orderBy("sample_idx", "channel").collect()] == [(i // 4, i % 4, float(i)) for i in range(12)]
    with pytest.raises(Exception, match="whole number"):
        spark.read.format("interleaved").options(path=str(tmp_path / "x.bin"), channels=5).load().count()


def _through(spark, tmp_path, df, f, name):
    src = str(tmp_path / name)
    df.write.parquet(src)
    q = f(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
    q.awaitTermination(120)
    time.sleep(0.2)
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    got = _through(spark, tmp_path, e, lambda s: live.live_entries(s, "user_id", "ts", "event_type"), "entries")
    assert len(got) == sequence.entries(e, ["user_id"], ["ts"], "event_type").count()
    t = e.select("user_id", F.unix_micros("ts").cast("double").alias("t"))
    kept = _through(spark, tmp_path, t, lambda s: live.live_spikes(s, "user_id", "t", 3.6e9), "spikes")
    assert len(kept) == sequence.refractory(t, ["user_id"], "t", 3.6e9).count()
    assert _through(spark, tmp_path, e, lambda s: live.window_means(s, ["user_id"], "ts", "value", "1 day", "1 day", "1 day"), "means")
    assert _through(spark, tmp_path, e, lambda s: live.live_bouts(s, ["user_id"], "ts", "6 hours", "1 day"), "bouts")


def test_neighbours_without_places_or_right_rows(spark):
    kind = "id long, x double, y double, z double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (None, 1.0, 1.0, 1.0), (4, 90.0, 0.0, 0.0)], kind)
    got = sorted((r.id, r["rank"], r.id_r) for r in ranges.knn_join(a, a, "id", "id", 1, 0.5).collect())
    assert got == [(1, 1, 1), (4, 1, 4)]
    none = ranges.knn_join(a, a.limit(0), "id", "id", 2, 0.5)
    assert none.count() == 0 and {"rank", "dist", "id_r"} <= set(none.columns)


def test_smoothing_of_equal_rows_and_short_series(spark):
    rows = [("a", 1, 2.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 5.0), ("c", 1, None), *(("d", i, float(i * i % 7)) for i in range(30))]
    got = sequence.weighted_mean(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], ["t"], "v", 1.0, "m").collect()
    assert len(got) == len(rows)

    def smooth(x):
        g = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
        padded = np.pad(np.array(x), 4, mode="symmetric")
        return [float((padded[i : i + 9] * g / g.sum()).sum()) for i in range(len(x))]

    for k in "abd":
        want = smooth([v for key, _, v in rows if key == k])
        assert np.allclose([r.m for r in sorted((r for r in got if r.k == k), key=lambda r: (r.t, r.m))], want)
    assert [r.m for r in got if r.k == "c"] == [None]


def test_merged_tables_go_by_feature_unsummed(spark):
    """Rows are dealt by feature before any sum, and features of one table, or of none, are left out."""
    a = spark.createDataFrame([("x", 1, 1.0), ("x", 1, 2.0), ("y", 1, 5.0), (None, 1, 9.0), ("z", 2, None)], "f string, s int, v double")
    b = spark.createDataFrame([("x", 1, 6.0), ("x", 2, 7.0), (None, 1, 9.0), ("z", 3, 4.0)], "f string, s int, v double")
    got = omics.merge_tables(a, b, "f", "s", "v")
    plan = got._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert len(plan) == 2 and "HashAggregate" in plan[0] and "HashAggregate" not in plan[1]
    assert {(r.f, r.s): r.v for r in got.collect()} == {("x", 1): 3.0, ("x", 2): 7.0, ("z", 2): None, ("z", 3): 4.0}


def test_samples_of_a_key_are_its_smallest_hashes(spark):
    """The rows are those of smallest hash, null keys included, and no window orders all rows of a key."""
    from pyspark.sql import Window

    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"))
    got = omics.sample_exactly(df, ["k"], "id", 20, 3)
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(3), "id"), "id")) - 1
    want = df.withColumn("slot", place).where("slot < 20")
    key = lambda r: (r.k or 0, r.slot, r.id)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert "_last" in got._jdf.queryExecution().optimizedPlan().toString()  # ranges of the hash are chosen before the order


def test_evidence_deals_members_before_telling_them_apart(spark):
    """Repeated pairs count once, members without a name are left out, and no sum is made before the exchange by member."""
    m = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "z"), (2, "b"), (3, "a"), (3, None)], "p int, m string")
    hits, names = m.where("m = 'a'").select("m"), spark.createDataFrame([("a", "A"), ("b", "B")], "m string, name string")
    got = omics.pathway_evidence(m, hits, "p", "m", "name", names=names)
    assert sorted((r.p, r.n_members, r.n_hits, r.share, r.support) for r in got.collect()) == [(1, 2, 1, 0.5, "A"), (3, 1, 1, 1.0, "A")]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_dense_neighbours_start_in_narrow_cells(spark):
    """Cells are narrowed until pairs are few, and the neighbours of crowded, repeated and lonely points are exact."""
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(0, 0.01, (300, 3)), np.tile([[0.02, 0.0, -0.0]], (60, 1)), rng.uniform(-5, 5, (20, 3))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id int, x double, y double, z double")
    assert ranges._fitting(df, 0.5, ("x", "y", "z"), 12) < 0.05
    got = {(r.id, r["rank"]): r.id_r for r in ranges.knn_join(df, df, "id", "id", 3, 0.5).collect()}
    for i, v in enumerate(p):
        d = np.sqrt(((p - v) ** 2) @ np.ones(3))
        assert [got[i, r] for r in (1, 2, 3)] == list(np.lexsort((np.arange(len(p)), d))[:3])


def test_first_within_are_the_smallest_keys(spark):
    """The n smallest keys within the radius, of crowded places, of few hits and of none; places that aren't finite have none."""
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 0.02, (2500, 3)), rng.uniform(-1, 1, (200, 3))])[rng.permutation(2700)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(9000, float("nan"), 0.0, 0.0)], "id int, x double, y double, z double")
    few = df.where("id % 9 = 0")
    got = {}
    for r in ranges.first_within(few, df, 0.1, "id", "id", 4).collect():
        got.setdefault(r.id, []).append(r.id_r)
    for i in range(0, 2700, 9):
        assert sorted(got[i]) == list(np.flatnonzero(np.sqrt(((p - p[i]) ** 2) @ np.ones(3)) <= 0.1)[:4])
    assert 9000 not in got
