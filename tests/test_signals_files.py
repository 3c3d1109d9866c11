"""Windows of channels, batches of files, feature arrays, clinical fields and live state against plain versions."""

import datetime
import gzip
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurotab.functions import clinical
from neurotab.operators import signal, windows
from neurotab.plans import catalog
from neurotab.sources import batch, features
from neurotab.streaming import carried

BANDS = {"low": (2.0, 6.0), "mid": (6.0, 12.0), "high": (12.0, 20.0)}


def _frame(spark, x, fs_gap=()):
    rows = [(1, c, i, float(x[c, i])) for c in range(len(x)) for i in range(x.shape[1]) if (c, i) not in fs_gap]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["k", "c", "i", "v"])).repartition(5)


def test_window_features_equal_single_windows(spark, monkeypatch):
    monkeypatch.setattr(windows, "SAMPLES", 200)  # several blocks
    x = np.random.default_rng(1).normal(size=(1, 1037))
    df = _frame(spark, x, {(0, 500)})
    got = windows.window_features(df, ["k"], "i", "v", 50.0, 100, 40, BANDS).toPandas().sort_values("win")
    wins = [w for w in range(24) if w * 40 + 100 <= 1037 and not w * 40 <= 500 < w * 40 + 100]
    assert got.win.tolist() == wins
    for w, row in zip(wins, got.itertuples()):
        s = x[0, w * 40 : w * 40 + 100]
        f, p = signal.welch_psd(s, 50.0, 100)
        assert row.log_mid == pytest.approx(np.log(signal.band_power(f, p, 6.0, 12.0) + 1e-12))
        slow, fast = (signal.zero_phase(s, signal.butterworth_sections(2, *b, 50.0)) for b in (BANDS["low"], BANDS["high"]))
        assert row.coupling == pytest.approx(signal.coupling(np.angle(signal.hilbert(slow)), abs(signal.hilbert(fast))))
        assert row.lzc == pytest.approx(signal.lempel_ziv(s > np.median(s)) / (100 / np.log2(100)))
    spec = windows.spectrogram(df, ["k"], "i", "v", 50.0, 100, 40, 10.0).toPandas()
    assert sorted(spec.win.unique()) == wins and len(spec) == len(wins) * 21
    assert windows.window_features(df.where("i < 99"), ["k"], "i", "v", 50.0, 100, 40, BANDS).count() == 0


def test_synchrony_by_blocks_of_channels_and_gaps(spark):
    x = np.random.default_rng(2).normal(size=(7, 400))
    bands = {"mid": (6.0, 12.0), "none": (30.0, 40.0)}
    gap = {(2, 50), (2, 51)} | {(5, i) for i in range(100, 180)}
    df = _frame(spark, x, gap)
    one = windows.synchrony(df, ["k"], "c", "i", "v", 50.0, 200, 100, bands).toPandas().sort_values("win")
    two = windows.synchrony(df, ["k"], "c", "i", "v", 50.0, 200, 100, bands, side=2).toPandas().sort_values("win")
    assert np.allclose(one.sync_mid, two.sync_mid) and one.n_channels.tolist() == two.n_channels.tolist() == [7, 7, 7]
    assert one.n_whole.tolist() == [5, 6, 7] and one.sync_none.isna().all()
    filled = x.copy()
    filled[2, 50:52] = np.interp([50, 51], [49, 52], x[2, [49, 52]])
    filled[5, 100:180] = np.interp(np.arange(100, 180), [99, 180], x[5, [99, 180]])
    want = np.mean([signal.coherence(filled[a, :200], filled[b, :200], 50.0, 100, 6.0, 12.0) for a in range(7) for b in range(a + 1, 7)])
    assert one.sync_mid.iloc[0] == pytest.approx(want)
    lone = windows.synchrony(df.where("c = 1"), ["k"], "c", "i", "v", 50.0, 200, 100, bands).toPandas()
    assert lone.sync_mid.isna().all() and (lone.n_channels == 1).all()


def test_whole_feature_vector_of_channels(spark):
    x = np.random.default_rng(3).normal(size=(4, 300))
    got = windows.channel_features(_frame(spark, x), ["k"], "c", "i", "v", 50.0, 100, 100, BANDS, ["mid", "high"]).toPandas().sort_values("win")
    assert list(got.columns) == ["k", "win", "log_low", "log_mid", "log_high", "coupling", "lzc", "n_channels", "n_whole", "sync_mid", "sync_high"]
    f, p = signal.welch_psd(x.mean(0)[100:200], 50.0, 100)
    assert got.log_low.iloc[1] == pytest.approx(np.log(signal.band_power(f, p, 2.0, 6.0) + 1e-12))
    want = np.mean([signal.coherence(x[a, 100:200], x[b, 100:200], 50.0, 100, 12.0, 20.0) for a in range(4) for b in range(a + 1, 4)])
    assert got.sync_high.iloc[1] == pytest.approx(want)


@pytest.mark.parametrize("n", [1, 97, 360, 1024])
def test_spectrum_in_two_steps(spark, n):
    x = np.random.default_rng(n).normal(size=(2, n))
    got = windows.spectrum(_frame(spark, x, {(1, n // 2)} if n > 1 else ()).withColumnRenamed("k", "rec"), ["rec", "c"], "i", "v").toPandas()
    one = got[got.c == 0].sort_values("k")
    assert one.k.tolist() == list(range(n)) and (one.n == n).all()
    assert np.allclose(one.re + 1j * one.im, np.fft.fft(x[0]), atol=1e-8) and (n == 1 or (got.c == 0).all())


def test_spectrum_is_split_for_long_recordings_only(spark):
    assert windows._rows.func(pd.Series([1, 45, 1 << 16, 1 << 17])).tolist() == [1, 1, 1, 256]
    x = np.random.default_rng(2).normal(size=1 << 17)
    df = spark.range(1 << 17).select(F.lit(1).alias("rec"), F.col("id").alias("i")).join(spark.createDataFrame(pd.DataFrame({"i": np.arange(1 << 17), "v": x})), "i")
    df = df.union(df.where("i < 45").select("i", F.lit(2), "v"))
    got = windows.spectrum(df, ["rec"], "i", "v").toPandas().sort_values(["rec", "k"])
    for rec, n in ((1, 1 << 17), (2, 45)):
        g = got[got.rec == rec]
        assert len(g) == n and np.allclose(g.re + 1j * g.im, np.fft.fft(x[:n]), atol=1e-8)


def test_coherence_matrix(spark):
    x = np.random.default_rng(5).normal(size=(3, 600))
    df = _frame(spark, x).withColumnRenamed("k", "rec")
    got = {(r.a, r.b): r.coherence for r in windows.coherence_matrix(df, ["rec"], "c", "i", "v", 50.0, 6.0, 12.0).collect()}
    spectra, f = np.fft.fft(x), np.fft.fftfreq(600, 1 / 50.0)
    inside = (f > 6.0) & (f < 12.0)
    for a in range(3):
        for b in range(a, 3):
            m = [abs(spectra[i] * spectra[j].conj())[inside].mean() for i, j in ((a, b), (a, a), (b, b))]
            assert got[a, b] == pytest.approx(m[0] ** 2 / (m[1] * m[2] + 1e-9))
    assert len(got) == 6


def _padded(x, n):
    """The spectrum of x, which goes on with its mean up to n samples."""
    return np.fft.fft(np.append(x, np.full(n - len(x), x.mean())))


def _coherence(spectra, inside):
    """Coherence by pair of channels from band means."""
    m = {(i, j): abs(x * y.conj())[inside].mean() for i, x in spectra.items() for j, y in spectra.items()}
    return {(i, j): m[i, j] ** 2 / (m[i, i] * m[j, j] + 1e-9) for i, j in m if i <= j}


def test_spectrum_of_a_common_length(spark):
    n = 1 << 17  # two steps; the shorter ones lack samples of some residues, or of none
    x = 40 + np.random.default_rng(3).normal(size=n)
    sizes = {0: n, 1: 100, 2: 70001}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"rec": 1, "c": c, "i": np.arange(m), "v": x[:m]}) for c, m in sizes.items()] + [pd.DataFrame({"rec": 2, "c": 0, "i": np.arange(45), "v": x[:45]})]))
    got = windows.spectrum(df, ["rec", "c"], "i", "v", ["rec"]).toPandas().sort_values("k")
    for c, m in sizes.items():
        g = got[(got.rec == 1) & (got.c == c)]
        assert (g.n == n).all() and g.k.tolist() == list(range(n)) and np.allclose(g.re + 1j * g.im, _padded(x[:m], n), atol=1e-6)
    other = got[got.rec == 2]
    assert len(other) == 45 and np.allclose(other.re + 1j * other.im, np.fft.fft(x[:45]), atol=1e-8)
    every = windows.spectrum(df.where("c = 1 or rec = 2"), ["rec", "c"], "i", "v", []).toPandas()
    assert (every.n == 100).all() and len(every) == 200


def test_coherence_matrix_of_channels_of_unequal_length(spark):
    x = 100 + np.random.default_rng(8).normal(size=(4, 700))
    x[3] = 7.0  # constant
    sizes = [700, 601, 333, 20]
    df = _frame(spark, x, {(c, i) for c, m in enumerate(sizes) for i in range(m, 700)}).withColumnRenamed("k", "rec")
    got = {(r.a, r.b): r.coherence for r in windows.coherence_matrix(df, ["rec"], "c", "i", "v", 50.0, 6.0, 12.0).collect()}
    f = np.fft.fftfreq(700, 1 / 50.0)
    want = _coherence({c: _padded(x[c, :m], 700) for c, m in enumerate(sizes)}, (f > 6.0) & (f < 12.0))
    assert got == pytest.approx(want) and got[3, 3] == pytest.approx(0)


def test_coherence_query_takes_all_samples(spark):
    sf = "/root/testdata/sf0.001"
    e = pd.read_parquet(f"{sf}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    want = {}
    for rec, of in e.groupby(e.user_id // 8):
        x = {u: g.value.to_numpy() for u, g in of.groupby("user_id")}
        n = max(map(len, x.values()))
        f = np.fft.fftfreq(n, 1 / 10.0)
        want |= {(rec, *pair): c for pair, c in _coherence({u: _padded(v, n) for u, v in x.items()}, (f > 1.0) & (f < 3.0)).items()}
    got = {(r.recording, r.a, r.b): r.coherence for r in catalog.QUERIES["signal_coherence_matrix"](spark, sf).collect()}
    assert got == pytest.approx(want)


def test_batch_keeps_failures_as_rows(spark, tmp_path):
    r = np.random.default_rng(6)
    fs = 2000.0
    x = r.normal(0, 0.05, 4000)
    x[[1000, 1500, 2200, 3000]] -= 3
    lines = ["time,value", *(f"{i / fs},{v}" for i, v in enumerate(x))]
    good = "\n".join(lines)
    (tmp_path / "sub").mkdir()
    files = {
        "good.csv": good.encode(), "sub/zipped.csv.gz": gzip.compress(good.encode()), "empty.csv": b"", "cut.csv": good[: len(good) // 2].encode()[:-3] + b"\n1.0",
        "cutzip.csv.gz": gzip.compress(good.encode())[:500], "short.csv": "\n".join(lines[:20]).encode(), "noise.csv": b"\xff\xfe\x00\x81" * 50, "other.csv": good.replace("value", "volts").encode(),
        "flat.csv": "\n".join(["time,value", *("0,1.5" for _ in range(500))]).encode(),
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "left.txt").write_bytes(b"not a trace")
    got = batch.sort_batch(spark, str(tmp_path), "*.csv*", ("time", "value"), fs, 100.0, 600.0, 4.0, 20, 10, 100).collect()
    by = {os.path.relpath(g.file.removeprefix("file:"), tmp_path): g for g in got}
    assert set(by) == set(files)
    assert {n for n, g in by.items() if g.ok} == {"good.csv", "sub/zipped.csv.gz", "flat.csv"}
    assert by["good.csv"].n_samples == 4000 and by["good.csv"].n_spikes >= 4 and by["good.csv"].n_spikes == by["sub/zipped.csv.gz"].n_spikes
    assert "empty" in by["empty.csv"].error and "missing columns: value" in by["other.csv"].error and "100 are needed" in by["short.csv"].error
    assert by["cut.csv"].error and by["cutzip.csv.gz"].error and by["noise.csv"].n_samples == 0
    t = batch.tally(spark.createDataFrame(got)).first()
    assert (t.processed, t.failed, len(t.failures)) == (3, 6, 6)
    large = batch.read_batch(spark, str(tmp_path), "good.csv", ("time", "value"), largest=10).collect()
    assert len(large) == 1 and "at most 10" in large[0].error
    plain = batch.read_batch(spark, str(tmp_path), "good.csv", None).where("error is null")
    assert plain.count() == 4000
    assert batch.sort_batch(spark, str(tmp_path), "*.none").count() == 0


def test_feature_arrays(spark, tmp_path):
    spark.dataSource.register(features.FeatureSource)
    r = np.random.default_rng(7)
    x = r.normal(size=(1000, 3))
    np.save(tmp_path / "a.npy", x)
    np.save(tmp_path / "one.npy", np.arange(10))
    np.save(tmp_path / "turned.npy", np.asfortranarray(x))
    np.savez_compressed(tmp_path / "b.npz", other=np.zeros(3), features=x.astype(np.float32))
    np.savez(tmp_path / "none.npz", other=x)
    np.save(tmp_path / "deep.npy", np.zeros((2, 2, 2)))
    np.save(tmp_path / "empty.npy", np.zeros((0, 4)))
    read = lambda name: spark.read.format("features").option("path", str(tmp_path / name)).option("rows", "300").load()
    for name in ("a.npy", "turned.npy", "b.npz"):
        got = read(name).orderBy("row").toPandas()
        assert got.row.tolist() == list(range(1000)) and np.allclose(np.stack(got.features), x, atol=1e-6)
    assert read("a.npy").rdd.getNumPartitions() == 4
    assert [r.features for r in read("one.npy").orderBy("row").collect()] == [[float(i)] for i in range(10)]
    assert read("empty.npy").count() == 0
    for name, reason in (("none.npz", "X or features"), ("deep.npy", "one or two dimensions"), ("a.csv", "npy or .npz")):
        with pytest.raises(Exception, match=reason):
            read(name).count()


def test_clinical_fields(spark):
    notes = [
        (1, "姓名：王小明 住院号: AB-12\n发病时间：2023-1-5 08:30 到院时间 2023/1/5 9:10\n采血时间:1月5日 10:00\nnihss：12 年龄 63 岁 性别:男 用药：阿司匹林 100mg\n高血压 溶栓 脑梗死"),
        (2, "起病 7：15，入院时间：3月4日 9:10 。60岁 女 ，NIHSS评分: 7。静滴 甘露醇\n脑出血，DM"),
        (3, "胰岛素 8u bid"),
        (4, ""),
        (5, None),
    ]
    t = F.col("t")
    got = {r.i: r for r in spark.createDataFrame(notes, "i int, t string").withColumns(clinical.extract(t)).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.onset.value, a.onset.snippet, a.onset.place) == ("2023-1-5 08:30", "发病时间：2023-1-5 08:30", notes[0][1].index("发病时间") + 1)
    assert a.arrival.value == "2023/1/5 9:10" and a.sampling.value == "1月5日 10:00" and a.nihss.value == "12" and a.age.value == "63" and a.sex.value == "男"
    assert a.sample_id == "住院号_AB-12" and a.patient_group == "ZS" and (a.htn, a.dm, a.thrombolysis, a.thrombectomy) == (1, 0, 1, 0) and a.meds.value == "阿司匹林 100mg"
    assert b.onset.value == "7：15" and b.nihss.value == "7" and b.age.value == "60" and b.sex.value == "女" and b.meds.value == "甘露醇" and b.dm == 1
    assert (c.meds.value, c.meds.snippet) == ("胰岛素", "胰岛素 8u bid") and c.onset is None and c.sample_id is None
    assert got[4].age is None and got[4].htn == 0 and got[5].age is None and got[5].htn == 0


def test_carried_state_does_not_depend_on_arrival(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", 0, 0, 0, "A", True), ("a", 1, 3, 4, "A", True), ("a", 2, None, None, None, False), ("a", 5, 3, 0, "B", True), ("a", 6, 3, 0, "A", False), ("a", 4000, 0, 0, "A", True), ("b", 2, 1, 1, "B", False)]
    typed = [(k, at(t), None if x is None else float(x), None if y is None else float(y), z, f) for k, t, x, y, z, f in rows]
    schema = "k string, t timestamp, x double, y double, z string, f boolean"
    deals = {"in_order": [[0, 1, 6], [2, 3], [4, 5]], "mixed": [[3, 0, 6, 2], [1, 4], [5]], "at_once": [[5, 3, 4, 1, 0, 2, 6]]}
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    results = []
    try:
        for name, parts in deals.items():
            folder = tmp_path / name
            for n, part in enumerate([*parts, None, None]):
                new = [typed[i] for i in part] if part else [("z", at(20_000 + 10 * n), 0.0, 0.0, "Z", False)]
                spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
                if n == 0:
                    stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
                    live = carried.carried(stream, "k", "t", "x", "y", "z", "f", "30 seconds", 2.0)
                q = live.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start()
                q.awaitTermination(120)
                assert q.exception() is None
            results.append(sorted(tuple(r) for r in spark.read.parquet(str(folder / "out")).where("k <> 'z'").collect()))
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert results[0] == results[1] == results[2]
    got = {(r[0], (r[1] - at(0)).total_seconds()): r[5:] for r in results[0]}
    assert got["a", 0] == (1, None, True) and got["a", 1] == (None, 5.0, False) and got["a", 2] == (None, None, False)
    assert got["a", 5] == (2, 4.0, True) and got["a", 6] == (3, 0.0, False) and got["a", 4000] == (1, None, True) and got["b", 2] == (1, None, False)
