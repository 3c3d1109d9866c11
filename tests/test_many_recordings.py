"""Work on many short recordings: one call for many of them, with the results of each by itself."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from neurotab.operators import cloud, signal, windows
from neurotab.sources import batch


def test_windows_of_short_recordings_share_calls(spark, monkeypatch):
    """300 recordings of 30 to 60 samples with gaps, repeats, missing values and a null key; plain windows of each are the reference."""
    r = np.random.default_rng(3)
    rows, want = [], {}
    for k in [None, *range(299)]:
        n = int(r.integers(30, 60))
        x = r.normal(size=n).astype(object)
        gone = set(r.choice(n, 3, replace=False).tolist()) if r.random() < 0.5 else set()
        twice = int(r.integers(n))
        for i in range(n):
            if i in gone:
                if i % 2:
                    rows.append((k, i, None if i % 4 == 1 else float("nan")))
                continue
            rows.append((k, i, float(x[i])))
            if i == twice:
                rows.append((k, i, float(x[i]) + 1.0))
                x[i] = float(x[i]) + 0.5
        for w in range(10):
            at = range(w * 8, w * 8 + 24)
            if at[-1] < n and not gone & set(at):
                want[(k, w)] = [float(x[i]) for i in at]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(7)

    def kernel(x):
        return pd.DataFrame({"_w": np.arange(len(x)), "first": x[:, 0], "total": x.sum(1), "together": float(len(x))})

    for samples in (windows.SAMPLES, 40):  # blocks of many windows, and of five
        monkeypatch.setattr(windows, "SAMPLES", samples)
        out = windows._over_windows(df, ["k"], "i", "v", 24, 8, "first double, total double, together double", kernel).collect()
        got = {(x.k, x.win): (x.first, x.total) for x in out}
        assert len(out) == len(got) == len(want)
        assert all(got[i] == pytest.approx((w[0], sum(w))) for i, w in want.items())
        if samples > 40:
            assert max(x.together for x in out) > 50


def test_rows_of_spectra_and_couplings():
    r = np.random.default_rng(4)
    f, p = np.arange(11.0), r.random((20, 11))
    for rule in ("trapezoid", "strict", "sum", "mean"):
        for low, high in ((2.0, 5.0), (4.0, 4.0), (30.0, 40.0)):
            assert signal.band_powers(f, p, low, high, rule) == pytest.approx([signal.band_power(f, row, low, high, rule) for row in p])
    phase, size = r.uniform(-np.pi, np.pi, (20, 40)), r.random((20, 40))
    size[3] = 0.0
    assert signal.couplings(phase, size) == pytest.approx([signal.coupling(a, b) for a, b in zip(phase, size)])
    assert signal.couplings(phase, size)[3] == pytest.approx(0.0)


def test_bandpass_of_short_recordings(spark):
    """Recordings of 1 to 70 samples and a long one in chunks: each as by itself; missing values stay NaN of their own recording."""
    r = np.random.default_rng(5)
    x = {k: r.normal(size=1 + k % 70) for k in range(150)} | {None: r.normal(size=3000)}
    x[40][3] = np.nan
    df = spark.createDataFrame([(k, i, float(v)) for k, s in x.items() for i, v in enumerate(s)], "k long, i long, v double").repartition(5)
    out = signal.bandpass(df, ["k"], "i", "v", 10.0, 0.5, 3.0, 2, 1000).toPandas()
    assert len(out) == sum(map(len, x.values()))
    sections = signal.butterworth_sections(2, 0.5, 3.0, 10.0)
    for k, rows in out.groupby("k", dropna=False):
        k = None if pd.isna(k) else int(k)
        rows = rows.sort_values("i")
        assert rows.i.tolist() == list(range(len(x[k])))
        assert rows.filtered.to_numpy() == pytest.approx(signal.zero_phase(x[k], sections), abs=1e-6, nan_ok=True)


def test_traces_are_files_of_one_folder(spark, tmp_path):
    """400 files, the largest of more rows than a batch: listed at once, read back whole and in order."""
    n = {k: 25_000 if k == 7 else 1 + k % 9 for k in range(400)}
    df = spark.createDataFrame([(k, i / 10.0, i * 0.1 + k) for k, m in n.items() for i in range(m)], "recording long, time double, value double").repartition(6)
    folder = f"file://{tmp_path}/traces"
    assert batch.write_traces(df, folder, "recording", "time") == 400
    assert sorted(p.name for p in (tmp_path / "traces").iterdir()) == sorted(f"recording={k}.csv" for k in n)
    got = batch.read_batch(spark, folder, "*.csv", ("time", "value"), 5).toPandas()
    bad, good = got[got.error.notna()], got[got.error.isna()]
    key = lambda d: d.file.str.extract(r"recording=(\d+)\.csv")[0].astype(int)
    assert set(key(bad)) == {k for k, m in n.items() if m < 5} and len(bad) == len(set(key(bad)))
    for k, rows in good.groupby(key(good)):
        rows = rows.sort_values("idx")
        assert rows.idx.tolist() == list(range(n[k]))
        assert rows.value.to_numpy() == pytest.approx(np.arange(n[k]) * 0.1 + k)
        assert rows.t_sec.to_numpy() == pytest.approx(np.arange(n[k]) / 10)
    assert batch.write_traces(df.limit(0), f"file://{tmp_path}/none", "recording", "time") == 0


def reached(cells, diagonal):
    """Components of (key, place...) by a plain search; cells with a missing value are alone."""
    left, out = {c for c in cells if None not in c}, [frozenset([c]) for c in cells if None in c]
    d = len(next(iter(cells))) - 1
    steps = [s for s in itertools.product((-1, 0, 1), repeat=d) if any(s) and (diagonal or sum(map(abs, s)) == 1)]
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            c = todo.pop()
            for s in steps:
                n = (c[0], *(a + b for a, b in zip(c[1:], s)))
                if n in left:
                    left.remove(n)
                    part.add(n)
                    todo.append(n)
        out.append(frozenset(part))
    return set(out)


@pytest.mark.parametrize("names,spread,n,diagonal", [("ijk", 25, 9000, False), ("ijk", 25, 2500, True), ("ij", 90, 9000, False)])
def test_components_across_blocks(spark, names, spread, n, diagonal):
    r = np.random.default_rng(6)
    cells = {(int(k), *map(int, p)) for k, p in zip(r.integers(0, 2, n), r.integers(-spread // 2, spread, (n, len(names))))}
    cells |= {(None, *(3,) * len(names)), (None, *(3,) * (len(names) - 1), 4), (0, None, *(1,) * (len(names) - 1))}
    df = spark.createDataFrame(sorted(cells, key=str), "v int, " + ", ".join(f"{c} int" for c in names)).repartition(5)
    out = cloud.voxel_components(df, "v", tuple(names), diagonal)
    assert out.columns == ["v", *names, "component"]
    rows = out.withColumn("own", F.xxhash64("v", *names)).collect()
    groups = {}
    for x in rows:
        groups.setdefault(x.component, []).append(x)
    assert len(rows) == len(cells) and {frozenset(tuple(x[:-2]) for x in g) for g in groups.values()} == reached(cells, diagonal)
    assert all(c == min(x.own for x in g) for c, g in groups.items())


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    calls, plain = [], cloud.settled
    monkeypatch.setattr(cloud, "settled", lambda d: calls.append(1) or plain(d))
    df = spark.createDataFrame([(1, i - 100, 5, 5) for i in range(400)], "v int, i int, j int, k int")
    assert cloud.voxel_components(df, "v").select("component").distinct().count() == 1 and len(calls) <= 9
