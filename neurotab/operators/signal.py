"""Signals by recording and channel: filters, spectra, coupling, complexity, on NumPy kernels over keyed chunks.

A long recording is never one group. Samples go to chunks of a fixed number of
samples with a halo of neighbouring samples on both sides (``chunks``); a kernel
sees one chunk, and what it makes of the halo is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunks(df: DataFrame, index: str, size: int, halo: int) -> DataFrame:
    """Rows with ``chunk`` and ``inside``: each in its own chunk, and again, not inside, in chunks whose halo it is."""
    low, high = F.floor((F.col(index) - halo) / float(size)), F.floor((F.col(index) + halo) / float(size))
    d = df.withColumn("chunk", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
    return d.withColumn("inside", F.floor(F.col(index) / float(size)) == F.col("chunk"))


def first_rows(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Whether each row of a sorted table is the first of its group."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in names:
        code = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def whole_groups(batches, names: Sequence[str], rows: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of batches sorted by names: tables of about ``rows`` rows that cut no group, and whether each row is the first of its group."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        first = first_rows(table, names)
        end = int(np.flatnonzero(first)[-1])  # the last group may go on
        if end:
            yield table.slice(0, end), first[:end]
        held, n = table.slice(end).combine_chunks().to_batches(), table.num_rows - end
    if n:
        table = pa.Table.from_batches(held)
        yield table, first_rows(table, names)


def fir_bandpass(low: float, high: float, fs: float, taps: int) -> np.ndarray:
    """Hamming-windowed sinc band-pass of odd length, gain 1 at the middle of the band."""
    t = np.arange(taps) - (taps - 1) / 2
    h = (2 * high / fs * np.sinc(2 * high / fs * t) - 2 * low / fs * np.sinc(2 * low / fs * t)) * np.hamming(taps)
    return h / np.abs(np.sum(h * np.exp(-1j * np.pi * (low + high) / fs * t)))


def butterworth_sections(order: int, low: float, high: float, fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital Butterworth band-pass, by prewarping and the bilinear transform.

    The limits are kept at 0.01 Hz and 0.999 of half the rate. Of a wide band with an
    odd order, two poles are real; they make one section.
    """
    low, high = max(low, 0.01), min(high, 0.999 * fs / 2)
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    centre, width = w1 * w2, w2 - w1
    poles = []
    for k in range(order):
        p = width * np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) / 2
        root = np.sqrt(p * p - centre)
        poles += [p + root, p - root]
    z = [(2 * fs + p) / (2 * fs - p) for p in poles]
    real = [p.real for p in z if abs(p.imag) < 1e-12]
    pairs = [(2 * p.real, abs(p) ** 2) for p in sorted((p for p in z if p.imag >= 1e-12), key=lambda p: p.real)]
    pairs += [(p + q, p * q) for p, q in zip(real[::2], real[1::2])]
    sections = []
    middle = np.exp(2j * np.pi * np.sqrt(low * high) / fs) if low > 0 else 1.0
    for both, product in pairs:
        a = np.array([1.0, -both, product])
        b = np.array([1.0, 0.0, -1.0])
        gain = abs(np.polyval(b, middle) / np.polyval(a, middle))
        sections.append((b / gain, a))
    return sections


@lru_cache(64)
def _recursion(a1: float, a2: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Impulse response of a section's recursion, and the matrix that applies it to a block."""
    impulse = np.zeros(size)
    h0 = h1 = 0.0
    for i in range(size):
        impulse[i] = (1.0 if i == 0 else 0.0) - a1 * h0 - a2 * h1
        h0, h1 = impulse[i], h0
    i = np.arange(size)
    return impulse, np.where(i[:, None] >= i[None, :], impulse[np.abs(i[:, None] - i[None, :])], 0.0).T


def _run_section(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One section along the last axis in blocks: the recursion of a block is one matrix product."""
    n, size = x.shape[-1], 256
    impulse, mix = _recursion(float(a[1]), float(a[2]), size)
    first, second = -a[1] * impulse - a[2] * np.append(0.0, impulse[:-1]), -a[2] * impulse
    v = b[0] * x
    v[..., 1:] += b[1] * x[..., :-1]
    v[..., 2:] += b[2] * x[..., :-2]
    y, y1, y2 = np.empty(x.shape), np.zeros((*x.shape[:-1], 1)), np.zeros((*x.shape[:-1], 1))
    for s in range(0, n, size):
        m = min(size, n - s)
        y[..., s : s + m] = v[..., s : s + m] @ mix[:m, :m] + first[:m] * y1 + second[:m] * y2
        y1, y2 = y[..., s + m - 1 : s + m], y[..., s + m - 2 : s + m - 1] if m > 1 else y1
    return y


def zero_phase(x: np.ndarray, sections) -> np.ndarray:
    """Forward and backward through all sections along the last axis, with ends reflected oddly."""
    pad = min(x.shape[-1] - 1, 3 * (2 * len(sections) + 1))
    y = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], -1) if pad > 0 else x.astype(float)
    for _ in range(2):
        for b, a in sections:
            y = _run_section(b, a, y)
        y = y[..., ::-1]
    return y[..., pad : y.shape[-1] - pad] if pad > 0 else y


def decay(sections, small: float = 1e-8) -> int:
    """Samples after which the slowest pole has died down."""
    r = max(abs(np.roots(a)).max() for _, a in sections)
    return int(np.ceil(np.log(small) / np.log(r)))


def bandpass(df: DataFrame, keys: Sequence[str], index: str, value: str, fs: float, low: float, high: float, order: int = 3, size: int = 1 << 16) -> DataFrame:
    """keys, index and ``filtered``: zero-phase Butterworth band-pass, by chunks whose halo outlasts the filter's memory."""
    sections = butterworth_sections(order, low, high, fs)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keys, index))

    names = [*keys, "chunk"]

    def run(batches):
        for table, first in whole_groups(batches, names):
            x = table["_v"].to_numpy()
            y, start = np.empty(len(x)), np.flatnonzero(first)
            size = np.diff(np.append(start, len(x)))
            for n in np.unique(size):  # chunks of one length are one call
                at = start[size == n][:, None] + np.arange(n)
                y[at] = zero_phase(x[at], sections)
            out = table.select([*keys, index]).append_column("filtered", pa.array(y))
            yield from out.filter(table["inside"]).to_batches()

    c = chunks(df.select(*keys, index, F.col(value).cast("double").alias("_v")), index, size, decay(sections))
    return c.repartition(*names).sortWithinPartitions(*names, index).mapInArrow(run, f"{kinds}, filtered double")


def segment_spectra(x: np.ndarray, nperseg: int, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of the Hann-windowed, mean-free segments along the last axis (a new axis before it), and the window."""
    n = min(nperseg, x.shape[-1])
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    segments = np.lib.stride_tricks.sliding_window_view(x, n, axis=-1)[..., :: max(1, n - int(n * overlap)), :]
    return np.fft.rfft((segments - segments.mean(-1, keepdims=True)) * w), w


def welch_psd(x: np.ndarray, fs: float, nperseg: int, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Power density along the last axis by averaged Hann-windowed, mean-free segments."""
    spectra, w = segment_spectra(x, nperseg, overlap)
    n = len(w)
    density = np.abs(spectra) ** 2 / (fs * (w**2).sum())
    density[..., 1 : (None if n % 2 else -1)] *= 2
    return np.fft.rfftfreq(n, 1 / fs), density.mean(-2)


def band_powers(f: np.ndarray, p: np.ndarray, low: float, high: float, rule: str = "trapezoid") -> np.ndarray:
    """Power of a band along the last axis: trapezoid over both limits, or over frequencies strictly between them (strict); sum or mean of bins below the upper limit."""
    if rule in ("trapezoid", "strict"):
        k = (f >= low) & (f <= high) if rule == "trapezoid" else (f > low) & (f < high)
        q = p[..., k]
        return ((q[..., 1:] + q[..., :-1]) / 2 * np.diff(f[k])).sum(-1)
    k = (f >= low) & (f < high)
    return (p[..., k].sum(-1) if rule == "sum" else p[..., k].mean(-1)) if k.any() else np.zeros(p.shape[:-1])


def band_power(f: np.ndarray, p: np.ndarray, low: float, high: float, rule: str = "trapezoid") -> float:
    """The same of one spectrum."""
    return float(band_powers(f, p, low, high, rule))


def lempel_ziv(bits: np.ndarray) -> int:
    """Lempel-Ziv phrases, counted from 1: each is the shortest stretch that doesn't stand anywhere before it; an unfinished last one isn't counted."""
    s, n = bytes(bits.astype(np.uint8)), len(bits)
    count, at = 1, 0
    while at < n:
        size = 1
        while at + size <= n and s.find(s[at : at + size], 0, at) >= 0:
            size += 1
        if at + size > n:
            break
        count, at = count + 1, at + size
    return count


def hilbert(x: np.ndarray) -> np.ndarray:
    """Analytic signal along the last axis."""
    n = x.shape[-1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def couplings(phase: np.ndarray, amplitude: np.ndarray, bins: int = 18) -> np.ndarray:
    """Modulation index of each row: mean amplitude over phase bins; an empty bin counts as 0."""
    k = np.minimum(((phase + np.pi) / (2 * np.pi) * bins).astype(int), bins - 1)
    k = (k + bins * np.arange(len(k))[:, None]).ravel()
    n = np.bincount(k, minlength=bins * len(phase))
    m = (np.bincount(k, amplitude.ravel(), bins * len(phase)) / np.maximum(n, 1)).reshape(-1, bins)
    total = m.sum(1, keepdims=True)
    p = np.where(total > 0, m / np.where(total > 0, total, 1.0), 1 / bins)
    return (np.log(bins) + (p * np.log(np.where(p > 0, p, 1.0))).sum(1)) / np.log(bins)


def coupling(phase: np.ndarray, amplitude: np.ndarray, bins: int = 18) -> float:
    """The same of one signal."""
    return float(couplings(phase[None], amplitude[None], bins)[0])


def coherence(x: np.ndarray, y: np.ndarray, fs: float, nperseg: int, low: float, high: float) -> float:
    """Mean coherence of two signals in a band, limits included."""
    n = min(nperseg, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    a, b = (np.fft.rfft((s - s.mean(1, keepdims=True)) * w) for s in (np.lib.stride_tricks.sliding_window_view(v, n)[:: max(1, n // 2)] for v in (x, y)))
    pxy, pxx, pyy = (a * b.conj()).mean(0), (abs(a) ** 2).mean(0), (abs(b) ** 2).mean(0)
    f = np.fft.rfftfreq(n, 1 / fs)
    k = (f >= low) & (f <= high)
    return float(np.mean(abs(pxy[k]) ** 2 / np.maximum(pxx[k] * pyy[k], 1e-300))) if k.any() else 0.0


def morlet_power(x: np.ndarray, fs: float, freqs: Sequence[float], cycles: float = 3.0) -> np.ndarray:
    """Power at each frequency and sample, by convolution with unit-energy Morlet wavelets."""
    out = np.empty((len(freqs), len(x)))
    for i, f in enumerate(freqs):
        sd = cycles / (2 * np.pi * f)
        t = np.arange(-int(5 * sd * fs), int(5 * sd * fs) + 1) / fs
        w = np.exp(2j * np.pi * f * t - t * t / (2 * sd * sd))
        w /= np.sqrt((abs(w) ** 2).sum() / 2)
        n = len(x) + len(w) - 1
        y = np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(w, n))
        out[i] = abs(y[(len(w) - 1) // 2 :][: len(x)]) ** 2
    return out


def detect_spikes(df: DataFrame, keys: Sequence[str], index: str, value: str, k: float = 4.0, dead: int = 30) -> DataFrame:
    """Samples under -k times the MAD scale, kept greedily more than ``dead`` samples apart."""
    from neurotab.operators.sequence import refractory

    med = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    mad = df.join(med, list(keys)).groupBy(*keys).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("_m")))).alias("_s"))
    low = df.join(mad, list(keys)).where(F.col(value) < -k * F.col("_s")).select(*keys, F.col(index).cast("double").alias(index))
    return refractory(low, keys, index, float(dead))


def waveforms(spikes: DataFrame, df: DataFrame, keys: Sequence[str], index: str, value: str, before: int, after: int) -> DataFrame:
    """Samples [spike - before, spike + after) as an array; spikes whose window isn't whole are dropped."""
    from neurotab.operators.ranges import interval_join

    j = interval_join(spikes.select(*keys, F.col(index).alias("spike")), df.select(*keys, F.col(index).cast("double").alias(index), value), keys, "spike", index, float(before), float(after))
    g = j.groupBy(*keys, "spike").agg(F.array_sort(F.collect_list(F.struct("rel", F.col(value).alias("v")))).alias("_w"))
    return g.where(F.size("_w") == before + after).select(*keys, "spike", F.transform("_w", lambda s: s.v).alias("waveform"))


def waveform_features(df: DataFrame) -> DataFrame:
    """Peak to peak, trough, peak and energy of each waveform."""
    w = F.col("waveform")
    return df.withColumns({"p2p": F.array_max(w) - F.array_min(w), "trough": F.array_min(w), "peak": F.array_max(w), "energy": F.aggregate(w, F.lit(0.0), lambda s, v: s + v * v)})


def interval_violations(spikes: DataFrame, keys: Sequence[str], index: str, fs: float, refractory_ms: float = 1.5, few: float | None = 0.0) -> DataFrame:
    """keys, n_spikes and the percentage of intervals strictly under the refractory time; ``few`` where there are less than two spikes.

    An interval is too short if the spike before lies within that time, so keys are
    cut to stretches of 1,000 refractory times with a halo of one: no key is one task.
    """
    from pyspark.sql import Window

    gap = refractory_ms * 1e-3 * fs
    t, width = F.col(index).cast("double"), 1000 * gap
    s = spikes.select(*keys, t.alias("_t"), F.explode(F.sequence(F.floor(t / width), F.floor((t + gap) / width))).alias("_b"))
    before = F.lag("_t").over(Window.partitionBy(*keys, "_b").orderBy("_t"))
    s = s.withColumn("_short", (F.col("_t") - before) / fs < refractory_ms * 1e-3).where(F.col("_b") == F.floor(F.col("_t") / width))
    n, short = F.count("*"), F.sum(F.coalesce(F.col("_short").cast("double"), F.lit(0.0)))
    return s.groupBy(*keys).agg(n.alias("n_spikes"), F.when(n < 2, F.lit(few)).otherwise(short / (n - 1) * 100).cast("double").alias("isi_violation"))


def signal_to_noise(waves: DataFrame, keys: Sequence[str], waveform: str = "waveform") -> DataFrame:
    """Four ratios of a cluster's waveforms of equal length.

    snr_baseline: mean peak to peak over twice the deviation of the first fifth of
    samples, infinite without noise. snr_residual: peak to peak of the mean waveform
    over twice the median over samples of the residual deviation (plus 1e-12).
    snr_single: the same without the factor of two, null without noise. snr_peak:
    largest mean magnitude over the deviation of the first five samples, null without
    noise. Deviations are those of the population. Clusters without a waveform have no row.
    """
    w = F.col(waveform)
    p2p = waves.where(F.size(w) > 0).withColumns({"_p2p": F.array_max(w) - F.array_min(w), "_fifth": F.greatest(F.lit(1), F.floor(F.size(w) / 5))})
    v = p2p.select(*keys, "_p2p", "_fifth", F.posexplode(w).alias("_i", "_v"))
    by_place = v.groupBy(*keys, "_i").agg(F.avg("_v").alias("_m"), F.stddev_pop("_v").alias("_r"))
    shape = by_place.groupBy(*keys).agg((F.max("_m") - F.min("_m")).alias("_mp"), F.max(F.abs("_m")).alias("_top"), F.median("_r").alias("_noise"))
    every = v.groupBy(*keys).agg(F.avg("_p2p").alias("_ap"), F.stddev_pop(F.when(F.col("_i") < F.col("_fifth"), F.col("_v"))).alias("_base"), F.stddev_pop(F.when(F.col("_i") < 5, F.col("_v"))).alias("_five"))
    ratios = {
        "snr_baseline": F.when(F.col("_base") <= 1e-12, F.lit(float("inf"))).otherwise(F.col("_ap") / (2 * F.col("_base"))),
        "snr_residual": F.col("_mp") / (2 * (F.col("_noise") + 1e-12)),
        "snr_single": F.when(F.col("_noise") > 0, F.col("_mp") / F.col("_noise")),
        "snr_peak": F.when(F.col("_five") > 0, F.col("_top") / F.col("_five")),
    }
    return shape.join(every, list(keys)).select(*keys, *(c.alias(n) for n, c in ratios.items()))


def cluster_quality(spikes: DataFrame, waves: DataFrame, keys: Sequence[str], index: str, fs: float, refractory_ms: float = 1.5, few: float | None = 0.0) -> DataFrame:
    """Number of spikes, interval violations and signal-to-noise ratios of each cluster; ratios are NaN where it has no waveform."""
    ratios = ("snr_baseline", "snr_residual", "snr_single", "snr_peak")
    none = signal_to_noise(waves, keys).withColumn("_known", F.lit(True))
    j = interval_violations(spikes, keys, index, fs, refractory_ms, few).join(none, list(keys), "left")
    return j.withColumns({c: F.when(F.col("_known").isNull(), F.lit(float("nan"))).otherwise(F.col(c)) for c in ratios}).drop("_known")


def average_reference(df: DataFrame, at: Sequence[str], value: str) -> DataFrame:
    """Values minus the mean over channels at the same place."""
    from pyspark.sql import Window

    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*at)))


def baseline(df: DataFrame, keys: Sequence[str], time: str, value: str, low: float, high: float) -> DataFrame:
    """Values minus the mean of their key's rows with low <= time <= high."""
    from pyspark.sql import Window

    inside = F.when(F.col(time).between(low, high), F.col(value))
    return df.withColumn(value, F.col(value) - F.avg(inside).over(Window.partitionBy(*keys)))


def laterality(df: DataFrame, keys: Sequence[str], channel: str, value: str, ipsi: Sequence[str], contra: Sequence[str]) -> DataFrame:
    """-(a - b) / (|a| + |b|) of the mean over ipsilateral and contralateral channels; 0 where both are 0."""
    a, b = (F.avg(F.when(F.col(channel).isin(*s), F.col(value))) for s in (ipsi, contra))
    size = F.abs(a) + F.abs(b)
    return df.groupBy(*keys).agg(F.when(size == 0, 0.0).otherwise(-(a - b) / size).alias("laterality"))


def fir_filter(df: DataFrame, keys: Sequence[str], index: str, value: str, taps: np.ndarray, size: int = 1 << 16) -> DataFrame:
    """keys, index and ``filtered``: convolution with symmetric taps, the delay taken out, in chunks with a halo of half the taps.

    The ends of a recording are reflected oddly, and padded with zeros where it is shorter than half the taps.
    """
    half = len(taps) // 2
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keys, index))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        x = pdf[value].to_numpy(float)
        pad = min(half, len(x) - 1)
        around = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
        pdf["filtered"] = np.convolve(np.pad(around, half - pad), taps, "valid")[: len(x)]
        return pdf.loc[pdf.inside, [*keys, index, "filtered"]]

    c = chunks(df.select(*keys, index, value), index, size, half)
    return c.groupBy(*keys, "chunk").applyInPandas(kernel, f"{kinds}, filtered double")


def clean_lfp(df: DataFrame, keys: Sequence[str], index: str, value: str, fs: float, target: float = 500.0, low: float = 1.0, high: float = 150.0, order: int = 3, size: int = 1 << 16) -> DataFrame:
    """keys, index (at the lower rate) and ``cleaned``: zeros and missing values are interpolated, then band-passed, then every q-th sample stays.

    The upper limit is kept at 0.8 of half the target rate, so that nothing aliases.
    Gaps at the ends take the nearest value, as do gaps longer than a chunk's halo;
    a chunk without any value gives nulls.
    """
    q = max(1, round(fs / target))
    sections = butterworth_sections(order, low, min(high, 0.8 * fs / q / 2), fs)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        x = pdf[value].to_numpy(float)
        there = np.isfinite(x) & (x != 0)
        at = np.arange(len(x))
        pdf["cleaned"] = zero_phase(np.interp(at, at[there], x[there]), sections) if there.any() else np.nan
        out = pdf.loc[pdf.inside & (pdf[index] % q == 0), [*keys, index, "cleaned"]]
        return out.assign(**{index: out[index] // q})

    c = chunks(df.select(*keys, index, value), index, size, decay(sections))
    return c.groupBy(*keys, "chunk").applyInPandas(kernel, f"{kinds}, {index} long, cleaned double")


def stage_rates(spikes: DataFrame, keys: Sequence[str], time: str, stages: dict[str, tuple[float, float]]) -> DataFrame:
    """n_<stage> and rate_<stage> of each key: spikes with start <= time < end, and these over the stage's length."""
    out = []
    for name, (start, end) in stages.items():
        n = F.count(F.when((F.col(time) >= start) & (F.col(time) < end), 1))
        out += [n.alias(f"n_{name}"), (n / F.lit(float(end - start)) if end > start else F.lit(None).cast("double")).alias(f"rate_{name}")]
    return spikes.groupBy(*keys).agg(*out)


def population(tables: dict[str, DataFrame], cluster: str = "cluster", count: str = "spike_count", more_than: int = 50) -> DataFrame:
    """Units of all recordings with more than so many spikes, as recording, neuron_id (recording_c and the cluster) and their columns.

    Tables without the two columns are skipped, columns that a table lacks are null.
    """
    whole = {name: t for name, t in tables.items() if {cluster, count} <= set(t.columns)}
    if not whole:
        raise ValueError(f"no table has the columns {cluster} and {count}")
    parts = [t.where(F.col(count) > more_than).withColumn("recording", F.lit(name)) for name, t in whole.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("neuron_id", F.concat("recording", F.lit("_c"), F.col(cluster).cast("string")))
