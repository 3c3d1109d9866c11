"""Features of sliding windows: spectra, coupling, complexity, synchrony of channels.

Samples go to blocks of consecutive windows, each sample to the few blocks whose
windows it lies in; a block's windows are one strided array, so filters are designed
once and spectra of all windows are one call. No recording is one task.

Windows [w * step, w * step + width) count from index 0, and exist where all their
samples do. A repeated index counts once, as the mean of its values.

Synchrony keeps each window's and channel's segment spectra as a table and forms
cross spectra by pairs of channel blocks, so neither all channels of a window nor
all pairs are in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from neurotab.operators import signal

SAMPLES = 1 << 16  # of a block, about


def blocks(df: DataFrame, index: str, width: int, step: int) -> tuple[DataFrame, int]:
    """Rows with ``_block``, once for each block of windows that they lie in, and the number of windows of a block."""
    per = max(1, SAMPLES // step)
    stride = per * step
    low = F.greatest(F.lit(0), F.ceil((F.col(index) - (stride - step + width) + 1) / float(stride)))
    high = F.floor(F.col(index) / float(stride))
    return df.where(F.col(index) >= 0).withColumn("_block", F.explode(F.sequence(low, high))), per


def laid_out(index: np.ndarray, value: np.ndarray, start: int) -> np.ndarray:
    """Values by index from start on, NaN where there is none, means where there are several."""
    at = index - start
    known = np.isfinite(value)
    n = np.bincount(at[known], minlength=int(at.max()) + 1).astype(float)
    total = np.bincount(at[known], value[known], int(at.max()) + 1)
    return np.divide(total, n, out=np.full(len(n), np.nan), where=n > 0)


def strided(x: np.ndarray, width: int, step: int, per: int) -> np.ndarray:
    """The windows of a block, one a row, as far as the values go."""
    if len(x) < width:
        return np.empty((0, width))
    return np.lib.stride_tricks.sliding_window_view(x, width)[::step][:per]


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def _over_windows(df: DataFrame, keys: Sequence[str], index: str, value: str, width: int, step: int, schema: str, kernel) -> DataFrame:
    """Rows of kernel(windows as rows) with keys and win; kernel gives a frame whose column ``_w`` is the row of the window.

    Blocks come sorted, and the windows of as many blocks as make ``SAMPLES`` samples
    are one call, so short recordings don't cost a call each. A block is never cut.
    """
    cut, per = blocks(df.select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_v")), "_i", width, step)
    names = [*keys, "_block"]

    def whole(table: pa.Table, first: np.ndarray):
        block = table["_block"].to_numpy()
        group, at, v = np.cumsum(first) - 1, table["_i"].to_numpy() - block * per * step, table["_v"].to_numpy()
        known = np.isfinite(v)
        group, at, v = group[known], at[known], v[known]
        if len(v) < width:
            return
        one = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(at) != 0)))
        group, at, v = group[one], at[one], np.add.reduceat(v, one) / np.diff(np.append(one, len(v)))
        p = np.flatnonzero((at % step == 0) & (at // step < per))
        p = p[p + width <= len(v)]
        p = p[(group[p + width - 1] == group[p]) & (at[p + width - 1] - at[p] == width - 1)]  # no index lacks between
        if not len(p):
            return
        out = kernel(np.lib.stride_tricks.sliding_window_view(v, width)[p])
        w = p[out.pop("_w").to_numpy(int)]
        rows = np.flatnonzero(first)[group[w]]
        own = [table[c].combine_chunks().take(pa.array(rows)) for c in keys]
        win = block[rows] * per + at[w] // step
        yield pa.RecordBatch.from_arrays([*own, pa.array(win), *(pa.array(out[c].to_numpy(float)) for c in out)], [*keys, "win", *out.columns])

    def run(batches):
        for table, first in signal.whole_groups(batches, names, SAMPLES):
            yield from whole(table, first)

    ordered = cut.repartition(*names).sortWithinPartitions(*names, "_i")
    return ordered.mapInArrow(run, ", ".join(filter(None, [_kinds(df, keys), "win long", schema])))


def window_features(df: DataFrame, keys: Sequence[str], index: str, value: str, fs: float, width: int, step: int, bands: dict[str, tuple[float, float]], rule: str = "trapezoid", nperseg: int | None = None, per_sample: bool = False) -> DataFrame:
    """Log band powers, phase-amplitude coupling (first band, last band) and Lempel-Ziv complexity of each whole window of the series.

    Segments of the spectrum last two seconds or ``nperseg`` samples. The complexity is
    c / (n / log2 n) of c phrases in n samples, or c / n with ``per_sample``.
    """
    names = list(bands)
    slow, fast = (signal.butterworth_sections(2, *bands[n], fs) for n in (names[0], names[-1]))

    def kernel(x: np.ndarray) -> pd.DataFrame:
        out = {"_w": np.arange(len(x))}
        if len(x):
            f, p = signal.welch_psd(x, fs, min(nperseg or int(2 * fs), width))
            for n in names:
                out[f"log_{n}"] = np.log(signal.band_powers(f, p, *bands[n], rule) + 1e-12)
            phase, size = np.angle(signal.hilbert(signal.zero_phase(x, slow))), abs(signal.hilbert(signal.zero_phase(x, fast)))
            out["coupling"] = signal.couplings(phase, size)
            high = x > np.median(x, 1, keepdims=True)
            out["lzc"] = [signal.lempel_ziv(bits) / (width if per_sample else width / np.log2(width)) for bits in high]
        return pd.DataFrame(out, columns=["_w", *(f"log_{n}" for n in names), "coupling", "lzc"])

    more = ", ".join(f"log_{n} double" for n in names)
    return _over_windows(df, keys, index, value, width, step, f"{more}, coupling double, lzc double", kernel)


def spectrogram(df: DataFrame, keys: Sequence[str], index: str, value: str, fs: float, width: int, step: int, top: float) -> DataFrame:
    """keys, win, freq, db of each whole window, up to ``top`` Hz."""

    def kernel(x: np.ndarray) -> pd.DataFrame:
        f = np.fft.rfftfreq(width, 1 / fs)
        k = f <= top
        p = signal.welch_psd(x, fs, width)[1][:, k] if len(x) else np.empty((0, int(k.sum())))
        return pd.DataFrame({"_w": np.repeat(np.arange(len(x)), int(k.sum())), "freq": np.tile(f[k], len(x)), "db": 10 * np.log10(p.ravel() + 1e-20)})

    return _over_windows(df, keys, index, value, width, step, "freq double, db double", kernel)


def channel_spectra(df: DataFrame, keys: Sequence[str], channel: str, index: str, value: str, fs: float, width: int, step: int, low: float, high: float) -> DataFrame:
    """keys, channel, win, whole, re, im: segment spectra of each window with at least half of its samples, between two frequencies.

    Segments last two seconds and overlap by half; re and im hold them one after
    another. Missing samples of a window are interpolated, at its ends by the nearest value.
    """
    cut, per = blocks(df.select(*keys, channel, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_v")), "_i", width, step)
    nperseg = min(int(2 * fs), width)
    f = np.fft.rfftfreq(nperseg, 1 / fs)
    bins = (f >= low) & (f <= high)
    length = (per - 1) * step + width

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[-1].as_py()
        x = laid_out(table["_i"].to_numpy(), table["_v"].to_numpy(), block * per * step)
        w = strided(np.pad(x, (0, max(0, length - len(x))), constant_values=np.nan), width, step, per).copy()
        there = np.isfinite(w).sum(1)
        kept = np.flatnonzero(2 * there >= width)
        for i in kept[there[kept] < width]:
            at = np.flatnonzero(np.isfinite(w[i]))
            w[i] = np.interp(np.arange(width), at, w[i][at])
        s = signal.segment_spectra(w[kept], nperseg)[0][..., bins].reshape(len(kept), -1) if len(kept) else np.empty((0, 0), complex)
        offsets = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * s.shape[1])
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(p).ravel())) for p in (s.real, s.imag)]
        columns = {c: pa.array([v.as_py()] * len(kept), v.type) for c, v in zip([*keys, channel], key)}
        return pa.table(columns | {"win": pa.array(block * per + kept), "whole": pa.array(there[kept] == width), "re": lists[0], "im": lists[1]})

    return cut.groupBy(*keys, channel, "_block").applyInArrow(run, f"{_kinds(df, [*keys, channel])}, win long, whole boolean, re array<double>, im array<double>")


def synchrony(df: DataFrame, keys: Sequence[str], channel: str, index: str, value: str, fs: float, width: int, step: int, bands: dict[str, tuple[float, float]], side: int = 64) -> DataFrame:
    """keys, win, n_channels, n_whole and sync_<band>: mean coherence over all pairs of channels in each window with a whole channel; null with one channel.

    Channels that lack samples of a window take part by interpolation if half of them
    are there; n_whole counts those without a gap. Channels are dealt to blocks of
    about ``side`` by hash, and a task holds the spectra of one window and two blocks.
    """
    names = list(bands)
    low, high = min(b[0] for b in bands.values()), max(b[1] for b in bands.values())
    f = np.fft.rfftfreq(min(int(2 * fs), width), 1 / fs)
    f = f[(f >= low) & (f <= high)]
    inside = {n: (f >= bands[n][0]) & (f <= bands[n][1]) for n in names}
    spectra = channel_spectra(df, keys, channel, index, value, fs, width, step, low, high)
    # as many blocks as the recording with most channels needs: one number reaches the driver
    most = df.groupBy(*keys).agg(F.count_distinct(channel).alias("n")).agg(F.max("n")).first()[0] or 1
    groups = -(-most // side)
    own = F.pmod(F.xxhash64(channel), F.lit(groups)).cast("int")
    pairs = spectra.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = pairs.withColumns({"_a": F.least("_own", "_other"), "_b": F.greatest("_own", "_other")})

    def run(table: pa.Table) -> pa.Table:
        first = {c: table[c][0] for c in [*keys, "win", "_a", "_b"]}
        x = table["re"].combine_chunks().flatten().to_numpy() + 1j * table["im"].combine_chunks().flatten().to_numpy()
        x = x.reshape(table.num_rows, -1, len(f)).transpose(2, 0, 1)  # bin, channel, segment
        mine = table["_own"].to_numpy() == first["_a"].as_py()
        left, right = x[:, mine], x[:, ~mine] if first["_a"].as_py() != first["_b"].as_py() else x
        cross = abs(left @ right.conj().transpose(0, 2, 1)) ** 2
        power = [(abs(s) ** 2).sum(2) for s in (left, right)]
        c = cross / np.maximum(power[0][:, :, None] * power[1][:, None, :], 1e-300)
        if first["_a"].as_py() == first["_b"].as_py():
            c *= np.triu(np.ones(c.shape[1:]), 1)
            n = len(left[0]) * (len(left[0]) - 1) // 2
        else:
            n = c.shape[1] * c.shape[2]
        once = first["_a"].as_py() == first["_b"].as_py()
        columns = {k: pa.array([v.as_py()], v.type) for k, v in first.items() if k[0] != "_"}
        columns |= {"_pairs": pa.array([n]), "_n": pa.array([table.num_rows if once else 0]), "_whole": pa.array([sum(table["whole"].to_pylist()) if once else 0])}
        return pa.table(columns | {f"_{b}": pa.array([float(c[inside[b]].mean(0).sum()) if inside[b].any() else 0.0]) for b in names})

    sums = pairs.groupBy(*keys, "win", "_a", "_b").applyInArrow(run, ", ".join(filter(None, [_kinds(df, keys), "win long, _pairs long, _n long, _whole long", *(f"_{b} double" for b in names)])))
    g = sums.groupBy(*keys, "win").agg(*(F.sum(c).alias(c) for c in ("_pairs", "_n", "_whole", *(f"_{b}" for b in names)))).where("_whole > 0")
    mean = lambda b: F.when(F.col("_pairs") > 0, F.col(f"_{b}") / F.col("_pairs")) if inside[b].any() else F.lit(None).cast("double")
    return g.select(*keys, "win", F.col("_n").alias("n_channels"), F.col("_whole").alias("n_whole"), *(mean(b).alias(f"sync_{b}") for b in names))


def channel_features(df: DataFrame, keys: Sequence[str], channel: str, index: str, value: str, fs: float, width: int, step: int, bands: dict[str, tuple[float, float]], sync: Sequence[str], rule: str = "trapezoid") -> DataFrame:
    """The whole feature vector of each window: ``window_features`` of the mean over channels (those with a value), and ``synchrony`` of all channels in the bands of ``sync``."""
    mean = df.groupBy(*keys, index).agg(F.avg(F.when(~F.isnan(F.col(value).cast("double")), F.col(value))).alias(value))
    features = window_features(mean, keys, index, value, fs, width, step, bands, rule)
    both = synchrony(df, keys, channel, index, value, fs, width, step, {b: bands[b] for b in sync})
    return features.join(both, [*keys, "win"], "left")


@F.pandas_udf(LongType())
def _rows(n: pd.Series) -> pd.Series:
    """The largest divisor of n up to its square root; 1 for recordings of up to ``SAMPLES``, which are transformed at once."""

    def one(v: int) -> int:
        d = int(v**0.5) if v > SAMPLES else 1
        while v % d:
            d -= 1
        return d

    return n.map(one)


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with the row of right of the same keys; without keys right has one row."""
    return left.join(right, list(keys)) if keys else left.join(F.broadcast(right), F.lit(True))


def spectrum(df: DataFrame, keys: Sequence[str], index: str, value: str, common: Sequence[str] | None = None) -> DataFrame:
    """keys, k, n, re, im: the discrete Fourier transform of whole recordings, 0 <= k < n.

    Up to ``SAMPLES`` samples are one transform. Longer recordings take two steps over
    n = a * b samples: samples of one residue modulo a are transformed by length b,
    turned, and those of one place by length a, so a task holds about the square root
    of a recording. A prime n has a = 1 and takes one task. Indexes run from 0 without a gap; recordings that have one aren't returned.

    With ``common``, some of keys, n is that of the longest recording with the same
    values of these, so all have the same frequencies. A shorter one goes on with its
    mean, which adds no step at its end; none is cut.
    """
    s = df.select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_v")).where("_v is not null")
    for c in keys:  # the join below drops null keys; dropped here, both of its sides read the same rows once
        s = s.where(F.col(c).isNotNull())
    sizes = s.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_i").alias("_lo"), F.max("_i").alias("_hi"), F.count_distinct("_i").alias("_d"), F.avg("_v").alias("_mean")).where("_lo = 0 and _hi = n - 1 and _d = n")
    if common is None:
        sizes = sizes.withColumn("_fill", F.lit(0.0))
    else:
        # a window, since a join would read the table anew; without keys all recordings would be one task of it
        sizes = sizes.withColumn("_most", F.max("n").over(Window.partitionBy(*common))) if common else _joined(sizes, sizes.agg(F.max("n").alias("_most")), [])
        sizes = sizes.withColumn("_fill", F.when(F.col("n") < F.col("_most"), F.col("_mean")).otherwise(0.0)).withColumn("n", F.col("_most"))
    s = _joined(s, sizes.select(*keys, "n", _rows("n").alias("_a"), "_fill"), keys)
    s = s.withColumn("_v", F.col("_v") - F.col("_fill"))  # what is added are zeros; the mean comes back at k = 0
    own = [*keys, "n", "_a", "_fill"]
    kinds = ", ".join(filter(None, [_kinds(df, keys), "n long, _a long, _fill double"]))

    def short(table: pa.Table, at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        laid = np.zeros(size, complex)
        laid[at] = x
        return np.fft.fft(laid)

    def columns(table: pa.Table, rows: int) -> dict:
        return {c: pa.array([table[c][0].as_py()] * rows, table.schema.field(c).type) for c in own}

    def result(table: pa.Table, k: np.ndarray, x: np.ndarray) -> pa.Table:
        out = columns(table, len(k))
        x[k == 0] += out["n"][0].as_py() * out.pop("_fill")[0].as_py()
        out.pop("_a")
        return pa.table(out | {"k": pa.array(k), "re": pa.array(x.real.copy()), "im": pa.array(x.imag.copy())})

    def inner(table: pa.Table) -> pa.Table:
        n, a, r = (table[c][0].as_py() for c in ("n", "_a", "_r"))
        y = short(table, table["_i"].to_numpy() // a, table["_v"].to_numpy(), n // a) * np.exp(-2j * np.pi * r * np.arange(n // a) / n)
        return pa.table(columns(table, n // a) | {"_r": pa.array([r] * (n // a), pa.int64()), "_k": pa.array(np.arange(n // a)), "re": pa.array(y.real.copy()), "im": pa.array(y.imag.copy())})

    def outer(table: pa.Table) -> pa.Table:
        n, a, k = (table[c][0].as_py() for c in ("n", "_a", "_k"))
        x = short(table, table["_r"].to_numpy(), table["re"].to_numpy() + 1j * table["im"].to_numpy(), a)
        return result(table, k + n // a * np.arange(a), x)

    def once(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        return result(table, np.arange(n), short(table, table["_i"].to_numpy(), table["_v"].to_numpy(), n))

    schema = ", ".join(filter(None, [_kinds(df, keys), "n long, k long, re double, im double"]))
    whole = s.where("_a = 1").groupBy(*keys, "n").applyInArrow(once, schema)
    first = s.where("_a > 1").withColumn("_r", F.col("_i") % F.col("_a")).groupBy(*keys, "_r").applyInArrow(inner, f"{kinds}, _r long, _k long, re double, im double")
    return whole.unionByName(first.groupBy(*keys, "_k").applyInArrow(outer, schema))


def coherence_matrix(df: DataFrame, keys: Sequence[str], channel: str, index: str, value: str, fs: float, low: float, high: float) -> DataFrame:
    """keys, a, b, coherence of all pairs of channels (a <= b) of whole recordings, from mean spectra of the band low < f < high.

    Mean |X * conj(Y)| squared over the product of mean |X| ** 2 and |Y| ** 2 (plus
    1e-9); a channel whose band is empty is left out. Bins go to groups, each of which
    adds one matrix of sums; channels with gaps are left out, as in ``spectrum``. A
    channel that ends before the longest one of its recording goes on with its mean.
    """
    s = spectrum(df, [*keys, channel], index, value, keys)
    f = F.col("k") * fs / F.col("n")
    band = s.where((F.col("k") < (F.col("n") + 1) / 2) & (f > low) & (f < high)).select(*keys, channel, "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_m"))
    kind = df.schema[channel].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        pdf = table.select([channel, "k", "_m"]).to_pandas().pivot(index=channel, columns="k", values="_m")  # all channels have all bins
        m = pdf.to_numpy()
        i, j = np.triu_indices(len(m))
        names = pa.array(pdf.index.to_list(), table.schema.field(channel).type)
        first = {c: pa.array([table[c][0].as_py()] * len(i), table.schema.field(c).type) for c in keys}
        return pa.table(first | {"a": names.take(pa.array(i)), "b": names.take(pa.array(j)), "cross": pa.array((m @ m.T)[i, j]), "bins": pa.array([m.shape[1]] * len(i), pa.int64())})

    parts = band.groupBy(*keys, F.floor(F.col("k") / 256)).applyInArrow(run, ", ".join(filter(None, [_kinds(df, keys), f"a {kind}, b {kind}, cross double, bins long"])))
    g = parts.groupBy(*keys, "a", "b").agg(F.sum("cross").alias("_s"), F.sum("bins").alias("_n"))
    own = g.where(F.col("a") == F.col("b"))
    for c in "ab":
        g = g.join(own.select(*keys, F.col("a").alias(c), (F.col("_s") / F.col("_n")).alias(f"_p{c}")), [*keys, c])
    mean = F.col("_s") / F.col("_n")
    return g.select(*keys, "a", "b", (mean * mean / (F.col("_pa") * F.col("_pb") + 1e-9)).alias("coherence"))
