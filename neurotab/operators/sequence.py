"""Ordered label sequences: runs, bouts, alternation, transitions, occupancy.

All of them share one layout, rows of (key, order, label), and one window,
``partitionBy(key).orderBy(order)``, so that chained operators shuffle once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def entries(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, first: str | None = None) -> DataFrame:
    """Rows where the label differs from the one before; ``first`` is the label assumed before the first row."""
    before = F.lag(label, 1, first).over(_over(keys, order))
    return df.withColumn("_before", before).where(~F.col(label).eqNullSafe(F.col("_before"))).drop("_before")


def alternation(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Share (percent) of consecutive label triples that hold three different labels; 0 with under three entries."""
    w = _over(keys, order)
    e = df.select(*keys, F.col(label).alias("a"), F.lead(label, 1).over(w).alias("b"), F.lead(label, 2).over(w).alias("c"))
    differs = (F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c"))
    return e.groupBy(*keys).agg(
        F.count("a").alias("n_entries"),
        F.coalesce(F.avg(F.when(F.col("c").isNotNull(), differs.cast("double"))) * 100.0, F.lit(0.0)).alias("alternation_pct"),
    )


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Counts and row-normalised probabilities of label pairs that follow one another."""
    pairs = df.select(*keys, F.col(label).alias("from_state"), F.lead(label).over(_over(keys, order)).alias("to_state"))
    n = pairs.where("from_state is not null and to_state is not null").groupBy(*keys, "from_state", "to_state").agg(F.count("*").alias("n"))
    return n.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "from_state")))


def occupancy(df: DataFrame, keys: Sequence[str], label: str, noise: Column | None = None) -> DataFrame:
    """Share of rows by label, without rows for which ``noise`` holds."""
    kept = df if noise is None else df.where(~noise)
    n = kept.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def bouts(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, label: str) -> DataFrame:
    """Run-length encoding: start of each run of one label and its duration to the next run (the last one: to its last row)."""
    w = _over(keys, order)
    change = F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(1))
    runs = df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w))
    b = runs.groupBy(*keys, "run", label).agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("n"))
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("run"))
    return b.withColumn("duration", F.coalesce(following, F.col("last")) - F.col("start")).drop("last")


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Last non-null value up to each row; null before the first one."""
    w = _over(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def centred_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, out: str) -> DataFrame:
    """Mean of the rows around each row that exist; an even width reaches one row further back than ahead."""
    w = _over(keys, order).rowsBetween(-(width // 2), width - width // 2 - 1)
    return df.withColumn(out, F.avg(value).over(w))


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, out: str) -> DataFrame:
    """Sum of the rows around each row over the full width: what lies beyond the ends counts as 0."""
    w = _over(keys, order).rowsBetween(-(width // 2), width - width // 2 - 1)
    return df.withColumn(out, F.sum(value).over(w) / float(width))


def weighted_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, sigma: float, out: str) -> DataFrame:
    """Gaussian smoothing cut at four sigma, with the series reflected at its ends (d c b a | a b c d | d c b a).

    Each row takes its neighbours from a window frame, which holds all places that a
    reflection leads to. Equal rows each keep a result; null values weigh nothing,
    and where all are null the mean is null.
    """
    from math import exp

    reach = int(4 * sigma + 0.5)
    weights = [exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    total, w = sum(weights), _over(keys, order)
    taps = F.array(*(F.struct(F.lit(k - reach).alias("o"), F.lit(g / total).alias("g")) for k, g in enumerate(weights)))
    d = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)).cast("int"))
    d = d.withColumn("_f", F.collect_list(F.struct(F.col(value).cast("double").alias("v"))).over(w.rowsBetween(-reach, reach)))

    def term(t):
        turn = F.pmod(F.col("_i") + t.o, 2 * F.col("_n"))
        source = F.when(turn < F.col("_n"), turn).otherwise(2 * F.col("_n") - 1 - turn)
        return F.coalesce(F.get("_f", source - F.greatest(F.col("_i") - reach, F.lit(0))).v * t.g, F.lit(0.0))

    mean = F.aggregate(F.transform(taps, term), F.lit(0.0), lambda x, y: x + y)
    return d.withColumn(out, F.when(F.exists("_f", lambda x: x.v.isNotNull()), mean)).drop("_i", "_n", "_f")


def rising_edges(df: DataFrame, keys: Sequence[str], order: Sequence[str], above: Column) -> DataFrame:
    """Rows where ``above`` holds and didn't hold in the row before (the first row counts as not above before)."""
    now = df.withColumn("_now", F.coalesce(above, F.lit(False)))
    return now.withColumn("_was", F.lag("_now", 1, False).over(_over(keys, order))).where("_now and not _was").drop("_now", "_was")


def amplitude_bouts(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, value: str, k: float, shortest: float) -> DataFrame:
    """Runs where |value| exceeds mean + k deviations; runs that touch either end or last ``shortest`` or less are dropped."""
    every, w = Window.partitionBy(*keys), _over(keys, order)
    limit = F.avg(F.abs(value)).over(every) + k * F.stddev_pop(F.abs(value)).over(every)
    d = df.withColumn("_high", F.abs(value) > limit).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(every))
    d = d.withColumn("_new", F.coalesce((F.lag("_high").over(w) != F.col("_high")).cast("int"), F.lit(1))).withColumn("run", F.sum("_new").over(w))
    runs = d.withColumn("_next", F.lead(time).over(w)).groupBy(*keys, "run", "_high").agg(F.min(time).alias("start"), F.max("_next").alias("stop"), F.min("_i").alias("_a"), F.max("_i").alias("_b"), F.first("_n").alias("_n"))
    inside = runs.where("_high and _a > 1 and _b < _n").withColumn("duration", F.col("stop") - F.col("start"))
    return inside.where(F.col("duration") > shortest).select(*keys, "start", "stop", "duration")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank of each value inside its key; ties share the mean of their ranks."""
    rank = F.rank().over(_over(keys, [value]))
    return df.withColumn(out, rank + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def sliding_windows(df: DataFrame, keys: Sequence[str], index: str, width: int, step: int) -> DataFrame:
    """Each row once for every window [w * step, w * step + width) of its zero-based index that lies whole inside the series."""
    n = F.count("*").over(Window.partitionBy(*keys))
    last = F.floor((n - width) / float(step))
    low = F.greatest(F.lit(0), F.ceil((F.col(index) - width + 1) / float(step)))
    high = F.least(last, F.floor(F.col(index) / float(step)))
    d = df.withColumn("_low", low).withColumn("_high", high).where("_high >= _low")
    return d.withColumn("win", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def interpolate(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Linear interpolation over missing values by row position; ends take the nearest value."""
    w = _over(keys, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    d = df.withColumn("_i", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct("_i", F.col(value).alias("v")))
    d = d.withColumn("_p", F.last(known, ignorenulls=True).over(back)).withColumn("_q", F.first(known, ignorenulls=True).over(ahead))
    slope = (F.col("_q.v") - F.col("_p.v")) * (F.col("_i") - F.col("_p._i")) / (F.col("_q._i") - F.col("_p._i"))
    between = F.when(F.col("_q._i") > F.col("_p._i"), F.col("_p.v") + slope)
    return d.withColumn(out, F.coalesce(F.col(value), between, F.col("_p.v"), F.col("_q.v"))).drop("_i", "_p", "_q")


def refractory(df: DataFrame, keys: Sequence[str], time: str, dead: float) -> DataFrame:
    """Times kept greedily: each more than ``dead`` after the last one kept; by chunks, however long a run without a gap is."""
    from neurotab.operators import scan

    return scan.refractory(df, keys, time, dead)


def segments(df: DataFrame, time: str, pre: float, stim: float, post: float) -> DataFrame:
    """Rows of [-pre, 0), [0, stim) and [stim, stim + post) labelled pre, stim and post; other rows go."""
    t = F.col(time)
    label = F.when((t >= -pre) & (t < 0), "pre").when((t >= 0) & (t < stim), "stim").when((t >= stim) & (t < stim + post), "post")
    return df.withColumn("segment", label).where("segment is not null")


def trapezoid(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str) -> DataFrame:
    """Area under y over x by key, by trapezoids between neighbouring rows; null with one row."""
    w = _over(keys, [x])
    d = df.select(*keys, ((F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2.0).alias("_a"))
    return d.groupBy(*keys).agg(F.sum("_a").alias(out))


def transition_entropy(trans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of -p log2 p over the transitions of each key."""
    return trans.groupBy(*keys).agg(F.sum(-F.col("prob") * F.log2("prob")).alias("entropy"))


def append_after(pre: DataFrame, post: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Both recordings on one time axis: post starts where the last time of pre with its keys is; keys without pre start at 0."""
    end = pre.groupBy(*keys).agg(F.max(time).alias("_end"))
    moved = post.join(end, list(keys), "left").withColumn(time, F.col(time) + F.coalesce("_end", F.lit(0)))
    return pre.withColumn("segment", F.lit("pre")).unionByName(moved.drop("_end").withColumn("segment", F.lit("post")))


def segments_by_bounds(df: DataFrame, time: str, bounds: dict[str, tuple[float, float]], names: Sequence[str] = ("pre", "stim", "post")) -> DataFrame:
    """Rows of [start, end) of each named segment; other rows go. An error if one of the six bounds is missing or a segment ends before it starts."""
    gone = [n for n in names if n not in bounds or None in bounds[n]]
    if gone:
        raise ValueError(f"bounds are missing for {', '.join(gone)}")
    wrong = [n for n in names if bounds[n][1] < bounds[n][0]]
    if wrong:
        raise ValueError(f"segments end before they start: {', '.join(wrong)}")
    label = F.lit(None).cast("string")
    for n in reversed(names):  # where two overlap, the first in order has the row
        label = F.when((F.col(time) >= bounds[n][0]) & (F.col(time) < bounds[n][1]), n).otherwise(label)
    return df.withColumn("segment", label).where("segment is not null")


def in_order(parts: dict[str, DataFrame], keys: Sequence[str], time: str, step: float = 0.0) -> DataFrame:
    """Any number of segments on one time axis, in the order given: each starts ``step`` after the last time of its key before it."""
    ends, out = None, None
    for name, part in parts.items():
        moved = part.withColumn("segment", F.lit(name))
        if ends is not None:
            moved = moved.join(ends, list(keys), "left").withColumn(time, F.col(time) + F.coalesce(F.col("_end") + step, F.lit(0.0))).drop("_end")
        own = moved.groupBy(*keys).agg(F.max(time).alias("_own"))
        ends = own.withColumnRenamed("_own", "_end") if ends is None else ends.join(own, list(keys), "full").select(*keys, F.greatest("_end", "_own").alias("_end"))
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
    return out


def transition_table(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, states: Sequence, eps: float = 0.0) -> DataFrame:
    """keys, from_state, to_state, n, prob for every pair of states: row-normalised counts, eps added to each sum; a row without transitions is 0. States that aren't in the list (noise) are taken out first."""
    kept = df.where(F.col(label).isin(*states))
    seen = transitions(kept, keys, order, label).select(*keys, "from_state", "to_state", "n")
    listed = F.array(*map(F.lit, states))
    grid = kept.select(*keys).distinct().withColumn("from_state", F.explode(listed)).withColumn("to_state", F.explode(listed))
    d = grid.join(seen, [*keys, "from_state", "to_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(*keys, "from_state")) + F.lit(float(eps))
    return d.withColumn("prob", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def pick_evenly(df: DataFrame, keys: Sequence[str], index: str, n: int) -> DataFrame:
    """At most n rows of each key, evenly spread over its zero-based index: those at floor(i * (m - 1) / (n - 1)) of m rows, the first and last ones included."""
    m = df.groupBy(*keys).agg(F.count("*").alias("_m"))
    at = F.floor(F.col("_i") * (F.col("_m") - 1) / F.lit(float(max(n - 1, 1))))
    wanted = m.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_m").cast("int")) - 1)))
    wanted = wanted.withColumn(index, F.when(F.col("_m") > n, at).otherwise(F.col("_i")).cast(df.schema[index].dataType)).select(*keys, index).distinct()
    return df.join(wanted, [*keys, index], "left_semi")


def stability(windows: DataFrame, keys: Sequence[str], mean: str = "mean") -> DataFrame:
    """Windows with ``stability``: how far each window's mean lies from the mean over the key's windows."""
    own = windows.groupBy(*keys).agg(F.avg(mean).alias("_c"))
    return windows.join(own, list(keys)).withColumn("stability", F.abs(F.col(mean) - F.col("_c"))).drop("_c")


def change_index(df: DataFrame, keys: Sequence[str], time: str, value: str, early: float) -> DataFrame:
    """change: mean of rows with time >= 0 minus the mean of those before; early_gradient: mean slope between neighbouring rows with 0 <= time <= early, null with under two."""
    w = _over(keys, [time])
    inside = (F.col(time) >= 0) & (F.col(time) <= early)
    slope = (F.lead(value).over(w) - F.col(value)) / F.when(F.lead(time).over(w) > F.col(time), F.lead(time).over(w) - F.col(time))
    d = df.select(*keys, time, value, F.when(inside & (F.lead(time).over(w) <= early), slope).alias("_g"))
    mean = lambda on: F.avg(F.when(on, F.col(value)))
    return d.groupBy(*keys).agg((mean(F.col(time) >= 0) - mean(F.col(time) < 0)).alias("change"), F.avg("_g").alias("early_gradient"))
