"""Signal queries over events: the values of a user in order are the samples of a channel at 10 Hz."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from neurotab.functions.columns import r6
from neurotab.operators import signal, windows
from neurotab.plans.registry import registry, table

QUERIES, ORACLES, query = registry()
BANDS = {"slow": (0.3, 1.0), "mid": (1.0, 2.0), "fast": (2.0, 4.0)}


def traces(spark, sf):
    """user_id, i (sample number from 0), value."""
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return table("events")(spark, sf).select("user_id", i.alias("i"), "value")


@query()
def signal_bandpass(spark, sf):
    return signal.bandpass(traces(spark, sf), ["user_id"], "i", "value", 10.0, 0.5, 3.0, 2, 4096)


@query()
def signal_window_features(spark, sf):
    return windows.window_features(traces(spark, sf), ["user_id"], "i", "value", 10.0, 40, 20, BANDS)


@query()
def signal_spectrogram(spark, sf):
    return windows.spectrogram(traces(spark, sf), ["user_id"], "i", "value", 10.0, 32, 16, 4.0)


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value FROM events), p AS (SELECT user_id, i s FROM t WHERE value>150)
SELECT user_id, s spike, round(max(value)-min(value), 6) p2p, round(min(value), 6) trough, round(max(value), 6) peak, round(sum(value*value), 4) energy FROM p JOIN t USING (user_id) WHERE i>=s-3 AND i<s+5 GROUP BY 1, 2 HAVING count(*)=8""")
def signal_waveforms(spark, sf):
    t = traces(spark, sf)
    spikes = t.where("value > 150").select("user_id", F.col("i").cast("double").alias("i"))
    w = signal.waveform_features(signal.waveforms(spikes, t, ["user_id"], "i", "value", 3, 5))
    return w.select("user_id", F.col("spike").cast("long").alias("spike"), *(r6(F.col(c)).alias(c) for c in ("p2p", "trough", "peak")), F.round("energy", 4).alias("energy"))


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value FROM events), s AS (SELECT user_id, i s FROM t WHERE value>150),
g AS (SELECT user_id, count(*) n_spikes, CASE WHEN count(*)<2 THEN 0.0 ELSE 100.0::double*sum(CASE WHEN d<5 THEN 1 ELSE 0 END)/(count(*)-1) END v FROM (SELECT user_id, s-lag(s) OVER (PARTITION BY user_id ORDER BY s) d FROM s) GROUP BY 1),
w AS (SELECT user_id, s, i-s+3 k, value v, count(*) OVER (PARTITION BY user_id, s) c FROM s JOIN t USING (user_id) WHERE i>=s-3 AND i<s+5),
p AS (SELECT user_id, s, max(v)-min(v) p2p FROM w WHERE c=8 GROUP BY 1, 2), a AS (SELECT user_id, avg(p2p) ap FROM p GROUP BY 1),
f AS (SELECT user_id, stddev_pop(v) FILTER (k<1) base, stddev_pop(v) FILTER (k<5) five FROM w WHERE c=8 GROUP BY 1),
m AS (SELECT user_id, k, avg(v) m, stddev_pop(v) r FROM w WHERE c=8 GROUP BY 1, 2), h AS (SELECT user_id, max(m)-min(m) mp, max(abs(m)) top, median(r) noise FROM m GROUP BY 1)
SELECT g.user_id, n_spikes, round(v, 6) isi_violation, round(CASE WHEN base>1e-12 THEN ap/(2*base) END, 6) snr_baseline, round(CASE WHEN noise>1e-9 THEN mp/(2*(noise+1e-12)) END, 6) snr_residual, round(CASE WHEN noise>1e-9 THEN mp/noise END, 6) snr_single, round(CASE WHEN five>1e-9 THEN top/five END, 6) snr_peak
FROM g LEFT JOIN a USING (user_id) LEFT JOIN f USING (user_id) LEFT JOIN h USING (user_id)""")
def signal_cluster_quality(spark, sf):
    t = traces(spark, sf)
    spikes = t.where("value > 150").select("user_id", F.col("i").cast("double").alias("i"))
    q = signal.cluster_quality(spikes, signal.waveforms(spikes, t, ["user_id"], "i", "value", 3, 5), ["user_id"], "i", 10.0, 500.0)
    # ratios without noise or without waveforms are null here
    ratio = {c: r6(F.when(F.abs(F.col(c)) < 1e9, F.col(c))) for c in ("snr_baseline", "snr_residual", "snr_single", "snr_peak")}
    return q.withColumn("isi_violation", r6(F.col("isi_violation"))).withColumns(ratio)


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value FROM events)
SELECT user_id, i, round(value-avg(value) OVER (PARTITION BY i), 6) referenced, round(value-avg(CASE WHEN i BETWEEN 0 AND 9 THEN value END) OVER (PARTITION BY user_id), 6) corrected FROM t""")
def signal_reference(spark, sf):
    t = traces(spark, sf)
    ref = signal.average_reference(t, ["i"], "value").withColumnRenamed("value", "referenced")
    base = signal.baseline(t, ["user_id"], "i", "value", 0, 9).withColumnRenamed("value", "corrected")
    return ref.join(base, ["user_id", "i"]).select("user_id", "i", r6(F.col("referenced")).alias("referenced"), r6(F.col("corrected")).alias("corrected"))


@query("""WITH g AS (SELECT event_type, avg(CASE WHEN user_id%2=0 THEN value END) a, avg(CASE WHEN user_id%2=1 THEN value END) b FROM events GROUP BY 1)
SELECT event_type, round(CASE WHEN abs(a)+abs(b)=0 THEN 0 ELSE -(a-b)/(abs(a)+abs(b)) END, 6) laterality FROM g""")
def signal_laterality(spark, sf):
    e = table("events")(spark, sf).withColumn("side", F.when(F.col("user_id") % 2 == 0, "left").otherwise("right"))
    return signal.laterality(e, ["event_type"], "side", "value", ["left"], ["right"]).withColumn("laterality", r6(F.col("laterality")))
