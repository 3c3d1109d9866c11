"""Summaries over the given tables: rates by stage, populations, regions, puncta, classes, groups from names, coupled channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab.functions import text as tx
from neurotab.functions.columns import r6
from neurotab.operators import cloud, evaluate, omics, signal, windows
from neurotab.plans.registry import registry, table
from neurotab.plans.signals import traces

QUERIES, ORACLES, query = registry()
events, embeddings = table("events"), table("embeddings")
STAGES = {"pre": (0, 8), "stim": (8, 16), "rec": (16, 24)}
TYPES = ("view", "click", "purchase")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (hour(ts)>={a} AND hour(ts)<{b}) n_{s}, round(count(*) FILTER (hour(ts)>={a} AND hour(ts)<{b})/8.0::double, 6) rate_{s}" for s, (a, b) in STAGES.items()) + " FROM events GROUP BY 1")
def stage_rates(spark, sf):
    e = events(spark, sf).select("user_id", F.hour("ts").alias("hour"))
    r = signal.stage_rates(e, ["user_id"], "hour", STAGES)
    return r.withColumns({f"rate_{s}": r6(F.col(f"rate_{s}")) for s in STAGES})


@query("""SELECT event_type recording, event_type||'_c'||user_id neuron_id, user_id "cluster", count(*) spike_count FROM events WHERE event_type IN ('view','click','purchase') GROUP BY ALL HAVING count(*)>5""")
def unit_population(spark, sf):
    e = events(spark, sf)
    units = {t: e.where(F.col("event_type") == t).groupBy(F.col("user_id").alias("cluster")).agg(F.count("*").alias("spike_count")) for t in TYPES}
    return signal.population(units | {"none": e.select("user_id")}, more_than=5)


CELLS = "label, floor(embedding[1]::double/0.05::double)::bigint y, floor(embedding[2]::double/0.05::double)::bigint x"


@query(f"""WITH p AS (SELECT DISTINCT {CELLS} FROM embeddings), a AS (SELECT DISTINCT {CELLS}, 1.0::double a FROM embeddings WHERE vec_id%2=0), b AS (SELECT DISTINCT {CELLS}, 1.0::double b FROM embeddings WHERE vec_id%5=0),
j AS (SELECT label, y%2=0 even, coalesce(a, 0) a, coalesce(b, 0) b FROM p LEFT JOIN a USING (label, y, x) LEFT JOIN b USING (label, y, x))
SELECT label, even, count(*) n, round(avg(a), 6) share_half, avg(a)>0.2 half, round(avg(b), 6) share_fifth, avg(b)>0.2 fifth, avg(a)>0.2 AND avg(b)>0.2 all_positive FROM j GROUP BY 1, 2""")
def region_coverage(spark, sf):
    cell = lambda i: F.floor(F.col("embedding")[i].cast("double") / 0.05)
    p = embeddings(spark, sf).select("vec_id", "label", cell(0).alias("y"), cell(1).alias("x"))
    at = ["label", "y", "x"]
    pixels = p.select(*at).distinct().withColumn("even", F.col("y") % 2 == 0)
    r = cloud.region_coverage(pixels, {"half": p.where("vec_id % 2 = 0"), "fifth": p.where("vec_id % 5 = 0")}, at, ["label", "even"])
    return r.withColumns({c: r6(F.col(c)) for c in ("share_half", "share_fifth")})


@query("""WITH g AS (SELECT l_suppkey k, count(*) n, avg(l_quantity::double) a, avg(l_extendedprice::double) i, avg(CASE WHEN l_discount>0.05 THEN 1.0::double ELSE 0.0::double END) c FROM lineitem GROUP BY 1)
SELECT s_suppkey, coalesce(n, 0) n, round(coalesce(a, 0), 4) mean_area, round(coalesce(i, 0), 4) mean_intensity, round(coalesce(c, 0), 6) coloc_ratio, round(coalesce(n, 0)/1000.0::double, 6) density FROM supplier LEFT JOIN g ON k=s_suppkey""")
def puncta_summary(spark, sf):
    li = table("lineitem")(spark, sf)
    puncta = li.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").cast("double").alias("area"), F.col("l_extendedprice").cast("double").alias("light"), (F.col("l_discount") > 0.05).alias("near"))
    tissue = table("supplier")(spark, sf).select("s_suppkey", F.lit(1000).alias("pixels"))
    s = cloud.puncta_summary(puncta, tissue, ["s_suppkey"], "area", "light", "near", "pixels")
    return s.withColumns({"mean_area": F.round("mean_area", 4), "mean_intensity": F.round("mean_intensity", 4), "coloc_ratio": r6(F.col("coloc_ratio")), "density": r6(F.col("density"))})


@query("SELECT lang, count(*) n, min(count(*)) OVER () smallest, least(min(count(*)) OVER (), 10) folds FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def language_folds(spark, sf):
    return evaluate.class_counts(table("documents")(spark, sf), "lang", 10)


@query("SELECT event_type, count(DISTINCT user_id) n, round(count(DISTINCT user_id)/(SELECT count(DISTINCT user_id) FROM events)::double, 6) frequency FROM events GROUP BY 1")
def type_selection(spark, sf):
    e = events(spark, sf)
    folds = e.select("user_id").distinct().count()
    return omics.selection_frequency(e, "event_type", "user_id", folds).withColumn("frequency", r6(F.col("frequency")))


@query(r"""SELECT s_suppkey, regexp_extract(s_name, '^([A-Za-z]+)', 1) word, regexp_extract(s_name, '([0-9]+)$', 1) digits, CASE WHEN contains(lower(s_name), '7') THEN 'seven' WHEN contains(lower(s_name), '1') OR contains(lower(s_name), '2') THEN 'low' ELSE 'rest' END "group"
FROM supplier WHERE regexp_matches(s_name, '^[A-Za-z]') AND regexp_matches(s_name, '[0-9]$')""")
def supplier_names(spark, sf):
    s = tx.name_parts(table("supplier")(spark, sf).select("s_suppkey", "s_name"), "s_name", {"word": "^([A-Za-z]+)", "digits": "([0-9]+)$"})
    return s.withColumn("group", tx.group_by_words(F.col("s_name"), {"seven": ("7",), "low": ("1", "2")}, "rest")).drop("s_name")


TAPS = signal.fir_bandpass(0.5, 3.0, 10.0, 31)


@query(f"""WITH t AS (SELECT user_id, list(value ORDER BY ts, event_id) v, count(*) n FROM events GROUP BY 1), h AS (SELECT [{", ".join(f"{h!r}::double" for h in TAPS.tolist())}] h),
e AS (SELECT user_id, n, list_transform(range(-15, n+15), lambda j: CASE WHEN j<0 THEN 2*v[1]-v[1-j] WHEN j>n-1 THEN 2*v[n]-v[2*n-1-j] ELSE v[j+1] END) e FROM t)
SELECT user_id, i, round(list_dot_product(e[i+1:i+31], h), 6) filtered FROM (SELECT user_id, unnest(range(0, n)) i, e FROM e), h""")
def signal_fir(spark, sf):
    f = signal.fir_filter(traces(spark, sf), ["user_id"], "i", "value", TAPS, 4096)
    return f.withColumn("filtered", r6(F.col("filtered")))


@query()
def signal_clean(spark, sf):
    return signal.clean_lfp(traces(spark, sf), ["user_id"], "i", "value", 10.0, 5.0, 0.2, 2.0, 2, 4096)


@query()
def signal_synchrony(spark, sf):
    t = traces(spark, sf).withColumn("recording", F.floor(F.col("user_id") / 8))
    return windows.synchrony(t, ["recording"], "user_id", "i", "value", 10.0, 40, 20, {"mid": (1.0, 2.0), "fast": (2.0, 4.0)})
