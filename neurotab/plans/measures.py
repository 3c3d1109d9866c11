"""Measures over the given tables: profiles, calibration, intervals, segments, transitions and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab.functions import columns
from neurotab.functions.columns import r6
from neurotab.operators import cloud, evaluate, models, neighbours, omics
from neurotab.operators import sequence as seq
from neurotab.plans.registry import registry, table
from neurotab.plans.sales import BRANDED, branded
from neurotab.plans.signals import traces
from neurotab.plans.texts import SCORED, scored

QUERIES, ORACLES, query = registry()
events, lineitem, orders, embeddings = map(table, ("events", "lineitem", "orders", "embeddings"))


def _rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity/(sqrt(l_quantity*l_quantity+l_discount*l_discount+l_tax*l_tax)+1e-6::double), 6) l_quantity, round(l_discount/(sqrt(l_quantity*l_quantity+l_discount*l_discount+l_tax*l_tax)+1e-6::double), 6) l_discount,
 round(l_tax/(sqrt(l_quantity*l_quantity+l_discount*l_discount+l_tax*l_tax)+1e-6::double), 6) l_tax, (l_quantity>40)::int responder FROM lineitem""")
def line_unit_vectors(spark, sf):
    li = lineitem(spark, sf)
    v = columns.unit_vector(["l_quantity", "l_discount", "l_tax"])
    return _rounded(li.select("l_orderkey", "l_linenumber", *v, (F.col("l_quantity") > 40).cast("int").alias("responder")), "l_quantity", "l_discount", "l_tax")


@query(f"""WITH v AS (SELECT p_brand, CASE WHEN l_discount>=0.05 THEN l_extendedprice END x FROM {BRANDED}), m AS (SELECT p_brand, median(x) m FROM v GROUP BY 1)
SELECT p_brand, round(avg(coalesce(x, m, 0)), 4) filled, count(*) n FROM v JOIN m USING (p_brand) GROUP BY 1""")
def brand_filled(spark, sf):
    v = branded(spark, sf).select("p_brand", F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice")).alias("x"))
    return columns.fill_median(v, ["x"], ("p_brand",)).groupBy("p_brand").agg(F.round(F.avg("x"), 4).alias("filled"), F.count("*").alias("n"))


@query(f"""SELECT p_brand, round(avg(CASE WHEN l_returnflag='R' THEN l_quantity END)/(avg(CASE WHEN l_returnflag='N' THEN l_quantity END)+0.1::double), 6) ratio FROM {BRANDED} WHERE p_size<=25 GROUP BY 1""")
def brand_polarisation(spark, sf):
    """One marker's mean over another's plus 0.1, in one region (small parts)."""
    on = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    return branded(spark, sf).where("p_size <= 25").groupBy("p_brand").agg(r6(columns.ratio(on("R"), on("N") + 0.1)).alias("ratio"))


@query(f"""WITH a AS (SELECT p_brand, l_shipdate::date d, avg(l_quantity) v FROM {BRANDED} WHERE l_returnflag='R' GROUP BY 1, 2), b AS (SELECT p_brand, l_shipdate::date d, avg(l_extendedprice) v FROM {BRANDED} WHERE l_returnflag='N' GROUP BY 1, 2)
SELECT count(*) n, round(corr(a.v, b.v), 6) r FROM a JOIN b USING (p_brand, d)""")
def marker_correlation(spark, sf):
    b = branded(spark, sf).withColumn("d", F.col("l_shipdate").cast("date"))
    return _rounded(omics.joined_correlation(b.where("l_returnflag = 'R'"), b.where("l_returnflag = 'N'"), ["p_brand", "d"], "l_quantity", "l_extendedprice"), "r")


@query(f"""WITH a AS (SELECT p_type, count(*) n, avg(l_quantity) mean, stddev_samp(l_quantity)/sqrt(count(*)) se FROM {BRANDED} WHERE l_returnflag='R' GROUP BY 1), b AS (SELECT p_type, count(*) n, avg(l_discount) mean, stddev_samp(l_discount)/sqrt(count(*)) se FROM {BRANDED} WHERE l_returnflag='A' GROUP BY 1)
SELECT p_type, a.n energy_n, round(a.mean, 6) energy_mean, round(a.se, 6) energy_se, b.n complexity_n, round(b.mean, 6) complexity_mean, round(b.se, 6) complexity_se FROM a JOIN b USING (p_type)""")
def type_profile(spark, sf):
    b = branded(spark, sf)
    p = omics.profile({"energy": omics.mean_se(b.where("l_returnflag = 'R'"), ["p_type"], "l_quantity"), "complexity": omics.mean_se(b.where("l_returnflag = 'A'"), ["p_type"], "l_discount")}, ["p_type"])
    return _rounded(p, "energy_mean", "energy_se", "complexity_mean", "complexity_se")


@query(f"""WITH q AS (SELECT p_type FROM {BRANDED} WHERE l_linestatus='F' GROUP BY 1 HAVING stddev_samp(l_quantity)/avg(l_quantity)*100<57) SELECT p_type, count(*) n FROM {BRANDED} WHERE p_type IN (SELECT * FROM q) GROUP BY 1""")
def type_rsd_filter(spark, sf):
    return omics.rsd_filter(branded(spark, sf), "p_type", "l_quantity", F.col("l_linestatus") == "F", 57.0).groupBy("p_type").agg(F.count("*").alias("n"))


@query(f"SELECT p_brand, round(var_samp(l_extendedprice), 2) variance FROM {BRANDED} GROUP BY 1 ORDER BY var_samp(l_extendedprice) DESC, p_brand LIMIT 7")
def brand_top_variance(spark, sf):
    return omics.top_variance(branded(spark, sf), "p_brand", "l_extendedprice", 7).withColumn("variance", F.round("variance", 2))


@query(f"""WITH s AS ({SCORED}), b AS (SELECT *, least(floor(p*4), 3) i FROM s WHERE p BETWEEN 0 AND 1)
SELECT round(i/4, 6) low, round((i+1)/4, 6) high, count(*) n, round(avg(p), 6) mean_p, round(avg(y::double), 6) AS share FROM b GROUP BY i HAVING count(*)>=3""")
def label_calibration_bins(spark, sf):
    c = evaluate.calibration_table(scored(spark, sf), "y", "p", "uniform", 4, 3)
    return _rounded(c, "low", "high", "mean_p", "share")


@query()
def label_adaptive_bins(spark, sf):
    """Bins of the score merged until each has 30 rows."""
    return evaluate.calibration_table(scored(spark, sf), "y", "p", "adaptive", 20, 30)


@query(f"""WITH m AS (SELECT p_brand b, avg(l_quantity) v, stddev_samp(l_quantity)/sqrt(count(*)) s FROM {BRANDED} GROUP BY 1),
o AS (SELECT *, CASE b WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 3 END k FROM m)
SELECT row_number() OVER (ORDER BY k, b) place, b p_brand, round(v, 6) mean, round(v-2*s, 6) lo, round(v+2*s, 6) hi, printf('%.3f (%.3f, %.3f)', v, v-2*s, v+2*s) AS text FROM o""")
def brand_interval_table(spark, sf):
    m = omics.mean_se(branded(spark, sf), ["p_brand"], "l_quantity")
    m = m.select("p_brand", "mean", (F.col("mean") - 2 * F.col("se")).alias("lo"), (F.col("mean") + 2 * F.col("se")).alias("hi"))
    t = evaluate.interval_table(m, "p_brand", "mean", "lo", "hi", ["Brand#3", "Brand#1"])
    return _rounded(t.withColumn("place", F.col("place").cast("long")), "mean", "lo", "hi")


@query("""WITH p AS (SELECT event_type, user_id, hour(ts)::double t, value FROM events WHERE value IS NOT NULL), a AS (SELECT user_id, t, value, CASE WHEN t>=2 AND t<8 THEN 'pre' WHEN t>=8 AND t<14 THEN 'stim' WHEN t>=14 AND t<23 THEN 'post' END segment FROM p)
SELECT segment, count(*) n, round(avg((value-(SELECT avg(value) FROM a WHERE segment IS NOT NULL))/(SELECT stddev_pop(value) FROM a WHERE segment IS NOT NULL)), 6) z FROM a WHERE segment IS NOT NULL GROUP BY 1""")
def segment_scores(spark, sf):
    """Mean joint z-score of three segments given by six bounds."""
    e = events(spark, sf).select(F.hour("ts").cast("double").alias("t"), "value")
    s = seq.segments_by_bounds(e, "t", {"pre": (2, 8), "stim": (8, 14), "post": (14, 23)})
    z = models.joint_scaled({n: s.where(F.col("segment") == n).drop("segment") for n in ("pre", "stim", "post")}, ["value"])
    return z.groupBy("segment").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("z"))


STATES = ("view", "click", "purchase", "refund")


@query("""WITH s AS (SELECT unnest(['view','click','purchase','refund']) s), e AS (SELECT user_id, event_type f, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) t FROM events WHERE event_type IN ('view','click','purchase','refund')),
c AS (SELECT user_id, f, t, count(*) n FROM e WHERE t IS NOT NULL GROUP BY ALL), g AS (SELECT user_id, a.s f, b.s t FROM (SELECT DISTINCT user_id FROM e), s a, s b), d AS (SELECT user_id, f, t, coalesce(n, 0) n FROM g LEFT JOIN c USING (user_id, f, t))
SELECT user_id, f from_state, t to_state, n::bigint n, round(n/(sum(n) OVER (PARTITION BY user_id, f)+1e-8::double), 6) prob FROM d""")
def event_transition_table(spark, sf):
    return _rounded(seq.transition_table(events(spark, sf), ["user_id"], ["ts", "event_id"], "event_type", STATES, 1e-8), "prob")


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value, count(*) OVER (PARTITION BY user_id) m FROM events),
k AS (SELECT DISTINCT user_id, CASE WHEN m>12 THEN floor(j*(m-1)/11.0::double)::bigint ELSE j END i FROM (SELECT DISTINCT user_id, m FROM t), range(0, 12) r(j) WHERE j<m)
SELECT user_id, i, value FROM t JOIN k USING (user_id, i)""")
def trace_picks(spark, sf):
    """Twelve samples evenly spread over each trace."""
    return seq.pick_evenly(traces(spark, sf), ["user_id"], "i", 12)


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value FROM events), s AS (SELECT user_id, i-30.0::double t, value, lead(value) OVER w-value dv, lead(i) OVER w-30 nt FROM t WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, round(avg(value) FILTER (t>=0)-avg(value) FILTER (t<0), 6) change, round(avg(dv) FILTER (t>=0 AND nt<=10), 6) early_gradient FROM s GROUP BY 1""")
def trace_change(spark, sf):
    t = traces(spark, sf).withColumn("t", F.col("i") - 30.0)
    return _rounded(seq.change_index(t, ["user_id"], "t", "value", 10.0), "change", "early_gradient")


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value FROM events), w AS (SELECT user_id, i//10 win, avg(value) m FROM t GROUP BY 1, 2)
SELECT user_id, win, round(m, 6) mean, round(abs(m-avg(m) OVER (PARTITION BY user_id)), 6) stability FROM w""")
def trace_stability(spark, sf):
    w = traces(spark, sf).groupBy("user_id", F.floor(F.col("i") / 10).alias("win")).agg(F.avg("value").alias("mean"))
    return _rounded(seq.stability(w, ["user_id"]), "mean", "stability")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda c: c::double) v FROM embeddings), c AS (SELECT label, list(m ORDER BY i) c FROM (SELECT label, i, avg(v[i]) m FROM e, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)
SELECT vec_id, label, round(list_distance(v, c.c), 6) own, round(list_distance(v, z.c), 6) to_reference FROM e JOIN c USING (label) LEFT JOIN (SELECT c FROM c WHERE label=0) z ON true""")
def vector_centroid_distances(spark, sf):
    """Distances of every vector to the centres of its class and of class 0, in all 64 components."""
    names = [f"f{i}" for i in range(64)]
    e = embeddings(spark, sf).select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)))
    return _rounded(omics.centroid_distances(e, "label", names, 0).select("vec_id", "label", "own", "to_reference"), "own", "to_reference")


@query("""WITH p AS (SELECT vec_id, label, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z, embedding[4]::double e FROM embeddings),
n AS (SELECT a.vec_id, avg(b.e) m FROM p a JOIN LATERAL (SELECT e FROM p b WHERE b.vec_id%2=0 ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.vec_id LIMIT 4) b ON true GROUP BY 1)
SELECT label, count(*) n, round(corr(e, m), 5) r, count(*) FILTER (e IS NULL) missing, count(*) FILTER (label NOT IN (0,1,2,3,4)) unknown_labels, count(*)>=20 AND label IN (0,1,2,3,4) ok FROM p JOIN n USING (vec_id) GROUP BY 1""")
def field_checks(spark, sf):
    """Field values at points against the mean over the four nearest nodes, by class."""
    p = embeddings(spark, sf).select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyze")))
    near = neighbours.nearest(p, p.where("vec_id % 2 = 0"), "vec_id", "vec_id", ["x", "y", "z"], 4)
    means = near.join(p.select(F.col("vec_id").alias("vec_id_r"), "e"), "vec_id_r").groupBy("vec_id").agg(F.avg("e").alias("m"))
    q = cloud.field_quality(p.join(means, "vec_id"), ["label"], "e", "m", "label", 20, range(5))
    return q.withColumn("r", F.round("r", 5))


@query("""WITH e AS (SELECT event_type, user_id, avg(value) v FROM events GROUP BY 1, 2) SELECT event_type, user_id, round(exp((v-m)/100)/sum(exp((v-m)/100)) OVER (PARTITION BY user_id), 6) weight FROM (SELECT *, max(v) OVER (PARTITION BY user_id) m FROM e)""")
def event_softmax(spark, sf):
    e = events(spark, sf).groupBy("event_type", "user_id").agg((F.avg("value") / 100.0).alias("v"))
    return evaluate.softmax(e, ["user_id"], "v", "weight").select("event_type", "user_id", r6(F.col("weight")).alias("weight"))
