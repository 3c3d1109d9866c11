"""Track queries over events: a user's events are the frames of a session, value and hour the place, the type its zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab.functions.columns import r6
from neurotab.operators import models, track
from neurotab.plans.registry import registry, table
from neurotab.plans.texts import SCORED, scored

QUERIES, ORACLES, query = registry()
ORDER = ["ts", "event_id"]
PLACED = "SELECT user_id, ts, event_id, event_type, value x, hour(ts)::double y FROM events"
STEPS = f"SELECT *, coalesce(sqrt(power(x-lag(x) OVER w,2)+power(y-lag(y) OVER w,2))*0.5, 0) dist FROM ({PLACED}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def placed(spark, sf):
    return table("events")(spark, sf).select("user_id", "ts", "event_id", "event_type", F.col("value").alias("x"), F.hour("ts").cast("double").alias("y"))


@query(f"SELECT user_id, round(count(*)/10.0::double, 6) duration, round(sum(dist), 5) distance, round(avg(dist*10), 5) mean_speed FROM ({STEPS}) GROUP BY 1")
def track_sessions(spark, sf):
    s = track.sessions(track.steps(placed(spark, sf), ["user_id"], ORDER, 10.0, 0.5), ["user_id"], 10.0)
    return s.select("user_id", r6(F.col("duration")).alias("duration"), F.round("distance", 5).alias("distance"), F.round("mean_speed", 5).alias("mean_speed"))


@query(f"""SELECT user_id, event_type, round(count(*)/10.0::double, 6) duration, round(sum(dist), 5) distance, sum(CASE WHEN b IS DISTINCT FROM event_type THEN 1 ELSE 0 END)::bigint entries
FROM (SELECT *, lag(event_type, 1, 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) b FROM ({STEPS})) GROUP BY 1, 2""")
def track_zones(spark, sf):
    s = track.steps(placed(spark, sf), ["user_id"], ORDER, 10.0, 0.5)
    z = track.zone_summary(s, ["user_id"], ORDER, 10.0, "event_type", "view")
    return z.select("user_id", "event_type", r6(F.col("duration")).alias("duration"), F.round("distance", 5).alias("distance"), "entries")


@query(f"""SELECT user_id, motion, count(*) n FROM (SELECT user_id, CASE WHEN s<300 THEN 'Freezing' WHEN s<350 THEN 'Immobility' ELSE 'Mobility' END motion FROM
 (SELECT user_id, round(avg(dist*10) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 9) s FROM ({STEPS}))) GROUP BY 1, 2""")
def track_motion(spark, sf):
    s = track.steps(placed(spark, sf), ["user_id"], ORDER, 10.0, 0.5)
    return track.motion_states(s, ["user_id"], ORDER, 30, 300.0, 350.0).groupBy("user_id", "motion").agg(F.count("*").alias("n"))


@query(f"""WITH s AS ({STEPS}), b AS (SELECT user_id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM s GROUP BY 1),
z AS (SELECT s.*, x BETWEEN (x0+x1)/2-(x1-x0)/4 AND (x0+x1)/2+(x1-x0)/4 AND y BETWEEN (y0+y1)/2-(y1-y0)/4 AND (y0+y1)/2+(y1-y0)/4 inside FROM s JOIN b USING (user_id)),
e AS (SELECT *, lag(inside) OVER (PARTITION BY user_id ORDER BY ts, event_id) was FROM z)
SELECT user_id, round(count(*)/10.0::double, 6) duration, round(sum(dist), 5) distance, round(avg(dist*10), 5) mean_speed, round(nullif(count(*) FILTER (inside), 0)/10.0::double, 6) centre_duration, round(sum(dist) FILTER (inside), 5) centre_distance,
 CASE WHEN count(*) FILTER (inside)>0 THEN count(*) FILTER (inside AND NOT was) END centre_entries FROM e GROUP BY 1""")
def track_open_field(spark, sf):
    frames = placed(spark, sf).withColumn("frame", F.struct(*ORDER))
    o = track.open_field(frames, ["user_id"], "frame", 10.0, 0.5)
    return o.withColumns({c: F.round(c, 6 if c.endswith("duration") else 5) for c in ("duration", "distance", "mean_speed", "centre_duration", "centre_distance")})


@query(f"""WITH s AS ({SCORED}), v AS (SELECT *, (SELECT sum(CASE WHEN b.p<a.p THEN 1.0 WHEN b.p=a.p THEN 0.5 ELSE 0 END) FROM s b WHERE b.y=0) nb, (SELECT sum(CASE WHEN b.p>a.p THEN 1.0 WHEN b.p=a.p THEN 0.5 ELSE 0 END) FROM s b WHERE b.y=1) pa FROM s a),
t AS (SELECT sum(CASE WHEN y=1 THEN nb END)::double u, sum(y)::double p, sum(1-y)::double n FROM v)
SELECT doc_id, round(CASE WHEN y=1 THEN (u-nb)/((t.p-1)*n) ELSE (u-pa)/(t.p*(n-1)) END - u/(t.p*n), 7) change FROM v, t""")
def label_influence(spark, sf):
    return models.influence(scored(spark, sf), "doc_id", "y", "p").select("doc_id", F.round("change", 7).alias("change"))


@query("""WITH s AS (SELECT count(*)::double n, sum(l_quantity) x, sum(l_quantity**2) x2, sum(l_quantity**3) x3, sum(l_quantity**4) x4, sum(l_extendedprice) y, sum(l_quantity*l_extendedprice) xy, sum(l_quantity**2*l_extendedprice) x2y FROM lineitem),
d AS (SELECT *, x4*(x2*n-x*x)-x3*(x3*n-x*x2)+x2*(x3*x-x2*x2) d FROM s),
c AS (SELECT (x2y*(x2*n-x*x)-x3*(xy*n-x*y)+x2*(xy*x-x2*y))/d a, (x4*(xy*n-x*y)-x2y*(x3*n-x*x2)+x2*(x3*y-xy*x2))/d b, (x4*(x2*y-x*xy)-x3*(x3*y-xy*x2)+x2y*(x3*x-x2*x2))/d c FROM d)
SELECT round(a, 4) a, round(b, 3) b, round(c, 2) c, round(-b/(2*a), 1) vertex FROM c""")
def price_quadratic(spark, sf):
    q = models.quadratic(table("lineitem")(spark, sf), "l_quantity", "l_extendedprice")
    q = spark.createDataFrame([tuple(float(v) for v in q.values())], "a double, b double, c double, vertex double")
    return q.select(*(F.round(c, n).alias(c) for c, n in (("a", 4), ("b", 3), ("c", 2), ("vertex", 1))))
