"""Queries over the event table: one user is one subject, its events a sequence of states and a sampled value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from neurotab.functions.columns import r6
from neurotab.operators import ranges
from neurotab.operators import sequence as seq
from neurotab.plans.registry import registry, table

QUERIES, ORACLES, query = registry()
ORDER = ["ts", "event_id"]
W = "PARTITION BY user_id ORDER BY ts, event_id"
events = table("events")
#: Microseconds since 1970 of a time without zone, in any session time zone.
MICROS_SQL = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def timed(spark, sf):
    """Events with t, seconds since the epoch as double."""
    return events(spark, sf).withColumn("micros", F.expr(MICROS_SQL)).withColumn("t", F.col("micros") / 1e6)


@query("""
SELECT user_id, count(*) AS n_entries,
  coalesce(round(avg(CASE WHEN c IS NULL THEN NULL WHEN a<>b AND b<>c AND a<>c THEN 1.0::double ELSE 0.0::double END)*100.0, 6), 0.0)::double AS alternation_pct
FROM (SELECT user_id, event_type a, lead(event_type,1) OVER w b, lead(event_type,2) OVER w c
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1""")
def events_alternation(spark, sf):
    return seq.alternation(events(spark, sf), ["user_id"], ORDER, "event_type").withColumn("alternation_pct", r6(F.col("alternation_pct")))


TRANSITIONS = f"""SELECT user_id, from_state, to_state, n, n/sum(n) OVER (PARTITION BY user_id, from_state) p FROM (
  SELECT user_id, from_state, to_state, count(*) n FROM (SELECT user_id, event_type from_state, lead(event_type) OVER ({W}) to_state FROM events) WHERE to_state IS NOT NULL GROUP BY ALL)"""


@query(f"SELECT user_id, from_state, to_state, n, round(p::double, 6) prob FROM ({TRANSITIONS})")
def events_transitions(spark, sf):
    return seq.transitions(events(spark, sf), ["user_id"], ORDER, "event_type").withColumn("prob", r6(F.col("prob")))


@query(f"SELECT user_id, round(sum(-p*log2(p))::double, 6) entropy FROM ({TRANSITIONS}) GROUP BY 1")
def events_transition_entropy(spark, sf):
    t = seq.transitions(events(spark, sf), ["user_id"], ORDER, "event_type")
    return seq.transition_entropy(t, ["user_id"]).withColumn("entropy", r6(F.col("entropy")))


@query(f"SELECT from_state, to_state, round(avg(p)::double, 6) mean_prob, count(*) n_users FROM ({TRANSITIONS}) GROUP BY 1, 2")
def events_mean_transitions(spark, sf):
    t = seq.transitions(events(spark, sf), ["user_id"], ORDER, "event_type")
    return t.groupBy("from_state", "to_state").agg(r6(F.avg("prob")).alias("mean_prob"), F.count("*").alias("n_users"))


@query("SELECT user_id, event_type, count(*) n, round((count(*)/sum(count(*)) OVER (PARTITION BY user_id))::double, 6) fraction FROM events WHERE event_type<>'error' GROUP BY 1, 2")
def events_occupancy(spark, sf):
    return seq.occupancy(events(spark, sf), ["user_id"], "event_type", F.col("event_type") == "error").withColumn("fraction", r6(F.col("fraction")))


@query(f"""
SELECT user_id, event_type, run, n, round((coalesce(lead(s) OVER (PARTITION BY user_id ORDER BY run), l) - s)::double, 6) duration FROM (
  SELECT user_id, event_type, run, count(*) n, min(t) s, max(t) l FROM (
    SELECT *, sum(c) OVER ({W})::bigint run FROM (SELECT *, epoch_us(ts)/1e6 t, CASE WHEN lag(event_type) OVER ({W}) = event_type THEN 0 ELSE 1 END c FROM events)) GROUP BY ALL)""")
def events_bouts(spark, sf):
    return seq.bouts(timed(spark, sf), ["user_id"], ORDER, "t", "event_type").select("user_id", "event_type", "run", "n", r6(F.col("duration")).alias("duration"))


@query(f"""
SELECT user_id, event_type, count(*) n_entries FROM (SELECT user_id, event_type, lag(event_type, 1, 'view') OVER ({W}) b FROM events) WHERE b IS DISTINCT FROM event_type GROUP BY 1, 2""")
def events_entries(spark, sf):
    return seq.entries(events(spark, sf), ["user_id"], ORDER, "event_type", first="view").groupBy("user_id", "event_type").agg(F.count("*").alias("n_entries"))


@query(f"""
WITH a AS (SELECT *, epoch_us(ts)/1e6 t, avg(abs(value)) OVER (PARTITION BY user_id) + stddev_pop(abs(value)) OVER (PARTITION BY user_id) lim FROM events),
b AS (SELECT *, abs(value)>lim high, row_number() OVER ({W}) i, count(*) OVER (PARTITION BY user_id) n, lead(t) OVER ({W}) nx FROM a),
c AS (SELECT *, CASE WHEN lag(high) OVER ({W}) = high THEN 0 ELSE 1 END ch FROM b),
d AS (SELECT *, sum(ch) OVER ({W}) run FROM c)
SELECT user_id, round((max(nx)-min(t))::double, 6) duration, round(min(t)::double, 6) "start" FROM d GROUP BY user_id, run, high, n HAVING high AND min(i)>1 AND max(i)<n AND max(nx)-min(t)>60""")
def events_high_bouts(spark, sf):
    b = seq.amplitude_bouts(timed(spark, sf), ["user_id"], ORDER, "t", "value", 1.0, 60.0)
    return b.select("user_id", r6(F.col("duration")).alias("duration"), r6(F.col("start")).alias("start"))


@query(f"SELECT event_id, user_id, last_value(CASE WHEN event_type<>'error' THEN value END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) carried FROM events")
def events_carry_forward(spark, sf):
    e = events(spark, sf).withColumn("seen", F.when(F.col("event_type") != "error", F.col("value")))
    return seq.carry_forward(e, ["user_id"], ORDER, "seen", "carried").select("event_id", "user_id", "carried")


@query(f"SELECT event_id, round(avg(value) OVER ({W} ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING), 6) smooth FROM events")
def events_rolling_mean(spark, sf):
    return seq.centred_mean(events(spark, sf), ["user_id"], ORDER, "value", 30, "smooth").select("event_id", r6(F.col("smooth")).alias("smooth"))


@query(f"SELECT event_id, round(sum(value) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)/5.0::double, 6) smooth FROM events")
def events_moving_average(spark, sf):
    return seq.moving_average(events(spark, sf), ["user_id"], ORDER, "value", 5, "smooth").select("event_id", r6(F.col("smooth")).alias("smooth"))


@query(f"""
WITH e AS (SELECT *, row_number() OVER ({W})-1 i, count(*) OVER (PARTITION BY user_id) n FROM events),
k AS (SELECT unnest(range(-4, 5)) o), g AS (SELECT o, exp(-0.5*o*o)/(SELECT sum(exp(-0.5*o*o)) FROM k) g FROM k),
t AS (SELECT event_id, user_id, g, ((i+o)%(2*n)+2*n)%(2*n) m, n FROM e, g)
SELECT t.event_id, round(sum(s.value*g)::double, 6) smooth FROM t JOIN e s ON s.user_id=t.user_id AND s.i=CASE WHEN m<t.n THEN m ELSE 2*t.n-1-m END GROUP BY 1""")
def events_gaussian(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "ts", "value")
    return seq.weighted_mean(e, ["user_id"], ORDER, "value", 1.0, "smooth").select("event_id", r6(F.col("smooth")).alias("smooth"))


@query(f"SELECT event_id, user_id FROM (SELECT *, value>100 now, lag(value>100, 1, false) OVER ({W}) was FROM events) WHERE now AND NOT was")
def events_rising_edges(spark, sf):
    return seq.rising_edges(events(spark, sf), ["user_id"], ORDER, F.col("value") > 100).select("event_id", "user_id")


@query(f"""SELECT user_id, count(*) n_intervals, round(coalesce(avg(CASE WHEN d<3600 THEN 100.0::double ELSE 0.0::double END), 0.0), 6) violation_pct, round(avg(d), 6) mean_gap
FROM (SELECT user_id, (epoch_us(ts)-lag(epoch_us(ts)) OVER ({W}))/1e6 d FROM events) WHERE d IS NOT NULL GROUP BY 1""")
def events_gaps(spark, sf):
    # differences of seconds as doubles carry an error of about 1e-7, so whole microseconds are taken
    d = timed(spark, sf).withColumn("d", (F.col("micros") - F.lag("micros").over(Window.partitionBy("user_id").orderBy(*ORDER))) / 1e6).where("d is not null")
    return d.groupBy("user_id").agg(F.count("*").alias("n_intervals"), r6(F.coalesce(F.avg((F.col("d") < 3600).cast("double")) * 100.0, F.lit(0.0))).alias("violation_pct"), r6(F.avg("d")).alias("mean_gap"))


SEGMENTED = """SELECT e.*, epoch_us(e.ts)/1e6 - p.first_at rel FROM events e JOIN (SELECT user_id, min(epoch_us(ts)/1e6) first_at FROM events WHERE event_type='purchase' GROUP BY 1) p USING (user_id)"""
SEGMENT = "CASE WHEN rel>=-86400 AND rel<0 THEN 'pre' WHEN rel>=0 AND rel<172800 THEN 'stim' WHEN rel>=172800 AND rel<432000 THEN 'post' END"


def _around_first_purchase(spark, sf):
    e = timed(spark, sf)
    first = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("t").alias("at"))
    return seq.segments(e.join(first, "user_id").withColumn("rel", F.col("t") - F.col("at")), "rel", 86400.0, 172800.0, 259200.0)


@query(f"SELECT user_id, segment, count(*) n, round(avg(value), 6) mean_value FROM (SELECT *, {SEGMENT} segment FROM ({SEGMENTED})) WHERE segment IS NOT NULL GROUP BY 1, 2")
def events_segments(spark, sf):
    return _around_first_purchase(spark, sf).groupBy("user_id", "segment").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))


@query(f"""SELECT user_id, round(avg(CASE WHEN segment='post' THEN value END) - avg(CASE WHEN segment='pre' THEN value END), 6) rci,
  round(count(CASE WHEN segment='pre' THEN 1 END)/86400.0::double*3600, 6) rate_pre, round(count(CASE WHEN segment='stim' THEN 1 END)/172800.0::double*3600, 6) rate_stim, round(count(CASE WHEN segment='post' THEN 1 END)/259200.0::double*3600, 6) rate_post
FROM (SELECT *, {SEGMENT} segment FROM ({SEGMENTED})) WHERE segment IS NOT NULL GROUP BY 1""")
def events_pre_post(spark, sf):
    of = lambda s, c: F.when(F.col("segment") == s, c)
    rate = lambda s, d: r6(F.count(of(s, F.lit(1))) / d * 3600.0).alias(f"rate_{s}")
    return _around_first_purchase(spark, sf).groupBy("user_id").agg(
        r6(F.avg(of("post", F.col("value"))) - F.avg(of("pre", F.col("value")))).alias("rci"), rate("pre", 86400.0), rate("stim", 172800.0), rate("post", 259200.0)
    )


@query("""
SELECT floor((e.t-p.t)/3600)::bigint AS "hour", count(*) n, round(avg(value), 6) mean_value FROM (SELECT user_id, epoch_us(ts)/1e6 t FROM events WHERE event_type='purchase') p
JOIN (SELECT user_id, value, epoch_us(ts)/1e6 t FROM events) e ON e.user_id=p.user_id AND e.t-p.t>=-7200 AND e.t-p.t<18000 GROUP BY 1""")
def events_peri_event(spark, sf):
    e = timed(spark, sf)
    at = e.where("event_type = 'purchase'").select("user_id", F.col("t").alias("at"))
    j = ranges.interval_join(at, e.select("user_id", "t", "value"), ["user_id"], "at", "t", 7200.0, 18000.0)
    return j.groupBy(F.floor(F.col("rel") / 3600.0).alias("hour")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts)/1e6 t, row_number() OVER (PARTITION BY user_id ORDER BY ts) rn FROM events),
r AS (SELECT user_id, rn, t kept, true k FROM e WHERE rn=1
  UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.t-r.kept>21600 THEN e.t ELSE r.kept END, e.t-r.kept>21600 FROM r JOIN e ON e.user_id=r.user_id AND e.rn=r.rn+1)
SELECT user_id, round(kept::double, 6) t FROM r WHERE k""")
def events_refractory(spark, sf):
    return seq.refractory(timed(spark, sf), ["user_id"], "t", 21600.0).select("user_id", r6(F.col("t")).alias("t"))


@query("""SELECT e.event_id, e.user_id, s.event_type state, s.value state_value FROM (SELECT * FROM events WHERE event_type='error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type<>'error') s ON e.user_id=s.user_id AND e.ts>=s.ts""")
def events_asof_state(spark, sf):
    e = events(spark, sf)
    state = e.where("event_type <> 'error'").select("user_id", "ts", F.col("event_type").alias("state"), F.col("value").alias("state_value"))
    return ranges.asof_join(e.where("event_type = 'error'").select("event_id", "user_id", "ts"), state, ["user_id"], "ts", ["state", "state_value"]).drop("ts")


@query(f"""
WITH e AS (SELECT *, CASE WHEN event_type<>'error' THEN value END v, row_number() OVER ({W}) i FROM events),
p AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) a, min(CASE WHEN v IS NOT NULL THEN i END) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) b FROM e)
SELECT p.event_id, round(coalesce(p.v, CASE WHEN p.b>p.a THEN x.v+(y.v-x.v)*(p.i-p.a)/(p.b-p.a) END, x.v, y.v), 6) filled
FROM p LEFT JOIN e x ON x.user_id=p.user_id AND x.i=p.a LEFT JOIN e y ON y.user_id=p.user_id AND y.i=p.b""")
def events_interpolated(spark, sf):
    e = events(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return seq.interpolate(e, ["user_id"], ORDER, "v", "filled").select("event_id", r6(F.col("filled")).alias("filled"))


@query(f"""
WITH e AS (SELECT *, row_number() OVER ({W})-1 i, count(*) OVER (PARTITION BY user_id) n FROM events)
SELECT user_id, w win, count(*) n, round(avg(value), 6) mean_value, round(var_pop(value), 6) var_value FROM (SELECT *, unnest(range(0, greatest(0, floor((n-20)/8.0)::bigint+1))) w FROM e) WHERE i>=w*8 AND i<w*8+20 GROUP BY 1, 2""")
def events_sliding_windows(spark, sf):
    e = events(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1)
    return seq.sliding_windows(e, ["user_id"], "i", 20, 8).groupBy("user_id", "win").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean_value"), r6(F.var_pop("value")).alias("var_value"))


@query("SELECT event_id, (rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value)-1)/2.0)::double rank FROM events")
def events_average_rank(spark, sf):
    return seq.average_rank(events(spark, sf), ["user_id"], "value", "rank").select("event_id", F.col("rank").cast("double").alias("rank"))


@query("""SELECT event_id, round((value-avg(value) OVER u)/(stddev_pop(value) OVER u+1e-8), 6) z, round((value-min(value) OVER u)/(max(value) OVER u-min(value) OVER u+1e-9), 6) unit
FROM events WINDOW u AS (PARTITION BY event_type)""")
def events_scaled(spark, sf):
    u = Window.partitionBy("event_type")
    low, high = F.min("value").over(u), F.max("value").over(u)
    return events(spark, sf).select("event_id", r6((F.col("value") - F.avg("value").over(u)) / (F.stddev_pop("value").over(u) + 1e-8)).alias("z"), r6(F.when(high - low < 1e-6, 0.0).otherwise((F.col("value") - low) / (high - low + 1e-9))).alias("unit"))


@query("SELECT event_type, round((stddev_samp(value)/(avg(value)+1e-8))::double, 6) cv, round((stddev_samp(value)/sqrt(count(value)))::double, 6) sem, count(*) n FROM events GROUP BY 1")
def events_variation(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(r6(F.stddev_samp("value") / (F.avg("value") + 1e-8)).alias("cv"), r6(F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT user_id, median(value) med FROM events GROUP BY 1)
SELECT user_id, round(1.4826::double*median(abs(value-med)), 6) mad_scale, round(any_value(med), 6) med FROM events JOIN m USING (user_id) GROUP BY 1""")
def events_mad(spark, sf):
    e = events(spark, sf)
    med = e.groupBy("user_id").agg(F.median("value").alias("med"))
    return e.join(med, "user_id").groupBy("user_id").agg(r6(1.4826 * F.median(F.abs(F.col("value") - F.col("med")))).alias("mad_scale"), r6(F.first("med")).alias("med"))


@query("SELECT json_extract_string(props, '$.k')::bigint k, count(*) n, round(sum(value), 6) total FROM events GROUP BY 1")
def events_json(spark, sf):
    return events(spark, sf).groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("SELECT least(floor(hour(ts)/4), 5)::bigint h, least(floor(value/50), 9)::bigint v, count(*) n FROM events GROUP BY 1, 2")
def events_histogram2d(spark, sf):
    return events(spark, sf).groupBy(F.least(F.floor(F.hour("ts") / 4.0), F.lit(5)).cast("long").alias("h"), F.least(F.floor(F.col("value") / 50.0), F.lit(9)).cast("long").alias("v")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, user_id, i FROM (SELECT *, row_number() OVER ({W})-1 i FROM events) WHERE i%5=0")
def events_stride(spark, sf):
    return events(spark, sf).withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1).cast("long")).where("i % 5 = 0").select("event_id", "user_id", "i")


@query(f"SELECT event_id, round(coalesce((nx-pv)/2, nx-value, value-pv, 0), 6) slope FROM (SELECT *, lead(value) OVER ({W}) nx, lag(value) OVER ({W}) pv FROM events)")
def events_gradient(spark, sf):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    e = events(spark, sf).withColumn("nx", F.lead("value").over(w)).withColumn("pv", F.lag("value").over(w))
    return e.select("event_id", r6(F.coalesce((F.col("nx") - F.col("pv")) / 2.0, F.col("nx") - F.col("value"), F.col("value") - F.col("pv"), F.lit(0.0))).alias("slope"))
