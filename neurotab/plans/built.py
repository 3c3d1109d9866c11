"""Text, epoch, score, pixel, state and streaming operators over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from neurotab.functions import pixels
from neurotab.functions import text as tx
from neurotab.functions.columns import r6
from neurotab.operators import epochs, evaluate, models, omics, states
from neurotab.operators import sequence as seq
from neurotab.plans.registry import registry, table
from neurotab.plans.sales import BRANDED, branded
from neurotab.plans.signals import traces
from neurotab.plans.texts import SCORED, scored
from neurotab.sources import tables
from neurotab.sources.shared import shared_dir
from neurotab.streaming import live

QUERIES, ORACLES, query = registry()
events, lineitem, orders, part, documents, embeddings = map(table, ("events", "lineitem", "orders", "part", "documents", "embeddings"))


def _rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})




@query("""SELECT l_linenumber%5 kind, CASE l_linenumber%5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END flag, count(*) n FROM lineitem GROUP BY 1, 2""")
def yes_no_cells(spark, sf):
    k = F.col("l_linenumber") % 5
    cell = F.when(k == 0, " Yes").when(k == 1, "否").when(k == 2, "TRUE ").when(k == 3, "-").otherwise("maybe")
    return lineitem(spark, sf).select(k.alias("kind"), tx.binary(cell).alias("flag")).groupBy("kind", "flag").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey%4=3 THEN NULL ELSE strftime(o_orderdate::date + INTERVAL (CASE WHEN o_orderkey%4=2 THEN 0 ELSE 510 END) MINUTE, '%Y-%m-%d %H:%M:%S') END parsed,
 CASE WHEN o_custkey%2=0 THEN (o_custkey%9)::double WHEN o_orderkey%4<>3 THEN round(24-CASE WHEN o_orderkey%4=2 THEN 0 ELSE 8.5::double END, 6) END AS hours FROM orders""")
def order_times(spark, sf):
    """Times in three spellings, and the hours from onset to a sample a day later, or the hours given."""
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    cell = F.when(k == 0, F.date_format(day, "yyyy年M月d日 8时30分")).when(k == 1, F.date_format(day, "yyyy/M/d 8:30")).when(k == 2, F.date_format(day, "yyyy.M.d")).otherwise("unknown")
    t = tx.timestamp(cell)
    given = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 9)
    hours = tx.onset_hours(given, t, (F.date_add(day, 1)).cast("timestamp"))
    return orders(spark, sf).select("o_orderkey", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("parsed"), r6(hours).alias("hours"))


@query(r"""WITH p AS (SELECT p_partkey, p_partkey%30 d FROM part) SELECT p_partkey, CASE WHEN d%10=0 THEN 'Day 0' WHEN contains(d::varchar, '14') THEN 'Day 14' WHEN contains(d::varchar, '11') THEN 'Day 11' WHEN contains(d::varchar, '7') THEN 'Day 7' WHEN contains(d::varchar, '3') THEN 'Day 3' WHEN contains(d::varchar, '1') THEN 'Day 1' ELSE 'rat '||d END AS "day",
 'g-'||lpad(d::varchar, 2, '0') subgroup, d frequency, CASE WHEN d%10=0 THEN 1 WHEN d<5 THEN 2 ELSE 3 END place FROM p""")
def part_names(spark, sf):
    """Days, subgroups, frequencies and sort keys of names that are made from part keys."""
    d = (F.col("p_partkey") % 30).cast("int")
    name = F.when(d % 10 == 0, "Baseline 2").otherwise(F.concat(F.lit("rat "), d.cast("string")))
    kind = F.when(d % 10 == 0, "a").when(d < 5, "b").otherwise("c")
    return part(spark, sf).select(
        "p_partkey", tx.group_day(name).alias("day"), tx.subgroup(F.lit("g"), F.concat(F.lit("scan_"), d.cast("string"), F.lit("_left.png"))).alias("subgroup"),
        tx.frequency(F.concat(F.lit("TI_"), d.cast("string"), F.lit("Hz"))).cast("long").alias("frequency"), tx.place_in(kind, ["a", "b"]).cast("int").alias("place"),
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity>=l_discount*400 AND l_quantity>=l_tax*500 THEN 'S1' WHEN l_discount*400>=l_tax*500 THEN 'S2' ELSE 'S3' END state FROM lineitem""")
def line_states(spark, sf):
    li = lineitem(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("p1"), (F.col("l_discount") * 400).alias("p2"), (F.col("l_tax") * 500).alias("p3"))
    return li.select("l_orderkey", "l_linenumber", tx.largest_state(["S1", "S2", "S3"], ["p1", "p2", "p3"]).alias("state"))


@query("""SELECT l_returnflag, round(sum(CASE WHEN abs(l_discount-0.05)<=1e-8+1e-5*0.05 OR abs(l_discount-0.1)<=1e-8+1e-5*0.1 THEN 0 ELSE l_quantity END), 2) q, round(sum(CASE WHEN abs(l_discount-0.05)<=1e-8+1e-5*0.05 OR abs(l_discount-0.1)<=1e-8+1e-5*0.1 THEN 0 ELSE l_extendedprice END), 2) price FROM lineitem GROUP BY 1""")
def blanked_triggers(spark, sf):
    b = epochs.blank_triggers(lineitem(spark, sf), "l_discount", ["l_quantity", "l_extendedprice"], [0.05, 0.1])
    return b.groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value, event_type='purchase' p FROM events), n AS (SELECT user_id, max(i) m FROM t GROUP BY 1),
a AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY i)-1 epoch FROM t JOIN n USING (user_id) WHERE p AND i-5>=0 AND i+8<=m)
SELECT a.user_id, epoch, count(*) n, round(avg(value), 6) mean FROM a JOIN t ON a.user_id=t.user_id AND t.i BETWEEN a.i-5 AND a.i+8 GROUP BY 1, 2""")
def purchase_epochs(spark, sf):
    """Epochs from five samples before to eight after each purchase that lie whole inside the trace."""
    from pyspark.sql import Window

    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("double")
    t = events(spark, sf).select("user_id", i.alias("i"), "value", "event_type")
    e = epochs.cut_epochs(t.select("user_id", "i", "value"), t.where("event_type = 'purchase'").select("user_id", F.col("i").alias("at")), ["user_id"], "i", -5.0, 8.0)
    return e.groupBy("user_id", F.col("epoch").cast("long").alias("epoch")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("""SELECT user_id, CASE WHEN user_id%3=0 THEN CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'view' ELSE event_type END ELSE event_type END channel, count(*) n FROM events GROUP BY 1, 2""")
def swapped_channels(spark, sf):
    s = epochs.swap_hemispheres(events(spark, sf).withColumnRenamed("event_type", "channel"), "channel", [("view", "click")], F.col("user_id") % 3 == 0)
    return s.groupBy("user_id", "channel").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest(l_quantity/40.0::double-0.1::double, 0), 1)/CASE WHEN sum(least(greatest(l_quantity/40.0::double-0.1::double, 0), 1)) OVER w>0 THEN sum(least(greatest(l_quantity/40.0::double-0.1::double, 0), 1)) OVER w ELSE 1 END, 6) p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def line_shares(spark, sf):
    li = lineitem(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 40.0 - 0.1).alias("raw"))
    return evaluate.normalise(li, ["l_orderkey"], "raw", "p").select("l_orderkey", "l_linenumber", r6(F.col("p")).alias("p"))


@query(f"""WITH s AS ({SCORED}) SELECT d.doc_id, round(1-p, 6) risk, round(ln(least(greatest(p, 1e-6), 1-1e-6)/(1-least(greatest(p, 1e-6), 1-1e-6))), 5) logit FROM documents d LEFT JOIN s USING (doc_id)""")
def document_risk(spark, sf):
    s = scored(spark, sf).select("doc_id", F.col("p").alias("p_NC"))
    r = evaluate.with_risk(documents(spark, sf).select("doc_id"), s, "doc_id")
    return r.select("doc_id", r6(F.col("risk")).alias("risk"), F.round(evaluate.logit(F.col("p_NC")), 5).alias("logit"))


@query(f"""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN p_size>10 THEN p_type END, 'Unclassified') p_type, CASE l_returnflag WHEN 'R' THEN 'Up' WHEN 'A' THEN 'Down' ELSE 'NA' END regulation FROM {BRANDED} WHERE l_discount<0.05 AND l_quantity>=30""")
def significant_lines(spark, sf):
    b = branded(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", F.when(F.col("p_size") > 10, F.col("p_type")).alias("p_type"), F.when(F.col("l_returnflag") == "R", " up").when(F.col("l_returnflag") == "A", "DOWN ").otherwise("other").alias("regulation"))
    return omics.significant(b, "l_discount", "l_quantity", 0.05, 30.0, ["p_type"], "regulation").select("l_orderkey", "l_linenumber", "p_type", "regulation")


@query("SELECT src, dst, w FROM (SELECT l_partkey src, l_suppkey dst, round(sum(l_quantity*CASE WHEN l_returnflag='R' THEN -1 ELSE 1 END), 2) w FROM lineitem GROUP BY 1, 2) ORDER BY abs(w) DESC, src, dst LIMIT 40")
def top_part_edges(spark, sf):
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    e = lineitem(spark, sf).groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.round(F.sum(F.col("l_quantity") * sign), 2).alias("w"))
    return omics.top_edges(e, "w", 40)


@query("""WITH m AS (SELECT avg(l_quantity) a, stddev_pop(l_quantity)+1e-12 sa, avg(l_discount) b, stddev_pop(l_discount)+1e-12 sb, avg(l_tax) c, stddev_pop(l_tax)+1e-12 sc FROM lineitem)
SELECT unnest(['l_quantity','l_discount','l_tax']) feature, unnest([x, y, z]) mean_abs FROM (SELECT round(avg(abs(0.5*(l_quantity-a)/sa)), 5) x, round(avg(abs(-2*(l_discount-b)/sb)), 5) y, round(avg(abs(1.5*(l_tax-c)/sc)), 5) z FROM lineitem, m)""")
def line_contributions(spark, sf):
    c = models.contributions(lineitem(spark, sf), ["l_quantity", "l_discount", "l_tax"], [0.5, -2.0, 1.5])
    return c.select("feature", F.round("mean_abs", 5).alias("mean_abs"))


@query("""WITH d AS (SELECT l_quantity x, l_extendedprice y FROM lineitem), s AS (SELECT count(*)::double n, avg(x) mx, avg(y) my, regr_slope(y, x) b, regr_intercept(y, x) a, sum(x*x)-count(*)*avg(x)*avg(x) sxx FROM d),
e AS (SELECT n, sxx, x-mx dx, (y-a-b*x)/(1-(1/n+(x-mx)*(x-mx)/sxx)) r, mx FROM d, s),
v AS (SELECT sum(r*r*dx*dx)/power(any_value(sxx), 2) vb, sum(r*r*power(1/n-mx*dx/sxx, 2)) va FROM e)
SELECT term, round(coef, 3) coef, round(se, 3) se FROM (SELECT 'intercept' term, a coef, sqrt(va) se FROM s, v UNION ALL SELECT 'l_quantity', b, sqrt(vb) FROM s, v)""")
def price_regression(spark, sf):
    """Least squares with HC3 errors of price on quantity."""
    rows = models.ols_hc3(lineitem(spark, sf), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(r["term"], r["coef"], r["se"]) for r in rows], "term string, coef double, se double").select("term", F.round("coef", 3).alias("coef"), F.round("se", 3).alias("se"))


@query("""WITH d AS (SELECT label g, unnest(range(1, 65)) i, unnest(list_transform(embedding, lambda c: c::double)) v FROM embeddings), m AS (SELECT i, g, avg(v) m, count(*) n, sum(v*v)-count(*)*avg(v)*avg(v) w FROM d GROUP BY 1, 2), t AS (SELECT i, avg(v) a, count(*) n FROM d GROUP BY 1),
f AS (SELECT i, (sum(m.n*power(m-a, 2))/(count(*)-1))/(sum(w)/(any_value(t.n)-count(*))) f FROM m JOIN t USING (i) GROUP BY 1) SELECT 'f'||(i-1) feature FROM f ORDER BY f DESC LIMIT 6""")
def label_anova_features(spark, sf):
    """The six components of largest ANOVA F over classes, of all 64."""
    names = [f"f{i}" for i in range(64)]
    e = embeddings(spark, sf).select("label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)))
    return spark.createDataFrame([(n,) for n in models.best_by_anova(e, names, "label", 6)], "feature string")


@query("""WITH s AS (SELECT user_id, hour(ts) f, avg(value) v FROM events GROUP BY 1, 2), z AS (SELECT user_id, CASE WHEN f<12 THEN 0 ELSE 1 END m, (v-avg(v) OVER (PARTITION BY f))/nullif(stddev_samp(v) OVER (PARTITION BY f), 0) z FROM s)
SELECT user_id, m AS module, round(avg(z), 6) score FROM z GROUP BY 1, 2""")
def hour_modules(spark, sf):
    long = events(spark, sf).groupBy("user_id", F.hour("ts").alias("hour")).agg(F.avg("value").alias("v"))
    members = spark.range(24).select(F.col("id").cast("int").alias("hour"), F.when(F.col("id") < 12, 0).otherwise(1).alias("module"))
    return _rounded(models.module_scores(long, members, "user_id", "hour", "v"), "score")


@query("""WITH m AS (SELECT user_id, event_type s, avg(value) g, avg(hour(ts)::double) y FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY g DESC, s) r FROM m),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id, r=1 ORDER BY y DESC, s) q FROM r) SELECT user_id, s event_type, CASE WHEN r=1 THEN 'S3' WHEN q=1 THEN 'S2' ELSE 'S1' END "label" FROM q""")
def event_state_names(spark, sf):
    return states.name_states(events(spark, sf).withColumn("hour", F.hour("ts").cast("double")), ["user_id"], "event_type", "value", "hour")


@query("""WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, value FROM events), b AS (SELECT user_id, i, value, CASE WHEN i<10 THEN 'pre' WHEN i<20 THEN 'stim' ELSE 'post' END segment, CASE WHEN i<10 THEN i WHEN i<20 THEN i-10 ELSE i-20 END j FROM t)
SELECT user_id, segment, (i-CASE segment WHEN 'pre' THEN 0 WHEN 'stim' THEN 1 ELSE 2 END)::double i, value FROM b""")
def trace_segments_in_order(spark, sf):
    """Three segments that each start at 0, put on one time axis again, each where the one before it ends."""
    t = traces(spark, sf).select("user_id", F.col("i").cast("double").alias("i"), "value")
    cut = {"pre": t.where("i < 10"), "stim": t.where("i >= 10 and i < 20").withColumn("i", F.col("i") - 10), "post": t.where("i >= 20").withColumn("i", F.col("i") - 20)}
    return seq.in_order(cut, ["user_id"], "i").select("user_id", "segment", "i", "value")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) NOT IN ('building', 'machinery') OR c_mktsegment IS NULL""")
def segment_violations(spark, sf):
    return tables.violations(table("customer")(spark, sf), "c_mktsegment", ["Building", "MACHINERY"]).select("c_custkey", "c_mktsegment")


@query("""WITH l AS (SELECT source origin, unnest(regexp_extract_all(hex(encode(text)), '.{48}')) h FROM documents), p AS (SELECT origin, ('0x'||substr(h, 6*x+5, 2))::int r, ('0x'||substr(h, 6*x+3, 2))::int g, ('0x'||substr(h, 6*x+1, 2))::int b FROM l, range(0, 8) t(x)),
m AS (SELECT *, greatest(r, g, b)::double top, (greatest(r, g, b)-least(r, g, b))::double d FROM p),
h AS (SELECT *, CASE WHEN d=0 THEN 0 WHEN top=r THEN 60.0::double*(g-b)/d WHEN top=g THEN 120+60.0::double*(b-r)/d ELSE 240+60.0::double*(r-g)/d END hue, round(CASE WHEN top=0 THEN 0 ELSE d/top*255 END) sat, round(0.299::double*r+0.587::double*g+0.114::double*b) grey FROM m)
SELECT origin, count(*) n, round(avg(grey), 6) grey, round(avg(round(CASE WHEN hue<0 THEN hue+360 ELSE hue END/2)), 6) hue, round(avg(sat), 6) sat, round(avg(top), 6) AS val FROM h GROUP BY 1""")
def pixel_channels(spark, sf):
    """Mean grey, hue, saturation and value where bytes of texts are pixels, eight to a line."""
    rows = documents(spark, sf).select(F.col("source").alias("origin"), F.encode("text", "utf-8").alias("data"))
    image = rows.select("origin", F.floor(F.octet_length("data") / 24.0).cast("int").alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), "data").where("height > 0")
    hue, sat, val = pixels.hsv()
    p = pixels.unpack(image).select("origin", pixels.grey().alias("grey"), hue.alias("hue"), sat.alias("sat"), val.alias("val"))
    return p.groupBy("origin").agg(F.count("*").alias("n"), *(r6(F.avg(c)).alias(c) for c in ("grey", "hue", "sat", "val")))


def _streamed(spark, sf: str, name: str, make):
    """All results of a streaming operator over a table's files, written to the shared folder and read back."""
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(spark.read.parquet(f"{sf}/{name}.parquet").schema.jsonValue())
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")
    out = make(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    run = out.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query("""SELECT event_type, strftime(to_timestamp(floor(epoch(ts)/21600)*21600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') start, count(value) n, round(avg(value), 6) mean, round(var_pop(value), 2) AS variance FROM events GROUP BY 1, 2""")
def live_window_means(spark, sf):
    """Windows of six hours over the events as a stream."""
    w = _streamed(spark, sf, "events", lambda s: live.window_means(s, ["event_type"], "ts", "value", "6 hours", "6 hours", "1 day"))
    return w.select("event_type", F.date_format("win.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", r6(F.col("mean")).alias("mean"), F.round("var", 2).alias("variance"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts)<INTERVAL 12 HOUR THEN 0 ELSE 1 END s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) b FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start, strftime(max(ts)+INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS stop, count(*) n FROM g GROUP BY user_id, b""")
def live_event_bouts(spark, sf):
    """Bouts of events less than twelve hours apart over the events as a stream."""
    b = _streamed(spark, sf, "events", lambda s: live.live_bouts(s, ["user_id"], "ts", "12 hours", "1 day"))
    return b.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("stop"), "n")
