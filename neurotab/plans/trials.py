"""Exact tests, intervals, neighbours, prognosis and batches over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from neurotab.functions import clinical
from neurotab.functions.columns import r6
from neurotab.operators import exact, neighbours, prognosis, resample, windows
from neurotab.plans.registry import registry, table
from neurotab.plans.signals import traces
from neurotab.sources import batch
from neurotab.sources.shared import shared_dir

QUERIES, ORACLES, query = registry()
orders, lineitem, customer, events, documents, labels, embeddings = map(table, ("orders", "lineitem", "customer", "events", "documents", "labels", "embeddings"))

SUCCESSIVE = "SELECT o_custkey k, o_totalprice a, lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) b FROM orders"


def successive(spark, sf):
    """k, a, b: prices of an order and of the customer's next one."""
    nxt = F.lead("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return orders(spark, sf).select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("a"), nxt.alias("b")).where("b is not null")


@query(f"""WITH RECURSIVE d AS (SELECT k, b-a d FROM ({SUCCESSIVE}) WHERE b IS NOT NULL AND b<>a),
r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) r, count(*) OVER (PARTITION BY k, abs(d)) t FROM d),
g AS (SELECT k, sum(CASE WHEN d>0 THEN r ELSE 0 END)::bigint p, sum(CASE WHEN d<0 THEN r ELSE 0 END)::bigint m, count(*) n FROM r GROUP BY 1 HAVING max(t)=1 AND count(*)<=50),
c(n, ways) AS (SELECT 0, [1::double] UNION ALL SELECT n+1, list_transform(range(0, (n+1)*(n+2)//2+1), lambda s: coalesce(ways[s+1], 0)+CASE WHEN s>=n+1 THEN coalesce(ways[s-n], 0) ELSE 0 END) FROM c WHERE n<50)
SELECT k, least(p, m)::double w, g.n::bigint n, round(least(1, 2*list_sum(ways[1:least(p, m)+1])/power(2, g.n)), 9) p FROM g JOIN c ON c.n=g.n""")
def customer_signed_rank(spark, sf):
    """Exact signed-rank tests of successive orders of each customer without ties and with 50 differences at most."""
    w = exact.wilcoxon(successive(spark, sf), ["k"], "a", "b").where("exact and n > 0")
    return w.select("k", "w", "n", F.round("p", 9).alias("p"))


@query("""WITH RECURSIVE v AS (SELECT o_custkey k, o_totalprice x, o_orderpriority IN ('1-URGENT','2-HIGH') g FROM orders),
r AS (SELECT k, g, rank() OVER (PARTITION BY k ORDER BY x) r, count(*) OVER (PARTITION BY k, x) t FROM v),
s AS (SELECT k, sum(CASE WHEN g THEN r ELSE 0 END)::bigint r1, count(*) FILTER (g) n1, count(*) FILTER (NOT g) n0 FROM r GROUP BY 1 HAVING max(t)=1 AND count(*)<=24 AND n1>0 AND n0>0),
c AS (SELECT 0 m, 0 k, 0 s, 1::double ways UNION ALL SELECT m, k, s, sum(ways) FROM (SELECT m+1 m, k+x k, s+x*(m+1) s, ways FROM c, (VALUES (0), (1)) t(x) WHERE m<24) GROUP BY 1, 2, 3),
u AS (SELECT k, n1, n0, r1-n1*(n1+1)//2 u FROM s)
SELECT u.k, u::double u, n1, n0, round(least(1, 2*sum(CASE WHEN c.s<=least(u, n1*n0-u)+n1*(n1+1)//2 THEN ways ELSE 0 END)/sum(ways)), 9) p FROM u JOIN c ON c.m=n1+n0 AND c.k=n1 GROUP BY u.k, u, n1, n0""")
def customer_rank_sum(spark, sf):
    """Exact rank-sum tests of urgent against other orders of each customer of up to 24 orders without ties."""
    m = exact.mann_whitney(orders(spark, sf), ["o_custkey"], F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "o_totalprice")
    return m.where("exact and n1 + n0 <= 24 and n1 > 0 and n0 > 0").select(F.col("o_custkey").alias("k"), "u", "n1", "n0", F.round("p", 9).alias("p"))


def _cells(spark, sf):
    """Mean prices of two halves of a customer's orders by priority (band) and status (channel)."""
    o = orders(spark, sf).withColumn("half", F.col("o_orderkey") % 2)
    half = lambda h: F.avg(F.when(F.col("half") == h, F.col("o_totalprice")))
    return o.groupBy("o_orderpriority", "o_orderstatus", "o_custkey").agg(half(0).alias("before"), half(1).alias("after"))


@query()
def priority_significance(spark, sf):
    """Test choice, significant differences and effect sizes by priority and status."""
    return exact.significance(_cells(spark, sf), ["o_orderpriority", "o_orderstatus"], "before", "after")


@query("""WITH o AS (SELECT o_orderpriority b, o_orderstatus c, o_custkey, avg(CASE WHEN o_orderkey%2=0 THEN o_totalprice END) x, avg(CASE WHEN o_orderkey%2=1 THEN o_totalprice END) y FROM orders GROUP BY 1, 2, 3),
g AS (SELECT b, c, count(*) n, avg(x) mx, avg(y) my, sqrt((var_samp(x)+var_samp(y))/2) s FROM o WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2)
SELECT b o_orderpriority, c o_orderstatus, n, round(CASE WHEN sign(mx)*sign(my)>0 AND s>0 AND abs((my-mx)/s)>=0.02 THEN (my-mx)/s ELSE 0 END, 6) effect_d FROM g""")
def priority_effects(spark, sf):
    """Effect sizes of the same cells with a low threshold."""
    s = exact.significance(_cells(spark, sf), ["o_orderpriority", "o_orderstatus"], "before", "after", least_d=0.02)
    return s.select("o_orderpriority", "o_orderstatus", "n", r6(F.col("effect_d")).alias("effect_d"))


@query()
def label_intervals(spark, sf):
    """AUC and Brier score of a simple score of quality with intervals of 3,000 stratified draws; folds by id."""
    s = documents(spark, sf).select("doc_id", (1.0 / (1.0 + F.exp(-(F.log1p(F.length("text").cast("double")) - 6.0) / 2.0))).alias("p")).join(labels(spark, sf), "doc_id")
    return resample.metric_intervals(s.withColumn("fold", F.col("doc_id") % 5), [], "quality", "p", "fold")


@query()
def flag_differences(spark, sf):
    """Intervals of the difference in mean quantity between returned and kept lines, by status, from 1,000 draws."""
    return resample.difference_interval(lineitem(spark, sf), ["l_linestatus"], "l_returnflag", "R", "N", "l_quantity", draws=1000, seed=3)


COMPONENTS = [f"f{i}" for i in range(64)]


@query(f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda c: c::double) v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id o, list_distance(a.v, b.v) d FROM e a JOIN e b ON a.label%3=0 AND b.label%3=1),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) r FROM d) SELECT vec_id, r AS "rank", o AS neighbor, round(d, 6) distance FROM r WHERE r<=5""")
def vector_neighbours(spark, sf):
    """The five nearest vectors of another class in all 64 components."""
    e = embeddings(spark, sf).select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COMPONENTS)))
    n = neighbours.nearest(e.where("label % 3 = 0"), e.where("label % 3 = 1"), "vec_id", "vec_id", COMPONENTS, 5)
    return n.select("vec_id", F.col("rank").cast("long").alias("rank"), F.col("vec_id_r").alias("neighbor"), r6(F.col("distance")).alias("distance"))


@query("""WITH n AS (SELECT label, count(*) n FROM embeddings GROUP BY 1) SELECT label, (SELECT max(n) FROM n) n, (SELECT max(n) FROM n)-n synthetic FROM n""")
def label_oversample(spark, sf):
    """Rows of each class after oversampling in all 64 components."""
    e = embeddings(spark, sf).select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COMPONENTS)))
    s = neighbours.oversample(e, COMPONENTS, "vec_id", "label")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.col("synthetic"), 1)).alias("synthetic"))


@query()
def customer_prognosis(spark, sf):
    """Errors of a forest for the change between a customer's first and last order."""
    first, last = (f("o_totalprice", F.struct("o_orderdate", "o_orderkey")) for f in (F.min_by, F.max_by))
    o = orders(spark, sf).groupBy(F.col("o_custkey").alias("id")).agg(first.alias("before"), last.alias("after"), F.count("*").cast("double").alias("n_orders"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("priority"))
    c = customer(spark, sf).select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > -500, F.col("c_acctbal")).alias("balance"), "c_mktsegment")
    _, errors, _ = prognosis.train_validate(o.join(c, "id"), "id", "change", "before", "after", ["before", "n_orders", "balance"], ["priority", "c_mktsegment"], trees=(20,), depths=(3, 5), leaves=(1, 5), folds=3, rounds=2)
    return errors


NOTE = """'住院号：H'||o_orderkey||CASE WHEN o_orderkey%3=0 THEN ' 发病时间：'||strftime(o_orderdate, '%Y-%m-%d')||' 08:30' WHEN o_orderkey%3=1 THEN ' 起病 7：15' ELSE '' END||CASE WHEN o_orderkey%4<2 THEN chr(10)||'入院时间: '||strftime(o_orderdate, '%Y/%m/%d') ELSE ' 首次到院时间 3月4日 9:10' END
||CASE WHEN o_orderkey%5=0 THEN '' ELSE ' 采血时间：'||strftime(o_orderdate, '%Y.%m.%d')||' 10:05' END||CASE WHEN o_orderkey%2=0 THEN ' nihss: ' ELSE ' NIHSS评分：' END||(o_custkey%43)||' 年龄: '||(20+o_custkey%70)||' 岁 性别：'||CASE WHEN o_custkey%2=0 THEN '男' ELSE '女' END
||CASE WHEN o_orderkey%7=0 THEN ' 脑梗死' WHEN o_orderkey%7=1 THEN ' 脑出血' ELSE '' END||CASE WHEN o_orderkey%6=0 THEN ' 高血压 阿司匹林 100mg 每日一次' WHEN o_orderkey%6=1 THEN chr(10)||'用药：胰岛素 8u' ELSE ' 糖尿病 溶栓' END"""


def _pattern(field: str) -> str:
    """SQL of value, snippet and (by the snippet) place of a field: the patterns in order."""
    import re

    test = lambda p: f"regexp_matches(t, '(?i){p}')"
    of = lambda p, g: f"regexp_extract(t, '(?i){p}', {g})"
    ps = clinical.FIELDS[field]
    snippet = "CASE " + " ".join(f"WHEN {test(p)} THEN {of(p, 0)}" for p in ps) + " END"
    value = "CASE " + " ".join(f"WHEN {test(p)} THEN {of(p, min(re.compile(p).groups, 2))}" for p in ps) + " END"
    return f"{value} AS {field}, {snippet} AS {field}_snippet, strpos(t, {snippet}) AS {field}_place"


NINE = ("onset", "arrival", "sampling", "nihss", "age", "meds")


@query(f"""WITH n AS (SELECT o_orderkey, {NOTE} t FROM orders)
SELECT o_orderkey, {", ".join(map(_pattern, NINE))}, regexp_extract(t, '(性别)[:：]?\\s*(男|女)', 2) sex, '住院号_'||regexp_extract(t, '住院号[:：]?\\s*([A-Za-z0-9\\-]+)', 1) sample_id,
 CASE WHEN regexp_matches(t, '(?i)缺血|脑梗|梗死|IS|ZS') THEN 'ZS' WHEN regexp_matches(t, '(?i)出血|ICH|HS') THEN 'HS' END patient_group, contains(t, '高血压')::int htn, contains(t, '糖尿病')::int dm, contains(t, '溶栓')::int thrombolysis FROM n""")
def order_notes(spark, sf):
    """The nine clinical fields of notes that are made from orders: value, snippet and place of each."""
    k, c, lit = F.col("o_orderkey"), F.col("o_custkey"), F.lit
    day = lambda f: F.date_format("o_orderdate", f)
    note = F.concat(
        lit("住院号：H"), k.cast("string"), F.when(k % 3 == 0, F.concat(lit(" 发病时间："), day("yyyy-MM-dd"), lit(" 08:30"))).when(k % 3 == 1, lit(" 起病 7：15")).otherwise(lit("")),
        F.when(k % 4 < 2, F.concat(lit("\n入院时间: "), day("yyyy/MM/dd"))).otherwise(lit(" 首次到院时间 3月4日 9:10")), F.when(k % 5 == 0, lit("")).otherwise(F.concat(lit(" 采血时间："), day("yyyy.MM.dd"), lit(" 10:05"))),
        F.when(k % 2 == 0, lit(" nihss: ")).otherwise(lit(" NIHSS评分：")), (c % 43).cast("string"), lit(" 年龄: "), (20 + c % 70).cast("string"), lit(" 岁 性别："), F.when(c % 2 == 0, "男").otherwise("女"),
        F.when(k % 7 == 0, " 脑梗死").when(k % 7 == 1, " 脑出血").otherwise(""), F.when(k % 6 == 0, " 高血压 阿司匹林 100mg 每日一次").when(k % 6 == 1, "\n用药：胰岛素 8u").otherwise(" 糖尿病 溶栓"),
    )
    found = orders(spark, sf).select("o_orderkey", note.alias("t")).withColumns(clinical.extract(F.col("t")))
    parts = [F.col(f"{f}.{p}").alias(f if p == "value" else f"{f}_{p}") for f in NINE for p in ("value", "snippet", "place")]
    return found.select("o_orderkey", *(p.cast("long") if i % 3 == 2 else p for i, p in enumerate(parts)), F.col("sex.value").alias("sex"), "sample_id", "patient_group", "htn", "dm", "thrombolysis")


@query("""SELECT floor(user_id/5)::bigint recording, count(*)>=340 ok, CASE WHEN count(*)>=340 THEN count(*) ELSE 0 END n_samples, CASE WHEN count(*)<340 THEN 'ValueError: '||count(*)||' samples, 340 are needed' END error FROM events GROUP BY 1""")
def trace_batch(spark, sf):
    """Trace files of five users each, written and sorted as one batch: the files with too few samples fail by themselves."""
    e = events(spark, sf).select(F.floor(F.col("user_id") / 5).alias("recording"), "user_id", F.row_number().over(Window.partitionBy(F.floor(F.col("user_id") / 5)).orderBy("ts", "event_id")).alias("i"), "value")
    folder = f"{shared_dir(spark)}/traces-{uuid.uuid4().hex}"
    batch.write_traces(e.select("recording", ((F.col("i") - 1) / 10.0).alias("time"), "value"), folder, "recording", "time")
    r = batch.sort_batch(spark, folder, "*.csv", ("time", "value"), 10.0, 0.5, 3.0, 3.0, 2, 5, 340)
    return r.select(F.regexp_extract("file", "recording=([0-9]+)", 1).try_cast("long").alias("recording"), "ok", "n_samples", "error")


@query()
def signal_channel_features(spark, sf):
    """The whole feature vector of windows over eight users as channels, synchrony included."""
    t = traces(spark, sf).withColumn("recording", F.floor(F.col("user_id") / 8))
    bands = {"slow": (0.3, 1.0), "mid": (1.0, 2.0), "fast": (2.0, 4.0)}
    return windows.channel_features(t, ["recording"], "user_id", "i", "value", 10.0, 40, 20, bands, ["mid", "fast"])


@query()
def signal_coherence_matrix(spark, sf):
    """Coherence of whole recordings of all pairs of eight users, all samples of each."""
    t = traces(spark, sf).withColumn("recording", F.floor(F.col("user_id") / 8))
    return windows.coherence_matrix(t, ["recording"], "user_id", "i", "value", 10.0, 1.0, 3.0)
