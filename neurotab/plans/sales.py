"""Queries over lineitem, orders, part and supplier: a part or brand is a feature, a line a measurement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from neurotab.functions.columns import r6
from neurotab.operators import omics, stats
from neurotab.operators import sequence as seq
from neurotab.plans.registry import registry, table

QUERIES, ORACLES, query = registry()
lineitem, orders, part, supplier = map(table, ("lineitem", "orders", "part", "supplier"))


def _rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


def branded(spark, sf):
    """Lines with their part's brand and type."""
    return lineitem(spark, sf).join(part(spark, sf).select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))


BRANDED = "lineitem JOIN part ON l_partkey=p_partkey"


@query("""WITH d AS (SELECT o_orderpriority, date_diff('day', date '1970-01-01', o_orderdate::date)::double x, avg(o_totalprice) y FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, round(sum((nx-x)*(ny+y)/2), 4) area FROM (SELECT *, lead(x) OVER w nx, lead(y) OVER w ny FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY x)) GROUP BY 1""")
def orders_trapezoid(spark, sf):
    d = orders(spark, sf).groupBy("o_orderpriority", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double").alias("x")).agg(F.avg("o_totalprice").alias("y"))
    return seq.trapezoid(d, ["o_orderpriority"], "x", "y", "area").withColumn("area", F.round("area", 4))


@query(f"""SELECT p_brand, round((avg(CASE WHEN l_returnflag='R' THEN l_quantity END)-avg(CASE WHEN l_returnflag='N' THEN l_quantity END))/(avg(CASE WHEN l_returnflag='N' THEN l_quantity END)+1e-9), 6) effect FROM {BRANDED} GROUP BY 1""")
def brand_effect_ratio(spark, sf):
    on = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    return branded(spark, sf).groupBy("p_brand").agg(r6((on("R") - on("N")) / (on("N") + 1e-9)).alias("effect"))


@query("""SELECT l_returnflag, round(avg(CASE WHEN l_linestatus='O' THEN l_quantity END), 6) "O", round(avg(CASE WHEN l_linestatus='F' THEN l_quantity END), 6) "F" FROM lineitem GROUP BY 1""")
def flag_status_pivot(spark, sf):
    return _rounded(lineitem(spark, sf).groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.avg("l_quantity")), "O", "F")


@query(f"""WITH g AS (SELECT p_brand, count(CASE WHEN l_returnflag='R' THEN l_extendedprice END) n1, count(CASE WHEN l_returnflag<>'R' THEN l_extendedprice END) n0,
 avg(CASE WHEN l_returnflag='R' THEN l_extendedprice END) m1, avg(CASE WHEN l_returnflag<>'R' THEN l_extendedprice END) m0, var_samp(CASE WHEN l_returnflag='R' THEN l_extendedprice END) v1, var_samp(CASE WHEN l_returnflag<>'R' THEN l_extendedprice END) v0 FROM {BRANDED} GROUP BY 1)
SELECT p_brand, n1, n0, round(m1-m0, 4) diff, round((m1-m0)/sqrt(v1/n1+v0/n0), 6) t, round(power(v1/n1+v0/n0,2)/(power(v1/n1,2)/(n1-1)+power(v0/n0,2)/(n0-1)), 4) df FROM g""")
def brand_welch(spark, sf):
    w = stats.welch(branded(spark, sf), ["p_brand"], F.col("l_returnflag") == "R", "l_extendedprice")
    return _rounded(w, "t").withColumn("diff", F.round("diff", 4)).withColumn("df", F.round("df", 4))


@query()
def brand_welch_fdr(spark, sf):
    w = stats.welch(branded(spark, sf), ["p_brand"], F.col("l_returnflag") == "R", "l_extendedprice")
    return stats.benjamini_hochberg(w.withColumn("p", stats.p_student("t", "df")), "p")


RANKED = f"""SELECT *, rank() OVER (PARTITION BY p_type ORDER BY l_quantity)+(count(*) OVER (PARTITION BY p_type, l_quantity)-1)/2.0::double r, count(*) OVER (PARTITION BY p_type)::double total, power(count(*) OVER (PARTITION BY p_type, l_quantity)::double, 2)-1 tie FROM {BRANDED}"""


@query(f"""WITH g AS (SELECT p_type, l_returnflag, sum(r) r, count(*)::double n, sum(tie) tie, any_value(total) total FROM ({RANKED}) GROUP BY 1, 2)
SELECT p_type, round((12.0/(any_value(total)*(any_value(total)+1))*sum(r*r/n)-3.0*(any_value(total)+1))/(1-sum(tie)/(power(any_value(total),3)-any_value(total))), 4) h, count(*)-1 df FROM g GROUP BY 1""")
def type_kruskal(spark, sf):
    return stats.kruskal(branded(spark, sf), ["p_type"], "l_returnflag", "l_quantity").withColumn("h", F.round("h", 4))


@query(f"""WITH g AS (SELECT p_type, sum(CASE WHEN l_returnflag='R' THEN r END) r1, count(CASE WHEN l_returnflag='R' THEN 1 END)::double n1, count(CASE WHEN l_returnflag<>'R' THEN 1 END)::double n0, sum(tie) tie FROM ({RANKED}) GROUP BY 1),
u AS (SELECT *, r1-n1*(n1+1)/2 u FROM g)
SELECT p_type, u, round(greatest((abs(u-n1*n0/2)-0.5)/sqrt(n1*n0/12*((n1+n0+1)-tie/((n1+n0)*(n1+n0-1)))), 0), 5) z, round(2*u/(n1*n0)-1, 6) delta FROM u""")
def type_rank_sum(spark, sf):
    return _rounded(stats.rank_sum(branded(spark, sf), ["p_type"], F.col("l_returnflag") == "R", "l_quantity"), "delta").withColumn("z", F.round("z", 5))


@query("""WITH o AS (SELECT l_orderkey, any_value(l_returnflag) f, avg(CASE WHEN l_linenumber<=2 THEN l_quantity END) a, avg(CASE WHEN l_linenumber>2 THEN l_quantity END) b, max(l_suppkey)%7 k FROM lineitem GROUP BY 1),
g AS (SELECT k, count(*) n, avg(b-a) m, stddev_samp(b-a) s, avg(a) ma, avg(b) mb, var_samp(a) va, var_samp(b) vb FROM o WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT k, n, round(m/(s/sqrt(n)), 5) t, n-1 df, round(CASE WHEN sign(ma)=sign(mb) THEN mb-ma ELSE 0 END, 6) diff, round(CASE WHEN sign(ma)=sign(mb) THEN mb-ma ELSE 0 END/sqrt((va+vb)/2), 6) d FROM g""")
def order_paired(spark, sf):
    half = lambda c: F.avg(F.when(c, F.col("l_quantity")))
    o = lineitem(spark, sf).groupBy("l_orderkey").agg(half(F.col("l_linenumber") <= 2).alias("a"), half(F.col("l_linenumber") > 2).alias("b"), (F.max("l_suppkey") % 7).alias("k"))
    return _rounded(stats.paired(o, ["k"], "a", "b"), "diff", "d").withColumn("t", F.round("t", 5))


@query("""WITH o AS (SELECT l_orderkey, avg(CASE WHEN l_linenumber<=2 THEN l_quantity END)-avg(CASE WHEN l_linenumber>2 THEN l_quantity END) d, max(l_suppkey)%7 k FROM lineitem GROUP BY 1),
r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d))+(count(*) OVER (PARTITION BY k, abs(d))-1)/2.0::double r, power(count(*) OVER (PARTITION BY k, abs(d))::double,2)-1 tie FROM o WHERE d<>0)
SELECT k, sum(CASE WHEN d>0 THEN r ELSE 0 END)::double w_plus, sum(CASE WHEN d<0 THEN r ELSE 0 END)::double w_minus,
 round((least(sum(CASE WHEN d>0 THEN r ELSE 0 END), sum(CASE WHEN d<0 THEN r ELSE 0 END))-count(*)*(count(*)+1)/4.0::double)/sqrt(count(*)*(count(*)+1)*(2*count(*)+1)/24.0::double-sum(tie)/48), 5) z FROM r GROUP BY 1""")
def order_signed_rank(spark, sf):
    half = lambda c: F.avg(F.when(c, F.col("l_quantity")))
    o = lineitem(spark, sf).groupBy("l_orderkey").agg(half(F.col("l_linenumber") <= 2).alias("a"), half(F.col("l_linenumber") > 2).alias("b"), (F.max("l_suppkey") % 7).alias("k"))
    return stats.signed_rank(o, ["k"], "a", "b").withColumn("z", F.round("z", 5))


@query()
def brand_ks_normal(spark, sf):
    return stats.ks_normal(branded(spark, sf), ["p_brand"], "l_extendedprice")


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)+(count(*) OVER (PARTITION BY l_returnflag, l_quantity)-1)/2.0::double a,
 rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount)+(count(*) OVER (PARTITION BY l_returnflag, l_discount)-1)/2.0::double b FROM lineitem)
SELECT l_returnflag, count(*) n, round(corr(a, b), 5) rho FROM r GROUP BY 1""")
def flag_spearman(spark, sf):
    return stats.spearman(lineitem(spark, sf), ["l_returnflag"], "l_quantity", "l_discount").select("l_returnflag", "n", F.round("rho", 5).alias("rho"))


@query(f"SELECT p_brand, round(stddev_samp(l_quantity)/avg(l_quantity)*100, 6) rsd, count(l_quantity) n FROM {BRANDED} GROUP BY 1")
def brand_rsd(spark, sf):
    return _rounded(omics.relative_deviation(branded(spark, sf), ["p_brand"], "l_quantity"), "rsd")


@query("""WITH l AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_discount>=0.02 THEN l_discount END v FROM lineitem)
SELECT l_returnflag, l_linestatus, round(avg(CASE WHEN v IS NULL THEN 1.0::double ELSE 0.0::double END), 6) missing, count(*) n FROM l GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())""")
def missing_rates(spark, sf):
    v = lineitem(spark, sf).withColumn("v", F.when(F.col("l_discount") >= 0.02, F.col("l_discount")))
    return _rounded(omics.missing_rate(v, ["l_returnflag", "l_linestatus"], "v"), "missing")


@query("SELECT l_partkey, count(*) n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount>0.05 GROUP BY 1 HAVING count(*)>=8) GROUP BY 1")
def present_parts(spark, sf):
    v = lineitem(spark, sf).withColumn("v", F.when(F.col("l_discount") > 0.05, F.col("l_discount")))
    return omics.present_features(v, "l_partkey", "v", 8).groupBy("l_partkey").agg(F.count("*").alias("n"))


@query(f"SELECT p_brand, round(avg(CASE WHEN l_linestatus='O' THEN l_extendedprice END), 4) mean_1, round(avg(CASE WHEN l_linestatus<>'O' THEN l_extendedprice END), 4) mean_0, round(log2((avg(CASE WHEN l_linestatus='O' THEN l_extendedprice END)+1e-9)/(avg(CASE WHEN l_linestatus<>'O' THEN l_extendedprice END)+1e-9)), 6) log2fc FROM {BRANDED} GROUP BY 1")
def brand_fold_change(spark, sf):
    f = omics.fold_change(branded(spark, sf), ["p_brand"], F.col("l_linestatus") == "O", "l_extendedprice")
    return _rounded(f, "log2fc").withColumn("mean_1", F.round("mean_1", 4)).withColumn("mean_0", F.round("mean_0", 4))


@query("SELECT p_name, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) r FROM part) WHERE r=1 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def top_parts(spark, sf):
    return omics.top_distinct(part(spark, sf), "p_name", [F.desc("p_retailprice"), F.col("p_partkey")], 10).select("p_name", "p_partkey", "p_retailprice")


@query(f"""WITH b AS (SELECT p_brand FROM {BRANDED} GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5)
SELECT p_type, CASE WHEN p_brand IN (SELECT p_brand FROM b) THEN p_brand ELSE 'Other' END p_brand, l_returnflag, count(*) n FROM {BRANDED} WHERE l_returnflag IN ('R','N') GROUP BY 1, 2, 3""".replace(f"FROM {BRANDED} GROUP BY 1 ORDER", f"FROM {BRANDED} WHERE l_returnflag IN ('R','N') GROUP BY 1 ORDER"))
def brand_flows(spark, sf):
    return omics.flows(branded(spark, sf).where("l_returnflag in ('R', 'N')"), "p_type", "p_brand", "l_returnflag", 5)


@query(f"SELECT p_type, p_brand, l_returnflag, count(*) n, grouping_id(p_type, p_brand, l_returnflag)::bigint level FROM {BRANDED} GROUP BY ROLLUP (p_type, p_brand, l_returnflag)")
def taxonomy_counts(spark, sf):
    return branded(spark, sf).rollup("p_type", "p_brand", "l_returnflag").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("""WITH m AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), h AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag='R' AND l_quantity>=48),
j AS (SELECT m.*, p_name, h.l_partkey IS NOT NULL hit FROM m JOIN part ON m.l_partkey=p_partkey LEFT JOIN h USING (l_partkey))
SELECT l_suppkey, count(*) n_members, count(CASE WHEN hit THEN 1 END) n_hits, round(count(CASE WHEN hit THEN 1 END)/count(*)::double, 6) "share", array_to_string(list_sort(list(DISTINCT p_name) FILTER (hit))[1:5], ';') support FROM j GROUP BY 1 HAVING n_hits>0""")
def supplier_evidence(spark, sf):
    m = lineitem(spark, sf).select("l_suppkey", "l_partkey")
    names = part(spark, sf).select(F.col("p_partkey").alias("l_partkey"), "p_name")
    hits = lineitem(spark, sf).where("l_returnflag = 'R' and l_quantity >= 48")
    return _rounded(omics.pathway_evidence(m, hits, "l_suppkey", "l_partkey", "p_name", names=names), "share")


FC = "SELECT l_partkey, avg(CASE WHEN l_returnflag='R' THEN l_quantity END)-avg(CASE WHEN l_returnflag<>'R' THEN l_quantity END) e, count(*) n FROM lineitem WHERE l_linestatus='{}' GROUP BY 1"


@query(f"""WITH a AS ({FC.format("O")}), b AS ({FC.format("F")}), j AS (SELECT a.e ea, b.e eb, a.n<12 sa, b.n<12 sb FROM a JOIN b USING (l_partkey))
SELECT count(*) n, count(CASE WHEN sa THEN 1 END) n_a, count(CASE WHEN sb THEN 1 END) n_b, count(CASE WHEN sa AND sb THEN 1 END) "both", count(CASE WHEN sa OR sb THEN 1 END) either, count(CASE WHEN sign(ea)=sign(eb) THEN 1 END) same_sign, round(corr(ea, eb), 5) r,
 round(count(CASE WHEN sa AND sb THEN 1 END)/nullif(count(CASE WHEN sa OR sb THEN 1 END), 0)::double, 6) jaccard FROM j""")
def part_concordance(spark, sf):
    def effects(status):
        on = lambda c: F.avg(F.when(c, F.col("l_quantity")))
        return lineitem(spark, sf).where(F.col("l_linestatus") == status).groupBy("l_partkey").agg((on(F.col("l_returnflag") == "R") - on(F.col("l_returnflag") != "R")).alias("e"), F.count("*").cast("double").alias("n"))

    return _rounded(omics.concordance(effects("O"), effects("F"), "l_partkey", "n", "e", 12.0), "jaccard").withColumn("r", F.round("r", 5))


@query("""WITH u AS (SELECT l_partkey, l_suppkey, l_quantity v FROM lineitem WHERE l_linestatus='O' UNION ALL SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_linestatus='F'),
k AS (SELECT l_partkey FROM lineitem WHERE l_linestatus='O' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus='F')
SELECT l_partkey, l_suppkey, round(avg(v), 6) v FROM u WHERE l_partkey IN (SELECT * FROM k) GROUP BY 1, 2""")
def merged_tables(spark, sf):
    of = lambda s: lineitem(spark, sf).where(F.col("l_linestatus") == s).select("l_partkey", "l_suppkey", F.col("l_quantity").alias("v"))
    return _rounded(omics.merge_tables(of("O"), of("F"), "l_partkey", "l_suppkey", "v"), "v")


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag='R' AND l_discount>=0.09 AND l_quantity>=45)")
def suppliers_without(spark, sf):
    gone = lineitem(spark, sf).where("l_returnflag = 'R' and l_discount >= 0.09 and l_quantity >= 45").select(F.col("l_suppkey").alias("s_suppkey"))
    return supplier(spark, sf).join(gone, "s_suppkey", "left_anti").select("s_suppkey", "s_nationkey")


@query("SELECT p_partkey, p_name, CASE WHEN r=1 THEN p_name ELSE p_name||'__'||r END feature FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) r FROM part)")
def unique_names(spark, sf):
    r = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return part(spark, sf).select("p_partkey", "p_name", F.when(r == 1, F.col("p_name")).otherwise(F.concat_ws("__", "p_name", r.cast("string"))).alias("feature"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 2) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) r2 FROM lineitem GROUP BY 1")
def price_line(spark, sf):
    y, x = "l_extendedprice", "l_quantity"
    return lineitem(spark, sf).groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), r6(F.regr_r2(y, x)).alias("r2"))


@query()
def flag_bootstrap(spark, sf):
    sub = lineitem(spark, sf).select("l_returnflag", "l_quantity", F.xxhash64("l_orderkey", "l_linenumber").alias("id"))
    m = stats.bootstrap_means(sub, [], ["l_returnflag"], "id", "l_quantity", 20, 5)
    per = m.groupBy("rep").agg((F.max(F.when(F.col("l_returnflag") == "R", F.col("mean"))) - F.max(F.when(F.col("l_returnflag") == "N", F.col("mean")))).alias("d"))
    return per.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.count("d").alias("draws"))


@query("SELECT l_returnflag, 40::bigint n, 40::bigint slots FROM lineitem GROUP BY 1")
def exact_samples(spark, sf):
    s = omics.sample_exactly(lineitem(spark, sf).withColumn("id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey")), ["l_returnflag"], "id", 40, 3)
    return s.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"))


@query("""WITH d AS (SELECT l_returnflag, l_quantity x, l_extendedprice y FROM lineitem), q AS (SELECT l_returnflag, quantile_cont(x, 0.8) a, quantile_cont(y, 0.95) b FROM d GROUP BY 1)
SELECT l_returnflag, any_value(a) p80, round(any_value(b), 4) p95, count(CASE WHEN x>=a THEN 1 END) above, round(sum(CASE WHEN y>=b THEN y END), 2) integrated FROM d JOIN q USING (l_returnflag) GROUP BY 1""")
def flag_percentiles(spark, sf):
    d = lineitem(spark, sf).select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    q = d.groupBy("l_returnflag").agg(F.percentile("x", F.lit(0.8)).alias("a"), F.percentile("y", F.lit(0.95)).alias("b"))
    g = d.join(F.broadcast(q), "l_returnflag").groupBy("l_returnflag")
    return g.agg(F.first("a").alias("p80"), F.round(F.first("b"), 4).alias("p95"), F.count(F.when(F.col("x") >= F.col("a"), 1)).alias("above"), F.round(F.sum(F.when(F.col("y") >= F.col("b"), F.col("y"))), 2).alias("integrated"))
