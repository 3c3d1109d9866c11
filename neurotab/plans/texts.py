"""Queries over documents, conversations and labels: notes with fields, scores against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab.functions import pixels
from neurotab.functions import text as tx
from neurotab.functions.columns import r6
from neurotab.operators import evaluate as ev
from neurotab.plans.registry import registry, table

QUERIES, ORACLES, query = registry()
documents, conversations, labels, part = map(table, ("documents", "conversations", "labels", "part"))


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '([0-9]{3,4}-[0-9]{3,4})', 1), '') phone, nullif(regexp_extract(text, '([A-Za-z0-9._]+@[a-z0-9.]+)', 1), '') mail,
 array_to_string(list_filter(['license','License','copyright','http'], lambda w: contains(text, w)), ';') words, (contains(text,'License') OR contains(text,'license'))::int flag FROM documents""")
def note_fields(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select(
        "doc_id", tx.first_match(t, ["([0-9]{3,4}-[0-9]{3,4})"]).alias("phone"), tx.first_match(t, ["([A-Za-z0-9._]+@[a-z0-9.]+)"]).alias("mail"),
        tx.keywords(t, ["license", "License", "copyright", "http"]).alias("words"), tx.any_keyword(t, ["License", "license"]).alias("flag"),
    )


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '　', ' ', 'g'), '[ \t]+', ' ', 'g'), ' ?\n\s*', chr(10), 'g'))) tidy FROM conversations""")
def tidy_turns(spark, sf):
    return conversations(spark, sf).select("conv_id", "turn", F.md5(tx.tidy(F.col("text"))).alias("tidy"))


@query("""SELECT p_partkey, CASE WHEN regexp_extract(upper(p_brand), '^(BRAND)', 1)='' THEN 'UNK' ELSE 'BRAND' END g, try_cast(regexp_extract(p_brand, '#([0-9]+)', 1) AS double) n,
 CASE WHEN lower(p_name) LIKE '%small%' THEN 1 WHEN lower(p_name) LIKE '%large%' THEN 0 END size_flag FROM part""")
def name_labels(spark, sf):
    low = F.lower("p_name")
    return part(spark, sf).select("p_partkey", tx.group_of(F.col("p_brand"), ["brand"]).alias("g"), tx.number(F.regexp_extract("p_brand", "#([0-9]+)", 1)).alias("n"), F.when(low.contains("small"), 1).when(low.contains("large"), 0).alias("size_flag"))


SCORED = "SELECT doc_id, quality y, least(n_chars/8000.0::double, 1.0::double) p, source FROM labels JOIN documents USING (doc_id)"


def scored(spark, sf):
    """doc_id, y (quality), p (length up to 8,000 characters), source."""
    d = documents(spark, sf).select("doc_id", "source", "n_chars")
    return labels(spark, sf).join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), F.least(F.col("n_chars") / 8000.0, F.lit(1.0)).alias("p"), "source")


@query(f"""WITH s AS ({SCORED}), c AS (SELECT p, count(*)::double n, sum(y)::double pos FROM s GROUP BY 1),
k AS (SELECT *, coalesce(sum(n-pos) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) below, sum(pos) OVER (ORDER BY p DESC) tp, sum(n) OVER (ORDER BY p DESC) al FROM c)
SELECT round(sum(pos*(below+(n-pos)/2))/(sum(pos)*sum(n-pos)), 6) auc, round(sum(pos*tp/al)/sum(pos), 6) ap, sum(pos) n_pos, sum(n-pos) n_neg FROM k""")
def label_auc(spark, sf):
    return ev.auc(scored(spark, sf), "y", "p").select(r6(F.col("auc")).alias("auc"), r6(F.col("ap")).alias("ap"), "n_pos", "n_neg")


@query(f"""WITH s AS ({SCORED}), c AS (SELECT p, count(*)::double n, sum(y)::double pos FROM s GROUP BY 1),
k AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) tp, sum(n-pos) OVER (ORDER BY p DESC) fp, sum(pos) OVER () ap, sum(n-pos) OVER () an FROM c)
SELECT round(p, 6) threshold, round(tp/ap, 6) tpr, round(fp/an, 6) fpr, round(tp/(tp+fp), 6) "precision" FROM k""")
def label_curve(spark, sf):
    return ev.curve(scored(spark, sf), "y", "p").select(*(r6(F.col(c)).alias(c) for c in ("threshold", "tpr", "fpr", "precision")))


@query(f"SELECT least(floor(p*10), 9)::bigint bin, count(*) n, round(avg(p), 6) mean_p, round(avg(y), 6) share FROM ({SCORED}) GROUP BY 1")
def label_reliability(spark, sf):
    r = ev.reliability(scored(spark, sf), "y", "p", 10)
    return r.select("bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("share")).alias("share"))


@query(f"""WITH b AS (SELECT count(*) n, avg(p) m, avg(y) s, sum((p-y)*(p-y)) q FROM ({SCORED}) GROUP BY least(floor(p*10), 9))
SELECT round(sum(n*abs(m-s))/sum(n), 6) ece, sum(n)::bigint n, round(sum(q)/sum(n), 6) brier FROM b""")
def label_calibration(spark, sf):
    b = ev.brier_ece(scored(spark, sf).withColumn("k", F.lit(1)), "y", "p", 10, ["k"])
    return b.select(r6(F.col("ece")).alias("ece"), "n", r6(F.col("brier")).alias("brier"))


@query(f"""WITH s AS ({SCORED}), t AS (SELECT unnest(range(1, 20))/20.0::double t), g AS (SELECT t, count(*)::double n, sum(y)::double pos, count(CASE WHEN p>=t AND y=1 THEN 1 END) tp, count(CASE WHEN p>=t AND y=0 THEN 1 END) fp FROM s, t GROUP BY 1)
SELECT round(t, 6) threshold, round(tp/n-fp/n*t/(1-t), 6) net_benefit_model, round(pos/n-(n-pos)/n*t/(1-t), 6) net_benefit_all, 0.0::double net_benefit_none FROM g""")
def label_decision_curve(spark, sf):
    d = ev.decision_curve(scored(spark, sf), "y", "p", [i / 20 for i in range(1, 20)])
    return d.select(*(r6(F.col(c)).alias(c) for c in d.columns))


@query(f"SELECT source, round(1-avg((y-p)*(y-p))/nullif(var_pop(y),0), 6) r2, round(avg(abs(y-p)), 6) mae, round(sqrt(avg((y-p)*(y-p))), 6) rmse, count(*) n FROM ({SCORED}) GROUP BY 1")
def label_regression(spark, sf):
    m = ev.regression_metrics(scored(spark, sf), "y", "p", ["source"])
    return m.select("source", *(r6(F.col(c)).alias(c) for c in ("r2", "mae", "rmse")), "n")


@query(f"SELECT y, n_folds, sum(n)::bigint n, max(n)-min(n) spread FROM (SELECT y, 5::bigint n_folds, count(*) n FROM (SELECT y, (row_number() OVER (PARTITION BY y ORDER BY doc_id)-1)%5 f FROM ({SCORED})) GROUP BY y, f) GROUP BY 1, 2")
def label_folds(spark, sf):
    f = ev.folds(scored(spark, sf), "doc_id", "y", 5, 1).groupBy("y", "fold").agg(F.count("*").alias("c"))
    return f.groupBy("y").agg(F.count("*").alias("n_folds"), F.sum("c").alias("n"), (F.max("c") - F.min("c")).alias("spread"))


@query()
def label_calibration_line(spark, sf):
    slope, intercept = ev.calibration_line(scored(spark, sf), "y", "p")
    return spark.createDataFrame([(slope, intercept)], "slope double, intercept double")


@query()
def label_bootstrap_auc(spark, sf):
    from neurotab.operators import stats

    b = stats.bootstrap(scored(spark, sf), [], ["y"], "doc_id", 40, 9)
    per = ev.auc(b, "y", "p", ["rep"])
    return per.agg(F.percentile("auc", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("interval"), F.count("auc").alias("draws"))


OD = "(-log10(({}+1.0::double)/256.0::double))"


@query(f"""WITH l AS (SELECT source origin, unnest(regexp_extract_all(hex(encode(text)), '.{{48}}')) h FROM documents),
p AS (SELECT origin, ('0x'||substr(h, 6*x+5, 2))::int r, ('0x'||substr(h, 6*x+3, 2))::int g, ('0x'||substr(h, 6*x+1, 2))::int b FROM l, range(0, 8) t(x)),
m AS (SELECT *, greatest(r, g, b)::double top, (greatest(r, g, b)-least(r, g, b))::double d FROM p),
h AS (SELECT *, CASE WHEN d=0 THEN 0 WHEN top=r THEN 60.0::double*(g-b)/d WHEN top=g THEN 120+60.0::double*(b-r)/d ELSE 240+60.0::double*(r-g)/d END hue, round(CASE WHEN top=0 THEN 0 ELSE d/top*255 END) sat, round(0.299::double*r+0.587::double*g+0.114::double*b)<245 tissue,
 greatest({{}}, 0) od FROM m),
o AS (SELECT *, tissue AND round(CASE WHEN hue<0 THEN hue+360 ELSE hue END/2) BETWEEN 5 AND 30 AND sat>=40 AND top BETWEEN 20 AND 220 positive FROM h)
SELECT origin, count(*) FILTER (tissue) tissue, count(*) FILTER (positive) positive, round(avg(od) FILTER (positive), 6) mean, round(sum(od) FILTER (positive), 4) integrated, round(count(*) FILTER (positive)/(count(*) FILTER (tissue)+1e-9::double), 6) area_ratio FROM o GROUP BY 1""".replace("{}", "+".join(f"({w}::double)*" + OD.format(c) for w, c in zip(pixels.DAB, "rgb"))))
def pixel_markers(spark, sf):
    """Colour metrics where the bytes of a document's text are the pixels of an image row, eight to a line; the bytes of a last line that isn't full are no pixels."""
    rows = documents(spark, sf).select(F.col("source").alias("origin"), F.encode("text", "utf-8").alias("data"))
    image = rows.select("origin", F.floor(F.octet_length("data") / 24.0).cast("int").alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"), "data").where("height > 0")
    m = pixels.marker_metrics(pixels.unpack(image), ["origin"], pixels.colour_mask("brown"), pixels.stain_density())
    return m.withColumns({"mean": r6(F.col("mean")), "integrated": F.round("integrated", 4), "area_ratio": r6(F.col("area_ratio"))})
