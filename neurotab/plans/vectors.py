"""Queries over embeddings: a vector's first components are a point, its dimensions features, its label a class."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from neurotab.functions.columns import r6
from neurotab.operators import cloud, models, omics, ranges
from neurotab.plans.registry import registry, table

QUERIES, ORACLES, query = registry()
embeddings = table("embeddings")
XYZ = "SELECT vec_id, label, embedding[1]::double x, embedding[2]::double y, embedding[3]::double z FROM embeddings"


def points(spark, sf):
    """vec_id, label and the first three components as x, y, z."""
    e = embeddings(spark, sf)
    return e.select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


def wide(spark, sf, n: int):
    return embeddings(spark, sf).select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n)))


D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


@query(f"""WITH p AS ({XYZ}), a AS (SELECT * FROM p WHERE label%2=0), b AS (SELECT * FROM p WHERE label%2=1)
SELECT vec_id, avg_l, sd_l, max_l, round(far, 6) far FROM (SELECT a.vec_id, round(avg(b.label), 6) avg_l, round(stddev_pop(b.label), 6) sd_l, max(b.label) max_l, max(d) far FROM a JOIN LATERAL (SELECT label, sqrt({D2}) d FROM b ORDER BY {D2}, b.vec_id LIMIT 8) b ON true GROUP BY 1)""")
def knn_fusion(spark, sf):
    p = points(spark, sf)
    j = ranges.knn_join(p.where("label % 2 = 0"), p.where("label % 2 = 1"), "vec_id", "vec_id", 8, 0.1)
    return j.groupBy("vec_id").agg(r6(F.avg("label_r")).alias("avg_l"), r6(F.stddev_pop("label_r")).alias("sd_l"), F.max("label_r").alias("max_l"), r6(F.max("dist")).alias("far"))


@query(f"""WITH p AS ({XYZ}), h AS (SELECT a.vec_id, b.vec_id i FROM p a JOIN p b ON sqrt({D2})<=0.08), g AS (SELECT vec_id, list_sort(list(i))[1:4] ids FROM h GROUP BY 1)
SELECT vec_id, slot, coalesce(ids[slot+1], ids[1]) hit FROM g, (SELECT unnest(range(0,4)) slot)""")
def radius_groups(spark, sf):
    p = points(spark, sf)
    h = ranges.first_within(p, p, 0.08, "vec_id", "vec_id", 4)
    g = ranges.pad_groups(h.select("vec_id", F.col("vec_id_r").alias("hit")), "vec_id", "hit", 4)
    return g.select("vec_id", F.col("slot").cast("long").alias("slot"), "hit")


@query(f"""WITH p AS ({XYZ}), a AS (SELECT * FROM p WHERE label%2=0), b AS (SELECT * FROM p WHERE label%2=1), h AS (SELECT a.vec_id FROM a JOIN b ON sqrt({D2})<0.06 GROUP BY 1)
SELECT label, count(*) n, count(h.vec_id) hits, round(count(h.vec_id)/count(*)::double, 6) ratio FROM a LEFT JOIN h USING (vec_id) GROUP BY 1""")
def nearest_within(spark, sf):
    p = points(spark, sf)
    a = p.where("label % 2 = 0")
    h = ranges.radius_join(a, p.where("label % 2 = 1"), 0.06, strict=True).select("vec_id").distinct().withColumn("hit", F.lit(1))
    return a.join(h, "vec_id", "left").groupBy("label").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), r6(F.count("hit") / F.count("*")).alias("ratio"))


@query(f"""WITH c AS (SELECT *, x-avg(x) OVER w cx, y-avg(y) OVER w cy, z-avg(z) OVER w cz FROM ({XYZ}) WINDOW w AS (PARTITION BY label)),
m AS (SELECT *, max(sqrt(cx*cx+cy*cy+cz*cz)) OVER (PARTITION BY label)+1e-6 r FROM c) SELECT vec_id, round(cx/r, 6) x, round(cy/r, 6) y, round(cz/r, 6) z FROM m""")
def unit_sphere(spark, sf):
    u = cloud.unit_sphere(points(spark, sf), ["label"])
    return u.select("vec_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query(f"""WITH c AS (SELECT *, sqrt(power(x-avg(x) OVER w,2)+power(y-avg(y) OVER w,2)+power(z-avg(z) OVER w,2)) d FROM ({XYZ}) WINDOW w AS (PARTITION BY label))
SELECT label, count(*) n, round(avg(d), 6) mean_d, round(max(d), 6) max_d FROM c GROUP BY 1""")
def centroid_distance(spark, sf):
    w = Window.partitionBy("label")
    d2 = sum(((F.col(c) - F.avg(c).over(w)) * (F.col(c) - F.avg(c).over(w)) for c in "xyz"), F.lit(0.0))
    return points(spark, sf).withColumn("d", F.sqrt(d2)).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean_d"), r6(F.max("d")).alias("max_d"))


LONG = "SELECT vec_id, i, embedding[i+1]::double v FROM embeddings, (SELECT unnest(range(0, 12)) i)"


def features(spark, sf):
    """Long form (vec_id, i, v) of the first twelve components."""
    return embeddings(spark, sf).select("vec_id", F.posexplode(F.slice("embedding", 1, 12)).alias("i", "v")).withColumn("v", F.col("v").cast("double")).withColumn("i", F.col("i").cast("long"))


@query(f"WITH f AS ({LONG}) SELECT a.i src, b.i dst, round(corr(a.v, b.v), 6) rho, count(*) n FROM f a JOIN f b ON a.vec_id=b.vec_id AND a.i<b.i GROUP BY 1, 2")
def dimension_correlations(spark, sf):
    return omics.correlations(features(spark, sf), "vec_id", "i", "v").withColumn("rho", r6(F.col("rho")))


@query(f"""WITH f AS ({LONG}), e AS (SELECT a.i src, b.i dst, corr(a.v, b.v) rho FROM f a JOIN f b ON a.vec_id=b.vec_id AND a.i<b.i GROUP BY 1, 2),
k AS (SELECT *, least(src%3, dst%3) class_a, greatest(src%3, dst%3) class_b FROM e WHERE abs(rho)>=0.02)
SELECT class_a, class_b, count(*) n_edges, round(count(*)/(CASE WHEN class_a=class_b THEN 6.0::double ELSE 16.0::double END), 6) density FROM k GROUP BY 1, 2""")
def graph_density(spark, sf):
    e = omics.correlations(features(spark, sf), "vec_id", "i", "v").where(F.abs("rho") >= 0.02)
    nodes = features(spark, sf).select("i").distinct().withColumn("c", F.col("i") % 3)
    return omics.class_density(e, nodes, "i", "c").withColumn("density", r6(F.col("density")))


@query()
def vector_pca_outliers(spark, sf):
    names = [f"f{i}" for i in range(16)]
    return models.outliers(wide(spark, sf, 16), names, 3).select("vec_id", "pc1", "pc2", "pc3", "t2", "q", "t2_out", "q_out")


@query()
def vector_kmeans(spark, sf):
    return models.kmeans(wide(spark, sf, 16), [f"f{i}" for i in range(16)], 4).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query()
def vector_partial_correlations(spark, sf):
    found = models.partial_correlations(wide(spark, sf, 10), [f"f{i}" for i in range(10)])
    return spark.createDataFrame(found, "src string, dst string, rho double")


@query()
def vector_farthest_points(spark, sf):
    return cloud.farthest_points(points(spark, sf), "label", "vec_id", 16, 3)


@query("""WITH RECURSIVE c AS (SELECT DISTINCT label, floor(embedding[1]::double/0.05::double)::int i, floor(embedding[2]::double/0.05::double)::int j, floor(embedding[3]::double/0.05::double)::int k FROM embeddings),
r AS (SELECT label, i, j, k, i ri, j rj, k rk FROM c UNION SELECT r.label, c.i, c.j, c.k, ri, rj, rk FROM r JOIN c ON r.label=c.label AND abs(r.i-c.i)+abs(r.j-c.j)+abs(r.k-c.k)=1),
g AS (SELECT label, i, j, k, min((ri, rj, rk)) root FROM r GROUP BY ALL)
SELECT label, root[1] first_i, root[2] first_j, root[3] first_k, count(*) area, round(avg(i), 6) ci, round(avg(j), 6) cj, round(avg(k), 6) ck FROM (SELECT *, row(root[1], root[2], root[3]) q FROM g) GROUP BY label, root""")
def vector_components(spark, sf):
    grid = points(spark, sf).select("label", *(F.floor(F.col(c) / 0.05).cast("int").alias(n) for c, n in zip("xyz", "ijk"))).distinct()
    g = cloud.voxel_components(grid, "label").groupBy("label", "component").agg(F.min(F.struct("i", "j", "k")).alias("first"), F.count("*").alias("area"), *(r6(F.avg(c)).alias(f"c{c}") for c in "ijk"))
    return g.select("label", *(F.col(f"first.{c}").alias(f"first_{c}") for c in "ijk"), "area", "ci", "cj", "ck")
