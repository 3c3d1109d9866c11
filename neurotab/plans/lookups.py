"""Queries that look labels and partners up by name, split tables, and lay a surface over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from neurotab.functions.columns import r6
from neurotab.functions.text import group_of
from neurotab.operators import lookup, ranges
from neurotab.plans.registry import registry, table

QUERIES, ORACLES, query = registry()


@query("""SELECT d.doc_id, coalesce(max(l.quality)::varchar, CASE WHEN lower(d.lang) IN ('en', 'de') THEN upper(d.lang) ELSE 'UNK' END) "group"
FROM (SELECT DISTINCT doc_id, lang FROM documents WHERE lang IS NOT NULL) d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id, d.lang""")
def document_labels(spark, sf):
    docs = table("documents")(spark, sf).where("lang is not null").select("doc_id", "lang").distinct()
    found = lookup.with_labels(docs, "doc_id", [table("labels")(spark, sf)], group_of(F.col("lang"), ("en", "de")), samples=["doc_id"], groups=["quality"])
    return found.select("doc_id", "group")


@query("""WITH f AS (SELECT s_nationkey n, s_suppkey k, s_name FROM supplier) SELECT c_custkey, coalesce((SELECT min(s_name) FROM f WHERE n=c_nationkey AND k=c_custkey), (SELECT min(s_name) FROM f WHERE n=c_nationkey)) s_name FROM customer""")
def customer_supplier(spark, sf):
    c = table("customer")(spark, sf).select(F.col("c_nationkey").alias("folder"), F.col("c_custkey").alias("stem"))
    f = table("supplier")(spark, sf).select(F.col("s_nationkey").alias("folder"), F.col("s_suppkey").alias("stem"), "s_name")
    return lookup.side_file(c, f, "folder", "stem", "s_name", "found").select(F.col("stem").alias("c_custkey"), F.col("found").alias("s_name"))


@query(r"""SELECT centre, suffix, count(*) n FROM (SELECT CASE WHEN s_nationkey=3 THEN 'val' ELSE 'train' END centre, CASE regexp_extract(s_name, '(\d+)$', 1)::int WHEN 1 THEN 'train' WHEN 2 THEN 'train' WHEN 3 THEN 'test' WHEN 4 THEN 'ext' END suffix FROM supplier) GROUP BY 1, 2""")
def supplier_splits(spark, sf):
    s = lookup.leave_out(table("supplier")(spark, sf), "s_nationkey", 3, "centre")
    s = lookup.split_by_suffix(s, "s_name", {1: "train", 2: "train", 3: "test", 4: "ext"}, "suffix")
    return s.groupBy("centre", "suffix").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT hour(ts)::double x, value/10 y, CASE WHEN event_type='purchase' THEN 1.0::double ELSE 0.0::double END z FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL),
b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM e), g AS (SELECT i, j, x0+(x1-x0)*i/9.0::double gx, y0+(y1-y0)*j/9.0::double gy FROM b, (SELECT unnest(range(0, 10)) i), (SELECT unnest(range(0, 10)) j)),
w AS (SELECT gx, gy, z, exp(-((x-gx)*(x-gx)+(y-gy)*(y-gy))/32.0::double) w FROM e, g) SELECT round(gx, 6) x, round(gy, 6) y, round(sum(w*z)/sum(w), 6) z FROM w GROUP BY gx, gy""")
def event_surface(spark, sf):
    e = table("events")(spark, sf).select(F.hour("ts").cast("double").alias("x"), (F.col("value") / 10).alias("y"), F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type").isNotNull(), 0.0).alias("z"))
    e = e.dropna()
    s = ranges.kernel_surface(e, "x", "y", "z", ranges.surface_nodes(e, "x", "y", 10))
    return s.select(*(r6(F.col(c)).alias(c) for c in "xyz"))
