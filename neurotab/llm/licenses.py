"""License scan: exact set-similarity join of text blocks with license templates.

A block is a window of words, a template the set of words of a license notice.
A block meets a template if it holds at least ``threshold`` of the template's
words. The join is the prefix-filtered one: words are ordered by how many
documents hold them, rarest first; a block can only meet a template with which
it shares a word of both prefixes, has enough words (length filter), and has
enough words left after the first shared one (positional filter). What passes is
verified on the full sets. All of it is DataFrame functions.

Cases: null text counts as empty; an empty text has no words, no block and score
0. Repeated rows each get their result. Other columns of the input are dropped.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import lower_ascii, row_key

#: Characters between words, after A-Z is lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words of public license notices, by label.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
]
THRESHOLD, STRIDE = 0.8, 64


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Blocks have 2 * stride words and start every ``stride`` words, so a notice of
    up to stride + 1 words lies whole in one. ``blocks`` lists (label, first word
    of the block, containment) of each block that meets a template.
    """
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    text = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.col("text")), GAP, " ")), F.lit(" "))
    rows = docs.select("doc_id", row_key().alias("_key"), text.alias("_text"))
    none = F.array().cast("array<string>")
    words = F.when(F.col("_text") == "  ", none).otherwise(F.split(F.trim("_text"), " "))

    known = F.array(*map(F.lit, vocabulary))
    held = rows.select(F.explode(F.array_intersect(words, known)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()  # as many rows as the templates have words
    often = {r.word: r.n for r in held}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for k, (label, s) in enumerate(sets):
        need, ranks = ceil(threshold * len(s) - 1e-9), sorted(rank[w] for w in s)
        index += [(r, k, label, i, len(s), need, ranks) for i, r in enumerate(ranks[: len(s) - need + 1])]
    spark = docs.sparkSession
    prefixes = F.broadcast(spark.createDataFrame(index, "rank int, template int, label string, at int, size int, need int, ranks array<int>"))  # as large as the templates
    least, rare = min(x[5] for x in index), F.array(*(F.lit(order[r]) for r in sorted({x[0] for x in index})))

    near = rows.withColumn("_words", words).where(F.arrays_overlap("_words", rare))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("_words") - stride) / float(stride)).cast("int") - 1))
    blocks = near.select("_key", "_words", F.explode(starts).alias("_b")).select("_key", (F.col("_b") * stride).alias("start"), F.slice("_words", F.col("_b") * stride + 1, 2 * stride).alias("_w"))
    in_order = F.array(*map(F.lit, order))
    ranked = F.array_sort(F.transform(F.array_intersect("_w", in_order), lambda w: (F.array_position(in_order, w) - 1).cast("int")))
    ranked_blocks = blocks.select("_key", "start", ranked.alias("_r")).where(F.size("_r") >= least)
    prefix = ranked_blocks.select("_key", "start", "_r", F.posexplode(F.slice("_r", F.lit(1), F.size("_r") - least + 1)).alias("_at", "rank"))
    pairs = prefix.join(prefixes, "rank").where(
        (F.size("_r") >= F.col("need")) & (1 + F.least(F.col("size") - 1 - F.col("at"), F.size("_r") - 1 - F.col("_at")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("_r", "ranks"))
    met = pairs.where(shared >= F.col("need")).select("_key", F.struct("label", "start", F.round(shared / F.col("size"), 6).alias("containment"), "template").alias("_m"))
    by_row = met.groupBy("_key").agg(F.array_sort(F.collect_set("_m")).alias("_met"))

    found = []
    for phrase, label in phrases.items():
        ws = phrase.split()
        there = F.col("_text").contains(f" {phrase} ")
        first = F.size(words) - len(ws)
        at = F.when(there, F.filter(F.sequence(F.lit(0), first), _stands(ws))).otherwise(F.array().cast("array<int>"))
        found.append((label, at))
    base = rows.withColumn("_words", words).select(
        "doc_id", "_key", F.size("_words").cast("long").alias("n_words"), *(at.alias(f"_p{k}") for k, (_, at) in enumerate(found))
    )
    places = F.concat(*(F.col(f"_p{k}") for k in range(len(found))))
    labels = F.concat(*(F.when(F.size(f"_p{k}") > 0, F.array(F.lit(label))).otherwise(none) for k, (label, _) in enumerate(found)))
    base = base.withColumn("_places", places).withColumn("_base", F.array_sort(F.array_distinct(labels)))
    out = base.join(by_row, "_key", "left")
    own = F.coalesce(F.transform("_met", lambda m: m.label), none)
    best = F.coalesce(F.array_max(F.transform("_met", lambda m: m.containment)), F.lit(0.0))
    return out.select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", own)), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(best).alias("score"),
        F.transform("_met", lambda m: F.struct(m.label.alias("label"), m.start.alias("start"), m.containment.alias("containment"))).alias("blocks"),
    )


def _stands(ws):
    """Whether the words ws stand at place i of _words."""
    return lambda i: reduce(and_, (F.element_at("_words", i + k + 1) == w for k, w in enumerate(ws)))


def oracle() -> str:
    """The same rows in SQL for DuckDB, every block against every template."""
    quote = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
    sets = ",".join(f"({k},'{label}',{quote(s)},{ceil(THRESHOLD * len(s) - 1e-9)})" for k, (label, s) in enumerate((a, sorted(set(b.split()))) for a, b in TEMPLATES))
    at = []
    for phrase, label in PHRASES.items():
        ws = phrase.split()
        at.append((label, f"list_filter(range(0, greatest(len(w)-{len(ws) - 1},0)), lambda i: " + " AND ".join(f"w[i+{k + 1}]='{x}'" for k, x in enumerate(ws)) + ")"))
    return rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text,''),'{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}','{"abcdefghijklmnopqrstuvwxyz"}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
p AS (SELECT r, doc_id, w, len(w) n, {", ".join(f"{x} p{k}" for k, (_, x) in enumerate(at))} FROM d),
t(k, label, s, need) AS (VALUES {sets}),
b AS (SELECT r, list_distinct(w[x*{STRIDE}+1 : x*{STRIDE}+{2 * STRIDE}]) bw FROM (SELECT r, w, unnest(range(0, greatest(1, ceil((n-{STRIDE})/{STRIDE}.0)::bigint))) x FROM p)),
m AS (SELECT r, list(DISTINCT label) own, max(round(c/len_s, 6)) best FROM (SELECT r, label, need, len(list_intersect(bw, s)) c, len(s)::double len_s FROM b, t) WHERE c >= need GROUP BY r),
q AS (SELECT p.*, {" || ".join(f"p{k}" for k in range(len(at)))} a, {" || ".join(f"CASE WHEN len(p{k})>0 THEN ['{label}'] ELSE [] END" for k, (label, _) in enumerate(at))} bl FROM p)
SELECT doc_id, n::bigint n_words, len(a)::bigint n_base, list_min(a)::bigint first_word, list_max(a)::bigint last_word,
  coalesce(array_to_string(list_sort(list_distinct(bl)), ','), '') base_labels, coalesce(array_to_string(list_sort(list_distinct(bl || coalesce(own, []))), ','), '') labels,
  CASE WHEN len(bl)>0 THEN 1.0::double ELSE coalesce(best, 0.0)::double END score
FROM q LEFT JOIN m USING (r)"""
