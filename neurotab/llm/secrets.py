"""Secrets in texts: three fixed patterns, and strings that look random to character Markov models.

Two models of first order, of random strings and of ordinary identifiers, give the
log-likelihood ratio of a candidate: a run of ``LEAST`` or more characters of
``ALPHABET`` with a letter, which overlaps no match of the patterns. At ``ODDS``
or more it is a span of kind ``random``.

The models are trained from labelled samples of distinct strings. Labelled random
are what the patterns match in the corpus (hex and access keys; assigned values with
letters and digits) and generated strings over common alphabets; labelled ordinary
are all other runs of 12 or more characters with a letter. Of each label the ``samples`` strings of
smallest hash are taken, wherever they stand, so repeated ones count once and the
models don't depend on how rows are dealt out; transitions are counted by Spark.

Cases: null and empty texts have no span; places are code points, ends exclusive. An
empty table gives no rows, rows that repeat an id stay rows. Without a single
ordinary sample (an empty corpus) its model is uniform. Extra columns are dropped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import Scratch, ship

# The base patterns with the least lengths of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
START = len(ALPHABET)
LEAST, ODDS, BACKOFF = 16, 20.0, 5.0
RUN = re.compile("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
LETTER, DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
GENERATED = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[:52] + "0123456789_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789")
SPANS = "array<struct<kind: string, start: int, end: int>>"
CODES = np.full(128, START, np.int64)
CODES[[ord(c) for c in ALPHABET]] = np.arange(START)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) of each match of the patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def other_runs(text: str, base: list[tuple[int, int, int, int]], least: int):
    """Matches of RUN of that length that overlap no span of base, which are sorted."""
    starts, reach = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
    for m in RUN.finditer(text):
        before = bisect_left(starts, m.end())
        if m.end() - m.start() >= least and not (before and reach[before - 1] > m.start()):
            yield m


def _labelled(texts: pa.Array):
    """(label, string) of each sample in the texts."""
    for text in texts.to_pylist():
        if text:
            base = base_spans(text)
            for _, end, kind, at in base:
                value = text[at:end].replace(".", "")
                if kind or (LETTER.search(value) and DIGIT.search(value)):
                    yield 1, value
            for m in other_runs(text, base, 0):
                if LETTER.search(m[0]):
                    yield 0, m[0]


def samples(docs: DataFrame, n: int) -> DataFrame:
    """label, value: of each label the n distinct strings with the smallest hashes in all texts; a task keeps its own n smallest only."""

    def run(batches):
        best: tuple[dict, dict] = ({}, {})
        worst = [1 << 64, 1 << 64]
        for b in batches:
            for label, value in _labelled(b.column(0)):
                h = xxhash.xxh64_intdigest(value)
                if h <= worst[label]:
                    best[label][value] = h
                    if len(best[label]) >= 2 * n:
                        worst[label] = sorted(best[label].values())[n - 1]
                        kept = {v: x for v, x in best[label].items() if x <= worst[label]}
                        best[label].clear()
                        best[label].update(kept)
        for label in (0, 1):
            for i in range(0, len(best[label]), 5000):
                part = list(best[label].items())[i : i + 5000]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(part), pa.int32()), pa.array([v for v, _ in part]), pa.array([h - (1 << 63) for _, h in part], pa.int64())], ["label", "value", "h"])

    found = Scratch(docs.sparkSession, "secrets").cut(docs.select("text").mapInArrow(run, "label int, value string, h long").distinct())
    first = [found.where(F.col("label") == label).orderBy("h", "value").limit(n) for label in (0, 1)]
    return first[0].union(first[1]).select("label", "value")


def generated(n: int, seed: int = 13) -> list[tuple[int, str]]:
    """n strings of 16 to 64 random characters of each alphabet, labelled random."""
    r = np.random.default_rng(seed)
    return [(1, "".join(r.choice(list(a), int(r.integers(16, 65))))) for a in GENERATED for _ in range(n)]


def train(labelled: DataFrame) -> np.ndarray:
    """Log-likelihood ratios of transitions (row: character before, the last one the start) from rows of (label, value); a character seen seldom leans on the shares of single characters, and these on half a count more each."""

    def run(batches):
        n = np.zeros((2, START + 1, START), np.int64)
        for b in batches:
            for label, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = _codes(value)
                np.add.at(n[label], (codes[:-1], codes[1:]), 1)
        at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int32()) for a in at), pa.array(n[at])], ["label", "a", "b", "n"])

    usable = labelled.select(F.col("label").cast("int"), "value").where(F.col("label").isin(0, 1) & F.col("value").rlike("^[A-Za-z0-9+/_=-]+$"))
    counts = np.zeros((2, START + 1, START))
    for r in usable.mapInArrow(run, "label int, a int, b int, n long").groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():  # a row a transition
        counts[r.label, r.a, r.b] += r.n
    alone = counts.sum(1, keepdims=True) + 0.5
    alone /= alone.sum(2, keepdims=True)
    p = np.log((counts + BACKOFF * alone) / (counts.sum(2, keepdims=True) + BACKOFF))
    return p[1] - p[0]


def _codes(value: str) -> np.ndarray:
    return np.concatenate([[START], CODES[np.frombuffer(value.encode("ascii"), np.uint8)]])


def ratio(model: np.ndarray, value: str) -> float:
    """Log-likelihood ratio of random against ordinary of a string over ALPHABET."""
    codes = _codes(value)
    return float(model[codes[:-1], codes[1:]].sum())


def spans(text: str | None, model: np.ndarray) -> list[dict]:
    """All spans of a text, by start and then by kind."""
    if not text:
        return []
    base = base_spans(text)
    more = [(m.start(), m.end(), 3, 0) for m in other_runs(text, base, LEAST) if LETTER.search(m[0]) and ratio(model, m[0]) >= ODDS]
    return [{"kind": KINDS[k], "start": a, "end": b} for a, b, k, _ in sorted(base + more, key=lambda s: (s[0], s[2]))]


def learn(docs: DataFrame, n: int = 20_000) -> np.ndarray:
    """The model from samples of docs (n a label at most) and generated strings."""
    ship(docs.sparkSession)
    return train(samples(docs, n).union(docs.sparkSession.createDataFrame(generated(2000), "label int, value string")))


def find(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, spans (kind, start, end) of every row of (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spans(t, model) for t in b.column(1).to_pylist()], kind)], ["doc_id", "spans"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def listed(found: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans of every document, with models learned from all of them."""
    found = find(docs, learn(docs))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(of, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
