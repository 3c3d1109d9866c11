"""Language identification: family first, then one-versus-one linear SVMs inside the family.

A text is a bag of letter 2-grams and 3-grams (bytes of the lower-cased text,
everything but letters a blank), hashed to two tables. Binary linear SVMs tell
families apart pair by pair, and languages of one family pair by pair; the class
with most votes wins, then the sum of margins decides. Every SVM is one group of
a grouped Spark job over a sample of labelled rows, at most about ``per_language``
rows a language; the number of SVMs grows with the square of the languages of a
family. Rows of the sample are sent as their bins and shares, once for each SVM that
learns from them. The weights, 2 * ``BINS`` floats an SVM, go to every task.

Cases: null text and text without a letter are ``und`` with score 0. With one
learned language every other text gets it; with none (no labelled row) every text
is ``und``. Repeated rows each get a result; extra columns are dropped. A row
without doc_id isn't held out and isn't learned from.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurotab.llm.common import ship

BINS = 1 << 13
SLICE = 1 << 18  # characters whose grams a task holds at once
#: Language families by ISO 639-1 code; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = regex.compile(r"\p{L}")
_KEEP = np.full(256, 32, np.int64)
_KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEEP[0x80:] = np.arange(0x80, 0x100)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the 2-grams and 3-grams of all texts, one of each at a byte, and where each text begins."""
    raw = [b" " + t.lower().encode() + b"  " for t in texts]
    x = _KEEP[np.frombuffer(b"".join(raw), np.uint8)]
    two = x[:-1] * 257 + x[1:]
    three = (two[:-1] * 257 + x[2:]) * 0x9E3779B1 >> 9
    starts = np.cumsum([0, *map(len, raw[:-1])])
    return np.stack([(two[:-1] * 0x85EBCA6B >> 7) % BINS, three % BINS + BINS], 1), starts


def sums(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean weight of the grams of each text, by SVM."""
    bins, starts = grams(texts)
    at = weights[bins[:, 0]] + weights[bins[:, 1]]
    at[(starts[1:, None] - np.array([1, 2])).ravel()] = 0  # grams that reach into the next text
    total = np.add.reduceat(at, starts, axis=0, dtype=np.float64)
    return total / np.diff(np.append(starts, len(bins) + 2))[:, None]


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bins that the grams of one text fall into, and the share of each."""
    bins, _ = grams([text])
    n = np.bincount(bins.ravel(), minlength=2 * BINS)
    at = np.flatnonzero(n)
    return at.astype(np.uint16), (n[at] / (len(bins) + 2)).astype(np.float32)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and equal weight of both classes, by accelerated gradient steps.

    rows: bins and shares of each text. Bins are standardised, but the rows stay
    sparse: the mean is taken off products with the weights.
    """
    size = np.array([len(at) for at, _ in rows])
    at, x = np.concatenate([a for a, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows])
    first, n = np.cumsum(size) - size, 2 * BINS
    mean = np.bincount(at, x, n) / len(rows)
    scale = np.sqrt(np.maximum(np.bincount(at, x.astype(np.float64) ** 2, n) / len(rows) - mean**2, 0)) + 1e-4
    unit = 1 / (scale * np.sqrt(n))
    x = (x * unit[at]).astype(np.float32)  # of standardised rows, but for their mean
    centre = mean * unit
    norm = np.add.reduceat(x * (x - 2 * centre[at]), first) + (centre**2).sum()
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    rate = 1 / (2 * float((share * (norm + 1)).sum()) + penalty)
    w, b, v, c = np.zeros(n), 0.0, np.zeros(n), 0.0
    for t in range(steps):
        margin = np.add.reduceat(x * v.astype(np.float32)[at], first) - centre @ v + c
        gap = np.maximum(0, 1 - y * margin) * y * share
        pull = np.bincount(at, x * np.repeat(gap.astype(np.float32), size), n) - gap.sum() * centre
        w2, b2 = v - rate * (penalty * v - 2 * pull), c + rate * 2 * gap.sum()
        m = t / (t + 3)
        v, c, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w * unit, float(b - w @ centre)


def learn(docs: DataFrame, per_language: int = 400, seed: int = 11) -> dict:
    """Weights of all SVMs, from a sample of labelled rows that aren't held out.

    Rows come by a hash of doc_id at a rate of per_language over the language's
    count, over the whole table.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs = sorted(count)
    family = {x: FAMILY_OF.get(x, f"own {x}") for x in langs}
    members = defaultdict(list)
    for x in langs:
        members[family[x]].append(x)
    svms = [("family", a, b) for a, b in combinations(sorted(members), 2)]
    svms += [("language", a, b) for f in sorted(members) for a, b in combinations(members[f], 2)]
    model = {"langs": langs, "members": dict(members), "svms": svms, "weights": np.zeros((2 * BINS, len(svms)), np.float32), "bias": np.zeros(len(svms))}
    if not svms:
        return model
    sides = {x: [(k, 1.0 if (x if level == "language" else family[x]) == a else -1.0) for k, (level, a, b) in enumerate(svms) if (x if level == "language" else family[x]) in (a, b)] for x in langs}
    rate = F.create_map(*(F.lit(v) for x in langs for v in (x, per_language / count[x])))
    share = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(share < rate[F.col("lang")]).repartition(min(64, 4 * len(langs)), "doc_id")

    def spread(batches):
        for pdf in batches:
            for d, t, x in zip(pdf.doc_id, pdf.text, pdf.lang):
                if LETTER.search(t):
                    at, v = frequencies(t)
                    yield pd.DataFrame([(k, side, str(d), at.tobytes(), v.tobytes()) for k, side in sides[x]], columns=["svm", "side", "doc", "at", "x"])

    def fit(pdf):
        pdf = pdf.sort_values(["doc", "side"])
        w, b = fit_svm([(np.frombuffer(a, np.uint16), np.frombuffer(v, np.float32)) for a, v in zip(pdf["at"], pdf.x)], pdf.side.to_numpy())
        return pd.DataFrame({"svm": [pdf.svm.iloc[0]], "w": [w.astype(np.float32).tobytes()], "b": [b]})

    fitted = sample.mapInPandas(spread, "svm int, side double, doc string, at binary, x binary").groupBy("svm").applyInPandas(fit, "svm int, w binary, b double")
    for r in fitted.collect():  # a row for each SVM
        model["weights"][:, r.svm], model["bias"][r.svm] = np.frombuffer(r.w, np.float32), r.b
    return model


def decide(margins: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of margins."""
    sure = 1 / (1 + np.exp(-np.clip(4 * margins, -30, 30)))

    def vote(level: str, classes: list[str]):
        votes, total, chance = (np.zeros((len(margins), len(classes))) for _ in range(3))
        for k, (of, a, b) in enumerate(model["svms"]):
            if of == level and a in classes:
                i, j = classes.index(a), classes.index(b)
                votes[:, i] += margins[:, k] >= 0
                votes[:, j] += margins[:, k] < 0
                total[:, i] += margins[:, k]
                total[:, j] -= margins[:, k]
                chance[:, i] += sure[:, k]
                chance[:, j] += 1 - sure[:, k]
        best = np.argmax(votes + 1e-6 * np.tanh(total), 1)
        return best, chance[np.arange(len(margins)), best] / max(1, len(classes) - 1) if len(classes) > 1 else np.ones(len(margins))

    families = sorted(model["members"])
    which, score = vote("family", families)
    pred = np.empty(len(margins), object)
    for f, name in enumerate(families):
        own = model["members"][name]
        lang, chance = vote("language", own)
        at = which == f
        pred[at] = np.asarray(own, object)[lang[at]]
        score = np.where(at, score * chance, score)
    return pred.tolist(), score


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """The columns of docs and lang_pred, score."""
    from neurotab.llm.tokens import grouped

    ship(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            full = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if model["langs"] else []
            own = [texts[i] for i in full]
            for s in grouped(own, SLICE):
                got, sure = decide(sums(own[s], model["weights"]) + model["bias"], model)
                for i, p, c in zip(full[s], got, sure):
                    pred[i], score[i] = p, c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = identify(docs.select("doc_id", "text"), learn(docs, **how))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
