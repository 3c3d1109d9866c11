"""Repeated runs of words, which the pipeline removes beside repeated strings of bytes."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from neurotab.llm import substrings


def short_words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 5))) for _ in range(n)]


def left_words(texts, n):
    """Words of each text outside runs of n words that stand twice."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(n)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize("crowd", [2000, 0])
def test_passages_of_short_words_go(spark, monkeypatch, crowd):
    """Passages of 51 words and more under 400 bytes, with other blanks around and in them; a passage of 49 words stays."""
    monkeypatch.setattr(substrings, "CROWD", crowd)
    passages = [short_words(k, 51 + k) for k in range(12)]
    assert all(len(" ".join(p)) < 400 for p in passages)
    texts = [" ".join(short_words(100 + k, 90) + passages[k % 12] + short_words(200 + k, 30 * (k % 3))) for k in range(24)]
    texts[13] = "  " + texts[13].replace(" ", " \n", 100)
    own = " ".join(short_words(900, 49))
    texts += [" ".join(passages[0]) + "\n", "début " + own, own + " Ende", "", None, " ", "é " * 60, "one"]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x for x in substrings.deduplicate(df, keep_text=True, words=True).collect()}
    want = left_words(texts, 50)
    assert [got[k].text.split() for k in range(len(texts))] == want and want[0] != texts[0].split() and want[25] == texts[25].split()
    assert all(got[k].n_bytes - got[k].n_removed == len(got[k].text.encode()) for k in got)
    there = {x.doc_id: x.text.split() for x in corpus_pipeline.drop_repeated_strings(spark, df, "").collect()}
    assert there == {k: w for k, w in enumerate(want) if k not in (24, 30)}  # nothing but a passage, and one word sixty times
