"""Clusters, phrases and secrets against plain versions, and their defined results for odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from neurotab.llm import clusters, phrases, secrets

DOCS = "doc_id long, text string, lang string, n long, word string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "clash", 2) for i, t, lang in rows], DOCS).repartition(3)


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 27 for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centres = [x for _, x in first[:k]]
    near = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, x in kept:
            of[near(x)[1]].append(x)
        centres = [[sum(c) // len(of[j]) for c in zip(*of[j])] if of[j] else c for j, c in enumerate(centres)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    own = Counter()
    for _, j, d in out:
        own[j] += d
    return sorted((i if i is not None else -1, j, d, own[j], sum(own.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, j, d in out)


def test_clusters(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(i % 7, 0.4, 64) / 3).tolist()) for i in range(300)]
    rows += [(5, rows[5][1]), (5, rows[9][1]), (None, rows[7][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [math.nan] + [0.0] * 63), (904, [None] + [0.0] * 63), (905, [-math.inf] + [0.0] * 63), (906, [1e30] * 64), (907, [-4000.0] * 64)]
    df = spark.createDataFrame([(i, v, "clash", 3) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    got = sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in clusters.cluster(df).collect())
    assert got == plain_clusters(rows, 40, 5) and len(got) == 304
    few = clusters.cluster(df.where("vec_id < 3"), k=5).collect()
    assert sorted(r.distance for r in few) == [0, 0, 0] and {r.inertia for r in few} == {0}
    assert clusters.cluster(df.where("vec_id >= 900 and vec_id < 906")).count() == 0


def test_clusters_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(duckdb.sql(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({clusters.oracle()})").fetchall())
    assert sorted(tuple(r) for r in clusters.cluster(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()) == want


def plain_phrases(rows, longest, least, share, top):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + m])] += 1
    often = {p: a for p, a in f.items() if a >= least}
    inside = defaultdict(int)
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], a)
    out = defaultdict(list)
    for (lang, p), a in often.items():
        if len(p) > 1 and 100 * inside[lang, p] < share * a:
            score, k = min((1000 * a * n[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), often[lang, p[:k]], often[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("least, share, top", [(4, 100, 2000), (3, 80, 25)])
def test_phrases(spark, least, share, top):
    r = random.Random(5)
    words = ["the", "The", "of", "a", "réa", "é\x01", "é", "é\x00b", "\x01", "日本", "end"] + [f"w{i}" for i in range(12)]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", " "]) for _ in range(r.randint(1, 60)))
    rows = [(i, text(), r.choice(["en", "en", "en", "fr", None, "und", ""])) for i in range(400)]
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(1000 + i, passage + " " + text(), "en") for i in range(60)] + [(7, "a a a a a a", "fr")] * 5
    rows += [(None, None, "en"), (1, "", None), (2, " \t. ,", "en"), (3, "w1 " * 30_000, "fr")]
    got = sorted(tuple(x) for x in phrases.mine(frame(spark, rows), least=least, share=share, top=top).collect())
    assert got == plain_phrases(rows, 5, least, share, top) and len(got) > 40


def test_phrases_of_nothing(spark):
    assert phrases.mine(frame(spark, [])).count() == 0
    assert phrases.mine(frame(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


def test_trie_bursts_and_spills():
    r = random.Random(2)
    trie, want = phrases.PhraseTrie(), Counter()
    for _ in range(30_000):
        ids = tuple(min(int(r.expovariate(0.05)) + 1, 400) for _ in range(r.randint(2, 5)))
        trie.add(ids, 2)
        want[ids] += 2
    assert trie.size == len(want) and any(type(c) is phrases.Node for c in trie.root.values())
    half = [e for tree in trie.spill(0.5) for e in tree]
    assert trie.size == len(want) - len(half) <= len(want) / 2
    rest = [e for tree in trie.spill(1.0) for e in tree]
    assert not {i for i, _ in half} & {i for i, _ in rest} and dict(half + rest) == want and not trie.root


def test_windows_of_one_hash():
    """Windows whose hashes meet are told apart."""
    ids = np.array([1, 2, 3, 0, 3, 2, 1, 0, 1, 2, 3], np.int32)
    rows, n = phrases.windows(ids, (ids[:-1] > 0) & (ids[1:] > 0), 5, np.zeros(1024, np.int64))
    assert dict(zip(map(tuple, rows.tolist()), n.tolist())) == {(1, 2, 3, 0, 0): 2, (2, 3, 0, 0, 0): 2, (3, 2, 1, 0, 0): 1, (2, 1, 0, 0, 0): 1}


def plain_base(text):
    """Base spans letter by letter: every keyword in either case, places tried from left to right."""
    out, chars = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    i = 0
    while i < len(text):
        m = re.compile(rf"""(?:{either})["']?\x20*[:=]\x20*["']?""").match(text, i)
        end = m.end() if m else 0
        while m and end < len(text) and text[end] in chars:
            end += 1
        if m and end == m.end():  # a quote that was taken must be left again: nothing else can follow
            m = None
        if m and end - m.end() >= 6:
            out.append((i, 0, end))
        i = end if m else i + 1
    for kind, run, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(run, text) if len(m[0]) >= least]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_secrets(spark):
    r = random.Random(8)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    parts = lambda: r.choice([
        some("abcdefghij ", 20), f'Api_Key = "{some(secrets.ALPHABET, 20)}', f"token: {some('abc', 5)}", "secret: token: abcdefgh", f"AKIA{some('ABC123', r.choice([15, 16, 30]))}", some("0123456789abcdef", r.choice([23, 24, 40])),
        "日本 é \U0001f600", "paſſword=abcdefgh", "PASSWD='hunter2hunter2'", some(secrets.ALPHABET[:62], 40), "token==abcdef", " internationalization_of_identifiers ",
    ])
    texts = ["".join(parts() + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 12))) for _ in range(400)] + [None, "", "x" * 200_000, "token " + " " * 50_000 + "=abcdefg", ("secret=abcdefg " * 5000)]
    rows = [(i if i % 50 else None, t, None) for i, t in enumerate(texts)] + [(3, texts[3], "en")]
    found = secrets.scan(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {x.doc_id: x for x in found if x.doc_id is not None}
    for i, t in enumerate(texts):
        if i % 50:
            base = plain_base(t or "")
            spans = by_id[i].spans.split(",") if by_id[i].spans else []
            assert [s for s in spans if not s.startswith("random")] == base
            assert by_id[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert (by_id[i].n_assign, by_id[i].n_access, by_id[i].n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
            assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))
    assert secrets.scan(frame(spark, [])).count() == 0


def test_secrets_on_held_out_strings(spark):
    """Models learned from one table tell random strings from words and identifiers of another."""
    model = secrets.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    r = np.random.default_rng(99)
    for chars in (secrets.ALPHABET[:62], secrets.ALPHABET[:64], "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        caught = [len(secrets.spans(f"see {''.join(r.choice(list(chars), 22))} here", model)) for _ in range(300)]
        assert sum(map(bool, caught)) >= 297
    held = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 1000").select("text").limit(3000).collect()
    runs = {m[0] for row in held for m in secrets.RUN.finditer(row.text or "") if len(m[0]) >= secrets.LEAST and secrets.LETTER.search(m[0]) and not secrets.base_spans(row.text)}
    assert len(runs) > 300 and sum(secrets.ratio(model, x) >= secrets.ODDS for x in runs) == 0
