"""Each text operator against a plain version, and its defined results for odd rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from neurotab.llm import embeddings, hamming, language, licenses, neardup, packing, pieces, queries, substrings, tokens, warc
from neurotab.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, set_id string, key int"
SF = "/root/testdata/sf0.001"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


BASE, PASSAGE = words(1, 150), words(2, 110)
NEAR = " ".join(w if i % 40 else "other" for i, w in enumerate(BASE.split()))
ROWS = [
    (0, BASE), (1, BASE), (1, BASE), (2, NEAR), (3, words(3, 120) + PASSAGE + words(4, 30)), (4, PASSAGE + " " + words(5, 60)),
    (5, None), (6, ""), (7, "   \n"), (8, "solo"), (9, "12 34 !!"), (10, "x" * 3000), (11, words(6, 5000)), (None, BASE),
    (12, "Released under the MIT License. Licensed under the Apache License, Version 2.0; CC BY-NC, under the MIT license"),
    (13, "It's <|endoftext|> 'we're’ ▁ é 日本 \U0001f600  two  blanks \x00"),
    (14, "This work is licensed under the GNU General Public License, version 3."),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, random.Random(k).choice(["en", "fr", None]), "s", len(t or ""), "clash", 1) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[12].n_base == 4 and got[12].base_labels == "apache-2,cc-by-nc,mit" and got[12].first_word == 1
    assert got[14].labels == "gpl-3" and got[14].base_labels == "" and got[14].score == 1.0
    assert got[0].labels == "" and got[0].score == 0 and got[5].n_words == 0 and got[5].first_word is None
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(none).count() == 0


def test_token_counts_equal_the_library(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, path).collect()) == want
    assert tokens.count_tokens(none, path).count() == 0


def test_token_counts_of_every_character():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b1{c} {c}" for c in every[i : i + 256]) for i in range(0, len(every), 256)]
    r = random.Random(17)
    some = [*"abest'  \n19.", "'re", "'ll", "é", "日", "\u00a0", "\u0345", "\U0001f600", "\U00020000"]
    texts += ["".join(r.choice(some) for _ in range(r.randint(0, 60))) for _ in range(10_000)]
    want = [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    assert np.concatenate([tokens.count_texts(texts[s], path) for s in tokens.grouped(texts)]).tolist() == want


def test_token_counter_of_few_states():
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = tokens.Counter(path, most=40), tokens.counter(path)
    data = np.frombuffer(BASE.encode(), np.uint8)
    start = np.arange(0, len(data) - 20, 20)
    length = np.full(len(start), 20)
    assert (small.count(data, start, length) == large.count(data, start, length)).all()


def test_hamming_search(spark):
    r = random.Random(4)
    codes = [r.getrandbits(64) - (1 << 63) for _ in range(300)]
    rows = [(i, codes[i % 200] if i < 290 else codes[0]) for i in range(300)] + [(300, None), (None, 5), (7, codes[7])]
    df = spark.createDataFrame(rows, "id long, code long")
    got = sorted(tuple(x) for x in hamming.search(df, df.where("id % 50 = 0"), 5).collect())
    known = {i: c for i, c in rows if i is not None and c is not None}
    want = []
    for q in (0, 50, 100, 150, 200, 250):
        near = sorted((((known[q] ^ c) & (1 << 64) - 1).bit_count(), i) for i, c in known.items() if i != q)[:5]
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert got == sorted(want)
    assert hamming.search(df.limit(0), df.limit(0)).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 16))
    v[30:50] = v[:20] + r.normal(size=(20, 16)) * 0.15
    v[50:60] = v[0]
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)] + [(60, None), (61, [0.0] * 16), (62, [float("nan")] * 16), (63, [1.0]), (64, [None] * 16)]
    got = {x.vec_id: x for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    x = np.array([a for _, a in rows[:60]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.9).sum(1) - 1
    assert [got[i].n_links for i in range(60)] == links.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(60, 65)) and got[50].component_id == 0


def test_expected_collisions_cover_the_threshold():
    for n in (2, 1000, 10**6):
        cells, trials = embeddings.plan(n, 0.9)
        p = embeddings.same_cell(embeddings.CELL) ** cells * 0.9973
        assert (1 - p) ** trials + trials * p * (1 - p) ** (trials - 1) < 0.005


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = pieces.encode(docs, path)
    assert sorted((str(r.doc_id), r.ids) for r in out.collect()) == sorted((str(i), sp.encode(x or "")) for i, x in ROWS)
    assert out.where("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(out, path).collect()}
    assert back[0] == BASE and back[13] == dict(ROWS)[13].replace("▁", " ") and back[5] == ""


def test_pieces_of_many_texts_equal_the_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model(path)
    r = random.Random(18)
    some = [*"thean  \n\tZ1.,", "▁", "é", "日", "\U0001f600", "tion", "ing "]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 80))) for _ in range(5000)] + ["a" * 70_000 + " b", " " * 5000, "ab" * 40_000]
    for s in pieces.grouped(texts, 1 << 16):
        assert [x.tolist() for x in m.encode(texts[s])] == [sp.encode(x) for x in texts[s]]


def test_pieces_of_no_rows(none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode(none, path)
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"] and out.count() == 0 and pieces.decode(out, path).count() == 0


def test_suffix_array():
    data = np.frombuffer(b"banana bandana banana", np.uint8)
    got = pieces.suffix_array(data, 64).tolist()
    assert got == sorted(range(len(data)), key=lambda i: bytes(data[i:]))


def test_warc(spark, tmp_path):
    page = "<p>" + "é" * 200
    rows = [(1, "http://a", page), (2, None, page), (2, None, page), (3, "x\r\ny", "short"), (4, "u", "short"), (5, "u", None), (None, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    digest = hashlib.sha256(page.encode()).hexdigest()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == sorted([("1", "response", None), ("2", "revisit", 1), ("2", "revisit", 1), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("None", "response", None)], key=str)
    assert {r.payload_digest for r in got if r.record_type == "revisit"} == {digest} and {r.payload_bytes for r in got if r.page_id == 2} == {len(page.encode())}
    whole = warc.read(warc.write(Scratch(spark, "w"), warc.with_references(Scratch(spark, "r"), pages), most=200), span=300).where("page_id = 3").first()
    assert bytes(whole.payload) == b"short" and whole.url == "x%0D%0Ay"
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_zip64_members(tmp_path):
    import zipfile

    import pyarrow.fs as pafs

    path = str(tmp_path / "z.zip")
    with zipfile.ZipFile(path, "w") as z, z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
        f.write(b"hello")
    with pafs.LocalFileSystem().open_input_file(path) as f:
        at, n = warc.members(f)["a"]
        assert f.read_at(n, at) == b"hello"
    with pafs.LocalFileSystem().open_output_stream(path) as f:
        f.write(b"not a zip file at all")
    with pafs.LocalFileSystem().open_input_file(path) as f, pytest.raises(ValueError):
        warc.members(f)


def test_borders_are_best():
    from itertools import combinations

    r = random.Random(1)
    for _ in range(60):
        x = sorted(r.sample(range(1, 30), r.randint(1, 7)))
        c, k = [r.randint(1, 9) for _ in x], r.randint(1, 4)
        cost = lambda ends: sum(n * (min(e for e in ends if e >= v) - v) for v, n in zip(x, c))
        best = min(cost([*s, x[-1]]) for m in range(min(k, len(x))) for s in combinations(x[:-1], m))
        assert cost(packing.borders(x, c, k)) == best and len(packing.borders(x, c, k)) <= k


def test_packing(docs, none):
    p = packing.pack(docs, max_length=64, budget=256, buckets=3).toPandas()
    assert p.groupby("doc_id").length.sum()[11] == 5000 and p[p.doc_id == 5].bucket.isna().all()
    full = p.dropna(subset=["bucket"])
    assert (full.length <= full.bucket).all() and not full.duplicated(["bucket", "batch", "slot"]).any()
    assert (full.groupby(["bucket", "batch"]).size() * full.groupby(["bucket", "batch"]).bucket.first() <= 256).all()
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, none, size):
    got = {r.doc_id: r for r in neardup.groups(docs, size).collect()}
    sets = {i: shingles(t, size) for i, t in ROWS if i is not None}
    assert all(got[i].n_shingles == len(s) for i, s in sets.items())
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[j] = min(label[j], label[i])
    assert {i: got[i].component_id for i in sets} == label and got[None].component_id is None and got[None].kept
    assert neardup.groups(none).count() == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Lists are long here, so pairs come from runs of values, leaders and other components."""
    monkeypatch.setattr(neardup, "LONG", 4)
    r = random.Random(8)
    texts = []
    for g in range(3):
        base = words(100 + g, 160).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = words(r.random(), 1)
            texts.append(" ".join(w) + " " + PASSAGE[: 60 * (g % 2)])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.groups(df, 2).collect()}
    sets = [shingles(t, 2) for t in texts]
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert [got[i] for i in range(len(sets))] == label


def test_members_with_inserted_text_of_a_large_group(spark):
    """Rare values of a near copy are those of its inserted text: they don't settle it."""
    r = random.Random(31)
    base = words(400, 400)
    texts = [base] + [f"{base} {words(1000 + i, 1)}{i}" for i in range(70)]
    texts += [f"{base} {words(2000 + i, round(400 * r.uniform(0.15, 0.25)))}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in neardup.groups(df, 2).collect()}
    sets = [shingles(t, 2) for t in texts]
    label = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in range(4):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert sum(c == 0 for c in label) > 300 and [got[i] for i in range(len(sets))] == label


def test_longer_copies_of_members_of_a_large_group(spark):
    """100 near copies of a text, and 500 copies with so much more text that they are alike to 0.805 to a member: one group."""
    r = random.Random(32)
    base = [f"{w}{i}" for i, w in enumerate(words(500, 1001).split())]
    near = []
    for i in range(100):
        w = list(base)
        for k in r.sample(range(len(w)), 20):
            w[k] = f"edit{i}x{k}"
        near.append(w)
    texts = [*near, *(near[i % 100] + [f"more{i}y{k}" for k in range(242)] for i in range(500))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {x.component_id for x in neardup.groups(df, 2).collect()} == {0}


def test_runs_of_small_sets():
    """Sets that a sketch holds whole have a run in common wherever their unshared values stand."""
    assert neardup.runs(80) == [(3, None), (2, 5)] and neardup.runs(50)[0][0] < 3
    r = random.Random(5)
    for percent in (80, 90):
        for n in range(2, neardup.SKETCH + 1):
            for _ in range(200):
                x = {r.random() for _ in range(n)}
                apart = r.randint(0, n * (100 - percent) // 100)
                a, b = x - set(r.sample(sorted(x), k := r.randint(0, apart))), x - set(r.sample(sorted(x), apart - k))
                if a == b or 100 * len(a & b) < percent * len(a | b):
                    continue
                keys = [{tuple(sorted(s)[i : i + length]) for length, most in neardup.runs(percent) if most is None or len(s) <= most for i in range(len(s) - length + 1)} for s in (a, b)]
                assert keys[0] & keys[1]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in components(Scratch(spark, "c"), edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def removed(texts, length):
    from collections import Counter

    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.append(0, gone.view(np.int8))) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2000, 0])
def test_repeated_strings(docs, none, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.deduplicate(docs).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(ROWS, removed([t for _, t in ROWS], 400)))
    assert substrings.deduplicate(none).count() == 0


@pytest.mark.parametrize("crowd", [2000, 1])
def test_edges_of_many_passages(spark, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    r = random.Random(5)
    a, b = words(50, 200), words(51, 200)
    texts = [words(60 + k, r.randint(1, 30)) + a[r.randint(0, 300) : r.randint(600, 1200)] + b[: r.randint(300, 700)] + words(90 + k, 20) for k in range(24)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.deduplicate(df).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 400)


def test_repeats_in_texts_of_several_pieces(spark):
    """A passage that begins near the end of a piece of a text of 2.5 MiB and stands in a short one too."""
    r = random.Random(6)
    filler = r.randbytes(substrings.PIECE * 5 // 4).hex()
    passage = words(7, 200)[:700]
    cut = substrings.PIECE - 350
    long = filler[:cut] + passage + filler[cut : 2 * cut] + passage + filler[2 * cut :]
    df = spark.createDataFrame([(0, long), (1, "ab " + passage + " cd"), (2, "x")], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.deduplicate(df).collect()}
    assert got[0] == (len(long), 1400, 2, hashlib.sha256(filler.encode()).hexdigest())
    assert got[1] == (706, 700, 1, hashlib.sha256(b"ab  cd").hexdigest()) and got[2][1:3] == (0, 0)


def test_suffix_order():
    raw = [b"xxbanana", b"xbandana", b"ban", b"xxxbanana", b"band"]
    left = np.array([2, 1, 0, 3, 0])
    runs = substrings.Runs(np.zeros(5, np.int64), raw, left)
    assert [raw[i][left[i] :] for i in runs.sorted()] == sorted(b[k:] for b, k in zip(raw, left))


def test_language(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.predict(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = {r.doc_id: r.lang_pred for r in language.predict(docs).collect()}
    assert odd[5] == odd[6] == odd[9] == "und" and odd[0] in ("en", "fr") and language.predict(none).count() == 0


def test_predictions_do_not_see_labels(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(table)
    a = language.identify(table.select("doc_id", "text"), model)
    b = language.identify(table.select((F.col("doc_id") + 1).alias("doc_id"), "text").withColumn("lang", F.lit("zz")), model)
    assert sorted(r.lang_pred for r in a.collect()) == sorted(r.lang_pred for r in b.collect())


def test_pipeline(spark, docs, none):
    out = none
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0
    kept = corpus_pipeline.keep_languages(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in kept.collect()} == {i for i, t in ROWS if t and re.search("[^\\W\\d_]", t)}
    left = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_strings(spark, docs, SF).collect()}
    assert left[8] == "solo" and PASSAGE[5:-5] not in left[3] and 6 in left
    assert corpus_pipeline.run(spark, SF).where("bucket is not null").count() > 0


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}


def test_odd_sketches_keep_similar_sets(spark):
    """Of 400 pairs at or over the threshold, whole bits or cancelled ones, none goes; nearly all far ones do."""
    from neurotab.llm import neardup

    r = np.random.default_rng(3)
    rows, alike = [], []
    for i in range(800):
        n = int(r.integers(5, 4000))
        shared = -(-8 * n // 10) if i % 2 else n // 2
        values = r.integers(-(2**63), 2**63 - 1, 2 * n, dtype=np.int64)
        rest = n - shared
        a = np.concatenate([values[:shared], values[shared : shared + rest // 2]])
        b = np.concatenate([values[:shared], values[shared + rest // 2 : n]])
        alike.append(100 * shared >= 80 * n)
        rows += [(2 * i, len(a), np.sort(a).tobytes()), (2 * i + 1, len(b), np.sort(b).tobytes())]
    sets = spark.createDataFrame([(i, n, bytearray(s)) for i, n, s in rows], "id long, n long, s binary")
    words = range(neardup.ODD // 64)
    side = neardup.smallest(sets, 8).select((F.col("id") / 2).cast("long").alias("pair"), (F.col("id") % 2).alias("side"), "n", "odd")
    both = side.where("side = 0").alias("a").join(side.where("side = 1").alias("b"), "pair")
    keep = neardup.odd_fits([F.col("a.odd")[k] for k in words], [F.col("b.odd")[k] for k in words], F.col("a.n"), F.col("b.n"), 80)
    got = {x.pair: x.keep for x in both.select("pair", keep.alias("keep")).collect()}
    assert all(got[i] for i in range(800) if alike[i])
    assert sum(got[i] for i in range(800) if not alike[i]) < 60


def test_filter_before_a_join_loses_no_key(spark):
    from neurotab.llm.common import perhaps_among

    ids = spark.createDataFrame([(i,) for i in range(0, 60_000, 20)] + [(None,)], "i long")
    rows = spark.range(60_000).union(spark.createDataFrame([(None,)], "id long"))
    got = {r.id: r.perhaps for r in perhaps_among(rows, F.col("id"), ids, 16).collect()}
    assert len(got) == 60_001 and got[None] is False and all(got[i] for i in range(0, 60_000, 20))
    assert sum(got.values()) < 3000 + 0.1 * 57_000


def test_values_of_long_lists_are_listed_by_prefix_only(spark):
    """Of sets that share a passage, few values are listed and never the passage; sets alike to 0.8 share one."""
    from neurotab.llm import neardup

    r = np.random.default_rng(5)
    passage = r.integers(-(2**63), 2**63 - 1, 20, dtype=np.int64)
    rows = []
    for i in range(300):
        own = r.integers(-(2**63), 2**63 - 1, 80, dtype=np.int64)
        rows += [(2 * i, np.concatenate([passage, own])), (2 * i + 1, np.concatenate([passage, own[:72], own[:8] + 1]))]
    sets = spark.createDataFrame([(i, len(s), bytearray(np.sort(s).tobytes())) for i, s in rows], "id long, n long, s binary")
    by: dict = {}
    for x in neardup.prefixes(neardup.smallest(sets, neardup.WIDE), 80).collect():
        by.setdefault(x.id, set()).add(x.v)
    assert all(by[2 * i] & by[2 * i + 1] for i in range(300))
    assert sum(map(len, by.values())) <= 0.21 * sum(len(s) for _, s in rows) and not any(v & set(passage.tolist()) for v in by.values())
