"""SQL of the text queries on tables that have links, revisits, notices and phrases, and vectors near the threshold."""

import math
import random

import duckdb
import numpy as np
import pytest

from neurotab.llm import embeddings, hamming, queries


def turned(r, v, cosine):
    """A vector at that cosine from v."""
    w = r.normal(size=len(v))
    w -= (w @ v) / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, t = np.random.default_rng(1), random.Random(1)
    sf = str(tmp_path_factory.mktemp("sf"))
    base = r.normal(size=(120, 64))
    vectors = [*base, *(turned(r, base[i], 0.93) for i in range(40)), *(turned(r, base[0], 0.97) for _ in range(30)), base[1], 3 * base[1], np.zeros(64)]
    rows = [(i, [float(x) for x in v], i % 7) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [], 1), (902, [math.nan] + [1.0] * 63, 1), (903, [None] + [1.0] * 63, 1), (904, [1.0] * 10, 2), (905, [1.0] * 10, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")

    words = ["".join(t.choice("abcdefgh") for _ in range(t.randint(2, 6))) for _ in range(60)]
    text = lambda n: " ".join(t.choice(words) for _ in range(n))
    texts = [text(t.randint(5, 200)) for _ in range(80)]
    for i in range(20):
        near = texts[i].split()
        if len(near) > 40:
            near[len(near) // 2] = "changed"
        texts.append(" ".join(near))
    texts += [texts[0], texts[0], None, "", "one", "under the MIT License. CC BY-NC"] + [f"{text(3)} strong tea, Strong tea. strong tea {text(2)}" for _ in range(140)]
    rows = [(i, x, t.choice(["en", "en", "fr", None]), "s", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")

    page = lambda n: "<p>" + text(n) + "</p>"
    pages = [page(40) for _ in range(30)]
    pages += pages[:10] * 3 + ["short", "short", "", None, None, "é" * 50, "é" * 50, "x" * 99, "x" * 99, "x" * 100, "x" * 100]
    spark.createDataFrame([(i, f"http://h{i % 3}/{i}", x) for i, x in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    return sf


@pytest.fixture(scope="module")
def sql(folder):
    con = duckdb.connect()
    for name in ("embeddings", "documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_where_there_is_something_to_find(spark, sql, folder, name):
    got = queries.QUERIES[name](spark, folder)
    want = sql.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    a, b = plain(tuple(r[c] for c in names) for r in got.collect()), plain(want.fetchall())
    assert a == b
    found = {
        "op1_license_scan": lambda r: r["n_base"] > 0, "op3_hamming_topk": lambda r: r["rank"] == 10, "op4_embedding_neardup": lambda r: r["n_links"] >= 29, "op6_warc_round_trip": lambda r: r["record_type"] == "revisit",
        "op8_minhash_neardup": lambda r: not r["kept"], "op11_centroid_clusters": lambda r: r["distance"] > 0, "op12_phrase_mining": lambda r: r["phrase"] == "strong tea",
    }
    assert any(found[name](dict(zip(names, r))) for r in a), "the table has nothing to find"


def test_vectors_near_the_threshold(spark):
    """Pairs at 0.90 to 0.92 are found but for a few, none below is linked; a dense group and odd rows."""
    r = np.random.default_rng(2)
    base = r.normal(size=(500, 48))
    cosines = np.concatenate([np.linspace(0.9001, 0.92, 400), np.linspace(0.88, 0.8999, 100)])
    partners = np.array([turned(r, b, c) for b, c in zip(base, cosines)])
    crowd = np.array([turned(r, base[499], 0.99) for _ in range(150)])
    vectors = np.concatenate([base, partners, crowd])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(None, base[3].tolist()), (7, base[7].tolist()), (7, base[8].tolist()), (5000, None), (5001, []), (5002, [0.0] * 48), (5003, [math.inf] * 48)]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, v string, id int").repartition(5)
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    by_id = {g.vec_id: g for g in got if g.vec_id not in (None, 7)}
    found = [by_id[i].component_id == by_id[500 + i].component_id for i in range(400) if i not in (3, 7, 8)]
    assert np.mean(found) >= 0.99
    assert not any(by_id[i].component_id == by_id[500 + i].component_id for i in range(400, 499))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    close = (unit[1000:] @ unit.T >= 0.9).sum(1) - 1
    assert [by_id[1000 + i].n_links for i in range(150)] == close.tolist()
    assert all(by_id[i].n_links == 0 and by_id[i].kept and by_id[i].component_id == i for i in (5000, 5001, 5002, 5003))
    assert [g.component_id for g in got if g.vec_id is None] == [None] and by_id[3].n_links >= 1
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_search_with_extra_columns(spark):
    rows = [(i, (1 << i) - 1, x) for i in range(12) for x in range(6)]
    df = spark.createDataFrame([(i, c, x, "n") for i, c, x in rows], "id long, code long, x int, n string")
    got = sorted((g.query_id, g["rank"], g.neighbor_id, g.distance) for g in hamming.search(df, df.where("id = 0"), 5).collect())
    assert got == [(0, k, k, k) for k in range(1, 6)]
