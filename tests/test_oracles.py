"""Queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from neurotab.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    def cell(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        if isinstance(x, float) or hasattr(x, "is_integer") or isinstance(x, int):
            return None if x != x else round(float(x), 5) + 0.0
        return str(x)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    want = sql.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), names)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 + 1e-8 * abs(q)) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"pixel_markers"}))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1
