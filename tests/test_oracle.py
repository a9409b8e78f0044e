"""Every query with SQL gives the same rows as DuckDB, floats to the last bit; the others run and give rows."""

import math

import pytest

from trailweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if not isinstance(v, (list, dict)) else str(v)


def rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck, sf_dir):
    df = catalog.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    assert sorted(x[0] for x in cur.description) == sorted(df.columns)
    assert got == rows([x[0] for x in cur.description], cur.fetchall())
