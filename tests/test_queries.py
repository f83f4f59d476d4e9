"""Every query with SQL beside it gives that SQL's rows on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else round(v, 9) + 0.0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if name not in catalog.ORACLE:
        assert got
        return
    rel = duck.sql(catalog.ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(want, key=order)


def test_entry_points(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
