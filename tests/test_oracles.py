"""Every registered query that has SQL against DuckDB on the same tables; the others must run."""

import duckdb
import pytest

from memlode.plans import registry
from memlode.session import TABLES

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def shape(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5) + 0.0
        else:
            df[c] = df[c].map(lambda v: None if v is None or v != v else str(v).removesuffix(" 00:00:00"))
    return df.astype(str).replace({"None": "", "nan": "", "<NA>": "", "NaT": ""}).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    if name not in SQL:
        assert got.count() >= 0
        return
    want = duck.execute(SQL[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = shape(got), shape(want)
    assert len(a) == len(b)
    assert a.equals(b), (a[(a != b).any(axis=1)].head(), b[(a != b).any(axis=1)].head())


def test_no_subsets_in_queries():
    assert registry.FLAGSHIP in QUERIES and set(SQL) <= set(QUERIES)
