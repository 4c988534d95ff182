"""The operators that SQL can express against DuckDB on the same tables."""

import duckdb
import pytest

from memlode.llm import queries as Q
from memlode.session import TABLES

SQL = Q.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_its_sql(spark, sf, duck, name):
    got, want = Q.queries()[name](spark, sf), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    flat = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    a, b = flat(got.select(*cols).collect()), flat(want[cols].itertuples(index=False, name=None))
    assert a == b
