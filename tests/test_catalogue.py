"""Every query with SQL gives the SQL's rows."""

import math

import duckdb
import pytest

from tributary.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 7) if isinstance(v, float) or type(v).__name__ == "Decimal" else v if isinstance(v, (bool, int)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == names
    assert got == sorted(repr([plain(dict(zip(rel.columns, r))[c]) for c in names]) for r in rel.fetchall())
