"""Corpus queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tests.test_catalogue import plain
from tributary.llm import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == names
    assert got == sorted(repr([plain(dict(zip(rel.columns, r))[c]) for c in names]) for r in rel.fetchall())
