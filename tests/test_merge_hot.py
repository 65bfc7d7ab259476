"""The fold of hot keys against the plain fold, and a key of very many rows."""

import random

import pytest
from pyspark.sql import functions as F

from tributary.config import Config, Policy
from tributary.operators import merge
from tributary.sources.delimited import records

MAPS = (("id", "employeeNumber"), ("mail", "email"), ("name", "fullName"), ("pay", "ctcAnnual"), ("place", "workLocation"), ("born", "dateOfBirth"), ("state", "status"), ("team", "department"), ("unit", "department"))


def sources(spark, seed, n):
    rng = random.Random(seed)
    places = ["Pune", "pune", "Pune Plant", "Old Pune Plant", "Goa", "", "n/a", "PUNE PLANT"]
    pays = ["5", "5.0", "7", "abc", "", "9", "1,000"]
    born = ["1990-01-02", "05/06/1991", "31/02/2020", "", "2 Jan 1990", "1990-01-02T00:00"]
    out = []
    for k in range(2):
        rows = [[rng.choice(["1", "APX-1", "2", "3", "", ""]), rng.choice(["a@x.in", "A@x.in", "b@gmail.com", ""]), rng.choice(["Ann Lee", "Ann", "ANN LEE-ROY", ""]), rng.choice(pays), rng.choice(places), rng.choice(born), rng.choice(["active", "A", "odd", "", "Active"]), rng.choice(["Sales", "Sales North", ""]), rng.choice(["sales", "IT", ""])] for _ in range(n)]
        out.append(merge.Source(records(spark, [c for c, _ in MAPS], rows), k, f"f{k}", MAPS))
    return out


def plain(df):
    def cells(c):
        return {k: None if v is None else (v["raw"], v["value"], v["confidence"], [tuple(x) for x in v["lineage"]], v["transform"], v["conflicts"], sorted(set(v["flags"])), v["n"]) for k, v in c.asDict().items()}

    return {r["key"]: (tuple(r["seq"]), r["row_ids"], cells(r["cells"]), sorted(r["flags"]), r["n_transforms"], r["employee_number"], r["record_id"]) for r in df.collect()}


@pytest.mark.parametrize("seed, config", [(1, Config()), (2, Config()), (3, Config(policy=Policy(numeric_conflict_escalates=False))), (4, Config(policy=Policy(containment_keeps_longer=False)))])
def test_same_records_as_the_plain_fold(spark, seed, config):
    s = sources(spark, seed, 45)
    want = plain(merge.merge_sources(s, config, most=None))
    got = plain(merge.merge_sources(s, config, most=0, listed=10_000))
    assert set(got) == set(want)
    for key in want:
        for a, b in zip(got[key], want[key]):
            if isinstance(a, dict):
                for f in b:
                    assert a[f] == b[f], (key, f)
            else:
                assert a == b, key


def test_a_number_that_very_many_rows_hold(spark):
    """A third of 300,000 rows under one junk number: their fold is that of the values in order; no list holds them all."""
    n = 300_000
    key = F.when(F.col("id") % 3 == 0, F.lit("000")).otherwise(F.col("id").cast("string"))
    place = F.when(F.col("id") == 60_000, "Pune Plant").when(F.col("id") == 240_000, "Old Pune Plant").when(F.col("id") % 3 == 0, F.lit("Pune")).otherwise("Goa")
    df = spark.range(n, numPartitions=8).select(key.alias("id"), place.alias("place"), F.col("id").cast("string").alias("pay"), F.col("id").alias("row_idx"))
    s = merge.Source(df, 0, "f", (("id", "employeeNumber"), ("place", "workLocation"), ("pay", "ctcAnnual")))
    got = merge.merge_sources([s], most=50_000, listed=100)
    assert got.count() == n // 3 * 2 + 1
    row = got.filter("key = 'emp:000'").first()
    assert row["cells"]["workLocation"]["value"] == "Old Pune Plant" and row["cells"]["workLocation"]["transform"] == "kept longer form"
    assert row["cells"]["ctcAnnual"]["value"] == "0" and row["cells"]["ctcAnnual"]["conflicts"] == [str(3 * i) for i in range(1, 101)]
    assert row["row_ids"] == [f"f:{3 * i}" for i in range(100)] and row["flags"] == ["ctcAnnual:conflict"]
