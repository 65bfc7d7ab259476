"""Likely duplicates against all pairs, on small blocks and on hot ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tributary.operators import duplicates

PEOPLE = "ord int, id string, first string, last string, phone string, dob string, number string"


def all_pairs(rows):
    out = {}
    rows = sorted(rows)
    made = []
    for o, i, f, la, p, d, n in rows:
        full = f"{f or ''} {la or ''}".lower().replace(".", "")
        made.append((i, full, re.sub("[^a-z]", "", full), (la or "").lower(), p or "", d or "", n))
    for k, (i, fa, ca, la, pa, da, na) in enumerate(made):
        for j, fb, cb, lb, pb, db, nb in made[k + 1 :]:
            alike = len(ca) > 3 and (ca == cb or cb in ca or ca in cb or fa[:1] == fb[:1] and la == lb)
            by = (alike and pa != "" and pa == pb, alike and da != "" and da == db and na != nb)
            if any(by):
                out[i, j] = by
    return out


def people(seed, n):
    rng = random.Random(seed)
    firsts = ["Ana", "Anabel", "Li", "", None, "A.", "Bo", "Maria", "Mariana", "J.R.", "X"]
    lasts = ["Lee", "Leeson", "Roy", "", None, "O", "Kim", "Lee-Roy"]
    pick = lambda *x: rng.choice(x)
    return [(k, f"p{k}", rng.choice(firsts), rng.choice(lasts), pick("1", "2", "", None), pick("d1", "d2", None), pick("n1", "n2", None, f"n{k}")) for k in range(n)]


def found(df):
    return {(r["keep_id"], r["drop_id"]): (r["by_phone"], r["by_dob"]) for r in df.collect()}


def parts(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[root(a)] = root(b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("seed, block", [(1, None), (1, 0), (2, 30)])
def test_same_pairs_on_small_blocks(spark, seed, block):
    """Through blocks, through classes of names, and through both."""
    rows = people(seed, 120)
    got = found(duplicates.fuzzy_pairs(spark.createDataFrame(rows, PEOPLE), block=block))
    assert got == all_pairs(rows) and len(got) > 200


def test_representatives_keep_every_linked_record(spark):
    rng = random.Random(7)
    rows = [(o, i, rng.choice(["Ana", "Anabel", "Li", ""]), rng.choice(["Lee", "O", ""]), p, d, n) for o, i, _, _, p, d, n in people(3, 220)]
    want = all_pairs(rows)
    got = found(duplicates.fuzzy_pairs(spark.createDataFrame(rows, PEOPLE), most=2))
    assert set(got) <= set(want) and len(got) < len(want)
    assert all(not b or w for k, by in got.items() for b, w in zip(by, want[k]))
    for k in (0, 1):  # by number and by day alike
        ends = lambda pairs: {i for p, by in pairs.items() if by[k] for i in p}  # noqa: B023, E731
        assert ends(got) == ends(want)


def test_a_number_that_many_share(spark):
    """A switchboard of 20,000 people, half of them of one name: rows grow with people, not with pairs."""
    n = 20_000
    name = F.when(F.col("id") % 2 == 0, "Ana").otherwise(F.concat(F.lit("N"), F.translate(F.col("id").cast("string"), "0123456789", "qwertzuiop")))
    df = spark.range(n).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), name.alias("first"), F.lit("Lee").alias("last"), F.lit("9").alias("phone"), F.lit("").alias("dob"), F.col("id").cast("string").alias("number"))
    got = duplicates.fuzzy_pairs(df).select("keep_id", "drop_id").collect()
    assert len(got) < 15 * n
    held = {i for p in got for i in p}
    assert len(held) == n  # all have one initial and last name with others
    sizes = {(r["kind"], r["n"]) for r in duplicates.groups(df).collect()}
    assert ("compact", n // 2) in sizes and ("initial", n // 2) in sizes
