"""Loads one by one against one run over all."""

import random

from pyspark.sql import functions as F

from tests.test_merge_hot import plain
from tributary.config import Config
from tributary.operators import merge, profile
from tributary.sources.delimited import read_csv_exact, records
from tributary.streaming import drop


def cells(spark, k, n, seed):
    rng = random.Random(seed)
    rows = [[str(rng.randint(0, 40_000)), rng.choice(["a@x.in", "B@y.in", ""]), rng.choice(["2020-01-02", "n/a"])] for _ in range(n)]
    return profile.long_cells(records(spark, ["no", "mail", "day"], rows), k, "f")


def test_sketches_of_loads(spark):
    """A second load's profile needs the first one's sketches alone; merging is associative; distinct counts within 2 %."""
    loads = [cells(spark, k, 6_000, k) for k in range(3)]
    kept = [profile.sketch_columns(c).cache() for c in loads]
    exact = {r["header"]: r for r in profile.profile_columns(loads[0].unionByName(loads[1]).unionByName(loads[2]).withColumn("row_idx", F.col("file_ord") * 10_000 + F.col("row_idx")).withColumn("file_ord", F.lit(0))).collect()}
    once = profile.merged_sketches(kept[0].unionByName(kept[1]).unionByName(kept[2]))
    again = profile.merged_sketches(profile.merged_sketches(kept[2].unionByName(kept[0])).unionByName(kept[1]))
    for merged in (once, again):
        got = {r["header"]: r for r in profile.profiles_of(merged).collect()}
        assert set(got) == set(exact)
        for h, want in exact.items():
            for c in ("samples", "rows", "present", "null_rate", "inferred"):
                assert got[h][c] == want[c], (h, c)
            assert abs(got[h]["unique_count"] - want["unique_count"]) <= 0.02 * want["unique_count"]


FILES = {
    "a.csv": "EmpCode,Dept,GrossCTC\n1,Sales,5\n2,IT,7\n,,\n3,HR,9\n",
    "b.csv": "employee_no,ctc,office\n2,8,Goa\n4,1,Pune\n,2,Delhi\n",
    "c.csv": "emp id,department,city\nAPX-1,Sales North,Goa\n4,IT,Pune Plant\n5,HR,Goa\n",
}


def test_files_dropped_one_by_one(spark, tmp_path):
    config, inbox, folder = Config(), tmp_path / "inbox", f"file://{tmp_path}/load"
    inbox.mkdir()
    for name, text in FILES.items():
        (inbox / name).write_text(text)
        drop.watch(spark, f"file://{inbox}", folder, read_csv_exact).awaitTermination(120)
    load = drop.Load(spark, folder)
    got = plain(load.records())
    # each file was a batch of its own, so they are numbered by batches
    sources = [drop.mapped(read_csv_exact(spark, f"file://{inbox}/{name}"), k * 10_000, name, config) for k, name in enumerate(sorted(FILES))]
    assert [len(s.mapping) for s in sources] == [3, 3, 3]
    assert got == plain(merge.merge_sources(sources))
    load.add(sources[2])  # the last one again
    assert plain(load.records()) == got
