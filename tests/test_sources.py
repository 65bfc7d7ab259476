import base64
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.sources import delimited, target, workbook


@pytest.mark.parametrize(
    "text, heads, rows",
    [
        ("﻿a,b\r\n1,2\r\n\r\n3", ["a", "b"], [["1", "2"], ["3", ""]]),
        ('a,b\n"x ""y"" z","l1\nl2"\n', ["a", "b"], [['x "y" z', "l1\nl2"]]),
        ('a,b\nab"c,d"e,f\n', ["a", "b"], [["abc,de", "f"]]),
        ("\n \na,a\n1,2,3\n", ["a"], [["2"]]),
        ('a\n""\n', ["a"], []),
        ("", [], []),
    ],
)
def test_parse_rows(text, heads, rows):
    assert delimited.parse_rows(text) == (heads, rows)


def test_chunks_of_any_cut():
    """Each record comes from the chunk in which it begins, wherever the cuts fall: within quotes, line ends, characters."""
    rng = random.Random(2)
    for turn in range(150):
        text = ("\ufeff" if turn % 3 == 0 else "") + "".join(rng.choices(['"', '""', ",", "\n", "\r\n", "\r", "é", " ", "ab", "x,y"], k=rng.randint(0, 40)))
        data = text.encode()
        want = [r for r in delimited.cells_of(text.removeprefix("\ufeff"))]
        for size in (1, 2, 3, 5, 7, 64):
            starts = range(0, max(len(data), 1), size)
            got = []
            for k, a in enumerate(starts):
                quoted = data[:a].count(b'"') % 2 == 1
                got += delimited.cells_of(delimited.chunk_text(io.BytesIO(data), len(data), delimited.Chunk(k, a, min(a + size, len(data)), quoted), ahead=2))
            assert got == want, (text, size)


def test_exact_file_in_chunks(spark, tmp_path):
    lines = "".join(f'{i},"say ""{i}""\n, ok",{"é" * (i % 7)}\r\n' + ("\n" if i % 5 == 0 else "") for i in range(400))
    text = "\ufeff\n id ,note,id\n" + lines
    (tmp_path / "x.csv").write_bytes(text.encode())
    heads, rows = delimited.parse_rows(text)
    for chunk in (97, 1000, 1 << 20):
        df = delimited.read_csv_exact(spark, f"file://{tmp_path}/x.csv", chunk)
        got = sorted(df.collect(), key=lambda r: r["row_idx"])
        assert df.columns == [*heads, "row_idx"] and [list(r)[:-1] for r in got] == rows and [r["row_idx"] for r in got] == list(range(400))
    (tmp_path / "empty.csv").write_bytes(b"")
    assert delimited.read_csv_exact(spark, f"{tmp_path}/empty.csv").collect() == []
    with pytest.raises(ValueError):
        delimited.read_csv_exact(spark, f"file://{tmp_path}/*.csv")


def test_large_workbook_is_streamed(spark, tmp_path):
    data = workbook.workbook_bytes(["n", "n2"], [[str(i), "x"] for i in range(12_000)])
    (tmp_path / "big.xlsx").write_bytes(data)
    df = workbook.read_workbooks(spark, f"{tmp_path}/big.xlsx")
    assert df.count() == 12_000 and df.agg({"row_idx": "max"}).first()[0] == 11_999 and df.filter("n = cast(row_idx as string)").count() == 12_000


def test_target_counts_whole_writes_only(spark, tmp_path):
    where = target.Target(spark, f"file://{tmp_path}/target")
    row = lambda *ids, batch="b": spark.createDataFrame([(str(i), batch, f"v{i}") for i in ids], "employee_number string, batch_id string, email string")
    one = row(*range(40)).repartition(4)
    assert where.read(one.schema).collect() == []
    lost = target.Writer(where.path, "b", 1)  # a task that wrote its file and was lost before it could tell
    lost.write(iter(pa.Table.from_pandas(one.toPandas()).to_batches()))
    where.write(one, "b", 1)
    where.write(one, "b", 1)  # the same attempt again
    assert where.read(one.schema).count() == 40 and where.attempts("b") == [1]
    with pytest.raises(Exception):
        where.write(one.withColumn("email", F.raise_error(F.lit("lost"))), "b", 2)
    assert where.attempts("b") == [1]
    where.write(row(3, 77).withColumn("email", F.lit("again")), "b", 2)
    where.write(row(3, batch="c"), "c", 1)
    got = {(r["batch_id"], r["employee_number"]): r["email"] for r in where.read(one.schema).collect()}
    assert len(got) == 42 and got["b", "3"] == "again" and got["c", "3"] == "v3" and got["b", "4"] == "v4"
    assert where.rollback("b") == 2 and where.rollback("b") == 0
    assert [r["batch_id"] for r in where.read(one.schema).collect()] == ["c"]
    where.write(row(1), "b", 1)
    assert where.read(one.schema).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,name\n1,"A, B"\n\n2, c \n')
    for read in (delimited.read_csv, delimited.read_csv_exact):
        rows = sorted(read(spark, f"file://{tmp_path}/x.csv").collect(), key=lambda r: r["row_idx"])
        assert [(r["id"], r["name"], r["row_idx"]) for r in rows] == [("1", "A, B", 0), ("2", "c", 1)]


def test_workbook(spark, tmp_path):
    data = workbook.workbook_bytes(["id", "näme"], [["1", "A & <B>"], ["", ""], ["2", ""]])
    assert workbook.sheet_rows(data) == (["id", "näme"], [["1", "A & <B>"], ["2", ""]])
    (tmp_path / "x.xlsx").write_bytes(data)
    (tmp_path / "y.xlsx").write_bytes(workbook.workbook_bytes(["more", "id"], [["m", "3"]]))
    found = workbook.read_workbooks(spark, f"file://{tmp_path}/*.xlsx")
    assert found.columns == ["id", "näme", "more", "file_name", "row_idx"]
    got = sorted((r["id"], r["more"], r["file_name"][-6:], r["row_idx"]) for r in found.collect())
    assert got == [("1", "", "x.xlsx", 0), ("2", "", "x.xlsx", 1), ("3", "m", "y.xlsx", 0)]
    up = delimited.read_upload(spark, "x.XLSX", base64_data=base64.b64encode(data).decode())
    assert up.count() == 2
    with pytest.raises(ValueError):
        delimited.read_upload(spark, "x.xlsx")
    with pytest.raises(ValueError):
        delimited.usable([up.limit(0)])


def test_row_numbers_over_partitions(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("cast(id as string) as v")
    assert all(int(r["v"]) == r["row_idx"] for r in delimited.with_row_numbers(df).collect())


def test_samples(spark):
    from tributary.operators import escalations
    from tributary.plans import pipeline
    from tributary.sources import samples

    result = pipeline.run(samples.extracts(spark))
    kinds = {r["kind"] for r in result.escalations.collect()}
    assert {"duplicate_fuzzy", "value_ambiguous_date", "value_unknown_enum", "conflict_cross_file", "validation_failed"} <= kinds
    rows = {r["employee_number"]: r for r in result.records.collect()}
    assert set(rows) == {"4711", "4712", "4713", "4713X"} and rows["4712"]["cells"]["ctcAnnual"]["value"] == "38500"
    assert rows["4712"]["cells"]["currency"]["value"] == "INR" and rows["4711"]["cells"]["workLocation"]["value"] == "Lisbon Harbour"
    # traced by hand: people, open escalations by kind, mappings by status
    assert {r["kind"]: r["n"] for r in escalations.summary(result.escalations).collect()} == {
        "mapping_competing": 1, "value_ambiguous_date": 1, "value_unknown_enum": 1, "conflict_cross_file": 1, "duplicate_fuzzy": 1, "validation_failed": 1,
    }
    counts = result.counts()
    assert (counts["people"], counts["auto"], counts["escalated"], counts["ignored"], counts["open"]) == (4, 20, 1, 0, 6)
    assert rows["4711"]["cells"]["designation"]["value"] == "Foreman" and rows["4713"]["cells"]["dateOfJoining"]["value"] == "2021-10-05"
