"""Texts of ten megabytes and more: seconds and some hundred megabytes, whatever their shape."""

import resource
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tributary.llm import lines, pii, secrets


@pytest.fixture
def quick():
    """The body takes some seconds and adds half a gigabyte at most."""
    began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    yield
    assert time.perf_counter() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 * 1024


def test_secrets_of_many_spans(quick):
    base, added = secrets.find("password=abcdefgh1 pwd: x9$kQ2!vLp " * 300_000)
    assert len(base) == 300_000 and len(added) == 300_000


def test_a_secret_of_five_million_characters(quick):
    base, added = secrets.find("password: ~" + "q" * 2_000_000 + "7xK2.q" * 500_000)
    assert base == [] and len(added) == 1


def test_personal_data_of_many_spans(quick):
    base, added = pii.find("a.novak@x.org wrote. " * 300_000)
    assert len(base) == 300_000


def test_personal_data_on_one_line(quick):
    text = "the town and " * 800_000 + "contact Anna Novak at +1 555 123 4567"
    base, added = pii.find(text)
    assert sorted(base) == sorted(brute.personal_spans(text)) and ("name", text.index("Anna"), text.index(" at +")) in added


def test_lines_of_long_texts(spark, tmp_path):
    """A million lines, of which every third goes, beside short texts of the same lines; and one line of ten megabytes."""
    many = "\n".join(" Same " if i % 3 == 0 else str(i) for i in range(1_000_000))
    pq.write_table(pa.table({"doc_id": range(12), "text": [many, "x" * 10_000_000, *["own\nsame\n"] * 10]}), tmp_path / "docs.parquet", row_group_size=1)
    docs = spark.read.parquet(f"file://{tmp_path}/docs.parquet")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.length("kept").alias("n"), F.sha2("kept", 256).alias("sha")).collect()}
    assert time.perf_counter() - began < 60
    assert (got[0]["n_lines"], got[0]["n_dropped"]) == (1_000_000, 333_334) and (got[1]["n_lines"], got[1]["n_dropped"], got[1]["n"]) == (1, 0, 10_000_000)
    assert (got[2]["n_lines"], got[2]["n_dropped"]) == (3, 2)  # "own" is in ten documents, too


def test_long_and_short_texts_agree(spark, monkeypatch):
    rows = [(i % 9, "\n".join(f"{(i * k) % 7} l" if k % 4 else "" for k in range(i % 13))) for i in range(60)] + [(None, None), (None, "0 l\n0 l"), (3, "0 l\n0 l"), (3, "0 l\n0 l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    for first in (False, True):
        out = []
        for many in (1000, 2, 0):
            monkeypatch.setattr(lines, "MANY_LINES", many)
            out.append(sorted(map(str, lines.dedup_lines(docs, keep_first=first).collect())))
        assert out[0] == out[1] == out[2] and len(out[0]) == len(rows)
