"""The target system as a data source: what a push accepts is written by tasks and counts once the whole batch is in.

`df.write.format("tributary_target").options(path=..., batch=..., attempt=...)` writes every task's rows to a file of its
own, whose name the task tells the driver; the commit names the files of all tasks in one manifest. Readers read what
manifests name. So a task that is lost, tried again or run twice leaves no row twice, a write that fails leaves none, and
the same (batch, attempt) written again leaves the first. Taking a batch back removes its manifests, then its files.

Rows have employee_number, batch_id and the payload's columns. Of one number in one batch the last attempt's row counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tributary.operators.store import latest
from tributary.sources.files import resolved

FORMAT = "tributary_target"


@dataclass
class Written(WriterCommitMessage):
    """A task's file; none if it had no row."""

    file: str | None
    rows: int


@dataclass
class File(InputPartition):
    file: str
    attempt: int

    def __init__(self, file: str, attempt: int):
        self.file, self.attempt = file, attempt


def _manifests(path: str) -> list[dict]:
    files, own = resolved(path)
    found = files.get_file_info(fs.FileSelector(f"{own}/manifests", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda f: f.path):
        if info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return out


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str, attempt: int):
        self.path, self.batch, self.attempt = path, batch, attempt

    def _name(self) -> str:
        return f"{uuid.uuid5(uuid.NAMESPACE_OID, self.batch).hex}-{self.attempt}"  # any text may name a batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, own = resolved(self.path)
        folder = f"{own}/data/{self._name()}"
        made, out, rows = None, None, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                files.create_dir(folder, recursive=True)
                made = f"{folder}/{uuid.uuid4().hex}.parquet"
                out = pq.ParquetWriter(files.open_output_stream(made), batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(made, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, own = resolved(self.path)
        there = f"{own}/manifests/{self._name()}.json"
        if files.get_file_info(there).type == fs.FileType.File:  # this attempt is in already
            self.abort(messages)
            return
        made = [m for m in messages if m is not None and m.file]
        said = {"batch": self.batch, "attempt": self.attempt, "rows": sum(m.rows for m in made), "files": [m.file for m in made]}
        files.create_dir(f"{own}/manifests", recursive=True)
        half = f"{own}/manifests/{uuid.uuid4().hex}.part"
        with files.open_output_stream(half) as f:
            f.write(json.dumps(said).encode())
        files.move(half, there)

    def abort(self, messages: list[Written | None]) -> None:
        """What tasks told goes; files of lost tasks are named nowhere, and go with the batch."""
        files, _ = resolved(self.path)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(m.file)


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema.fieldNames()

    def partitions(self) -> list[File]:
        return [File(f, m["attempt"]) for m in _manifests(self.path) for f in m["files"]] or [File("", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, _ = resolved(self.path)
        with files.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches():
                cells = {n: batch.column(n) for n in batch.schema.names} | {"attempt": pa.array([partition.attempt] * batch.num_rows, pa.int64())}
                yield pa.RecordBatch.from_arrays([cells[c] for c in self.columns], self.columns)


class TargetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("give the target's schema")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a target is only added to, or a batch taken back")
        return Writer(self.options["path"], self.options["batch"], int(self.options.get("attempt", 1)))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)


class Target:
    """A target folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.dataSource.register(TargetSource)

    def write(self, accepted: DataFrame, batch: str, attempt: int) -> None:
        accepted.write.format(FORMAT).mode("append").options(path=self.path, batch=batch, attempt=attempt).save()

    def read(self, schema: StructType) -> DataFrame:
        """The target's rows with these columns."""
        full = StructType([f for f in schema if f.name != "attempt"]).add("attempt", "long")
        rows = self.spark.read.format(FORMAT).schema(full).option("path", self.path).load()
        return latest(rows, ["batch_id", "employee_number"], [F.col("attempt").desc()]).select(*schema.fieldNames())

    def attempts(self, batch: str) -> list[int]:
        """Attempts of a batch that are in."""
        return sorted(m["attempt"] for m in _manifests(self.path) if m["batch"] == batch)

    def rollback(self, batch: str) -> int:
        """Takes a batch back; how many attempts of it were in."""
        files, own = resolved(self.path)
        attempts = self.attempts(batch)
        names = [Writer(self.path, batch, a)._name() for a in attempts]
        for name in names:  # from here on no reader sees them
            files.delete_file(f"{own}/manifests/{name}.json")
        for name in names:
            if files.get_file_info(f"{own}/data/{name}").type == fs.FileType.Directory:
                files.delete_dir(f"{own}/data/{name}")
        return len(attempts)
