"""Loading extracts as they are dropped: each file's rows are folded once and kept, and only records that the new rows
touch are made again.

A load keeps, under its folder, the folded rows of each file (`rows`, by file) and the records that each file made or changed
(`records`, by file): the last version of a key is its record. Both are written by file, so a file that is loaded again, as a
stream's batch may be after a failure, replaces its own and changes nothing. The records are those of one run over all
files in the order of their loading.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.config import FULL_NAME, Config
from tributary.functions.cut import cut, names
from tributary.operators import mapping, merge, profile
from tributary.operators.hot import small
from tributary.operators.store import latest

BINARY = "path string, modificationTime timestamp, length long, content binary"


class Load:
    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or Config()

    def _files(self, table: str) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in names(self.spark, f"{self.folder}/{table}") if n.startswith("file="))

    def _read(self, table: str, files: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{table}/file={f}" for f in files])

    def add(self, source: merge.Source) -> None:
        """The next file, or one of these again. Its file_ord says which."""
        k = source.file_ord
        merge.fold_rows(source, self.config).write.mode("overwrite").parquet(f"{self.folder}/rows/file={k}")
        every = self._read("rows", [f for f in self._files("rows") if f <= k]).drop("file")
        touched = cut(self._read("rows", [k]).select("key").distinct(), "touched")
        records = merge.fold(every.join(small(touched), "key", "left_semi"), self.config)
        records.write.mode("overwrite").parquet(f"{self.folder}/records/file={k}")

    def records(self) -> DataFrame:
        """As merge_sources gives them for all files so far."""
        return latest(self._read("records", self._files("records")), ["key"], [F.col("file").desc()]).drop("file")


def mapped(df: DataFrame, file_ord: int, file_name: str, config: Config) -> merge.Source:
    """A file with the columns that its own profile maps; those that wait for a person stay out."""
    found = mapping.propose(profile.profile_columns(profile.long_cells(df, file_ord, file_name), config.policy.samples), config)
    used = [(r["col_ord"], r["header"], r["target"]) for r in found.collect() if r["target"] is not None and (r["status"] == "auto" or r["status"] == "escalated" and r["target"] == FULL_NAME)]
    return merge.Source(df, file_ord, file_name, tuple((h, t) for _, h, t in sorted(used)))


def watch(spark: SparkSession, inbox: str, folder: str, read: Callable[[SparkSession, str], DataFrame], config: Config | None = None, pattern: str = "*.csv") -> StreamingQuery:
    """A stream over files dropped into a folder, each loaded with `read` in the order of batches and names. It ends when all
    that is there is loaded; started again, it goes on behind that."""
    load = Load(spark, folder, config)

    def batch(files: DataFrame, number: int) -> None:
        for i, row in enumerate(files.select("path").orderBy("path").collect()):  # names of one batch's files
            name = row["path"].rpartition("/")[2]
            load.add(mapped(read(spark, row["path"]), number * 10_000 + i, name, load.config))

    stream = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).load(inbox)
    return stream.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint").trigger(availableNow=True).start()
