"""Cutting lineage with a table in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local master's own temporary folder, which all its
    tasks see; on a cluster that would split a table over machines, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tributary-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def _tidy() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended before the interpreter did
            return


atexit.register(_tidy)


def written(df: DataFrame, name: str, by: str | None = None) -> str:
    """Where the frame now lies as a table, in a folder for each value of `by`; it goes when the interpreter ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tributary-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """The frame, written and read again: what follows neither plans nor computes what came before. It survives the loss
    of executors, as it lies in the folder that spark.checkpoint.dir names."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def kept(df: DataFrame, path: str) -> DataFrame:
    """The table at path if it was written whole before, else the frame, written there."""
    spark = df.sparkSession
    where, files = _files(spark, f"{path}/_SUCCESS")
    if not files.exists(where):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def names(spark: SparkSession, path: str) -> list[str]:
    """Of the files in a folder; none if it isn't there."""
    where, files = _files(spark, path)
    if not files.exists(where):
        return []
    return [n for f in files.listStatus(where) if not (n := f.getPath().getName()).startswith(("_", "."))]


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file unless it is there; whether this call did. The file system decides between two that try."""
    where, files = _files(spark, path)
    files.mkdirs(where.getParent())
    if files.exists(where):
        return False
    try:
        out = files.create(where, False)
    except Exception as e:  # raised by the JVM
        if "already exists" in str(e) or "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def text_of_file(spark: SparkSession, path: str) -> str:
    """Of a small file."""
    where, files = _files(spark, path)
    opened = files.open(where)
    try:
        return bytes(opened.readAllBytes()).decode()
    finally:
        opened.close()
