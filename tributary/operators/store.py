"""Job state as a log of versions: each save adds its jobs as a version of its own, and the last version of a job counts.

A save writes its rows to a folder of its own, then claims the next number by creating that number's commit, which only one
writer can. Who comes second reads what the first one wrote and tries again behind it; a job that it had read before then
is stale and is refused, so no update is lost. A compaction is a commit as well: it names a folder with the last versions,
from which readers start. Nothing is listed but the commits, and nothing is overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.cut import create_new, cut, delete, names, text_of_file

JOBS = "id string, client_name string, status string, created_at long, updated_at long, data string"


class Stale(Exception):
    """What was to be saved had been read before another writer saved it."""


class JobStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> list[dict]:
        """The commits from the last compaction on."""
        out: list[dict] = []
        for name in sorted(names(self.spark, f"{self.path}/commits"), reverse=True):
            said = json.loads(text_of_file(self.spark, f"{self.path}/commits/{name}"))
            out.append(said)
            if said["base"]:
                break
        return out[::-1]

    def _commit(self, folder: str, base: bool, number: int) -> bool:
        return create_new(self.spark, f"{self.path}/commits/{number:012}", json.dumps({"number": number, "folder": folder, "base": base}))

    def _rows(self, commits: list[dict]) -> DataFrame:
        schema = f"{JOBS}, version long"
        if not commits:
            return self.spark.createDataFrame([], schema)
        return latest(self.spark.read.schema(schema).parquet(*[f"{self.path}/log/{c['folder']}" for c in commits]), ["id"], [F.col("version").desc()])

    def save(self, jobs: DataFrame) -> int:
        """Adds jobs as the next version, which is returned; created_at of known jobs stays. Jobs with a `version`, as all()
        gives it, are refused together if any has another version by now; without one, or where it is null, the last save
        counts."""
        jobs = cut(jobs, "jobs")
        while True:
            commits = self._commits()
            known = self._rows(commits).select("id", F.col("created_at").alias("first_at"), F.col("version").alias("now"))
            met = jobs.join(known, "id", "left")
            if "version" in jobs.columns and not met.filter(F.col("version").isNotNull() & ~F.col("version").eqNullSafe(F.col("now"))).isEmpty():
                raise Stale("another writer saved a job since it was read: read it again")
            number, folder = commits[-1]["number"] + 1 if commits else 1, uuid.uuid4().hex
            rows = met.withColumn("created_at", F.coalesce("first_at", "created_at")).withColumn("version", F.lit(number).cast("long"))
            rows.select("id", "client_name", "status", "created_at", "updated_at", "data", "version").write.parquet(f"{self.path}/log/{folder}")
            if self._commit(folder, False, number):
                return number
            delete(self.spark, f"{self.path}/log/{folder}")  # another writer was first

    def compact(self) -> bool:
        """Brings the last versions together; whether they are in place. Writers that come first win."""
        commits = self._commits()
        if len(commits) < 2:
            return False
        folder = uuid.uuid4().hex
        self._rows(commits).write.parquet(f"{self.path}/log/{folder}")
        return self._commit(folder, True, commits[-1]["number"] + 1)

    def all(self) -> DataFrame:
        """Jobs with the version that each was saved as."""
        return self._rows(self._commits())

    def get(self, job_id: str) -> dict | None:
        rows = self.all().filter(F.col("id") == job_id).select("data").take(1)
        return json.loads(rows[0][0]) if rows else None

    def recent(self, most: int = 12) -> DataFrame:
        return recent_jobs(self.all(), most)


def recent_jobs(jobs: DataFrame, most: int = 12) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), "id").limit(most).select("id", "client_name", "status", "created_at")


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last version of each key: an upsert over an append-only log."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(by)).filter("rn = 1").drop("rn")


def snapshot(job: DataFrame) -> DataFrame:
    """A job without its source rows."""
    return job.drop("rows")


def recent_events(events: DataFrame, most: int = 80) -> DataFrame:
    """The log's last events by (ts, seq): a ring buffer at read time."""
    return events.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(most)


def tail(rows: DataFrame, most: int, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last `most` rows in order, newest first, with their rank from the end."""
    last = rows.orderBy(*[F.col(c).desc() for c in order]).limit(most)
    by = Window.orderBy(*[F.col(c).desc() for c in order])  # `most` rows
    return last.withColumn("rank", F.row_number().over(by).cast("long"))
