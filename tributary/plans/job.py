"""A job's life after its run: decisions, push, retry and rollback, each giving a new job; tables may be kept and read again.

A saved state is a set of tables in a folder of their own and one small file, named by the state's number, that says which.
Only one writer can create it, so of two that go on from one state the second is refused. Jobs that are saved also stand in
the job store beside them, which lists the newest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.config import Config
from tributary.functions.cut import create_new, cut, delete, names, text_of_file
from tributary.operators import decisions, merge, sink, store, trail
from tributary.operators.store import JobStore, Stale
from tributary.operators.trail import AUDIT, EVENT
from tributary.plans.pipeline import Result
from tributary.sources.target import Target

LOG = "record_id string, employee_number string, attempt long, method string, path string, status int, ok boolean, error string, body string, batch_id string"
STATE = ("status", "client", "engagement", "created_at", "pushes")
TABLES = ("profiles", "mappings", "records", "pairs", "escalations", "rules")


@dataclass(frozen=True)
class Job:
    """target holds what this job's batch put there: batch_id, employee_number and one column a field. turn: the number of
    the saved state that this job is or comes from; pushes: how often it was pushed."""

    job_id: str
    result: Result
    target: DataFrame
    log: DataFrame
    audit: DataFrame
    events: DataFrame
    status: str
    client: str = ""
    engagement: str = ""
    created_at: int = 0
    pushes: int = 0
    turn: int = 0

    @property
    def batch_id(self) -> str:
        return f"batch_{self.job_id[-6:]}"

    @staticmethod
    def of(job_id: str, result: Result, client: str = "", engagement: str = "", created_at: int = 0) -> Job:
        spark = result.records.sparkSession
        records = result.records
        for name, kind in (("excluded", "boolean"), ("push_status", "string")):
            if name not in records.columns:
                records = records.withColumn(name, F.lit(False if name == "excluded" else None).cast(kind))
        payload = merge.wide_records(records, result.config).drop("record_id")
        target = payload.limit(0).withColumn("batch_id", F.lit("").cast("string"))
        empty = lambda schema: spark.createDataFrame([], schema)
        audit, events = (have if have is not None else empty(kind) for have, kind in ((result.audit, AUDIT), (result.events, EVENT)))
        return Job(job_id, replace(result, records=records), target, empty(LOG), audit, events, result.status, client, engagement, created_at)

    def decided(self, choices: DataFrame) -> Job:
        """After decisions(escalation_id, choice, reject, at)."""
        done = cut(decisions.resolve(self.result.escalations, choices, self.result.records), "decisions")
        result = self.result.after(done)
        audit = self.audit.unionByName(trail.of_decisions(done, self.result.records, self.result.mappings, self.result.config))
        status = decisions.ready_state(self.status, result.escalations.filter("status = 'open'").limit(1).count())
        return replace(self, result=result, audit=audit, events=self.events.unionByName(trail.events_of_decisions(done)), status=status)

    def push(self, at: int, retry_failed: bool = False, to: Target | None = None) -> Job:
        """Pushes what is pending, or only what failed. Refused while escalations are open. What the target accepts is
        written to it, if one is given, as this batch's next attempt: a push that is run again after it was lost on the way
        changes nothing there."""
        if not self.result.escalations.filter("status = 'open'").isEmpty():
            raise ValueError("escalations are open: decide them before the push")
        records, config = self.result.records, self.result.config
        required = [f.key for f in config.fields if f.required]
        wide = merge.wide_records(records, config)
        due = sink.pending(records, retry_failed).select("record_id", "excluded", "push_status").join(wide, "record_id")
        before = self.log.select("record_id", "employee_number", "status")
        calls = cut(sink.push(due, required, self.target.select("employee_number"), before), "calls")
        log = cut(sink.told(calls, wide, required, self.batch_id), "log")
        payload = wide.withColumn("employee_number", F.coalesce("employee_number", "record_id")).withColumn("batch_id", F.lit(self.batch_id))
        after = cut(sink.after_push(records, calls), "records")
        failed = not after.filter("push_status = 'failed'").isEmpty()
        if to is not None:
            to.write(payload.join(calls.filter("ok").select("record_id"), "record_id", "left_semi").select(*self.target.columns), self.batch_id, self.pushes + 1)
        return replace(
            self,
            pushes=self.pushes + 1,
            result=replace(self.result, records=after),
            target=cut(sink.target_after(self.target, payload, calls), "target"),
            log=self.log.unionByName(log),
            audit=self.audit.unionByName(trail.of_calls(log, at)),
            events=self.events.unionByName(trail.events_of_calls(log, at)),
            status="partial_failure" if failed else "complete",
        )

    def rollback(self, at: int, to: Target | None = None) -> Job:
        """Takes the whole batch back, from the target too if one is given."""
        if to is not None:
            to.rollback(self.batch_id)
        calls, target, records = sink.rollback(self.result.records, self.target)
        log = cut(sink.told(calls, merge.wide_records(self.result.records, self.result.config), [f.key for f in self.result.config.fields if f.required], self.batch_id), "log")
        audit, events = trail.of_rollback(log, at, self.batch_id)
        return replace(self, result=replace(self.result, records=records), target=target, log=self.log.unionByName(log), audit=self.audit.unionByName(audit), events=self.events.unionByName(events), status="rolled_back")

    def counts(self) -> dict[str, int]:
        """The job's metrics: source rows, people, mappings by status, transforms, open escalations, pushed and failed."""
        pushed = self.result.records.agg(F.count_if(F.col("push_status") == "success").alias("pushed"), F.count_if(F.col("push_status") == "failed").alias("failed")).first()
        return {**self.result.counts(), **pushed.asDict()}

    def recent_events(self, most: int = 80) -> DataFrame:
        """The newest events; the limit is the feature."""
        return store.recent_events(self.events.withColumn("ts", F.col("at")).withColumn("seq", F.col("message")), most).drop("ts", "seq")

    def save(self, folder: str) -> Job:
        """The job as saved. All tables, as Parquet, under a folder of their own for this state; Stale if another state was
        saved since the one that this job comes from."""
        spark, where = self.result.records.sparkSession, f"{folder.rstrip('/')}/{self.job_id}"
        if _turns(spark, where) != self.turn:
            raise Stale(f"{self.job_id} was saved by another writer: load it again")
        own = f"{where}/tables/{uuid.uuid4().hex}"
        for name in TABLES:
            getattr(self.result, name).write.parquet(f"{own}/{name}")
        for name in ("target", "log", "audit", "events"):
            getattr(self, name).write.parquet(f"{own}/{name}")
        said = {"tables": own, **{n: getattr(self, n) for n in STATE}}
        if not create_new(spark, f"{where}/states/{self.turn + 1:09}", json.dumps(said)):
            delete(spark, own)
            raise Stale(f"{self.job_id} was saved by another writer: load it again")
        row = [(self.job_id, self.client, self.status, self.created_at, self.created_at, json.dumps({"engagement": self.engagement, "turn": self.turn + 1, "metrics": self.counts()}))]
        JobStore(spark, f"{folder.rstrip('/')}/_jobs").save(spark.createDataFrame(row, store.JOBS))
        return replace(self, turn=self.turn + 1)

    @staticmethod
    def load(spark: SparkSession, folder: str, job_id: str, config: Config | None = None) -> Job | None:
        """The last state that was saved whole."""
        where = f"{folder.rstrip('/')}/{job_id}"
        turn = _turns(spark, where)
        if not turn:
            return None
        said = json.loads(text_of_file(spark, f"{where}/states/{turn:09}"))
        read = lambda name: spark.read.parquet(f"{said['tables']}/{name}")
        return Job(job_id, Result(*map(read, TABLES), config or Config()), *map(read, ("target", "log", "audit", "events")), turn=turn, **{n: said[n] for n in STATE})

    @staticmethod
    def recent(spark: SparkSession, folder: str, most: int = 12) -> DataFrame:
        """id, client_name, status, created_at of the newest jobs saved under a folder; the limit is the feature."""
        return JobStore(spark, f"{folder.rstrip('/')}/_jobs").recent(most)


def _turns(spark: SparkSession, where: str) -> int:
    return max(map(int, names(spark, f"{where}/states")), default=0)
