"""Pushing records to the target, trying failed ones again, and taking a batch back.

The outcome of a push depends on what the target holds and on what came before in the same batch; both are columns: a
join with the target, and the first of each number in push order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def push_status(excluded: Column, missing: Column, number: Column, attempt: Column, failed_once: Column, taken: Column, was_failed: Column, first: Column | None = None) -> Column:
    """The HTTP status: excluded 409, missing required fields 422, a number ending in 8 fails its first attempt with 503,
    a number that the target or an earlier row of the batch has 409 unless the record failed before, else 201."""
    busy = number.endswith("8") & (attempt == 1) & ~failed_once
    present = taken if first is None else taken | ~first
    return F.when(excluded, 409).when(missing, 422).when(busy, 503).when(present & ~was_failed, 409).otherwise(201)


def push(records: DataFrame, required: list[str], target: DataFrame, calls: DataFrame, order: str = "record_id") -> DataFrame:
    """records(record_id, employee_number, push_status, excluded, one column a required field) to one call each.

    target(employee_number); calls(record_id, employee_number, status): all calls before, rollbacks included.
    """
    number = F.coalesce("employee_number", "record_id")
    missing = F.lit(False)
    for f in required:
        missing = missing | F.coalesce(F.col(f).cast("string") == "", F.lit(True))
    before = calls.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    once = calls.filter("status = 503").select(F.col("employee_number").alias("number"), F.lit(True).alias("failed_once")).distinct()
    held = target.select(F.col("employee_number").alias("number"), F.lit(True).alias("taken")).distinct()
    r = records.withColumn("number", number).withColumn("missing", missing).join(before, "record_id", "left").join(once, "number", "left").join(held, "number", "left")
    r = r.withColumn("attempt", F.coalesce("n", F.lit(0)) + 1).withColumn("failed_once", F.coalesce("failed_once", F.lit(False))).withColumn("taken", F.coalesce("taken", F.lit(False)))
    was_failed = F.coalesce(F.col("push_status") == "failed", F.lit(False))
    alone = push_status(F.col("excluded"), F.col("missing"), F.col("number"), F.col("attempt"), F.col("failed_once"), F.col("taken"), was_failed)
    # of one number's rows the first 503 clears the way for the next, so those that would pass are ranked among themselves
    by = Window.partitionBy("number").orderBy(order)
    busy_before = F.coalesce(F.max(F.when(alone == 503, 1)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    r = r.withColumn("failed_once", F.col("failed_once") | busy_before)
    alone = push_status(F.col("excluded"), F.col("missing"), F.col("number"), F.col("attempt"), F.col("failed_once"), F.col("taken"), was_failed)
    r = r.withColumn("alone", alone)
    passes_before = F.coalesce(F.max(F.when(F.col("alone") == 201, 1)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    status = F.when((F.col("alone") == 201) & passes_before & ~was_failed, 409).otherwise(F.col("alone"))
    return r.select("record_id", F.col("number").alias("employee_number"), "attempt", status.alias("status"), (status == 201).alias("ok"), F.lit("POST").alias("method"), "excluded")


def pending(records: DataFrame, retry_failed: bool) -> DataFrame:
    status = F.coalesce("push_status", F.lit("pending"))
    return records.filter((status == "failed") if retry_failed else (status != "success")).filter(~F.col("excluded"))


def after_push(records: DataFrame, calls: DataFrame) -> DataFrame:
    last = calls.select("record_id", F.when(F.col("ok"), "success").otherwise("failed").alias("new"))
    return records.join(last, "record_id", "left").withColumn("push_status", F.coalesce("new", "push_status")).drop("new")


def target_after(target: DataFrame, payload: DataFrame, calls: DataFrame) -> DataFrame:
    """The target with what was accepted; a record that is pushed again replaces its row."""
    took = payload.join(calls.filter("ok").select("record_id"), "record_id", "left_semi")
    return target.join(took.select("employee_number").distinct(), "employee_number", "left_anti").unionByName(took.select(*target.columns))


def rollback(records: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(calls: a DELETE for each success, the job's target without any row, records)."""
    done = records.filter("push_status = 'success'")
    number = F.coalesce("employee_number", "record_id")
    calls = done.select("record_id", number.alias("employee_number"), F.lit(1).cast("long").alias("attempt"), F.lit(204).alias("status"), F.lit(True).alias("ok"), F.lit("DELETE").alias("method"), F.lit(False).alias("excluded"))
    return calls, target.limit(0), records.withColumn("push_status", F.when(F.col("push_status") == "success", "rolled_back").otherwise(F.col("push_status")))


def told(calls: DataFrame, payload: DataFrame, required: list[str], batch_id: str) -> DataFrame:
    """The call log's rows: each call with its path, body and error. payload(record_id and one column a field)."""
    fields = [c for c in payload.columns if c not in ("record_id", "employee_number")]
    lacks = F.array_join(F.filter(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in required]), lambda x: x.isNotNull()), ", ")
    # fields may be named as the log's columns are, so that they become text before they meet it
    said = payload.select("record_id", lacks.alias("lacks"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))
    met = calls.join(said, "record_id", "left")
    status, deleted = F.col("status"), F.col("method") == "DELETE"
    # the wording is free; tests and users go by status
    error = F.when(status == 422, F.concat(F.lit("422 missing "), "lacks")).when(status == 503, "503 target is busy, try again").when((status == 409) & F.col("excluded"), "409 record is excluded").when(status == 409, "409 employee exists already")
    body = F.when(deleted, F.to_json(F.struct(F.col("employee_number").alias("employeeNumber"), F.lit(batch_id).alias("batchId")))).otherwise(F.col("payload"))
    path = F.when(deleted, F.concat(F.lit("/api/v1/employee/"), F.url_encode("employee_number"))).otherwise("/api/v1/employee")
    return met.select("record_id", "employee_number", "attempt", "method", path.alias("path"), "status", "ok", error.alias("error"), body.alias("body"), F.lit(batch_id).alias("batch_id"))


def outcome(calls: DataFrame) -> DataFrame:
    """status, n."""
    return calls.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
