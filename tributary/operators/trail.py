"""What happened to a job: an audit row for each act of a person or of the target, and events for whoever watches.

Audit: at, actor, action, subject, why, before, after. Events: at, level, step, message, detail. Wording is this engine's own;
actors, actions and levels are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.config import Config
from tributary.operators.merge import long_records

AUDIT = "at long, actor string, action string, subject string, why string, before string, after string"
EVENT = "at long, level string, step string, message string, detail string"


def _audit(df: DataFrame, at: Column, actor: Column | str, action: Column | str, subject: Column, why: Column, before: Column | None = None, after: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    return df.select(at.cast("long").alias("at"), lit(actor).alias("actor"), lit(action).alias("action"), subject.alias("subject"), lit(why).alias("why"), (before if before is not None else none).alias("before"), (after if after is not None else none).alias("after"))


def _event(df: DataFrame, at: Column, level: Column | str, step: str, message: Column, detail: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(at.cast("long").alias("at"), lit(level).alias("level"), F.lit(step).alias("step"), message.alias("message"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


def of_decisions(resolved: DataFrame, records: DataFrame, mappings: DataFrame, config: Config | None = None) -> DataFrame:
    """An audit row for each command, with values as they were before all of these decisions. Rejections have events only."""
    t, field, value = F.col("command.type"), F.col("command.field"), F.col("command.value")
    r = resolved.filter(t.isin("set_mapping", "set_field", "accept_value", "exclude_record", "merge_records"))
    cells = long_records(records, config).select(F.col("record_id").alias("cell_rid"), F.col("field").alias("cell_field"), F.col("value").alias("was"))
    who = records.select(F.col("record_id").alias("rid"), F.coalesce("employee_number", "record_id").alias("who"))
    columns = mappings.select(F.concat_ws(":", "file_name", "header").alias("mid"), "header", F.col("target").alias("mapped"))
    subject_id = F.coalesce(F.col("command.keep_id"), F.col("command.record_id"))
    met = r.withColumn("rid", subject_id).join(who, "rid", "left").join(cells, (F.col("rid") == F.col("cell_rid")) & (field == F.col("cell_field")), "left")
    met = met.join(who.select(F.col("rid").alias("drop_rid"), F.col("who").alias("dropped")), F.col("command.drop_id") == F.col("drop_rid"), "left").join(columns, F.col("command.mapping_id") == F.col("mid"), "left")
    action = F.when(t == "set_mapping", "mapping.correct").when(t == "set_field", "value.correct").when(t == "accept_value", "value.accept").when(t == "exclude_record", "record.exclude").otherwise("record.merge")
    subject = F.when(t == "set_mapping", F.coalesce("header", F.col("command.mapping_id"))).when(t.isin("set_field", "accept_value"), F.concat(F.coalesce("who", "rid"), F.lit("."), field)).when(t == "exclude_record", F.coalesce("who", "rid")).otherwise(F.concat(F.coalesce("who", "rid"), F.lit(" \u2190 "), F.coalesce("dropped", F.col("command.drop_id"))))
    why = F.when(t == "set_mapping", "a person chose the field").when(t == "set_field", "a person gave the value").when(t == "accept_value", "a person accepted the value").when(t == "exclude_record", "a person held the record back").otherwise("a person confirmed the duplicate")
    before = F.when(t == "set_mapping", F.coalesce("mapped", F.lit("unmapped"))).when(t == "set_field", F.coalesce("was", F.lit("empty")))
    after = F.when(t == "set_mapping", F.coalesce(field, F.lit("ignored"))).when(t == "set_field", F.coalesce(value, F.lit("empty"))).when(t == "accept_value", F.coalesce("was", F.lit("")))
    return _audit(met, F.col("at"), "human", action, subject, why, before, after)


def events_of_decisions(resolved: DataFrame) -> DataFrame:
    what = F.concat_ws(" \u00b7 ", F.when(F.col("status") == "rejected", "Rejected").otherwise("Resolved"), "kind", F.coalesce("record_id", F.col("command.mapping_id")))
    return _event(resolved, F.col("at"), "human", "review", what, F.col("command.type"))


def of_calls(log: DataFrame, at: int) -> DataFrame:
    """log: sink.told."""
    ok = F.col("ok")
    return _audit(log.filter("method = 'POST'"), F.lit(at), "target", F.when(ok, "push.ok").otherwise("push.fail"), F.col("employee_number"), F.when(ok, F.concat(F.lit("POST "), "path", F.lit(" \u2192 "), F.col("status").cast("string"))).otherwise(F.coalesce("error", F.lit("failed"))), None, F.when(ok, "created").otherwise(F.col("status").cast("string")))


def events_of_calls(log: DataFrame, at: int) -> DataFrame:
    ok = F.col("ok")
    return _event(log.filter("method = 'POST'"), F.lit(at), F.when(ok, "push").otherwise("warn"), "push", F.concat_ws(" \u00b7 ", F.when(ok, "201 created").otherwise(F.col("status").cast("string")), "employee_number", "error"))


def of_rollback(log: DataFrame, at: int, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """One audit row and one event for the batch."""
    n = log.filter("method = 'DELETE'").agg(F.count(F.lit(1)).alias("n"))
    return _audit(n, F.lit(at), "human", "batch.rollback", F.lit(batch_id), F.lit("a person took the batch back")), _event(n, F.lit(at), "warn", "rollback", F.concat(F.lit(f"Took batch {batch_id} back \u00b7 "), F.col("n").cast("string"), F.lit(" deletes")))


def of_run(profiles: DataFrame, mappings: DataFrame, records: DataFrame, escalations: DataFrame, at: int, assisted: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(audit, events) of a run, step by step, a millisecond apart. Only counts, columns and files reach the driver.

    assisted: how many columns a helper settled; None without one."""
    spark = profiles.sparkSession
    files = profiles.groupBy("file_ord", "file_name").agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns")).orderBy("file_ord").collect()
    columns = mappings.orderBy("file_ord", "col_ord").select("header", "target", "status", "reason").collect()
    r = records.agg(F.count(F.lit(1)).alias("people"), F.coalesce(F.sum("n_transforms"), F.lit(0)).alias("transforms"), F.count_if(F.size("flags") == 0).alias("clean")).first()
    kinds = {x["kind"]: x["n"] for x in escalations.filter("status = 'open'").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind").collect()}
    rows, n_columns, open_ = sum(f["rows"] for f in files), sum(f["columns"] for f in files), sum(kinds.values())
    auto, waiting = ([c for c in columns if c["status"] == s] for s in ("auto", "escalated"))
    pairs, conflicts = kinds.get("duplicate_fuzzy", 0), kinds.get("conflict_cross_file", 0)
    says: list[tuple[str, str, str, str | None]] = [
        ("info", "ingest", f"{len(files)} files, {rows} rows", " \u00b7 ".join(f"{f['file_name']} ({f['rows']})" for f in files)),
        ("info", "profile", f"{n_columns} columns profiled", None),
        ("auto", "map", f"{len(auto)} columns mapped, {len(waiting)} wait for a person", None),
        *(("escalate", "map", f"Waits: {c['header']}", c["reason"]) for c in waiting),
        ("auto" if assisted else "info", "ai_assist", "no helper" if assisted is None else f"{assisted} more columns mapped", None),
        ("auto", "transform", f"{r['transforms']} values cleaned, {r['people']} people", None),
        ("auto", "reconcile", f"{rows} rows of {len(files)} files are {r['people']} people", f"{pairs} likely duplicates, {conflicts} conflicts"),
        *(("escalate", "reconcile", f"{n} {what}", None) for n, what in ((pairs, "likely duplicates"), (conflicts, "conflicts")) if n),
        ("escalate" if open_ else "auto", "validate", f"{r['clean']} clean records, {open_} escalations", None),
        ("escalate" if open_ else "auto", "summarize", f"{open_} wait for a person" if open_ else "ready to push", " \u00b7 ".join(f"{n} {k}" for k, n in kinds.items()) or None),
    ]
    acts: list[tuple[str, str, str]] = [
        ("ingest", f"{len(files)} files", "extracts were read without a map of their columns"),
        ("profile", f"{n_columns} columns", "profiles decide the mapping's scores"),
        *(("map.auto", f"{c['header']} \u2192 {c['target']}", c["reason"]) for c in auto),
        *([("map.model", f"{assisted} columns", "a helper was sure enough")] if assisted else []),
        ("transform", f"{r['transforms']} values", "cleaning that can be undone"),
        ("reconcile", f"{r['people']} people", "equal numbers or addresses are one person"),
        ("validate", f"{open_} escalations", "what must not be guessed waits"),
    ]
    audit = spark.createDataFrame([(at + i, "agent", action, subject, why, None, None) for i, (action, subject, why) in enumerate(acts)], AUDIT)
    return audit, spark.createDataFrame([(at + i, *said) for i, said in enumerate(says)], EVENT)
