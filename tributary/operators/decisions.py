"""Applying people's decisions to records, mappings and escalations: state in, new state out, nothing changed in place.

decisions(escalation_id, choice, reject, at): choice names an option; unknown or absent takes the first; reject excludes
the record and leaves its other escalations open. Decisions count in the order (at, escalation_id), and one on an
escalation that an earlier one has closed counts for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.config import Config
from tributary.functions.cut import cut
from tributary.operators.escalations import COMMAND

NO_FLAGS = "cast(array() as array<string>)"


def _made(escalations: DataFrame, decisions: DataFrame) -> DataFrame:
    """The first decision on each open escalation, with the command it stands for."""
    by = Window.partitionBy("escalation_id").orderBy("at")
    one = decisions.withColumn("rn", F.row_number().over(by)).filter("rn = 1").select("escalation_id", "choice", F.coalesce("reject", F.lit(False)).alias("reject"), "at")
    met = escalations.filter("status = 'open'").join(one, "escalation_id")
    chosen = F.get(F.filter("options", lambda o: o["id"].eqNullSafe(F.col("choice"))), F.lit(0))
    apply = F.coalesce(chosen, F.get("options", F.lit(0)))["apply"]
    none = F.lit(None).cast("string")
    out = F.struct(F.lit("reject_record").alias("type"), F.col("record_id").alias("record_id"), *[none.alias(n) for n in ("mapping_id", "field", "value", "keep_id", "drop_id")]).cast(COMMAND)
    return met.select("escalation_id", "record_id", "field", "kind", F.when(F.col("reject"), "rejected").otherwise("resolved").alias("status"), F.when(F.col("reject"), out).otherwise(apply).alias("command"), "at")


def resolve(escalations: DataFrame, decisions: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Decisions that count: escalation_id, record_id, field, kind, status, command, at, whole.

    A fold over the decisions in their order that starts from records(record_id, excluded) as they are; without records
    all that is named is there and in. Of one record and field only rejections count until something else does, which
    closes the rest. A record goes out by a rejection, by an exclusion or by a merge into another record that is there,
    whichever escalation asked for it; once it is out, the next decision on it that is no rejection closes it altogether
    (whole). Records that aren't there never go out.

    Within a record the fold is a window. What decisions on other escalations take out may hang on what is out before, so
    this repeats until it stays the same. A decision hangs on earlier ones alone, so each round settles one more link of a
    chain and the end is the sequential fold's.
    """
    made = cut(_made(escalations, decisions), "made")
    turn = F.struct("at", "escalation_id")
    rejected = F.col("status") == "rejected"
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # decisions on no record stand alone, so that they are no group
    whose = F.coalesce("record_id", F.concat(F.lit("\0"), "escalation_id"))
    field = Window.partitionBy(whose, "field").orderBy("at", "escalation_id")
    record = Window.partitionBy(whose)
    closed = F.col("record_id").isNotNull() & (F.coalesce(F.sum(F.when(~rejected, 1)).over(before(field)), F.lit(0)) > 0)
    made = _with_state(made.withColumn("turn", turn).withColumn("closed", closed).filter(~F.col("closed")).drop("closed"), records)
    own = rejected | F.col("out_id").eqNullSafe(F.col("record_id"))
    local = cut(made.withColumn("own", F.when(own, F.col("turn"))), "local")
    outside, known = local.filter("false").select("record_id", F.col("turn").alias("gone")), None
    while True:
        met = local.join(outside.groupBy("record_id").agg(F.min("gone").alias("gone")), "record_id", "left")
        first = F.least(F.min("own").over(record), F.col("gone"))
        ends = ~rejected & (F.col("was_out") | (F.col("turn") >= first))
        met = met.withColumn("ends", F.col("there") & F.coalesce(ends, F.lit(False))).withColumn("end", F.min(F.when(F.col("ends"), F.col("turn"))).over(record))
        counts = met.filter(F.col("end").isNull() | (F.col("turn") <= F.col("end"))).withColumn("whole", F.coalesce(F.col("turn") == F.col("end"), F.lit(False)))
        counts = cut(counts.drop("own", "gone", "ends", "end", "there", "was_out"), "decided")
        outs = counts.filter(F.col("out_id").isNotNull() & ~F.col("out_id").eqNullSafe(F.col("record_id"))).select(F.col("out_id").alias("record_id"), F.col("turn").alias("gone"))
        if outs.isEmpty() or known is not None and outs.exceptAll(known).isEmpty() and known.exceptAll(outs).isEmpty():
            return counts.drop("turn", "out_id")
        outside = known = outs


def _with_state(made: DataFrame, records: DataFrame | None) -> DataFrame:
    """made with there and was_out of its record, and out_id: the record that its command takes out, if that is there."""
    kind, rejected = F.col("command.type"), F.col("status") == "rejected"
    named = F.when(~rejected & (kind == "exclude_record"), F.col("command.record_id")).when(~rejected & (kind == "merge_records"), F.col("command.drop_id"))
    keep = F.when(~rejected & (kind == "merge_records"), F.col("command.keep_id"))
    if records is None:
        return made.withColumn("there", F.col("record_id").isNotNull()).withColumn("was_out", F.lit(False)).withColumn("out_id", named)
    out = F.col("excluded") if "excluded" in records.columns else F.lit(False)
    state = records.select(F.col("record_id").alias("r_id"), out.alias("was_out"))
    ids = state.select("r_id")
    met = made.withColumn("named", named).withColumn("keep", keep).join(state, F.col("record_id") == F.col("r_id"), "left").withColumn("there", F.col("r_id").isNotNull()).drop("r_id")
    met = met.join(ids.withColumn("has_named", F.lit(True)), F.col("named") == F.col("r_id"), "left").drop("r_id")
    met = met.join(ids.withColumn("has_keep", F.lit(True)), F.col("keep") == F.col("r_id"), "left").drop("r_id")
    out_id = F.when(F.col("has_named") & (F.col("keep").isNull() & (kind == "exclude_record") | F.col("has_keep")), F.col("named"))
    return met.withColumn("out_id", out_id).withColumn("was_out", F.coalesce("was_out", F.lit(False))).drop("named", "keep", "has_named", "has_keep")


def close(escalations: DataFrame, resolved: DataFrame) -> DataFrame:
    """Escalations with new status: decided ones, and open ones of the same record and field (absent equals absent), or of
    a record that is out with such a decision."""
    done = resolved.select("escalation_id", F.col("status").alias("new"))
    settled = resolved.filter("status <> 'rejected' and record_id is not null").select(F.col("record_id").alias("r"), F.col("field").alias("f"), "whole").distinct()
    same = escalations.alias("e").join(settled.alias("s"), (F.col("e.record_id") == F.col("s.r")) & (F.col("e.field").eqNullSafe(F.col("s.f")) | F.col("s.whole")), "left_semi")
    related = same.select(F.col("escalation_id"), F.lit(True).alias("related"))
    met = escalations.join(done, "escalation_id", "left").join(related, "escalation_id", "left")
    status = F.coalesce("new", F.when((F.col("status") == "open") & F.col("related"), F.lit("resolved")), "status")
    return met.withColumn("status", status).drop("new", "related")


def set_mappings(mappings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mapping choices, of which the last counts; a column that is ignored by choice is `human` too. The merge isn't run
    again by itself."""
    picks = resolved.filter("command.type = 'set_mapping'").groupBy(F.col("command.mapping_id").alias("mid")).agg(F.max(F.struct("at", "escalation_id", F.col("command.field").alias("to"))).alias("last"))
    met = mappings.withColumn("mid", F.concat_ws(":", "file_name", "header")).join(picks, "mid", "left").drop("mid")
    hit = F.col("last").isNotNull()
    return met.withColumn("target", F.when(hit, F.col("last.to")).otherwise(F.col("target"))).withColumn("status", F.when(hit, "human").otherwise(F.col("status"))).drop("last")


def apply(records: DataFrame, resolved: DataFrame, config: Config | None = None) -> DataFrame:
    """Records with `excluded`, after field, acceptance, exclusion and merge commands in their order.

    A merge takes both records as they are at its turn. Merges that share no record run side by side; those that do, one
    after another, each with the other commands that come before it.
    """
    config = config or Config()
    if "excluded" not in records.columns:
        records = records.withColumn("excluded", F.lit(False))
    turn = F.struct("at", "escalation_id").alias("turn")
    single = resolved.filter("command.type in ('set_field', 'accept_value', 'exclude_record', 'reject_record') and command.record_id is not null").select(F.col("command.record_id").alias("record_id"), turn, "command")
    left = cut(resolved.filter("command.type = 'merge_records'").select(F.col("command.keep_id").alias("keep_id"), F.col("command.drop_id").alias("drop_id"), turn), "merges")
    since = None
    while not left.isEmpty():
        ends = left.select("turn", F.explode(F.array_distinct(F.array("keep_id", "drop_id"))).alias("record_id"))
        first = F.row_number().over(Window.partitionBy("record_id").orderBy("turn"))
        ready = ends.withColumn("rn", first).groupBy("turn").agg(F.max("rn").alias("rn")).filter("rn = 1").select("turn")
        now = cut(left.join(ready, "turn", "left_semi"), "ready")
        until = now.select("turn", F.explode(F.array_distinct(F.array("keep_id", "drop_id"))).alias("record_id")).select("record_id", F.col("turn").alias("until"))
        due = single.join(until, "record_id").filter(F.col("turn") < F.col("until")).drop("until")
        records = cut(_merge_pairs(_apply_single(records, _later(due, since), config), now, config), "merged")
        done = until.select("record_id", F.col("until").alias("since"))
        since = done if since is None else since.unionByName(done).groupBy("record_id").agg(F.max("since").alias("since"))
        left = cut(left.join(ready, "turn", "left_anti"), "merges")
    return _apply_single(records, _later(single, since), config)


def _later(acts: DataFrame, since: DataFrame | None) -> DataFrame:
    """Commands that come after the last merge of their record."""
    if since is None:
        return acts
    met = acts.join(since, "record_id", "left")
    return met.filter(F.col("since").isNull() | (F.col("turn") > F.col("since"))).drop("since")


def _apply_single(records: DataFrame, acts: DataFrame, config: Config) -> DataFrame:
    own = acts.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("turn", "command"))).alias("acts"))
    met = records.join(own, "record_id", "left")
    met = met.withColumn("acts", F.coalesce("acts", F.expr(f"cast(array() as array<struct<turn:{acts.schema['turn'].dataType.simpleString()},command:{COMMAND}>>)")))
    kinds = F.transform("acts", lambda x: x["command"]["type"])
    out = F.array_contains(kinds, "exclude_record")
    cells = F.col("cells")
    for f in config.fields:
        cells = cells.withField(f.key, _acted(f.key))
    touched = F.transform("acts", lambda x: F.coalesce(x["command"]["field"], F.lit("")))
    flags = F.when(out, F.expr(NO_FLAGS)).otherwise(F.filter("flags", lambda x: ~F.array_contains(touched, F.split(x, ":")[0])))
    done = met.withColumn("new_cells", cells).withColumn("flags", flags).withColumn("excluded", F.col("excluded") | out | F.array_contains(kinds, "reject_record")).drop("cells", "acts").withColumnRenamed("new_cells", "cells")
    if "employeeNumber" in config.by_key:
        done = done.withColumn("employee_number", F.col("cells.employeeNumber.value"))
    return done


def _acted(key: str) -> Column:
    """A field's state after its record's acts. A value that is cleared is null."""
    mine = F.filter("acts", lambda x: x["command"]["field"] == key)
    last = F.try_element_at(F.filter(mine, lambda x: x["command"]["type"] == "set_field"), F.lit(-1))["command"]
    state = F.col(f"cells.{key}")
    changed = state.withField("value", last["value"]).withField("confidence", F.lit(1.0)).withField("transform", F.lit("consultant correction"))
    return F.when(last.isNotNull(), changed).when(F.size(mine) > 0, state.withField("confidence", F.lit(1.0))).otherwise(state)


def _given(key: str) -> Column:
    """A keeper's field, filled by the dropped record's."""
    state, gift = F.col(f"cells.{key}"), F.col(f"given.{key}")
    filled = (F.coalesce(state["value"], F.lit("")) == "") & (F.coalesce(gift["value"], F.lit("")) != "")
    return F.when(filled, gift.withField("transform", F.lit("merged from duplicate"))).otherwise(state)


def _merge_pairs(records: DataFrame, pairs: DataFrame, config: Config) -> DataFrame:
    """Pairs that share no record: the keeper fills its empty fields from the dropped record and takes its rows; the
    dropped one is excluded. A pair of which one record is unknown does nothing."""
    known = records.select(F.col("record_id").alias("keep_id"))
    given = pairs.join(known, "keep_id", "left_semi").join(records.select(F.col("record_id").alias("drop_id"), F.col("cells").alias("given"), F.col("row_ids").alias("given_rows")), "drop_id")
    given = cut(given.select("keep_id", "drop_id", "given", "given_rows"), "given")
    met = records.join(given.drop("drop_id").withColumnRenamed("keep_id", "record_id"), "record_id", "left").join(given.select(F.col("drop_id").alias("record_id"), F.lit(True).alias("dropped")), "record_id", "left")
    cells = F.col("cells")
    for f in config.fields:
        cells = cells.withField(f.key, _given(f.key))
    gone, keeps = F.coalesce("dropped", F.lit(False)), F.col("given").isNotNull()
    flags = F.when(gone, F.expr(NO_FLAGS)).when(keeps, F.filter("flags", lambda x: ~F.contains(x, F.lit("duplicate")))).otherwise(F.col("flags"))
    met = met.withColumn("new_cells", cells).withColumn("row_ids", F.concat("row_ids", F.coalesce("given_rows", F.expr("cast(array() as array<string>)")))).withColumn("flags", flags).withColumn("excluded", F.col("excluded") | gone)
    return met.drop("cells", "given", "given_rows", "dropped").withColumnRenamed("new_cells", "cells")


def ready_state(status: str, open_count: int) -> str:
    """Waiting for people and ready are told apart by what is open; other states stay."""
    if status not in ("awaiting_human", "ready_to_push"):
        return status
    return "awaiting_human" if open_count else "ready_to_push"


def human_rules(resolved: DataFrame) -> DataFrame:
    """Playbook entries that decisions imply."""
    t, field, value = F.col("command.type"), F.col("command.field"), F.col("command.value")
    title = F.when((t == "set_field") & (field == "status") & (value == "terminated"), "Unlisted status is terminated").when((t == "set_field") & (field == "gender") & (value == "other"), "Unlisted gender is other").when(t == "merge_records", "Merge people who share a phone")
    return resolved.select(title.alias("title"), F.coalesce(field, F.lit("employeeNumber")).alias("applies_to"), F.lit("human").alias("origin")).filter("title is not null")
