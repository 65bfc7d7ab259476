"""What a person has to decide: typed escalations with their options, from records, mappings and rules.

Every function returns the columns of ESCALATION. An option's command is one struct with the fields that any kind needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.config import FULL_NAME, KIND_LABELS, Config
from tributary.functions.dates import year_of
from tributary.functions.text import labelled

COMMAND = "struct<type:string,record_id:string,mapping_id:string,field:string,value:string,keep_id:string,drop_id:string>"
OPTION = f"struct<id:string,label:string,apply:{COMMAND}>"
ESCALATION = ["kind", "record_id", "mapping_id", "field", "title", "evidence", "confidence", "options"]


def _none() -> Column:
    return F.lit(None).cast("string")


def command(kind: str, **given: Column) -> Column:
    names = ("record_id", "mapping_id", "field", "value", "keep_id", "drop_id")
    return F.struct(F.lit(kind).alias("type"), *[given.get(n, _none()).cast("string").alias(n) for n in names]).cast(COMMAND)


def option(id_: Column | str, label: Column | str, apply: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(id_).alias("id"), text(label).alias("label"), apply.alias("apply")).cast(OPTION)


def options(*each: Column) -> Column:
    return F.array(*each).cast(f"array<{OPTION}>") if each else F.expr(f"cast(array() as array<{OPTION}>)")


def _shape(df: DataFrame, kind: Column | str, title: Column, evidence: Column, confidence: Column | float, opts: Column, field: Column | None = None, record: Column | None = None, mapping: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        lit(kind).alias("kind"),
        (record if record is not None else _none()).alias("record_id"),
        (mapping if mapping is not None else _none()).alias("mapping_id"),
        (field if field is not None else _none()).alias("field"),
        title.alias("title"),
        evidence.cast("array<string>").alias("evidence"),
        lit(confidence).cast("double").alias("confidence"),
        opts.alias("options"),
    )


def flagged(records: DataFrame, config: Config) -> DataFrame:
    """One row a flag with its cell: record_id, who, field, issue, raw, value, conflicts, lineage, label, type, values."""
    names = [F.col(f"cells.{k}.value") for k in ("firstName", "lastName") if k in config.by_key]
    who = F.coalesce(F.col("employee_number"), F.btrim(F.concat_ws(" ", *names, F.lit(""))))
    cells = F.array(*[F.struct(F.lit(f.key).alias("field"), F.col(f"cells.{f.key}").alias("s")) for f in config.fields])

    def one(flag: Column) -> Column:  # the cell is in the same row, so that no cells move
        field = F.split(flag, ":")[0]
        return F.struct(field.alias("field"), F.split(flag, ":")[1].alias("issue"), F.get(F.filter("each", lambda x: x["field"] == field), F.lit(0))["s"].alias("s"))

    flags = records.select("record_id", who.alias("who"), "flags", cells.alias("each")).select("record_id", "who", F.explode(F.transform("flags", one)).alias("x"))
    flags = flags.select("record_id", "who", "x.field", "x.issue", *[F.col(f"x.s.{c}").alias(c) for c in ("raw", "value", "confidence", "transform", "conflicts", "lineage")])
    specs = config.fields_frame(records.sparkSession).select("field", "label", "type", "values")
    return flags.join(F.broadcast(specs), "field")  # the field table has one row a target field


def conflicts(records: DataFrame, config: Config | None = None) -> DataFrame:
    """One for each conflict; only numbers carry alternatives."""
    config = config or Config()
    f = flagged(records, config).filter("issue = 'conflict'")
    keep = option("keep", F.concat(F.lit("Keep "), F.coalesce("value", F.lit("—"))), command("accept_value", record_id=F.col("record_id"), field=F.col("field")))
    others = F.transform("conflicts", lambda v: option(F.concat(F.lit("use_"), v), F.concat(F.lit("Use "), v), command("set_field", record_id=F.col("record_id"), field=F.col("field"), value=v)))
    sources = F.transform("lineage", lambda x: F.concat(x["file_name"], F.lit(" · "), x["column"], F.lit(" · row "), x["row"].cast("string")))
    evidence = F.concat(F.array(F.concat(F.lit("Current: "), F.coalesce("value", F.lit("—")))), sources)
    return _shape(f, "conflict_cross_file", F.concat(F.col("label"), F.lit(" differs · "), F.col("who")), evidence, 0.5, F.concat(options(keep), others), F.col("field"), F.col("record_id"))


def value_issues(records: DataFrame, config: Config | None = None) -> DataFrame:
    """Ambiguous dates, unknown enum values, private mail addresses and invalid values."""
    config = config or Config()
    f = flagged(records, config).filter("issue in ('ambiguous_date', 'unknown_enum', 'personal_email', 'invalid')")
    rid, field, raw = F.col("record_id"), F.col("field"), F.coalesce("raw", F.lit(""))
    exclude = option("exclude", "Exclude record", command("exclude_record", record_id=rid))
    setting = lambda id_, label, value: option(id_, label, command("set_field", record_id=rid, field=field, value=value))
    pattern = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
    a, b, y = (F.regexp_extract(raw, pattern, k) for k in (1, 2, 3))
    year = F.when(F.length(y) == 2, year_of(y.try_cast("int")).cast("string")).otherwise(y)
    dmy, mdy = F.concat_ws("-", year, F.lpad(b, 2, "0"), F.lpad(a, 2, "0")), F.concat_ws("-", year, F.lpad(a, 2, "0"), F.lpad(b, 2, "0"))
    dates = F.when(raw.rlike(pattern), options(setting("dmy", F.concat(F.lit("DMY · "), dmy), dmy), setting("mdy", F.concat(F.lit("MDY · "), mdy), mdy))).otherwise(options(exclude))
    allowed = F.transform("values", lambda v: setting(v, F.replace(v, F.lit("_"), F.lit(" ")), v))
    first = F.when((field == "gender") & raw.rlike("(?i)trans"), options(setting("other", "Map to other", F.lit("other")))).when((field == "status") & raw.rlike("(?i)abscond"), options(setting("term", "terminated, noted as a delta", F.lit("terminated")))).otherwise(options())
    enums = F.concat(first, allowed, options(exclude))
    mails = options(option("accept", "Accept this address", command("accept_value", record_id=rid, field=field)), setting("clear", "Clear the address", _none()), exclude)
    issue = F.col("issue")
    kind = F.when(issue == "ambiguous_date", "value_ambiguous_date").when(issue == "unknown_enum", "value_unknown_enum").otherwise("validation_failed")
    confidence = F.when(issue == "ambiguous_date", 0.55).when(issue == "unknown_enum", 0.4).when(issue == "personal_email", 0.35).otherwise(0.2)
    what = F.when(issue == "ambiguous_date", "Ambiguous ").when(issue == "unknown_enum", "Unknown ").when(issue == "personal_email", "Private address as ").otherwise("Invalid ")
    opts = F.when(issue == "ambiguous_date", dates).when(issue == "unknown_enum", enums).when(issue == "personal_email", mails).otherwise(options(exclude))
    return _shape(f, kind, F.concat(what, F.lower("label"), F.lit(" · "), F.col("who")), F.array(F.concat(F.lit("Raw: "), raw)), confidence, opts, field, rid)


def duplicates(pairs: DataFrame) -> DataFrame:
    keep, drop = F.col("keep_id"), F.col("drop_id")
    opts = options(
        option("merge_a", F.concat(F.lit("Keep "), keep), command("merge_records", keep_id=keep, drop_id=drop)),
        option("merge_b", F.concat(F.lit("Keep "), drop), command("merge_records", keep_id=drop, drop_id=keep)),
        option("keep_both", "Keep both", command("accept_value", record_id=keep, field=F.lit("employeeNumber"))),
    )
    return _shape(pairs, "duplicate_fuzzy", F.concat(F.lit("Possible duplicate · "), keep, F.lit(" / "), drop), F.array(keep, drop), 0.72, opts, record=keep)


def skip_set(pairs: DataFrame) -> DataFrame:
    """Records of open pairs: their gaps may close once the pair is decided."""
    return pairs.select(F.explode(F.array("keep_id", "drop_id")).alias("record_id")).distinct()


def validate(records: DataFrame, skip: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """Missing required fields (one escalation a record), and births after joinings."""
    config = config or Config()
    live = records.filter(~F.col("excluded")) if "excluded" in records.columns else records
    if skip is not None:
        live = live.join(skip, "record_id", "left_anti")
    who = F.coalesce(F.col("employee_number"), F.col("record_id"))
    lacks = [F.when(F.coalesce(F.col(f"cells.{f.key}.value"), F.lit("")) == "", F.struct(F.lit(f.key).alias("field"), F.lit(f.label).alias("label"))) for f in config.fields if f.required]
    lacks = F.array(*lacks) if lacks else F.expr("cast(array() as array<struct<field:string,label:string>>)")
    gaps = live.select("record_id", who.alias("who"), F.filter(lacks, lambda x: x.isNotNull()).alias("gaps")).filter(F.size("gaps") > 0)
    exclude = options(option("exclude", "Exclude record", command("exclude_record", record_id=F.col("record_id"))))
    labels = F.array_join(F.transform("gaps", lambda g: g["label"]), ", ")
    out = _shape(gaps, "validation_failed", F.concat(F.lit("Missing required · "), F.col("who")), F.array(F.concat(F.lit("Missing: "), labels)), 0.2, exclude, F.get("gaps", F.lit(0))["field"], F.col("record_id"))
    if {"dateOfBirth", "dateOfJoining"} <= set(config.by_key):
        born, joined = F.col("cells.dateOfBirth.value"), F.col("cells.dateOfJoining.value")
        late = live.select("record_id", who.alias("who"), born.alias("born"), joined.alias("joined")).filter("born <> '' and joined <> '' and born > joined")
        out = out.unionByName(_shape(late, "validation_failed", F.concat(F.lit("DOB after joining · "), F.col("who")), F.array("born", "joined"), 0.15, options(), F.lit("dateOfBirth"), F.col("record_id")))
    return out


def of_mappings(mappings: DataFrame) -> DataFrame:
    """Escalated columns, by why they are."""
    m = mappings.filter("status = 'escalated'").withColumn("mapping_id", F.concat_ws(":", "file_name", "header"))
    mid = F.col("mapping_id")
    percent = lambda s: F.concat(F.round(s * 100).cast("int").cast("string"), F.lit("%"))
    to = F.transform("candidates", lambda c: option(c["field"], F.concat(F.lit("Map to "), c["field"], F.lit(" ("), percent(c["score"]), F.lit(")")), command("set_mapping", mapping_id=mid, field=c["field"])))
    opts = F.concat(to, options(option("ignore", "Ignore column", command("set_mapping", mapping_id=mid))))
    evidence = F.transform("candidates", lambda c: F.concat(c["field"], F.lit(" · "), percent(c["score"])))
    kind = F.when(F.col("reason") == "competing", "mapping_competing").otherwise("mapping_ambiguous")
    return _shape(m, kind, F.concat(F.lit("Where does it belong: "), F.col("header")), evidence, F.col("confidence"), opts, mapping=mid)


def required_without_source(mappings: DataFrame, config: Config | None = None, most: int = 8) -> DataFrame:
    """Required fields that no column feeds. A whole name feeds both its halves."""
    config = config or Config()
    spark = mappings.sparkSession
    used = mappings.filter("target is not null and status <> 'ignored'").select(F.explode(F.when((F.col("target") == FULL_NAME) & (F.col("status") == "auto"), F.array(F.lit("firstName"), F.lit("lastName"))).otherwise(F.array("target"))).alias("field"))
    gaps = config.fields_frame(spark).filter("required").select("field", "ord").join(used.distinct(), "field", "left_anti")
    first = mappings.select("file_ord", "col_ord", F.concat_ws(":", "file_name", "header").alias("m")).orderBy("file_ord", "col_ord").limit(most)
    listed = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "col_ord", "m"))), lambda x: x["m"]).alias("ms"))
    met = gaps.join(F.broadcast(listed), F.lit(True))  # one row of eight columns at most
    opts = F.transform("ms", lambda m: option(m, m, command("set_mapping", mapping_id=m, field=F.col("field"))))
    return _shape(met, "mapping_missing_required", F.concat(F.lit("No source for "), F.col("field")), F.array("field"), 0.2, opts, F.col("field"))


def first_of_each(escalations: DataFrame, order: str = "ord") -> DataFrame:
    """Of escalations that ask the same of the same thing the first in order; dropDuplicates would take any."""
    same = ["kind", "record_id", "mapping_id", F.coalesce("field", "title")]
    by = Window.partitionBy(*same).orderBy(order)
    return escalations.withColumn("rn", F.row_number().over(by)).filter("rn = 1").drop("rn")


def numbered(*parts: DataFrame) -> DataFrame:
    """All escalations, each with a stable id and order, the first of each kept, all open."""
    out = None
    for i, part in enumerate(parts):
        one = part.select(*ESCALATION, F.lit(i).alias("part"))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("ord", F.struct("part", F.coalesce("record_id", F.lit("")), F.coalesce("mapping_id", F.lit("")), F.coalesce("field", F.lit("")), "title"))
    out = first_of_each(out)
    name = F.concat_ws("|", "kind", F.coalesce("record_id", F.lit("")), F.coalesce("mapping_id", F.lit("")), F.coalesce("field", "title"))
    return out.withColumn("escalation_id", F.concat(F.lit("esc_"), F.substring(F.sha2(name, 256), 1, 16))).withColumn("status", F.lit("open"))


def summary(escalations: DataFrame) -> DataFrame:
    """kind, label, n of open ones."""
    return escalations.filter("status = 'open'").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("label", labelled(F.col("kind"), KIND_LABELS))


def clean_records(records: DataFrame) -> DataFrame:
    live = records.filter(~F.col("excluded")) if "excluded" in records.columns else records
    return live.filter(F.size("flags") == 0)


def delta_rules(cells: DataFrame, config: Config | None = None, least: int = 3) -> DataFrame:
    """Rules of this client's playbook that the data shows: the id prefix if `least` rows have it, and two standing ones."""
    config = config or Config()
    spark = cells.sparkSession
    hits = cells.filter(F.col("value").rlike(rf"(?i)^{config.id_prefix}-")).select("file_ord", "row_idx").distinct().limit(least)
    prefix = hits.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(F.lit("Strip employee prefix").alias("title"), F.lit("employeeNumber, managerEmployeeNumber").alias("applies_to"), F.lit("inferred").alias("origin"))
    standing = spark.createDataFrame([("Permanent is full_time", "employmentType", "inferred"), (f"Default currency {config.default_currency}", "currency", "inferred")], prefix.schema)
    return prefix.unionByName(standing)
