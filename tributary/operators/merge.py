"""Merging rows of many extracts into one record a person: two ordered folds, one shuffle.

The first fold happens inside each row, over the columns that feed one field, with no shuffle. Rows then meet by key (the
canonical employee number, else the lower-cased mail address, else a key of their own) and each field is folded again in
the order (file, row). Cleaning never happens inside a fold: every column is cleaned once, as a plain column, and a field's
state carries the cleaned form of the raw value that it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.config import FULL_NAME, Config
from tributary.functions.clean import CLEAN, canonical_id, clean_value
from tributary.functions.cut import cut
from tributary.functions.text import is_blank, split_person_name
from tributary.operators.hot import LISTED, fold_hot, small

#: Rows that one record's fold may bring together.
MOST_ROWS = 100_000

LINEAGE = "struct<file_name:string,column:string,row:int>"
CELL = f"struct<raw:string,value:string,confidence:double,lineage:array<{LINEAGE}>,transform:string,conflicts:array<string>,flags:array<string>,n:int>"
#: A cell while it is folded: with its raw value's cleaned form, so that nothing is cleaned twice.
STATE = f"{CELL[:-1]},clean:{CLEAN}>"
ITEM = f"struct<field:string,raw:string,clean:{CLEAN},lineage:{LINEAGE}>"


@dataclass(frozen=True)
class Source:
    """A frame of string columns with `row` numbering its rows from 0, and which column feeds which field, in order."""

    df: DataFrame
    file_ord: int
    file_name: str
    mapping: tuple[tuple[str, str], ...]
    row: str = "row_idx"


def tasks(spark: SparkSession) -> int:
    """Tasks that rows are dealt to: the session's number of a shuffle, a task a core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def empty_state() -> Column:
    none = F.lit(None)
    return F.struct(none.alias("raw"), none.alias("value"), F.lit(1.0).alias("confidence"), F.expr("array()").alias("lineage"), none.alias("transform"), F.expr("array()").alias("conflicts"), F.expr("array()").alias("flags"), F.lit(0).alias("n"), none.alias("clean")).cast(STATE)


def _state(raw, value, confidence, lineage, transform, conflicts, flags, n, clean=None) -> Column:
    names = ("raw", "value", "confidence", "lineage", "transform", "conflicts", "flags", "n", "clean")
    given = (raw, value, confidence, lineage, transform, conflicts, flags, n, clean)
    return F.struct(*[c.alias(k) for c, k in zip(given, names) if c is not None]).cast(STATE if clean is not None else CELL)


def absorb(config: Config):
    """The fold's step: (state, item) to state. Outcomes, in order:

    an empty value takes what comes; an equal one gains its lineage; numbers that differ conflict and are kept as
    alternatives; of strings that contain one another the longer stays; all else conflicts and the present value stays.
    """
    p = config.policy
    numbers = [f.key for f in config.fields if f.type == "number"]

    def step(a: Column, x: Column) -> Column:
        clean = x["clean"]
        value = clean["value"]
        seen = F.concat(a["lineage"], F.array(x["lineage"]))
        n = a["n"] + F.when(clean["transform"].isNotNull() & value.isNotNull(), 1).otherwise(0)
        sure = F.greatest(a["confidence"], clean["confidence"])
        no_conflicts = F.expr("cast(array() as array<string>)")
        conflict = F.concat(a["flags"], F.array(F.concat(x["field"], F.lit(":conflict"))))
        issue = F.when(clean["issue"].isNull(), a["flags"]).otherwise(F.concat(a["flags"], F.array(F.concat(x["field"], F.lit(":"), clean["issue"]))))
        new = value.isNotNull() & ~F.array_contains(a["conflicts"], F.coalesce(value, F.lit("")))
        more = F.when(new, F.concat(a["conflicts"], F.array(value))).otherwise(a["conflicts"])
        lower = (F.lower(a["value"]), F.lower(value))
        within = value.isNotNull() & (F.contains(*lower) | F.contains(*reversed(lower)))
        is_number = x["field"].isin(*numbers) if numbers and p.numeric_conflict_escalates else F.lit(False)
        within = within & F.lit(p.containment_keeps_longer)
        keep = (a["raw"], a["value"])
        return (
            F.when(a["value"].isNull() | (a["value"] == ""), _state(x["raw"], value, clean["confidence"], F.array(x["lineage"]), clean["transform"], no_conflicts, issue, n, clean))
            .when(a["value"] == value, _state(*keep, sure, seen, a["transform"], a["conflicts"], a["flags"], n, a["clean"]))
            .when(is_number, _state(*keep, a["confidence"], seen, a["transform"], more, conflict, n, a["clean"]))
            .when(within & (F.length(value) > F.length(a["value"])), _state(x["raw"], value, sure, seen, F.lit("kept longer form"), no_conflicts, a["flags"], n + 1, clean))
            .when(within, _state(*keep, a["confidence"], seen, a["transform"], a["conflicts"], a["flags"], n + 1, a["clean"]))
            .otherwise(_state(*keep, a["confidence"], seen, a["transform"], a["conflicts"], conflict, n, a["clean"]))
        )

    return step


def fold_rows(source: Source, config: Config | None = None) -> DataFrame:
    """file_ord, row_idx, row_id, key, states (field and state of what the row has), extra_flags, extra_n.

    The mapped columns are dealt to all tasks first: cleaning costs far more than reading, and a scan's tasks are told by bytes.
    """
    config = config or Config()
    df = source.df
    known = set(config.by_key)
    base = df.select(F.col(source.row).cast("int").alias("row_idx"), *[df[f"`{c}`"].cast("string").alias(f"c{i}") for i, (c, _) in enumerate(source.mapping)])
    base = base.repartition(tasks(df.sparkSession), "row_idx")
    names = [i for i, (_, target) in enumerate(source.mapping) if target == FULL_NAME]
    base = base.select("*", *[F.when(~is_blank(F.col(f"c{i}")), split_person_name(F.col(f"c{i}"))).alias(f"s{i}") for i in names])
    # each mapped column is cleaned once, as a plain column, before it enters an array
    wanted: list[tuple[str, Column, Column]] = []
    for i, (column, target) in enumerate(source.mapping):
        lineage = F.struct(F.lit(source.file_name).alias("file_name"), F.lit(column).alias("column"), (F.col("row_idx") + 2).alias("row"))
        if target == FULL_NAME:
            wanted += [(key, part, lineage) for key, part in (("firstName", F.col(f"s{i}.first")), ("lastName", F.nullif(F.col(f"s{i}.last"), F.lit("")))) if key in known]
        elif target in known:
            wanted.append((target, F.when(~is_blank(F.col(f"c{i}")), F.col(f"c{i}")), lineage))
    raws = base.select("*", *[raw.alias(f"r{k}") for k, (_, raw, _) in enumerate(wanted)])
    cleaned = raws.select("*", *[F.when(F.col(f"r{k}").isNotNull(), clean_value(key, F.col(f"r{k}"), config)).alias(f"k{k}") for k, (key, _, _) in enumerate(wanted)])
    none = F.expr("cast(array() as array<string>)")
    step, states = absorb(config), []
    for key in dict.fromkeys(key for key, _, _ in wanted):
        items = [F.struct(F.lit(key).alias("field"), F.col(f"r{k}").alias("raw"), F.col(f"k{k}").alias("clean"), lineage.alias("lineage")).cast(ITEM) for k, (field, _, lineage) in enumerate(wanted) if field == key]
        if len(items) == 1:  # the fold's first step is all there is
            k = next(k for k, (field, _, _) in enumerate(wanted) if field == key)
            clean, there = F.col(f"k{k}"), F.col(f"r{k}").isNotNull()
            flags = F.when(clean["issue"].isNull(), none).otherwise(F.array(F.concat(F.lit(f"{key}:"), clean["issue"])))
            state = _state(F.col(f"r{k}"), clean["value"], clean["confidence"], F.array(wanted[k][2]), clean["transform"], none, flags, F.when(clean["transform"].isNotNull() & clean["value"].isNotNull(), 1).otherwise(0), clean)
        else:
            there = F.coalesce(*[F.col(f"r{k}") for k, (field, _, _) in enumerate(wanted) if field == key]).isNotNull()
            state = F.aggregate(F.filter(F.array(*items), lambda x: x["raw"].isNotNull()), empty_state(), step)
        states.append(F.when(there, F.struct(F.lit(key).alias("field"), state.alias("state"))).alias(f"t_{key}"))
    kept = [c for c in cleaned.columns if c == "row_idx" or c[0] == "s" and c[1:].isdigit()]
    cleaned = cleaned.select(*kept, *states)
    fields = [c for c in cleaned.columns if c.startswith("t_")]
    have = F.filter(F.array(*fields), lambda x: x.isNotNull()) if fields else F.expr(f"cast(array() as array<struct<field:string,state:{STATE}>>)")
    singles = [F.when(F.col(f"s{i}").isNotNull() & (F.col(f"s{i}.last") == ""), F.array(F.lit("lastName:missing_from_split"))).otherwise(none) for i in names]
    extra_n = sum((F.when(F.col(f"s{i}").isNotNull(), 1).otherwise(0) for i in names), F.lit(0)).cast("int")
    row_id = F.concat(F.lit(f"{source.file_name}:"), F.col("row_idx").cast("string"))
    of = lambda key: F.col(f"t_{key}.state.value") if f"t_{key}" in fields else F.lit(None).cast("string")
    number, mail = of("employeeNumber"), of("email")
    key = (
        F.when(number != "", F.concat(F.lit("emp:"), canonical_id(number, config.id_prefix)))
        .when(mail != "", F.concat(F.lit("email:"), F.lower(mail)))
        .otherwise(F.concat(F.lit(f"row:{source.file_ord}:"), F.col("row_idx").cast("string")))
    )
    return cleaned.select(F.lit(source.file_ord).alias("file_ord"), "row_idx", row_id.alias("row_id"), have.alias("states"), (F.concat(*singles) if singles else none).alias("extra_flags"), extra_n.alias("extra_n"), key.alias("key"))


def merge_sources(sources: list[Source], config: Config | None = None, most: int | None = MOST_ROWS, listed: int = LISTED) -> DataFrame:
    """One row a record: key, seq (file and row first seen), row_ids, cells, flags, n_transforms, employee_number.

    The shuffle is on the key; a group holds one person's rows. Keys of more than `most` rows are counted beforehand, from
    the columns that make keys alone, and folded without being brought together (see hot.py); None: there are none.
    """
    config = config or Config()
    rows = None
    for s in sources:
        part = fold_rows(s, config)
        rows = part if rows is None else rows.unionByName(part)
    return fold(rows, config, most, listed)


def fold(rows: DataFrame, config: Config, most: int | None = MOST_ROWS, listed: int = LISTED) -> DataFrame:
    """Records of fold_rows' rows."""
    if most is None:
        return _recorded(fold_plain(rows, config), config)
    many = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key"), "many")
    if many.isEmpty():
        return _recorded(fold_plain(rows, config), config)
    side = small(many)
    plain = fold_plain(rows.join(side, "key", "left_anti"), config)
    return _recorded(plain.unionByName(fold_hot(rows.join(side, "key", "left_semi"), config, listed)), config)


def fold_plain(rows: DataFrame, config: Config) -> DataFrame:
    """fold_rows' rows to key, seq, row_ids, states (a map by field), row_flags, row_n, each key's rows in one group."""
    met = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("file_ord", "row_idx", "row_id", "states", "extra_flags", "extra_n"))).alias("rows"))
    first = F.get("rows", F.lit(0))
    later = F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))

    def contribution(s: Column) -> Column:
        state = s["state"]
        return F.struct(s["field"].alias("field"), F.coalesce(state["raw"], state["value"], F.lit("")).alias("raw"), state["clean"].alias("clean"), F.get(state["lineage"], F.lit(0)).alias("lineage"))

    comes = F.filter(F.flatten(F.transform(later, lambda r: r["states"])), lambda s: s["state"]["raw"].isNotNull() | s["state"]["value"].isNotNull())
    of_rows = F.flatten(F.transform("rows", lambda r: F.concat(F.flatten(F.transform(r["states"], lambda s: s["state"]["flags"])), r["extra_flags"])))
    n_rows = F.aggregate(F.flatten(F.transform("rows", lambda r: r["states"])), F.lit(0), lambda a, s: a + s["state"]["n"]) + F.aggregate("rows", F.lit(0), lambda a, r: a + r["extra_n"])
    out = met.select(
        "key",
        F.struct(first["file_ord"].alias("file_ord"), first["row_idx"].alias("row_idx")).alias("seq"),
        F.transform("rows", lambda r: r["row_id"]).alias("row_ids"),
        first["states"].alias("kept"),
        F.transform(comes, contribution).alias("comes"),
        of_rows.alias("row_flags"),
        n_rows.alias("row_n"),
    )
    step = absorb(config)

    def final(f: Column) -> Column:
        had = F.get(F.filter("kept", lambda s: s["field"] == f), F.lit(0))["state"]
        start = F.coalesce(had.withField("n", F.lit(0)), empty_state())  # the row's own count is in row_n
        return F.struct(f.alias("key"), F.aggregate(F.filter("comes", lambda x: x["field"] == f), start, step).alias("value"))

    every = F.array(*[F.lit(f.key) for f in config.fields])
    return out.select("key", "seq", "row_ids", F.map_from_entries(F.transform(every, final)).alias("states"), "row_flags", F.col("row_n").cast("long").alias("row_n"))


def _recorded(out: DataFrame, config: Config) -> DataFrame:
    n = F.col("row_n") + F.aggregate(F.map_values("states"), F.lit(0), lambda a, s: a + s["n"])
    flags = F.array_distinct(F.concat(F.flatten(F.transform(F.map_values("states"), lambda s: s["flags"])), F.col("row_flags")))
    cell = lambda f: F.coalesce(F.try_element_at("states", F.lit(f.key)), empty_state()).dropFields("clean").alias(f.key)
    out = out.select("key", "seq", "row_ids", F.struct(*[cell(f) for f in config.fields]).alias("cells"), flags.alias("flags"), n.alias("n_transforms"))
    return default_currency(out, config)


def default_currency(records: DataFrame, config: Config) -> DataFrame:
    """A pay without a currency gets the default one, at lower confidence; it counts as a transform."""
    number = F.col("cells.employeeNumber.value") if "employeeNumber" in config.by_key else F.lit(None).cast("string")
    if "currency" in config.by_key and "ctcAnnual" in config.by_key:
        silent = F.col("cells.ctcAnnual.value").isNotNull() & F.coalesce(F.col("cells.currency.value") == "", F.lit(True))
        given = F.expr("array()")
        made = _state(F.lit(None), F.lit(config.default_currency), F.lit(0.7), given, F.lit("defaulted because pay is present"), given, given, F.lit(0))
        records = records.withColumn("n_transforms", F.col("n_transforms") + F.when(silent, 1).otherwise(0)).withColumn("cells", F.col("cells").withField("currency", F.when(silent, made).otherwise(F.col("cells.currency"))))
    letters = F.substring(F.regexp_replace("key", "[^A-Za-z0-9]", ""), 1, 12)
    return records.withColumn("employee_number", number).withColumn("record_id", F.concat(F.lit("rec_"), letters, F.lit("_"), F.substring(F.sha2("key", 256), 1, 12)))


def long_records(records: DataFrame, config: Config | None = None) -> DataFrame:
    """record_id, field, ord, raw, value, confidence, transform, conflicts, lineage: one row a record and field."""
    config = config or Config()
    each = F.array(*[F.struct(F.lit(f.key).alias("field"), F.lit(i).alias("ord"), F.col(f"cells.{f.key}").alias("s")) for i, f in enumerate(config.fields)])
    return records.select("record_id", F.explode(each).alias("x")).select("record_id", "x.field", "x.ord", "x.s.raw", "x.s.value", "x.s.confidence", "x.s.transform", "x.s.conflicts", "x.s.lineage")


def wide_records(records: DataFrame, config: Config | None = None) -> DataFrame:
    """The target's payload: one column a field; numbers as doubles."""
    config = config or Config()
    return records.select("record_id", "employee_number", *[(F.col(f"cells.{f.key}.value").try_cast("double") if f.type == "number" else F.col(f"cells.{f.key}.value")).alias(f.key) for f in config.fields])
