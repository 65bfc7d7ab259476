"""Queries of the reconciliation engine on the star-schema tables, and the SQL they are held against.

Each applies the engine's own operators or Column functions to whole tables; the other module states the same in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.config import KIND_LABELS, Config, Field
from tributary.functions import clean, dates, text
from tributary.functions.cut import cut, shared_folder
from tributary.operators import decisions, duplicates, escalations, mapping, merge, profile, sink, store, trail
from tributary.plans.oracle import ORACLES
from tributary.sources import delimited, files, workbook
from tributary.sources.target import Target
from tributary.streaming.drop import Load

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types as headers."""
    odd = F.concat(F.lit("  "), F.replace(F.col("p_type"), F.lit(" "), F.lit("_/")), F.lit("&R.D "))
    return _read(spark, sf_dir, "part").select("p_partkey", text.normalize_header(odd).alias("normal"))


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared tokens of a part's name and type."""
    p = _read(spark, sf_dir, "part")
    a, b = F.array_distinct(text.tokens(F.col("p_name"))), F.array_distinct(text.tokens(F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand"))))
    return p.select("p_partkey", F.size(a).cast("long").alias("n_tokens"), F.size(F.array_intersect(a, b)).cast("long").alias("n_shared"))


def header_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three regions most like each nation in name; regions are five rows."""
    n, r = _read(spark, sf_dir, "nation"), F.broadcast(_read(spark, sf_dir, "region"))
    met = n.join(r, F.lit(True)).withColumn("score", F.round(text.similarity(F.col("n_name"), F.col("r_name")), 9))
    by = Window.partitionBy("n_nationkey").orderBy(F.col("score").desc(), "r_regionkey")
    ranked = met.withColumn("rank", F.row_number().over(by)).withColumn("lead", F.round(F.col("score") - F.coalesce(F.lead("score").over(by), F.lit(0.0)), 9))
    return ranked.filter("rank <= 3").select("n_nationkey", "r_regionkey", "score", F.col("rank").cast("long").alias("rank"), "lead")


def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shouted part names with a particle and initials."""
    p = _read(spark, sf_dir, "part")
    return p.select("p_partkey", text.title_case(F.concat(F.lit(" j.r.  VAN "), F.upper("p_name"), F.lit(" "))).alias("titled"))


def _names() -> Column:
    n = F.col("c_custkey")
    tail = F.element_at(F.split("c_name", "[#]"), -1)
    return F.when(n % 4 == 0, F.concat(F.lit("NAIR"), tail, F.lit(", arun"))).when(n % 4 == 1, F.concat(F.lit("Dr. maria del "), F.col("c_mktsegment"))).when(n % 4 == 2, F.lit("  pooja ")).otherwise(F.concat(F.lit("Mrs  Ana  "), F.lower("c_mktsegment"), F.lit(" SATO")))


def name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in four styles."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", text.split_person_name(_names()).alias("s"))
    return c.select("c_custkey", F.col("s.first").alias("first_name"), F.col("s.last").alias("last_name"))


def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that count as nothing, by event type."""
    k = F.col("event_id") % 8
    v = F.when(k == 0, " - ").when(k == 1, "N/A").when(k == 2, "na").when(k == 3, "NULL").when(k == 4, "Null").when(k == 5, "").otherwise(F.col("event_type"))
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(text.is_blank(v)).alias("n_blank"), F.count(F.lit(1)).alias("n"))


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances with marks, currency words and non-numbers around them."""
    k = F.col("c_custkey") % 5
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    v = F.when(k == 0, F.concat(F.lit("₹ "), cents.cast("string"))).when(k == 1, F.concat(F.lit("INR "), cents.cast("string"))).when(k == 2, F.concat(cents.cast("string"), F.lit(".5"))).when(k == 3, F.concat(F.lit("$1,"), F.lpad((F.abs(cents) % 1000).cast("string"), 3, "0"))).otherwise(F.concat(cents.cast("string"), F.lit("d")))
    return _read(spark, sf_dir, "customer").select("c_custkey", text.parse_number(v).alias("number"))


def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices grouped the Indian way."""
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.money(F.floor("o_totalprice").cast("long")).alias("shown"))


def _mails() -> Column:
    k = F.col("c_custkey") % 4
    who = F.concat(F.lit(" User"), F.col("c_custkey").cast("string"))
    return F.when(k == 0, F.concat(who, F.lit("@GMAIL.com "))).when(k == 1, F.concat(who, F.lit("@corp.example"))).when(k == 2, who).otherwise(F.concat(who, F.lit("@Yahoo.com")))


def email_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9, D10, E6d: addresses with their issue."""
    got = clean.clean_value("email", _mails())
    c = _read(spark, sf_dir, "customer").select("c_custkey", got.alias("x"), text.email_domain(_mails()).alias("domain"))
    return c.select("c_custkey", F.col("x.value").alias("value"), F.col("x.confidence").alias("confidence"), F.coalesce("x.issue", F.lit("")).alias("issue"), "domain")


def phone_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of several lengths."""
    k, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    v = F.when(k == 0, F.concat(F.lit("+91 98"), F.lpad(key, 8, "0"))).when(k == 1, F.concat(F.lit("98-"), F.lpad(key, 8, "0"))).when(k == 2, F.concat(F.lit("098"), F.lpad(key, 8, "0"))).when(k == 3, F.concat(F.lit("(1)44 98"), F.lpad(key, 8, "0"))).otherwise(key)
    return _read(spark, sf_dir, "customer").select("c_custkey", clean.clean_phone(v).alias("phone"), text.looks_phone(v).alias("looks_phone"))


def employee_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixed ids."""
    k, key = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    v = F.when(k == 0, F.concat(F.lit("apx-"), key)).when(k == 1, F.concat(F.lit(" APX_"), key, F.lit("b"))).when(k == 2, F.concat(key, F.lit(".0"))).otherwise(F.concat(F.lit("APX"), key))
    return _read(spark, sf_dir, "customer").select("c_custkey", clean.canonical_id(v).alias("id"))


def date_parse_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in six ways, one of them two-fold."""
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    v = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 1, F.date_format(d, "dd/MM/yyyy"))
        .when(k == 2, F.date_format(d, "MM-dd-yy"))
        .when(k == 3, F.date_format(d, "d-MMM-yyyy"))
        .when(k == 4, F.date_format(d, "MMM d, yyyy"))
        .otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("-02-30")))
    )
    o = _read(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(v).alias("p"))
    return o.select("o_orderkey", F.col("p.status").alias("status"), F.coalesce("p.iso", F.lit("")).alias("iso"), F.coalesce("p.dmy", F.lit("")).alias("dmy"), F.coalesce("p.mdy", F.lit("")).alias("mdy"))


EVENTS = Config(
    fields=(Field("event", "Event", "enum", values=("click", "view", "buy")),),
    enum_synonyms={"event": {"purchase": "buy", "search": "view"}},
)


def enum_map_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6g, I3: event types against a closed list."""
    e = _read(spark, sf_dir, "events").select(clean.clean_value("event", F.concat(F.upper("event_type"), F.lit(" ")), EVENTS).alias("x"))
    return e.groupBy(F.col("x.value").alias("value"), F.coalesce("x.issue", F.lit("")).alias("issue")).agg(F.count(F.lit(1)).alias("n"), F.max("x.confidence").alias("confidence"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").withColumn("row_idx", F.col("c_custkey"))
    cells = profile.long_cells(c, 0, "customer", columns=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    s = _read(spark, sf_dir, "supplier").withColumn("row_idx", F.col("s_suppkey"))
    return profile.profile_columns(cells.unionByName(profile.long_cells(s, 1, "supplier", columns=["s_suppkey", "s_name", "s_nationkey"])))


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles and inferred types of seven columns."""
    p = _profile(spark, sf_dir)
    return p.select("file_name", "header", "rows", "present", F.round("null_rate", 9).alias("null_rate"), "unique_count", F.array_join("samples", "|").alias("samples"), "inferred")


def map_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of the profiled columns. Beyond plain SQL; tests hold it against a plain implementation."""
    m = mapping.propose(_profile(spark, sf_dir))
    return m.select("file_name", "header", F.coalesce("target", F.lit("")).alias("target"), F.round("confidence", 9).alias("confidence"), F.round("margin", 9).alias("margin"), "status", "reason", F.array_join(F.transform("candidates", lambda c: c["field"]), ",").alias("candidates"))


def vocabulary_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3, C4, C8 of a large vocabulary: part types as fields, written as their parts' names; parts as columns, whose headers are
    their names with a letter more, a word less, or another word for one. Nothing meets every field that needn't."""
    p = _read(spark, sf_dir, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    header = F.when(key % 4 == 0, F.concat(name, F.lit("_X"))).when(key % 4 == 1, F.regexp_replace(name, "^[^ ]+ ", "")).when(key % 4 == 2, F.concat(name, F.lit(" "), "p_brand")).otherwise(F.regexp_replace(name, "e", "a"))
    sample = F.when(key % 3 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    columns = p.select(F.lit(0).alias("file_ord"), F.lit("parts").alias("file_name"), key.cast("int").alias("col_ord"), header.alias("header"), F.array(sample, F.col("p_brand")).alias("samples"))
    fields = p.groupBy(F.col("p_type").alias("field")).agg(F.min("p_partkey").cast("int").alias("ord")).withColumn("type", F.when(F.col("ord") % 3 == 0, "number").otherwise("string"))
    ways = p.select(F.col("p_type").alias("field"), name.alias("synonym")).distinct()
    best = mapping.nearest_fields(columns, fields, ways)
    return best.groupBy("col_ord").agg(F.max(F.round("score", 9)).alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ord", "field"))), lambda x: x["field"]), ",").alias("fields"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as columns of fifty files, which claim their segments as fields by made-up scores and leads."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    score, margin = (k * 37 % 100) / 100, (k * 11 % 40) / 100
    status, target, reason = mapping.decide(score, margin, F.col("c_mktsegment"), Config())
    kind = "array<struct<field:string,score:double>>"
    candidates = F.array(F.struct(F.col("c_mktsegment").alias("field"), score.alias("score")), F.struct(F.lit("other").alias("field"), (score / 2).alias("score"))).cast(kind)
    m = c.select(F.lit(0).alias("file_ord"), F.concat(F.lit("f"), (k % 50).cast("string")).alias("file_name"), k.cast("int").alias("col_ord"), F.col("c_name").alias("header"), target.alias("target"), score.alias("confidence"), margin.alias("margin"), status.alias("status"), reason.alias("reason"), candidates.alias("candidates"))
    return mapping.compete(m)


def map_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by score and lead, and columns that claim one field."""
    return _mapped(spark, sf_dir).select("col_ord", F.coalesce("target", F.lit("")).alias("target"), "status", "reason")


def mapping_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a reviewer sees."""
    return mapping.board(_mapped(spark, sf_dir)).select("col_ord", "status")


def uncertain_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first columns that a helper is asked about; the limit is the feature."""
    return mapping.uncertain(_mapped(spark, sf_dir)).select("col_ord", "status", "confidence")


def mapping_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A helper's answers for every fifth column, half of them for a field that isn't there."""
    k = F.col("c_custkey")
    up = _read(spark, sf_dir, "customer").filter(k % 5 == 0).select(F.lit(0).alias("file_ord"), k.cast("int").alias("col_ord"), F.when(k % 10 == 0, "phone").otherwise("nonsense").alias("target"), ((k * 13 % 100) / 100).alias("confidence"))
    m = mapping.apply_updates(_mapped(spark, sf_dir), up)
    return m.select("col_ord", F.coalesce("target", F.lit("")).alias("target"), "confidence", "status", "reason")


def mapping_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: what escalated columns ask."""
    e = escalations.of_mappings(_mapped(spark, sf_dir))
    return e.select("kind", "mapping_id", "title", "confidence", F.size("options").cast("long").alias("n_options"), F.get("options", F.lit(0))["label"].alias("first"), F.get("evidence", F.lit(1)).alias("second"))


def first_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of orders that ask the same of the same customer, the first by day."""
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    e = o.select(k.alias("escalation_id"), F.col("o_orderstatus").alias("kind"), F.when(k % 13 != 0, F.col("o_custkey").cast("string")).alias("record_id"), F.when(k % 7 == 0, F.lit("m")).alias("mapping_id"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").alias("field"), F.concat(F.lit("t"), (k % 2).cast("string")).alias("title"), F.struct("o_orderdate", k).alias("ord"))
    return escalations.first_of_each(e).select("escalation_id")


MERGE = Config(
    fields=(Field("employeeNumber", "Id", required=True), Field("name", "Name"), Field("ctcAnnual", "Amount", "number"), Field("currency", "Currency", "enum", values=("INR", "USD")), Field("workLocation", "Segment")),
    id_prefix="apx",
)


def _sources(spark: SparkSession, sf_dir: str) -> list[merge.Source]:
    c = _read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    a = c.select(F.concat(F.lit("APX-"), key.cast("string")).alias("id"), F.floor("c_acctbal").cast("long").cast("string").alias("amount"), F.lower("c_mktsegment").alias("place"), key.alias("row_idx"))
    b = c.filter(key % 2 == 0).select(key.cast("string").alias("no"), (F.floor("c_acctbal") + F.when(key % 6 == 0, 1).otherwise(0)).cast("long").cast("string").alias("pay"), F.when(key % 4 == 0, F.concat("c_mktsegment", F.lit(" plant"))).otherwise("other").alias("site"), key.alias("row_idx"))
    return [
        merge.Source(a, 0, "a", (("id", "employeeNumber"), ("amount", "ctcAnnual"), ("place", "workLocation"))),
        merge.Source(b, 1, "b", (("no", "employeeNumber"), ("pay", "ctcAnnual"), ("site", "workLocation"))),
    ]


def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extracts of one people, with conflicts, containment and defaults."""
    return _merged(merge.merge_sources(_sources(spark, sf_dir), MERGE))


def _merged(r: DataFrame) -> DataFrame:
    v = lambda f: F.coalesce(F.col(f"cells.{f}.value"), F.lit("")).alias(f)
    return r.select(v("employeeNumber"), v("ctcAnnual"), v("workLocation"), v("currency"), F.array_join(F.array_sort("flags"), ",").alias("flags"), F.array_join("cells.ctcAnnual.conflicts", ",").alias("alternatives"), F.size("row_ids").cast("long").alias("n_rows"), F.col("n_transforms").cast("long").alias("n_transforms"))


STAFF = Config(
    fields=(Field("employeeNumber", "Id", required=True), Field("firstName", "First"), Field("lastName", "Last"), Field("department", "Department"), Field("status", "Status", "enum", values=("active", "inactive"))),
    enum_synonyms={"status": {"a": "active"}},
)


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3, F2', G8, I11: the target's payload of merged records with whole names, two columns for one field, and a value
    that a second file gives with more confidence."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    a = c.select(k.cast("string").alias("id"), F.when(k % 3 == 0, "ANN  lee").otherwise("cher").alias("who"), F.when(k % 4 == 0, "sales").alias("team"), F.when(k % 2 == 0, "sales north").alias("unit"), F.lit("A").alias("st"), k.alias("row_idx"))
    b = c.filter(k % 2 == 0).select(k.cast("string").alias("no"), F.lit("ACTIVE").alias("state"), k.alias("row_idx"))
    r = cut(merge.merge_sources([merge.Source(a, 0, "a", (("id", "employeeNumber"), ("who", "fullName"), ("team", "department"), ("unit", "department"), ("st", "status"))), merge.Source(b, 1, "b", (("no", "employeeNumber"), ("state", "status")))], STAFF), "records")
    told = r.select("record_id", F.col("cells.status.confidence").alias("sure"), F.coalesce("cells.department.transform", F.lit("")).alias("how"), F.array_join("flags", ",").alias("flags"))
    wide = merge.wide_records(r, STAFF).join(told, "record_id")
    return wide.select(*[F.coalesce(f.key, F.lit("")).alias(f.key) for f in STAFF.fields], "sure", "how", "flags")


def incremental_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2 by loads: the two extracts one after the other, each making again only the records that it touches."""
    load = Load(spark, f"{shared_folder(spark)}/tributary-load-{uuid.uuid4().hex}", MERGE)
    for source in _sources(spark, sf_dir):
        load.add(source)
    return _merged(load.records())


def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1, C2 by loads: customers' profiles from two loads' kept sketches, and whether distinct counts are within 2 %."""
    c = _read(spark, sf_dir, "customer").withColumn("row_idx", F.col("c_custkey"))
    loads = [profile.long_cells(c.filter(F.col("c_custkey") % 3 == 0) if k else c.filter(F.col("c_custkey") % 3 != 0), k, "customer", columns=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]) for k in (0, 1)]
    kept = cut(profile.sketch_columns(loads[0]).unionByName(profile.sketch_columns(loads[1])), "sketches")
    p = profile.profiles_of(profile.merged_sketches(kept))
    exact = profile.profile_columns(loads[0].unionByName(loads[1]).withColumn("file_ord", F.lit(0))).select("header", F.col("unique_count").alias("exact"))
    close = F.abs(F.col("unique_count") - F.col("exact")) <= 0.02 * F.col("exact")
    return p.join(exact, "header").select("header", "rows", "present", F.round("null_rate", 9).alias("null_rate"), F.array_join("samples", "|").alias("samples"), "inferred", close.alias("close"))


def delimited_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: customers written as delimited files, with quotes, commas and line breaks in cells, and read by the exact rules."""
    folder = f"{shared_folder(spark)}/tributary-csv-{uuid.uuid4().hex}"
    note = F.concat(F.lit('say "'), F.col("c_mktsegment"), F.lit('",\n'), F.col("c_custkey").cast("string"), F.lit(","))
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" id "), note.alias("note"))
    c.repartition(2, F.col("` id `")).write.options(header=True, quote='"', escape='"', ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False).csv(folder)
    out = None
    for path, _ in files.listed(folder):
        part = delimited.read_csv_exact(spark, path, chunk=1 << 16).select(F.col("id").cast("long").alias("c_custkey"), "note")
        out = part if out is None else out.unionByName(part)
    return out


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as workbooks of up to 500 rows by executors, and read as a data source."""
    folder = f"{shared_folder(spark)}/tributary-books-{uuid.uuid4().hex}"

    def book(rows: pd.DataFrame) -> pd.DataFrame:
        system, own = files.resolved(folder)
        system.create_dir(own, recursive=True)
        name = f"{own}/{rows['book'].iloc[0]}.xlsx"
        half = f"{own}/.{uuid.uuid4().hex}"
        with system.open_output_stream(half) as f:
            f.write(workbook.workbook_bytes(["id", "name", "segment"], rows[["c_custkey", "c_name", "c_mktsegment"]].astype(str).values.tolist()))
        system.move(half, name)  # a task that is tried again writes the same book
        return pd.DataFrame({"book": rows["book"].iloc[:1], "n": [len(rows)]})

    c = _read(spark, sf_dir, "customer").withColumn("book", F.floor(F.col("c_custkey") / 500).cast("long"))
    cut(c.groupBy("book").applyInPandas(book, "book long, n long"), "books")
    return workbook.read_workbooks(spark, f"{folder}/*.xlsx").select(F.col("id").cast("long").alias("c_custkey"), "name", "segment")


def target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: what a target holds after two attempts of a batch, one of them written twice, and a batch that was taken back."""
    where = Target(spark, f"{shared_folder(spark)}/tributary-target-{uuid.uuid4().hex}")
    k = F.col("c_custkey")
    c = _read(spark, sf_dir, "customer").select(k.cast("string").alias("employee_number"), F.lit("b").alias("batch_id"), F.col("c_mktsegment").alias("segment"), k)
    where.write(c.filter(k % 2 == 0).drop("c_custkey"), "b", 1)
    where.write(c.filter(k % 2 == 0).drop("c_custkey"), "b", 1)
    where.write(c.filter(k % 4 == 0).drop("c_custkey").withColumn("segment", F.lower("segment")), "b", 2)
    where.write(c.filter(k % 2 == 1).drop("c_custkey").withColumn("batch_id", F.lit("gone")), "gone", 1)
    where.rollback("gone")
    return where.read(c.drop("c_custkey").schema)


def conflict_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of the merged records by kind and field."""
    e = escalations.conflicts(cut(merge.merge_sources(_sources(spark, sf_dir), MERGE), "records"), MERGE)
    return e.groupBy(text.labelled(F.col("kind"), KIND_LABELS).alias("label"), "field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("options")).alias("n_options"), F.max("confidence").alias("confidence"))


def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each repeated line key, in a total order."""
    line = _read(spark, sf_dir, "lineitem")
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    first = store.latest(line, ["l_orderkey", "l_linenumber"], order)
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts alike in name that share a number; two equi-joins, no product."""
    p = _read(spark, sf_dir, "part")
    people = p.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), F.element_at(F.split("p_name", " "), 1).alias("first"), F.element_at(F.split("p_name", " "), -1).alias("last"), F.concat("p_brand", F.lit("-"), "p_size", F.lit("-"), "p_type").alias("phone"), F.concat(F.lit("d"), F.round("p_retailprice", 2).cast("string")).alias("dob"), F.col("p_brand").alias("number"))
    return duplicates.fuzzy_pairs(people)


def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without what they need, but for those of open pairs."""
    fields = (Field("employeeNumber", "Id", required=True), Field("email", "Mail", "email", required=True), Field("status", "Segment", required=True))
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    cell = lambda v: F.struct(v.alias("value"))
    none = F.lit(None).cast("string")
    r = c.select(k.cast("string").alias("record_id"), k.cast("string").alias("employee_number"), F.struct(cell(k.cast("string")).alias("employeeNumber"), cell(F.when(k % 7 != 0, F.lit("x@y.z"))).alias("email"), cell(F.when(k % 5 == 0, F.lit("")).when(k % 11 == 0, none).otherwise(F.col("c_mktsegment"))).alias("status")).alias("cells"), (k % 13 == 0).alias("excluded"))
    skip = c.filter(k % 3 == 0).select(k.cast("string").alias("record_id"))
    e = escalations.validate(r, skip, Config(fields=fields))
    return e.select("record_id", "field", F.get("evidence", F.lit(0)).alias("evidence"), "confidence")


def date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ship before their order, by priority, as people who joined before their birth."""
    o, line = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    met = line.join(o, line.l_orderkey == o.o_orderkey)
    cell = lambda c: F.struct(F.date_format(c, "yyyy-MM-dd").alias("value"))
    r = met.select(F.col("o_orderpriority").alias("record_id"), F.lit("x").alias("employee_number"), F.struct(cell("o_orderdate").alias("dateOfBirth"), cell("l_shipdate").alias("dateOfJoining")).alias("cells"))
    late = escalations.validate(r, None, Config(fields=(Field("dateOfBirth", "Born", "date"), Field("dateOfJoining", "Joined", "date"))))
    return late.groupBy(F.col("record_id").alias("o_orderpriority")).agg(F.count(F.lit(1)).alias("n"))


def required_without_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields that the profiled columns don't feed."""
    m = mapping.propose(_profile(spark, sf_dir))
    return escalations.required_without_source(m).select("kind", "field", "confidence", F.size("options").cast("long").alias("n_options"))


def skip_set_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a mail address, but for those of open pairs: the two ends of each finished order."""
    c, o = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    skip = escalations.skip_set(o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("keep_id"), (F.col("o_custkey") + 1).cast("string").alias("drop_id")))
    r = c.select(F.col("c_custkey").cast("string").alias("record_id"), F.col("c_custkey").cast("string").alias("employee_number"), F.struct(F.struct(F.lit("").alias("value")).alias("email")).alias("cells"))
    found = escalations.validate(r, skip, Config(fields=(Field("email", "Mail", "email", required=True),)))
    return found.select(F.col("record_id").cast("long").alias("c_custkey"), F.get("evidence", F.lit(0)).alias("evidence"))


def escalation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open ones by kind, with labels."""
    kinds = list(KIND_LABELS)
    e = _read(spark, sf_dir, "orders").select(F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("o_orderkey") % len(kinds)).cast("int")).alias("kind"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"))
    return escalations.summary(e)


def _pushed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    number = F.when(k % 9 == 0, k - 1).otherwise(k).cast("string")
    r = c.select(F.lpad(k.cast("string"), 12, "0").alias("record_id"), number.alias("employee_number"), F.when(k % 10 == 3, "failed").alias("push_status"), (k % 17 == 0).alias("excluded"), F.when(k % 7 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("segment"))
    target = c.filter(k % 10 == 5).select(k.cast("string").alias("employee_number"))
    calls = c.filter(k % 10 == 3).select(F.lpad(k.cast("string"), 12, "0").alias("record_id"), number.alias("employee_number"), F.lit(422).alias("status"))
    return r, target, calls


def push_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A push of all customers to a target that holds some."""
    r, target, calls = _pushed(spark, sf_dir)
    out = sink.push(r, ["segment"], target, calls)
    return out.select("record_id", "employee_number", F.col("attempt").cast("long").alias("attempt"), "status", "ok")


def push_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending records' push by status."""
    r, target, calls = _pushed(spark, sf_dir)
    return sink.outcome(sink.push(sink.pending(r, True), ["segment"], target, calls))


def rollback_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: what the job's target holds and how its records stand after its batch is taken back."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    r = c.select(k.cast("string").alias("record_id"), k.cast("string").alias("employee_number"), F.when(k % 3 == 0, "success").otherwise("failed").alias("push_status"))
    _, left, after = sink.rollback(r, c.filter(k % 3 == 0).select(k.cast("string").alias("employee_number"), "c_mktsegment"))
    held = left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("in the target").alias("what"), "n")
    return held.unionByName(after.groupBy(F.col("push_status").alias("what")).agg(F.count(F.lit(1)).alias("n")))


def rollback_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the calls that take a batch back, as the log has them."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    number = F.when(k % 6 != 0, F.concat(F.lit("a b/"), k.cast("string")))
    r = c.select(F.lpad(k.cast("string"), 12, "0").alias("record_id"), number.alias("employee_number"), F.when(k % 3 == 0, "success").otherwise("failed").alias("push_status"))
    calls, _, _ = sink.rollback(r, c.select("c_mktsegment"))
    log = sink.told(calls, c.select(F.lpad(k.cast("string"), 12, "0").alias("record_id"), number.alias("employee_number"), F.col("c_mktsegment").alias("segment")), ["segment"], "batch_7")
    return log.select("record_id", "method", "path", "status", "ok", "body")


def push_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2: a push's calls with what they say, and the audit rows they leave."""
    r, target, calls = _pushed(spark, sf_dir)
    log = sink.told(sink.push(r, ["segment"], target, calls), r.select("record_id", "employee_number", "segment"), ["segment"], "batch_7")
    audit = trail.of_calls(cut(log, "log"), 5)
    return audit.groupBy("action", "why", F.coalesce("after", F.lit("")).alias("after")).agg(F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"))


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as escalations of their customers, and decisions on every second one."""
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    rid = F.col("o_custkey").cast("string")
    act = F.when(k % 7 == 0, escalations.command("exclude_record", record_id=rid)).when(k % 11 == 0, escalations.command("merge_records", keep_id=F.concat(F.lit("x"), rid), drop_id=rid)).otherwise(escalations.command("set_field", record_id=rid, field=F.lit("f"), value=F.lit("v")))
    accept = escalations.command("accept_value", record_id=rid, field=F.lit("f"))
    e = o.select(F.lpad(k.cast("string"), 12, "0").alias("escalation_id"), F.when(k % 13 != 0, rid).alias("record_id"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "b").alias("field"), F.lit("conflict_cross_file").alias("kind"), F.when(k % 5 == 0, "resolved").otherwise("open").alias("status"), escalations.options(escalations.option("act", "Act", act), escalations.option("accept", "Accept", accept)).alias("options"))
    d = o.filter(k % 2 == 0).select(F.lpad(k.cast("string"), 12, "0").alias("escalation_id"), F.when(k % 4 == 0, "accept").alias("choice"), (k % 10 == 4).alias("reject"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("at"))
    return e, d


def resolve_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which decisions count, folded in their order."""
    done = decisions.resolve(*_decided(spark, sf_dir))
    return done.select("escalation_id", "status", F.col("command.type").alias("command"), "at", "whole")


def close_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is open, decided or closed along with others after all decisions, each by its id."""
    e, d = _decided(spark, sf_dir)
    return decisions.close(e, decisions.resolve(e, d)).select("escalation_id", "status")


PEOPLE = Config(fields=(Field("employeeNumber", "Id", required=True), Field("firstName", "First"), Field("email", "Mail", "email")))


def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every four customers the third merges into the second and then the second into the first, the fourth
    is corrected, and corrections fall before, between and after merges."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    state = lambda v: F.struct(v.cast("string").alias("raw"), v.cast("string").alias("value"), F.lit(0.5).alias("confidence"), F.expr(f"cast(array() as array<{merge.LINEAGE}>)").alias("lineage"), F.lit(None).cast("string").alias("transform"), F.expr("cast(array() as array<string>)").alias("conflicts"), F.expr("cast(array() as array<string>)").alias("flags"), F.lit(0).alias("n"))
    first = F.when(k % 4 == 2, F.col("c_mktsegment"))
    mail = F.when(k % 4 == 1, F.col("c_name")).when(k % 4 == 2, F.lit("two"))
    r = c.select(k.cast("string").alias("record_id"), k.cast("string").alias("employee_number"), F.array(F.concat(F.lit("r"), k.cast("string"))).alias("row_ids"), F.struct(state(k).alias("employeeNumber"), state(first).alias("firstName"), state(mail).alias("email")).alias("cells"), F.array(F.lit("email:conflict"), F.lit("firstName:duplicate")).alias("flags"), F.lit(0).alias("n_transforms"))
    key = lambda d: (k + d).cast("string")
    none = F.lit(None).cast("string")
    row = lambda when, at, command, name: c.filter(when).select(F.concat(F.lit(name), k.cast("string")).alias("escalation_id"), none.alias("record_id"), none.alias("field"), F.lit("k").alias("kind"), F.lit("resolved").alias("status"), command.alias("command"), F.lit(at).cast("long").alias("at"), F.lit(False).alias("whole"))
    cmd = escalations.command
    done = (
        row(k % 4 == 1, 2, cmd("merge_records", keep_id=key(0), drop_id=key(1)), "m")
        .unionByName(row(k % 4 == 1, 4, cmd("merge_records", keep_id=key(-1), drop_id=key(0)), "n"))
        .unionByName(row(k % 8 == 2, 1, cmd("set_field", record_id=key(0), field=F.lit("firstName"), value=F.lit("early")), "a"))
        .unionByName(row(k % 16 == 1, 3, cmd("set_field", record_id=key(0), field=F.lit("email"), value=none), "b"))
        .unionByName(row(k % 4 == 0, 5, cmd("accept_value", record_id=key(0), field=F.lit("email")), "c"))
        .unionByName(row(k % 4 == 3, 1, cmd("exclude_record", record_id=key(0)), "d"))
    )
    out = decisions.apply(r, done, PEOPLE)
    return out.select(F.col("record_id").cast("long").alias("c_custkey"), *[F.coalesce(f"cells.{f}.value", F.lit("")).alias(f) for f in ("firstName", "email")], F.array_join(F.array_sort("row_ids"), ",").alias("row_ids"), "excluded", F.array_join("flags", ",").alias("flags"))


def dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a kind of field, cleaned by the dispatcher, with what blanks and unknown fields give."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    key = k.cast("string")
    values = {"employeeNumber": F.concat(F.lit("APX-"), key), "firstName": F.lower("c_mktsegment"), "phone": F.concat(F.lit("98"), F.lpad(key, 8, "0")), "dateOfBirth": F.concat(F.lit("2001-01-"), F.lpad((k % 40).cast("string"), 2, "0")), "managerEmployeeNumber": F.concat(F.lit("apx"), key), "workLocation": F.lower("c_mktsegment"), "panNumber": F.concat(F.lit("abcde"), F.lpad((k % 10000).cast("string"), 4, "0"), F.when(k % 2 == 0, "f").otherwise("")), "costCode": F.concat(F.lit(" "), key, F.lit(" "))}
    out = None
    for name, value in values.items():
        one = c.select("c_custkey", F.lit(name).alias("field"), clean.clean_value(name, F.when(k % 9 == 0, " n/a ").otherwise(value)).alias("x"))
        out = one if out is None else out.unionByName(one)
    return out.select("c_custkey", "field", F.coalesce("x.value", F.lit("")).alias("value"), F.col("x.confidence").alias("confidence"), F.coalesce("x.issue", F.lit("")).alias("issue"))


def value_issue_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalations of flagged values with their options."""
    c, k = _read(spark, sf_dir, "customer"), F.col("c_custkey")
    key = k.cast("string")
    born = F.concat(F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((k % 11 + 1).cast("string"), 2, "0"), F.lit("/90"))
    s = merge.Source(c.select(key.alias("id"), F.when(k % 4 == 0, F.lit("absconding")).otherwise("active").alias("st"), F.concat(key, F.when(k % 3 == 0, "@gmail.com").when(k % 3 == 1, "@x.in").otherwise("")).alias("mail"), born.alias("born"), k.alias("row_idx")), 0, "a", (("id", "employeeNumber"), ("st", "status"), ("mail", "email"), ("born", "dateOfBirth")))
    e = escalations.value_issues(cut(merge.merge_sources([s]), "records"))
    return e.groupBy("kind", "field", F.array_join(F.transform("options", lambda o: o["id"]), ",").alias("options"), "confidence").agg(F.count(F.lit(1)).alias("n"))


def tail_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: a log's last rows, newest first; the limit is the feature."""
    e = _read(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    return store.tail(e, 30).select("event_id", "rank")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the last order of each customer."""
    o = store.latest(_read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return o.select("o_custkey", "o_orderkey", "o_orderstatus")


def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: the twelve newest jobs; the limit is the feature."""
    o = _read(spark, sf_dir, "orders")
    jobs = o.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("client_name"), F.col("o_orderstatus").alias("status"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    return store.recent_jobs(jobs)


def event_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6: the log's last eighty events; the limit is the feature."""
    e = _read(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    return store.recent_events(e).select("event_id", "event_type")


def currency_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a pay and no currency."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    pay, currency = F.when(k % 3 != 0, F.floor("c_acctbal").cast("long").cast("string")), F.when(k % 4 == 0, F.lit("usd"))
    s = merge.Source(c.select(k.cast("string").alias("id"), pay.alias("pay"), currency.alias("cur"), k.alias("row_idx")), 0, "a", (("id", "employeeNumber"), ("pay", "ctcAnnual"), ("cur", "currency")))
    r = merge.merge_sources([s], MERGE)
    return r.select(F.col("employee_number").cast("long").alias("c_custkey"), F.coalesce("cells.currency.value", F.lit("")).alias("currency"), F.col("cells.currency.confidence").alias("confidence"))


def delta_rule_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix rule shows if three rows have it."""
    s = _read(spark, sf_dir, "supplier")
    cells = profile.long_cells(s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("apx-"), F.col("s_suppkey").cast("string"))).otherwise("x").alias("id"), F.col("s_suppkey").alias("row_idx")), 0, "s")
    return escalations.delta_rules(cells).select("title", "applies_to", "origin")


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: documents to text and back."""
    e = _read(spark, sf_dir, "events")
    back = F.from_json(F.to_json(F.from_json("props", "k long")), "k long")
    return e.select("event_id", back["k"].alias("k"))


def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records without a flag."""
    r = escalations.clean_records(merge.merge_sources(_sources(spark, sf_dir), MERGE))
    return r.select(F.col("employee_number").alias("employeeNumber"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_sources(spark, sf_dir)


ALL: tuple[Query, ...] = (
    normalize_text, token_overlap, header_similarity_topk, title_case, name_split, blank_filter, number_parse, money_format, email_clean,
    phone_clean, employee_id, date_parse_mixed, enum_map_unknown, profile_columns, profile_merged, map_columns, vocabulary_top3, map_decision, mapping_board, uncertain_columns, mapping_updates, mapping_escalations, first_escalations, payload_rows, merge_sources, incremental_merge, delimited_exact, workbook_rows, target_rows, conflict_escalations,
    exact_dedupe, fuzzy_pairs, missing_required, date_order, required_without_source, skip_set_validation, escalation_summary, push_status,
    push_outcome, push_log, rollback_net, rollback_calls, resolve_decisions, close_related, merge_pairs, dispatched, value_issue_options, tail_views, upsert_latest, recent_topk, event_ring, currency_default, delta_rule_threshold, json_roundtrip, clean_records,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
