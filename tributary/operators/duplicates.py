"""Likely duplicates: pairs of records alike in name that share a phone number or a day of birth.

Up to some hundred records of one number meet each other. A switchboard's number is shared by a hundred thousand people, so
beyond that records meet by number *and* name: those of one number with one compact name, those with one initial and last
name, and those of which one compact name lies within the other. The last are found through the rarest gram of the shorter
name. Names meet as classes (one row a number and name), and only classes that meet are expanded to their records.

Where two classes hold more than `most` * `most` pairs, not all pairs come out: each record then meets up to six records of
the other class (the first, the last, the first with a long name, and one of each with another employee number), so that
every record with a link keeps at least one, to a representative. `groups` says how large such classes are. Up to that
bound, pairs are all there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.cut import cut
from tributary.operators.hot import small

GRAM = 4
#: Classes of at most so many records each give all their pairs.
MOST = 200
BLOCK = ["by", "shared"]
CLASS = [*BLOCK, "kind", "name"]


def members(people: DataFrame) -> DataFrame:
    """by, shared, compact, initial, ord, id, long, number: a row for each number or day that a person has."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    full = F.regexp_replace(F.lower(F.concat(filled("first"), F.lit(" "), filled("last"))), r"\.", "")
    made = people.select("ord", "id", "number", full.alias("full"), filled("last").alias("last"), *[F.col(c).cast("string").alias(c) for c in ("phone", "dob")])
    made = made.withColumn("compact", F.regexp_replace("full", "[^a-z]", "")).withColumn("initial", F.concat(F.substring("full", 1, 1), F.lit("\0"), F.lower("last")))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("shared")) for c in ("phone", "dob")]))
    out = made.select("compact", "initial", (F.length("compact") > 3).alias("long"), "ord", "id", "number", each.alias("x"))
    return out.select("x.by", "x.shared", "compact", "initial", "long", "ord", "id", "number").filter(F.coalesce("shared", F.lit("")) != "")


def classes(rows: DataFrame) -> DataFrame:
    """Each member in its class of equal compact names and in that of equal initial and last name."""
    each = F.explode(F.array(F.struct(F.lit("compact").alias("kind"), F.col("compact").alias("name")), F.struct(F.lit("initial").alias("kind"), F.col("initial").alias("name"))))
    return rows.select(*BLOCK, each.alias("c"), "long", "ord", "id", "number").select(*BLOCK, "c.kind", "c.name", "long", "ord", "id", "number")


def contained(rows: DataFrame) -> DataFrame:
    """by, shared, outer, inner: compact names of one block of which one lies within the other.

    A name is sought by the one of its grams that the fewest longer names of its block hold; if any is in none, it lies in
    none. Names of fewer than GRAM letters are their own gram, so longer names give grams of the sizes that their block asks
    for."""
    names = rows.select(*BLOCK, F.col("compact").alias("name")).distinct()
    several = names.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*BLOCK)
    names = names.join(several, BLOCK, "left_semi")
    length = F.length("name")
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), length - F.col("size") + 1), lambda i: F.substring("name", i, F.col("size"))))).alias("gram")
    inner = names.withColumn("size", F.least(length, F.lit(GRAM)))
    asked = inner.select(*BLOCK, "size").distinct()
    outer = names.join(asked, BLOCK).filter(length > F.col("size")).select(*BLOCK, F.col("name").alias("outer"), "size", grams)
    often = outer.groupBy(*BLOCK, "size", "gram").agg(F.count(F.lit(1)).alias("n"))
    sought = inner.select(*BLOCK, F.col("name").alias("inner"), "size", grams).join(often, [*BLOCK, "size", "gram"], "left")
    sought = sought.groupBy(*BLOCK, "size", "inner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).filter("m.n > 0")
    met = outer.join(sought.select(*BLOCK, "size", "inner", F.col("m.gram").alias("gram")), [*BLOCK, "size", "gram"])
    return met.filter((F.length("outer") > F.length("inner")) & F.contains("outer", "inner")).select(*BLOCK, "outer", "inner")


def linked(a: str, b: str) -> Column:
    """a comes before b: only the earlier one's name must be long, and days of birth link different employee numbers only."""
    return (F.col(f"{a}.ord") < F.col(f"{b}.ord")) & F.col(f"{a}.long") & ((F.col("by") == "phone") | ~F.col(f"{a}.number").eqNullSafe(F.col(f"{b}.number")))


def fuzzy_pairs(people: DataFrame, most: int = MOST, block: int | None = None) -> DataFrame:
    """people(ord, id, first, last, phone, dob, number) to keep_id, drop_id, by_phone, by_dob; the earlier record first.

    Numbers and days that at most `block` (or `most`) records share give all their pairs; of the others names decide who meets.
    """
    rows = members(people)
    large = cut(rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (most if block is None else block)).select(*BLOCK), "shared")
    if large.isEmpty():
        return _told(within_blocks(rows))
    side = small(large)
    return _told(within_blocks(rows.join(side, BLOCK, "left_anti")).unionByName(across_classes(rows.join(side, BLOCK, "left_semi"), most)))


def within_blocks(rows: DataFrame) -> DataFrame:
    """by, a, b: all pairs of each number or day."""
    x, y = rows.alias("a"), rows.select(*[F.col(c).alias(c if c in BLOCK else f"b_{c}") for c in rows.columns])
    met = x.join(y, BLOCK).filter(F.col("ord") < F.col("b_ord"))
    alike = (F.col("compact") == F.col("b_compact")) | F.contains("compact", "b_compact") | F.contains("b_compact", "compact") | (F.col("initial") == F.col("b_initial"))
    met = met.filter(F.col("long") & alike & ((F.col("by") == "phone") | ~F.col("number").eqNullSafe(F.col("b_number"))))
    return met.select("by", F.col("id").alias("keep_id"), F.col("b_id").alias("drop_id"))


def _told(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("keep_id", "drop_id").agg(F.bool_or(F.col("by") == "phone").alias("by_phone"), F.bool_or(F.col("by") == "dob").alias("by_dob"))


def across_classes(rows: DataFrame, most: int) -> DataFrame:
    """by, keep_id, drop_id, through classes of names."""
    all_ = classes(rows)
    size = all_.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"))
    own = size.filter("n > 1").select(*CLASS, F.col("kind").alias("kind2"), F.col("name").alias("name2"), "n", F.col("n").alias("n2"))
    across = contained(rows).select(*BLOCK, F.lit("compact").alias("kind"), F.col("outer").alias("name"), F.lit("compact").alias("kind2"), F.col("inner").alias("name2"))
    across = across.join(size, CLASS).join(size.select(*BLOCK, F.col("kind").alias("kind2"), F.col("name").alias("name2"), F.col("n").alias("n2")), [*BLOCK, "kind2", "name2"])
    meets = own.unionByName(across).withColumn("all", F.col("n") * F.col("n2") <= most * most)
    person = F.struct("ord", "id", "long", "number")
    one = all_.select(*CLASS, person.alias("x"))
    other = one.select(*BLOCK, F.col("kind").alias("kind2"), F.col("name").alias("name2"), F.col("x").alias("y"))
    every = meets.filter("all").join(one, CLASS).join(other, [*BLOCK, "kind2", "name2"]).select("by", "x", "y")
    few = meets.filter("not all")
    heads = representatives(one, few.select(*CLASS).unionByName(few.select(*BLOCK, F.col("kind2").alias("kind"), F.col("name2").alias("name"))).distinct())
    to = heads.select(*BLOCK, F.col("kind").alias("kind2"), F.col("name").alias("name2"), "heads")
    back = few.select(*BLOCK, F.col("kind2").alias("kind"), F.col("name2").alias("name"), F.col("kind").alias("kind2"), F.col("name").alias("name2"))
    ways = few.select(*CLASS, "kind2", "name2").unionByName(back).distinct()
    star = one.join(ways.join(to, [*BLOCK, "kind2", "name2"]).select(*CLASS, "heads"), CLASS).select("by", "x", F.explode("heads").alias("y"))
    met = every.unionByName(star)
    first = F.when(F.col("x.ord") < F.col("y.ord"), F.struct(F.col("x").alias("a"), F.col("y").alias("b"))).otherwise(F.struct(F.col("y").alias("a"), F.col("x").alias("b")))
    met = met.select("by", first.alias("p")).select("by", "p.a", "p.b").filter(linked("a", "b"))
    return met.select("by", F.col("a.id").alias("keep_id"), F.col("b.id").alias("drop_id"))


def representatives(one: DataFrame, wanted: DataFrame) -> DataFrame:
    """CLASS columns and heads of each wanted class: its first and its last person, and the first and last whose employee
    number differs from theirs. One person with each of two numbers is enough for anyone to find a different one."""
    own = one.join(wanted, CLASS, "left_semi")
    ends = own.groupBy(*CLASS).agg(F.min("x").alias("first"), F.max("x").alias("last"))
    differs = lambda c: F.when(~F.col("x.number").eqNullSafe(F.col(f"{c}.number")), F.col("x"))
    more = own.join(ends, CLASS).groupBy(*CLASS, "first", "last").agg(F.min(differs("first")).alias("first2"), F.max(differs("last")).alias("last2"))
    # in classes of one initial and last name a short name may come first, which nobody follows
    long = own.filter("x.long").groupBy(*CLASS).agg(F.min("x").alias("long1"))
    more = more.join(long, CLASS, "left")
    most = own.filter("x.long").join(long, CLASS).groupBy(*CLASS).agg(F.min(F.when(~F.col("x.number").eqNullSafe(F.col("long1.number")), F.col("x"))).alias("long2"))
    met = more.join(most, CLASS, "left")
    return met.select(*CLASS, F.array_distinct(F.filter(F.array("first", "last", "first2", "last2", "long1", "long2"), lambda h: h.isNotNull())).alias("heads"))


def groups(people: DataFrame, least: int = MOST) -> DataFrame:
    """by, shared, kind, name, n, first_id: classes of more than `least` records, whose pairs go through representatives."""
    all_ = classes(members(people))
    return all_.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "ord").alias("first_id")).filter(F.col("n") > least)


def record_pairs(records: DataFrame) -> DataFrame:
    """fuzzy_pairs of merged records that are not excluded."""
    value = lambda f: F.col(f"cells.{f}.value")
    live = records.filter(~F.col("excluded")) if "excluded" in records.columns else records
    # the order of first sight as one number; keyed records come before those without a key
    ord_ = F.struct(F.col("key").startswith("row:").alias("orphan"), F.col("seq.file_ord"), F.col("seq.row_idx"))
    return fuzzy_pairs(live.select(ord_.alias("ord"), F.col("record_id").alias("id"), value("firstName").alias("first"), value("lastName").alias("last"), value("phone").alias("phone"), value("dateOfBirth").alias("dob"), F.col("employee_number").alias("number")))
