"""The merge's fold for keys that very many rows share: a junk number, a default address.

The plain fold brings a key's rows together in one array. Here no group is brought together; what the fold does to each
row is found by aggregates instead, from what can change a field's value at all:

- an empty value takes what comes, so the first row with a value ends that;
- after it only a longer value that contains the present one replaces it, so the next one is the earliest such row, found
  for all keys and fields by one aggregate a round; values grow with each, so rounds end soon, mostly after the first;
- between two such rows the value is known, so each row's outcome (equal, within, conflict, alternative) is a plain
  expression over its row and the value's short history, and counts, confidence and flags are sums and maxima.

Rows, flags, values, confidences and counts are the plain fold's. Of what a record lists (its rows, a field's lineage and
alternatives) come the first `listed` in the fold's order: a list of 10**8 entries is no cell. `contributions` has them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.config import Config
from tributary.functions.cut import cut

#: Entries of a record's lists at most, where its key is hot.
LISTED = 1000
#: Parts that a group is ranked in, before what is left of them is ranked together.
SALTS = 64
#: Rows that are broadcast at most; beyond that they meet the others in a join.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it is few rows. df is a table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def first_of(df: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """The first `most` of each group, ranked in parts first, so that no group is sorted in one place."""
    part = Window.partitionBy(*by, F.pmod(F.xxhash64(order), F.lit(SALTS))).orderBy(order)
    whole = Window.partitionBy(*by).orderBy(order)
    some = df.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= most)
    return some.withColumn("rn", F.row_number().over(whole)).filter(F.col("rn") <= most).drop("rn")


def contributions(rows: DataFrame) -> DataFrame:
    """key, seq, row_id, field, raw, clean, lineage: what each row brings to each field of its record."""
    each = rows.select("key", F.struct("file_ord", "row_idx").alias("seq"), "row_id", F.explode("states").alias("s"))
    state = F.col("s.state")
    return each.select("key", "seq", "row_id", F.col("s.field").alias("field"), F.coalesce(state["raw"], state["value"], F.lit("")).alias("raw"), state["clean"].alias("clean"), F.get(state["lineage"], F.lit(0)).alias("lineage"), state.alias("state"))


def fold_hot(rows: DataFrame, config: Config, listed: int = LISTED) -> DataFrame:
    """rows (as fold_rows gives them) of hot keys to key, seq, row_ids, states (a map by field), flags, n_transforms."""
    rows = cut(rows, "hot")
    place = F.struct("file_ord", "row_idx")
    heads = cut(rows.groupBy("key").agg(F.min(place).alias("first")), "heads")
    items = contributions(rows).join(small(heads), "key")
    start = cut(items.filter(F.col("seq") == F.col("first")).select("key", "field", "seq", F.col("state").alias("s0")), "start")
    later = cut(items.filter((F.col("seq") > F.col("first")) & (F.col("state.raw").isNotNull() | F.col("state.value").isNotNull())).select("key", "field", "seq", "row_id", "raw", "clean", "lineage"), "later")
    epochs = cut(_epochs(start, later, config), "epochs")
    states = _states(start, later, epochs, config, listed)
    n = F.aggregate(F.transform("states", lambda s: s["state"]["n"]), F.lit(0), lambda a, x: a + x) + F.col("extra_n")
    flags = F.concat(F.flatten(F.transform("states", lambda s: s["state"]["flags"])), F.col("extra_flags"))
    of_rows = rows.select("key", n.cast("long").alias("n"), F.array_distinct(flags).alias("flags"))
    counted = of_rows.groupBy("key").agg(F.sum("n").alias("row_n"))
    said = of_rows.select("key", F.explode("flags").alias("flag")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("flag")).alias("row_flags"))  # some a field
    ids = first_of(rows.select("key", place.alias("seq"), "row_id"), ["key"], "seq", listed)
    ids = ids.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "row_id"))), lambda x: x["row_id"]).alias("row_ids"))
    cells = states.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "state"))).alias("states"))  # one a field
    out = heads.join(cells, "key", "left").join(counted, "key").join(said, "key", "left").join(ids, "key")
    return out.select("key", F.col("first").alias("seq"), "row_ids", "states", F.coalesce("row_flags", F.expr("cast(array() as array<string>)")).alias("row_flags"), F.col("row_n").alias("row_n"))


def _is_number(config: Config) -> Column:
    numbers = [f.key for f in config.fields if f.type == "number"]
    return F.col("field").isin(*numbers) if numbers and config.policy.numeric_conflict_escalates else F.lit(False)


def _epochs(start: DataFrame, later: DataFrame, config: Config) -> DataFrame:
    """key, field, seq, value, kind, raw, clean: each value that a field has had, from which row on. kind: start, first or
    longer."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    known = start.filter(filled(F.col("s0.value"))).select("key", "field", "seq", F.col("s0.value").alias("value"), F.lit("start").alias("kind"), F.col("s0.raw").alias("raw"), F.col("s0.clean").alias("clean"))
    take = F.min(F.struct("seq", "raw", "clean")).alias("m")
    row = lambda df, kind: df.select("key", "field", "m.seq", F.col("m.clean.value").alias("value"), F.lit(kind).alias("kind"), "m.raw", "m.clean")
    have = cut(known.select("key", "field"), "have")
    firsts = row(later.filter(filled(F.col("clean.value"))).join(small(have), ["key", "field"], "left_anti").groupBy("key", "field").agg(take), "first")
    out = cut(known.unionByName(firsts), "epochs")
    if not config.policy.containment_keeps_longer:
        return out
    now = out.select("key", "field", F.col("seq").alias("since"), F.col("value").alias("present")).filter(~_is_number(config))
    while True:
        now = cut(now, "present")
        value, present = F.col("clean.value"), F.col("present")
        longer = (F.col("seq") > F.col("since")) & F.contains(F.lower(value), F.lower(present)) & (F.length(value) > F.length(present))
        found = cut(row(later.join(small(now), ["key", "field"]).filter(longer).groupBy("key", "field").agg(take), "longer"), "longer")
        if found.isEmpty():
            return out
        out = out.unionByName(found)
        now = found.select("key", "field", F.col("seq").alias("since"), F.col("value").alias("present"))


def _states(start: DataFrame, later: DataFrame, epochs: DataFrame, config: Config, listed: int) -> DataFrame:
    """key, field, state: as the plain fold leaves each field."""
    history = cut(epochs.groupBy("key", "field").agg(F.array_sort(F.collect_list(F.struct("seq", "value", "kind"))).alias("had")), "history")  # values that grow
    value, clean = F.col("clean.value"), F.col("clean")
    met = later.join(small(history), ["key", "field"], "left")
    before = F.filter("had", lambda h: h["seq"] < F.col("seq"))
    met = met.withColumn("present", F.try_element_at(before, F.lit(-1))["value"]).withColumn("takes", F.coalesce(F.exists("had", lambda h: h["seq"] == F.col("seq")), F.lit(False)))
    number = _is_number(config)
    lower = (F.lower("present"), F.lower(value))
    within = value.isNotNull() & (F.contains(*lower) | F.contains(*reversed(lower))) & F.lit(config.policy.containment_keeps_longer)
    what = (
        F.when(F.col("present").isNull(), "take").when(F.col("present") == value, "equal").when(number, "number").when(F.col("takes"), "longer").when(within, "within").otherwise("conflict")
    )
    met = met.withColumn("what", what)
    done = F.when(clean["transform"].isNotNull() & value.isNotNull(), 1).otherwise(0) + F.when(F.col("what").isin("longer", "within"), 1).otherwise(0)
    sure = F.when(F.col("takes") | (F.col("what") == "equal"), clean["confidence"])
    taken = F.when(F.col("what") == "take", F.struct("seq", "raw", "clean", "lineage"))
    sums = met.groupBy("key", "field").agg(
        F.sum(done).alias("n"),
        F.max(sure).alias("sure"),
        F.bool_or(F.col("what").isin("number", "conflict")).alias("differs"),
        F.max(taken).alias("last"),
        F.array_sort(F.collect_set(F.when(F.col("what") == "take", clean["issue"]))).alias("issues"),
    )
    lists = first_of(met.filter((F.col("what") != "take") | F.col("takes")).select("key", "field", "seq", "lineage"), ["key", "field"], "seq", listed)
    lists = lists.groupBy("key", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lineage"))), lambda x: x["lineage"]).alias("seen"))
    others = met.filter((F.col("what") == "number") & value.isNotNull()).groupBy("key", "field", value.alias("value")).agg(F.min("seq").alias("seq"))
    others = first_of(others, ["key", "field"], "seq", listed).groupBy("key", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("others"))
    last = epochs.groupBy("key", "field").agg(F.max(F.struct("seq", "value", "kind", "raw", "clean")).alias("e"))
    whole = start.select("key", "field", "s0").join(sums, ["key", "field"], "full").join(last, ["key", "field"], "left").join(lists, ["key", "field"], "left").join(others, ["key", "field"], "left")
    none, no_lineage = F.expr("cast(array() as array<string>)"), F.expr("array()")
    e, s0, kind = F.col("e"), F.col("s0"), F.col("e.kind")
    from_start = F.coalesce(F.col("s0.value") != "", F.lit(False))
    empty, untouched = e.isNull(), F.col("n").isNull()
    alternatives = F.filter(F.coalesce("others", none), lambda v: ~F.array_contains(F.coalesce(s0["conflicts"], none), v))
    kept = F.coalesce(F.when(from_start, s0["conflicts"]), none)
    flags = F.concat(F.coalesce(s0["flags"], none), F.transform(F.coalesce("issues", none), lambda i: F.concat("field", F.lit(":"), i)), F.when(F.col("differs"), F.array(F.concat("field", F.lit(":conflict")))).otherwise(none))
    made = F.struct(
        F.when(empty, F.col("last.raw")).otherwise(e["raw"]).alias("raw"),
        F.when(empty, F.col("last.clean.value")).otherwise(e["value"]).alias("value"),
        F.when(empty, F.col("last.clean.confidence")).otherwise(F.greatest(F.when(from_start, s0["confidence"]), F.col("sure"))).alias("confidence"),
        F.when(empty, F.array("last.lineage")).otherwise(F.slice(F.concat(F.coalesce(F.when(from_start, s0["lineage"]), no_lineage), F.coalesce("seen", no_lineage)), 1, listed)).alias("lineage"),
        F.when(empty, F.col("last.clean.transform")).when(kind == "longer", F.lit("kept longer form")).when(kind == "start", s0["transform"]).otherwise(e["clean"]["transform"]).alias("transform"),
        F.when(empty | (kind == "longer"), none).otherwise(F.slice(F.concat(kept, alternatives), 1, listed)).alias("conflicts"),
        F.array_distinct(flags).alias("flags"),
        F.coalesce("n", F.lit(0)).cast("int").alias("n"),
        F.when(empty, F.col("last.clean")).otherwise(e["clean"]).alias("clean"),
    )
    kind_of = start.schema["s0"].dataType.simpleString()
    return whole.select("key", "field", F.when(untouched, s0.withField("n", F.lit(0))).otherwise(made.cast(kind_of)).alias("state"))
