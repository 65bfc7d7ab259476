"""Which target field each source column feeds: scores, ranks, decisions, competition, and an optional assistant."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.config import FULL_NAME, Config
from tributary.functions.cut import cut
from tributary.functions.text import is_blank, looks_email, looks_phone, normalize_header, parse_number, similarity_normal, tokens
from tributary.operators import vocabulary
from tributary.operators.profile import date_like

COLUMN = ["file_ord", "file_name", "col_ord", "header"]
#: The one field that leftover headers may feed.
LEFTOVER_FIELD = "workLocation"
#: Of the search of a large vocabulary: sizes of grams and floors.
ROUNDS = ((3, 0.7), (2, 0.5))


def _ratio(samples: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(samples, test)) / F.size(samples)


def type_bonus(samples: Column, field: Column, kind: Column) -> Column:
    """How far the sampled values look like the field's type. samples: present values, 8 at most."""
    bonus = (
        F.when(kind == "email", _ratio(samples, looks_email) * 0.14)
        .when(kind == "phone", _ratio(samples, looks_phone) * 0.1)
        .when(kind == "date", _ratio(samples, lambda s: date_like(s) | s.rlike(r"(?i)\d{1,2}-[a-z]{3}-\d{2,4}")) * 0.12)
        .when(kind == "number", _ratio(samples, lambda s: parse_number(s).isNotNull()) * 0.08)
        .when(field == "employeeNumber", _ratio(samples, lambda s: s.rlike(r"(?i)[a-z]*-?\d{3,}")) * 0.06)
    )
    return F.when(F.size(samples) == 0, F.lit(0.0)).otherwise(F.coalesce(bonus, F.lit(0.0)))


def type_penalty(samples: Column, field: Column, kind: Column) -> Column:
    wordy = lambda s: looks_email(s) | (s.rlike("(?i)[a-z]{4,}") & ~s.rlike(r"\d"))
    return (
        F.when(F.size(samples) == 0, F.lit(0.0))
        .when((kind == "date") & F.forall(samples, wordy), F.lit(0.4))
        .when((kind == "email") & F.forall(samples, lambda s: ~F.contains(s, F.lit("@"))), F.lit(0.45))
        .when((field == "ctcAnnual") & F.forall(samples, looks_email), F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def field_table(fields: DataFrame, ways: DataFrame) -> DataFrame:
    """field, ord, type, synonyms, field_tokens: one row a field. fields(field, ord, type), ways(field, synonym)."""
    known = ways.groupBy("field").agg(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("synonym"))))).alias("field_tokens"), F.collect_list("synonym").alias("synonyms"))
    made = fields.select("field", "ord", "type").join(known, "field", "left")
    return made.withColumn("synonyms", F.coalesce("synonyms", F.array("field"))).withColumn("field_tokens", F.coalesce("field_tokens", tokens(F.col("field"))))


def _prepared(profiles: DataFrame) -> DataFrame:
    return profiles.select(*COLUMN, normalize_header(F.col("header")).alias("normal"), F.filter("samples", lambda s: ~is_blank(s)).alias("samples"))


def way_score(normal: Column, way: Column, plain: Column) -> Column:
    """How like a normalised header is a way of writing a field. plain: the way, normalised."""
    return (
        F.when(normal == way, F.lit(0.96))
        .when(F.contains(normal, way) | F.contains(way, normal), F.lit(0.88))
        .otherwise(similarity_normal(normal, plain))
    )


def _scored(by_name: Column, head: Column, bonus: Column, penalty: Column, leftovers: tuple[str, ...]) -> Column:
    """A column's score for a field, of the name's likeness, the header's words, and what types add and take."""
    shared = F.size(F.array_intersect(head, F.col("field_tokens")))
    best = F.when(shared > 0, F.greatest(by_name, shared / F.greatest(F.size(head), F.lit(1)) * vocabulary.WORDS)).otherwise(by_name)
    total = best + bonus - penalty
    return F.when(F.col("normal").isin(*leftovers) & (F.col("field") != LEFTOVER_FIELD), F.lit(0.05)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.99), total)))


def score_pairs(met: DataFrame, leftovers: tuple[str, ...]) -> DataFrame:
    """COLUMN, field, ord, score, of columns that meet rows of the field table."""
    head = F.array_distinct(tokens(F.col("header")))
    own = similarity_normal(F.col("normal"), normalize_header(F.col("field")))
    by_name = F.aggregate("synonyms", own, lambda best, way: F.greatest(best, way_score(F.col("normal"), way, normalize_header(way))))
    bonus, penalty = (f(F.col("samples"), F.col("field"), F.col("type")) for f in (type_bonus, type_penalty))
    return met.select(*COLUMN, "field", "ord", _scored(by_name, head, bonus, penalty, leftovers).alias("score"))


def _types(samples: Column) -> Column:
    """All that types can add to or take from a column's score for any field."""
    none, plain = F.lit(""), F.lit("string")
    added = [type_bonus(samples, none, F.lit(k)) for k in ("email", "phone", "date", "number")]
    taken = [type_penalty(samples, none, F.lit(k)) for k in ("date", "email")]
    return F.array(*added, type_bonus(samples, F.lit("employeeNumber"), plain), *taken, type_penalty(samples, F.lit("ctcAnnual"), plain))


def _of_types(types: Column, field: Column, kind: Column) -> tuple[Column, Column]:
    """type_bonus and type_penalty, read from _types."""
    at = lambda i: F.get(types, F.lit(i))
    bonus = F.when(kind == "email", at(0)).when(kind == "phone", at(1)).when(kind == "date", at(2)).when(kind == "number", at(3)).when(field == "employeeNumber", at(4)).otherwise(F.lit(0.0))
    by_kind = F.when(kind == "date", at(5)).when(kind == "email", at(6)).otherwise(F.lit(0.0))
    return bonus, F.when(by_kind > 0, by_kind).when(field == "ctcAnnual", at(7)).otherwise(F.lit(0.0))


def score_columns(profiles: DataFrame, config: Config) -> DataFrame:
    """COLUMN, field, ord, score, for each column and field: a broadcast of the small field and synonym tables."""
    spark = profiles.sparkSession
    fields = field_table(config.fields_frame(spark), config.synonyms_frame(spark))
    return score_pairs(_prepared(profiles).join(F.broadcast(fields), F.lit(True)), config.leftovers)  # the field table has one row a target field


def _vocabulary(fields: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(field, ord, type, field_tokens), (field, way, plain) and (field, word), of fields and all their ways; `plain` is the
    way, normalised, or the field's own name, which has no `way`. A field's ways are never brought together."""
    fields = cut(fields.select("field", "ord", "type"), "fields")
    known = cut(ways.select("field", F.col("synonym").alias("way")).distinct().join(fields.select("field"), "field"), "ways")
    known = known.unionByName(fields.join(known.select("field").distinct(), "field", "left_anti").select("field", F.col("field").alias("way"))).filter("way is not null")
    own = fields.select("field", F.lit(None).cast("string").alias("way"), normalize_header(F.col("field")).alias("plain"))
    spelled = cut(known.select("field", "way", normalize_header(F.col("way")).alias("plain")).unionByName(own), "spelled")
    words = cut(spelled.filter("way is not null").select("field", F.explode(tokens(F.col("way"))).alias("word")).distinct(), "words")
    table = fields.join(words.groupBy("field").agg(F.collect_list("word").alias("field_tokens")), "field", "left")  # different words
    return cut(table.withColumn("field_tokens", F.coalesce("field_tokens", F.expr("cast(array() as array<string>)"))), "table"), spelled, words


def nearest_fields(profiles: DataFrame, fields: DataFrame, ways: DataFrame, leftovers: tuple[str, ...] = (), most: int = 3, rounds: tuple[tuple[int, float], ...] = ROUNDS) -> DataFrame:
    """COLUMN, field, ord, score, round: the `most` best fields of each column, as by scoring it against all of them.

    Columns of one normalised header to which types could add the same are alike and are ranked once; a header's likeness to a
    field is that of the ways that it resembles, each found by a join. Each round ranks what can reach its floor by name. The
    best are certain when the last of them beats the floor by more than types could add to any other field; others go on to a
    lower floor, and at last (round -1) their headers meet all ways.
    """
    columns = cut(_prepared(profiles).select(*COLUMN, "normal", _types(F.col("samples")).alias("types")), "columns")
    table, spelled, words = _vocabulary(fields, ways)
    texts = cut(spelled.select("*", F.explode(F.array_distinct(F.array("way", "plain"))).alias("text")).filter("text is not null"), "texts")
    spared = table.select("field", "ord").orderBy("ord", "field").limit(most + 1).select("field").unionByName(table.filter(F.col("field") == LEFTOVER_FIELD).select("field")).distinct()
    left = F.col("normal").isin(*leftovers)
    likeness = F.max(way_score(F.col("head"), F.col("way"), F.col("plain"))).alias("by_name")
    by = Window.partitionBy("normal", "types").orderBy(F.col("score").desc(), "ord")
    same = lambda a, b: a["normal"].eqNullSafe(b["normal"]) & (a["types"] == b["types"])

    def best(named: DataFrame) -> DataFrame:
        """normal, types, field, ord, score, rn: of open columns by named(head, field, by_name)."""
        met = alike.join(named.join(table, "field"), F.col("normal").eqNullSafe(F.col("head")))
        score = _scored(F.col("by_name"), F.array_distinct(tokens(F.col("normal"))), *_of_types(F.col("types"), F.col("field"), F.col("type")), leftovers)
        scored = met.select("normal", "types", "field", "ord", score.alias("score"))
        return scored.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= most)

    alike, out = cut(columns.select("normal", "types").distinct(), "alike"), []
    for turn, (q, floor) in enumerate(rounds):
        heads = cut(alike.filter(~left).select(F.col("normal").alias("text")).distinct().withColumn("words", F.array_distinct(tokens(F.col("text")))), "heads")
        near = vocabulary.near_texts(heads.select("text"), texts.select("text").distinct(), q, floor).join(texts.withColumnRenamed("text", "near"), "near")
        # leftovers score alike for all fields but one, so that the first few stand for the rest
        few = alike.filter(left).select(F.col("normal").alias("head")).distinct().join(spelled.join(spared, "field"), F.lit(True))
        named = near.select("head", "field", "way", "plain").unionByName(few.select("head", "field", "way", "plain")).groupBy("head", "field").agg(likeness)
        # fields found by words alone are less like the header than the floor; their words are counted
        named = named.unionByName(vocabulary.sharing_words(heads, words, floor).select("head", "field", F.lit(0.0).alias("by_name"))).groupBy("head", "field").agg(F.max("by_name").alias("by_name"))
        bar = F.lit(floor) + F.array_max(F.slice("types", 1, 5))
        sure = left | (F.max(F.when(F.col("rn") == most, F.col("score"))).over(Window.partitionBy("normal", "types")) > bar)
        ranked = cut(best(named).withColumn("sure", F.coalesce(sure, F.lit(False))).filter("sure").drop("sure"), "nearest")
        out.append(ranked.withColumn("round", F.lit(turn)))
        settled = ranked.select("normal", "types").distinct()
        alike = cut(alike.join(settled, same(alike, settled), "left_anti"), "alike")
        if alike.isEmpty():
            break
    else:
        heads = cut(alike.select(F.col("normal").alias("head")).distinct(), "heads")
        out.append(best(heads.join(spelled, F.lit(True)).groupBy("head", "field").agg(likeness)).withColumn("round", F.lit(-1)))
    found = cut(reduce(DataFrame.unionByName, out).drop("rn"), "found")
    return columns.join(found, same(columns, found)).select(*COLUMN, "field", "ord", "score", "round")


def full_names(profiles: DataFrame, config: Config) -> DataFrame:
    """Columns that hold whole names."""
    ways = F.array(*[F.lit(w) for w in config.synonyms.get(FULL_NAME, ())] or [F.lit(None).cast("string")])
    normal = normalize_header(F.col("header"))
    return profiles.filter(F.exists(ways, lambda w: (normal == w) | (similarity_normal(normal, normalize_header(w)) > 0.9)))


def decide(confidence: Column, margin: Column, top: Column, config: Config) -> tuple[Column, Column, Column]:
    """status, target and reason of a column by its best score and its lead."""
    p = config.policy
    auto = (confidence >= p.auto_certain) | ((confidence >= p.auto_min) & (margin >= p.auto_margin))
    unclear = (confidence >= p.ignore_below) & (margin < p.auto_margin)
    likely = confidence >= p.ignore_below
    status = F.when(auto, "auto").when(unclear | likely, "escalated").otherwise("ignored")
    target = F.when(auto, top).when(unclear, F.lit(None)).when(likely, top)
    reason = F.when(auto, "match").when(unclear, "ambiguous").when(likely, "weak").otherwise("leftover")
    return status, target, reason


def propose(profiles: DataFrame, config: Config | None = None) -> DataFrame:
    """COLUMN, target, confidence, margin, status, reason, candidates: of each source column.

    Columns of one file that claim one field compete: the best keeps it, others are escalated if strong, else ignored.
    """
    config = config or Config()
    profiles = cut(profiles, "profiles")  # else tests of headers are pushed below the profiles' aggregate, to each cell
    named = full_names(profiles, config).select(*COLUMN)
    asked = profiles.join(F.broadcast(named), COLUMN, "left_anti")
    if sum(map(len, config.synonyms.values())) > config.policy.compared_synonyms:
        spark = profiles.sparkSession
        scored = nearest_fields(asked, config.fields_frame(spark), config.synonyms_frame(spark), config.leftovers)
    else:
        scored = score_columns(asked, config)
    by = Window.partitionBy(*COLUMN).orderBy(F.col("score").desc(), "ord")
    ranked = scored.withColumn("rn", F.row_number().over(by)).withColumn("next", F.lead("score").over(by))
    best = ranked.filter("rn <= 3").groupBy(*COLUMN).agg(
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("confidence"),
        F.max(F.when(F.col("rn") == 1, F.col("field"))).alias("top"),
        F.max(F.when(F.col("rn") == 1, F.col("score") - F.coalesce("next", F.lit(0.0)))).alias("margin"),
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "field", "score"))), lambda x: F.struct(x["field"].alias("field"), x["score"].alias("score"))).alias("candidates"),
    )
    status, target, reason = decide(F.col("confidence"), F.col("margin"), F.col("top"), config)
    plain = best.select(*COLUMN, target.alias("target"), "confidence", "margin", status.alias("status"), reason.alias("reason"), "candidates")
    whole = named.select(
        *COLUMN, F.lit(FULL_NAME).alias("target"), F.lit(0.93).alias("confidence"), F.lit(0.4).alias("margin"), F.lit("auto").alias("status"), F.lit("full_name").alias("reason"),
        F.array(F.struct(F.lit(FULL_NAME).alias("field"), F.lit(0.93).alias("score"))).alias("candidates"),
    )
    return compete(plain.unionByName(whole), config)


def compete(mappings: DataFrame, config: Config | None = None, strong: float = 0.8) -> DataFrame:
    claims = F.col("target").isNotNull() & (F.col("status") != "ignored") & (F.col("target") != FULL_NAME)
    by = Window.partitionBy("file_name", F.when(claims, F.col("target")), claims).orderBy(F.col("confidence").desc(), "file_ord", "col_ord")
    ranked = mappings.withColumn("rn", F.when(claims, F.row_number().over(by)))
    loses = F.col("rn") > 1
    ousted = loses & (F.col("confidence") < strong)
    return ranked.select(
        *COLUMN,
        F.when(ousted, F.lit(None)).otherwise(F.col("target")).alias("target"),
        "confidence",
        "margin",
        F.when(ousted, "ignored").when(loses, "escalated").otherwise(F.col("status")).alias("status"),
        F.when(ousted, "weaker").when(loses, "competing").otherwise(F.col("reason")).alias("reason"),
        "candidates",
    )


def uncertain(mappings: DataFrame, most: int = 12) -> DataFrame:
    """The columns that an assistant may be asked about, in order."""
    asked = (F.col("status") == "escalated") | ((F.col("status") == "ignored") & (F.col("confidence") >= 0.3))
    return mappings.filter(asked).orderBy("file_ord", "col_ord").limit(most)


def assist(mappings: DataFrame, profiles: DataFrame, helper: Callable[[DataFrame, DataFrame], DataFrame] | None, config: Config | None = None) -> DataFrame:
    """helper(columns, profiles) runs on the driver and returns file_ord, col_ord, target, confidence; none by default. One
    that fails leaves the mappings as they are: `assist` is a step that a run can do without."""
    if helper is None:
        return mappings
    try:
        return apply_updates(mappings, cut(helper(uncertain(mappings), profiles), "assisted"), config)
    except Exception as error:
        warnings.warn(f"the mapping helper failed: {error}", stacklevel=2)
        return mappings


def apply_updates(mappings: DataFrame, updates: DataFrame, config: Config | None = None) -> DataFrame:
    """A sure update maps its column, a likely one only explains it. Unknown targets are refused."""
    config = config or Config()
    known = [*config.by_key, FULL_NAME]
    u = updates.filter(F.col("target").isin(*known) | F.col("target").isNull()).select("file_ord", "col_ord", F.col("target").alias("new_target"), F.col("confidence").alias("new_confidence"))
    met = mappings.join(u, ["file_ord", "col_ord"], "left")
    open_ = (F.col("status") != "auto") & F.col("new_target").isNotNull()
    sure, likely = open_ & (F.col("new_confidence") >= config.policy.auto_min), open_ & (F.col("new_confidence") >= config.policy.ignore_below)
    return met.select(
        *COLUMN,
        F.when(sure, F.col("new_target")).otherwise(F.col("target")).alias("target"),
        F.when(sure, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        "margin",
        F.when(sure, "auto").otherwise(F.col("status")).alias("status"),
        F.when(sure | likely, "assisted").otherwise(F.col("reason")).alias("reason"),
        "candidates",
    )


def board(mappings: DataFrame) -> DataFrame:
    """What a reviewer sees: all but hopeless columns."""
    return mappings.filter((F.col("status") != "ignored") | (F.col("confidence") >= 0.4))
