"""Which fields of a large vocabulary a header can resemble, found through grams instead of by comparing it with each.

A header resembles a way of writing a field when their similarity (1 - edit distance / longer length) reaches a floor, when
one lies within the other, or when they share enough words. Each has an equi-join of its own:

- Similar strings of longer length n share at least n + q - 1 - q * d of their padded q-grams, d being the most edits that
  the floor allows. Grams are numbered by occurrence and ordered by how rare they are among the ways, so that two strings
  which share so many share one of their first ones; length and count are checked before anything is compared letter by letter.
- A string within another is found by the one of its grams that the fewest others hold; strings of up to two letters,
  the empty one included, are their own gram.
- Shared words are found by the rarest words of the header, as many as can't all be missing.

What is found holds every pair that reaches the floor, and some that don't: scoring follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
#: What a share of common words is worth in a score.
WORDS = 0.8
_SLACK = 1e-9


def _grams(texts: DataFrame, q: int) -> DataFrame:
    """text, gram: padded grams, each told by its occurrence, so that those of a text are different."""
    padded = F.concat(F.lit("\x01" * (q - 1)), "text", F.lit("\x02" * (q - 1)))
    each = texts.select("text", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text") + (q - 1)), lambda i: F.substring(padded, i, F.lit(q)))).alias("pos", "gram"))
    nth = F.row_number().over(Window.partitionBy("text", "gram").orderBy("pos"))
    return each.select("text", F.concat("gram", F.lit("\x03"), nth.cast("string")).alias("gram"))


def _first_grams(grams: DataFrame, often: DataFrame, q: int, floor: float) -> DataFrame:
    """text, grams, gram: all grams of a text, and a row for each of the rarest that similar texts can't all lack."""
    known = grams.join(often, "gram", "left").groupBy("text").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("g"))
    shared = F.greatest(F.lit(1), F.ceil(F.length("text") * (1 - q * (1 - floor)) + (q - 1) - _SLACK).cast("int"))
    known = known.select("text", F.transform("g", lambda x: x["gram"]).alias("grams"), shared.alias("shared"))
    return known.select("text", "grams", F.explode(F.slice("grams", F.lit(1), F.size("grams") - F.col("shared") + 1)).alias("gram"))


def similar(heads: DataFrame, ways: DataFrame, q: int, floor: float) -> DataFrame:
    """head, way: texts (column text, distinct) whose similarity reaches the floor; what differs in length or shares too few grams isn't compared."""
    if q * (1 - floor) > 1 + _SLACK:
        raise ValueError(f"similar texts may share no gram of {q} at a floor of {floor}")
    mine, theirs = (_grams(t.filter("text <> ''"), q) for t in (heads, ways))
    often = theirs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    a = _first_grams(mine, often, q, floor)
    b = _first_grams(theirs, often, q, floor)
    met = a.select("gram", F.col("text").alias("head"), F.col("grams").alias("mine")).join(b.select("gram", F.col("text").alias("way"), F.col("grams").alias("theirs")), "gram")
    shorter, longer = F.least(F.length("head"), F.length("way")), F.greatest(F.length("head"), F.length("way"))
    edits = F.floor(longer * (1 - floor) + _SLACK)
    met = met.filter(longer - shorter <= edits)
    # two texts meet at each first gram that they share; the first of these decides, so that pairs need no distinct
    met = met.filter(F.col("gram") == F.element_at(F.array_intersect("mine", "theirs"), 1))
    met = met.filter(F.size(F.array_intersect("mine", "theirs")) >= longer + (q - 1) - edits * q)
    return met.filter(F.levenshtein("head", "way") <= edits).select("head", "way")


def within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner, outer: texts (column text, distinct) of which the first lies within the second or equals it."""
    sized = inner.select("text", F.least(F.length("text"), F.lit(GRAM)).alias("size"))
    sizes = sized.select("size").distinct()  # four rows at most
    cut_up = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("size") + 1), lambda i: F.substring("text", i, F.col("size"))))
    grams = F.explode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(cut_up)).alias("gram")
    held = outer.join(F.broadcast(sizes), F.length("text") >= F.col("size")).select(F.col("text").alias("outer"), "size", grams)
    often = held.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("n"))
    sought = sized.select(F.col("text").alias("inner"), "size", grams).join(often, ["size", "gram"], "left")
    sought = sought.groupBy("inner", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).filter("m.n > 0")
    met = held.join(sought.select("inner", "size", F.col("m.gram").alias("gram")), ["size", "gram"])
    return met.filter(F.contains("outer", "inner")).select("inner", "outer")


def sharing_words(heads: DataFrame, words: DataFrame, floor: float) -> DataFrame:
    """head, field: headers (text, words) and fields (field, word) that may share the words that the floor asks for."""
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    each = heads.select("text", F.size("words").alias("of"), F.explode("words").alias("word")).join(often, "word", "left")
    known = each.groupBy("text", "of").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("w"))
    asked = F.ceil(F.col("of") * (floor / WORDS) - _SLACK).cast("int")
    rare = known.select(F.col("text").alias("head"), F.explode(F.slice("w", F.lit(1), F.greatest(F.lit(0), F.col("of") - F.greatest(asked, F.lit(1)) + 1))).alias("x"))
    return rare.select("head", F.col("x.word").alias("word")).join(words, "word").select("head", "field")


def near_texts(heads: DataFrame, ways: DataFrame, q: int, floor: float) -> DataFrame:
    """head, near: all texts (column text, distinct) whose similarity reaches the floor or of which one lies within the other."""
    if not 0 < floor < 1:
        raise ValueError("a floor lies between 0 and 1")
    pairs = similar(heads, ways, q, floor).toDF("head", "near")
    pairs = pairs.unionByName(within(heads, ways).toDF("head", "near"))
    return pairs.unionByName(within(ways, heads).select(F.col("outer").alias("head"), F.col("inner").alias("near"))).distinct()
