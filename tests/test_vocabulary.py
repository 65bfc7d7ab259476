"""Fields found through grams against every column scored with every field."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tributary.config import Config
from tributary.operators import mapping, vocabulary

COLUMNS = "file_ord int, file_name string, col_ord int, header string, samples array<string>"
WORDS = "work home tax cost pay hire base unit code name mail date city rank plan site term note team bank".split()


def invented(seed, n):
    """Fields with ways of writing them, and columns whose headers are such ways, bent, cut, joined or odd."""
    rng = random.Random(seed)
    some = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    kinds = ["string", "string", "number", "date", "email", "phone", "enum"]
    fields = [(f"f{rng.choice(WORDS)}{i}", i, rng.choice(kinds)) for i in range(n)] + [("workLocation", n, "string"), ("employeeNumber", n + 1, "string")]
    ways = [(f, some(rng.randint(1, 4)) + rng.choice(["", " no", "_Id", str(rng.randint(0, 99))])) for f, _, _ in fields if rng.random() < 0.95 for _ in range(rng.randint(1, 5))]
    ways += [(fields[3][0], "a"), (fields[4][0], ""), (fields[5][0], "no"), (fields[6][0], "aaaa aaaa")]

    def bent(text):
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(text))
            text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("aeqz _") + text[i:], text[:i] + "x" + text[i + 1 :]])
        return text

    samples = [[], ["a@b.com", "c@d.org"], ["12", "x"], ["2020-01-02"], ["EMP-1001"], ["plain", ""], ["9123450001"], ["01-Mar-20", "7"]]
    heads = [bent(rng.choice(ways)[1]) for _ in range(150)] + [some(3) for _ in range(20)] + ["", " ", "a", "no", "aaaaaaaa", "Username", "cost center", "zz", "wörk", "x" * 400, "work " * 60]
    return fields, ways, [(0, "f.csv", i, h, rng.choice(samples)) for i, h in enumerate(heads)]


def top(df):
    return sorted((r["col_ord"], r["field"], round(r["score"], 12)) for r in df.collect())


@pytest.fixture(params=[1, 2])
def tables(request, spark):
    fields, ways, columns = invented(request.param, 300)
    return spark.createDataFrame(columns, COLUMNS), spark.createDataFrame(fields, "field string, ord int, type string"), spark.createDataFrame(ways, "field string, synonym string")


def test_the_same_best_fields_as_the_full_product(tables):
    columns, fields, ways = tables
    left = Config().leftovers
    every = mapping.score_pairs(mapping._prepared(columns).join(mapping.field_table(fields, ways), F.lit(True)), left)
    by = Window.partitionBy("col_ord").orderBy(F.col("score").desc(), "ord")
    wanted = every.withColumn("rn", F.row_number().over(by)).filter("rn <= 3")
    got = mapping.nearest_fields(columns, fields, ways, left).cache()
    assert top(got) == top(wanted) and got.count() == 3 * columns.count()
    of = {r["round"]: r["n"] for r in got.groupBy("round").agg(F.count_distinct("col_ord").alias("n")).collect()}
    assert of[0] > columns.count() / 3 and of.get(-1, 0) < columns.count() / 4  # most columns never meet all fields


@pytest.mark.parametrize("q, floor", mapping.ROUNDS)
def test_similar_pairs_each_once(tables, q, floor):
    columns, _, ways = tables
    heads = columns.select(F.lower("header").alias("text")).distinct()
    texts = ways.select(F.lower("synonym").alias("text")).distinct()
    got = vocabulary.similar(heads, texts, q, floor)
    a, b = F.col("text"), F.col("way")
    near = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    wanted = heads.join(texts.toDF("way"), F.lit(True)).filter((a != "") & (b != "") & (near >= floor)).select(a.alias("head"), "way")
    assert wanted.count() > 50 and sorted(wanted.collect()) == sorted(got.collect())


def test_texts_within_others(spark):
    texts = ["", "a", "ab", "abc", "abcd", "xabcdx", "bcd", "bca", "zz"]
    inner, outer = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(t,) for t in [*texts, "abab"]], "text string")
    got = sorted((r["inner"], r["outer"]) for r in vocabulary.within(inner, outer).collect())
    assert got == sorted((i, o) for i in texts for o in [*texts, "abab"] if i in o)


def test_a_floor_that_grams_cannot_promise_is_refused(spark):
    one = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError):
        vocabulary.similar(one, one, 3, 0.5)


def test_mappings_of_a_large_vocabulary_are_those_of_a_small_one(tables):
    columns = tables[0]
    small, large = Config(), Config(policy=replace(Config().policy, compared_synonyms=0))
    seen = lambda c: sorted(map(repr, mapping.propose(columns, c).collect()))
    assert seen(small) == seen(large)


def test_no_columns_and_no_fields(tables):
    columns, fields, ways = tables
    assert mapping.nearest_fields(columns.limit(0), fields, ways).isEmpty()
    assert mapping.nearest_fields(columns, fields.limit(0), ways).isEmpty()


def test_columns_that_are_alike_are_ranked_once(spark, monkeypatch):
    fields, ways, columns = invented(3, 30)
    columns = columns[:40]
    again = columns + [(o, f, i + 1000, h.upper(), s) for o, f, i, h, s in columns]
    ranked, cut = [], mapping.cut

    def seen(df, name):
        made = cut(df, name)
        ranked.extend([made.count()] if name == "nearest" else [])
        return made

    monkeypatch.setattr(mapping, "cut", seen)
    got = top(mapping.nearest_fields(spark.createDataFrame(again, COLUMNS), spark.createDataFrame(fields, "field string, ord int, type string"), spark.createDataFrame(ways, "field string, synonym string")))
    assert [x for x in got if x[0] >= 1000] == [(i + 1000, f, s) for i, f, s in got if i < 1000] and len(got) == 6 * len(columns)
    assert ranked[0] <= 3 * len(columns)
