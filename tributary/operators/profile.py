"""Column profiles and inferred types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.text import is_blank, js_trim, looks_email, looks_iso_date, looks_phone, parse_number


def long_cells(df: DataFrame, file_ord: int, file_name: str, row: str = "row_idx", columns: list[str] | None = None) -> DataFrame:
    """file_ord, file_name, col_ord, header, row_idx, value: one row a cell, built without a shuffle."""
    names = columns or [c for c in df.columns if c != row]
    cells = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(c).alias("header"), df[f"`{c}`"].cast("string").alias("value")) for i, c in enumerate(names)])
    return df.select(F.lit(file_ord).alias("file_ord"), F.lit(file_name).alias("file_name"), F.col(row).cast("long").alias("row_idx"), F.explode(cells).alias("x")).select("file_ord", "file_name", "x.col_ord", "x.header", "row_idx", "x.value")


def date_like(c: Column) -> Column:
    return looks_iso_date(c) | c.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}")


def _tallies(v: Column) -> list[Column]:
    """Counts of present values by what they look like."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("present"),
        F.count_if(looks_email(v)).alias("emails"),
        F.count_if(looks_phone(v)).alias("phones"),
        F.count_if(parse_number(v).isNotNull() & ~looks_phone(v)).alias("numbers"),
        F.count_if(date_like(v) | v.rlike(r"(?i)\d{1,2}-[a-z]{3}")).alias("dates"),
        F.count_if(v.rlike(r"(?i)(?:apx-)?\d{3,}")).alias("ids"),
    ]


def _told() -> list[Column]:
    """inferred and null_rate, from tallies and unique_count."""
    n = F.greatest(F.col("present"), F.lit(1))
    inferred = (
        F.when(F.col("emails") / n > 0.7, "email")
        .when(F.col("phones") / n > 0.7, "phone")
        .when(F.col("numbers") / n > 0.7, "number")
        .when(F.col("dates") / n > 0.6, "date")
        .when((F.col("unique_count") <= 8) & (F.col("unique_count") / n < 0.4), "enum")
        .when(F.col("ids") / n > 0.8, "id")
        .otherwise("string")
    )
    return [inferred.alias("inferred"), F.when(F.col("rows") > 0, 1 - F.col("present") / F.col("rows")).otherwise(F.lit(1.0)).alias("null_rate")]


def profile_columns(cells: DataFrame, samples: int = 8) -> DataFrame:
    """file_ord, file_name, col_ord, header, samples, rows, present, null_rate, unique_count, inferred.

    One aggregation over cells, and one over the first `samples` present values of each column, which a window finds; no
    column's values are ever collected. Ratios are over present values.
    """
    keys = ["file_ord", "file_name", "col_ord", "header"]
    there = ~is_blank(F.col("value"))
    v = F.when(there, F.col("value"))
    counted = cells.groupBy(*keys).agg(*_tallies(v), F.count_distinct(F.lower(js_trim(v))).alias("unique_count"))
    order = Window.partitionBy(*keys).orderBy("row_idx")
    first = cells.filter(there).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= samples)
    shown = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]).alias("samples"))
    out = counted.select("*", *_told()).join(shown, keys, "left")
    return out.select(*keys, F.coalesce("samples", F.expr("cast(array() as array<string>)")).alias("samples"), "rows", "present", "null_rate", "unique_count", "inferred")


#: A sketch of distinct values has 2**SKETCH buckets: a relative error of 0.8 % (one standard deviation), in 16 KB.
SKETCH = 14


def sketch_columns(cells: DataFrame, samples: int = 8) -> DataFrame:
    """A load's profiles as they can be kept and merged: file_name, col_ord, header, tallies, `distinct` (a sketch) and
    `firsts` (file_ord, row_idx, value of the first present values)."""
    keys = ["file_name", "col_ord", "header"]
    there = ~is_blank(F.col("value"))
    v = F.when(there, F.col("value"))
    counted = cells.groupBy(*keys).agg(*_tallies(v), F.hll_sketch_agg(F.lower(js_trim(v)), SKETCH).alias("distinct"))
    order = Window.partitionBy(*keys).orderBy("file_ord", "row_idx")
    first = cells.filter(there).withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= samples)
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("file_ord", "row_idx", "value"))).alias("firsts"))
    return counted.join(shown, keys, "left")


def merged_sketches(sketches: DataFrame, samples: int = 8) -> DataFrame:
    """Sketches of several loads, as one of all their rows. Order and grouping don't matter."""
    keys = ["file_name", "col_ord", "header"]
    tallies = [c for c in sketches.columns if c not in (*keys, "distinct", "firsts")]
    met = sketches.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in tallies], F.hll_union_agg("distinct", False).alias("distinct"), F.collect_list("firsts").alias("lists"))  # one list a load
    return met.withColumn("firsts", F.slice(F.array_sort(F.flatten("lists")), 1, samples)).drop("lists")


def profiles_of(sketches: DataFrame) -> DataFrame:
    """Profiles like profile_columns', of which unique_count is an estimate."""
    counted = sketches.withColumn("unique_count", F.when(F.col("present") > 0, F.hll_sketch_estimate("distinct")).otherwise(F.lit(0)).cast("long"))
    shown = F.coalesce(F.transform("firsts", lambda x: x["value"]), F.expr("cast(array() as array<string>)")).alias("samples")
    return counted.select("*", *_told()).select("file_name", "col_ord", "header", shown, "rows", "present", "null_rate", "unique_count", "inferred")
