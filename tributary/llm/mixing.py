"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

All of it is DataFrame code. Documents meet their source's figures in (source, bucket) groups, of which a hot source
has as many as any other, so no task holds a source.

Defined results: a null text has size 0; a null source is a source of its own, ranked last; a null or repeated doc_id
is a document like any other (equal ids share a bucket); a source whose documents are all empty gets target 0; an empty
table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import SPACE, Table, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2.0
BUCKETS = 4096
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(rf"[^{SPACE}]+"), F.lit(0))).cast("long")


def water_levels(sources: DataFrame, weights: tuple, share: float, epochs: float) -> DataFrame:
    """sources(source, source_size) with target. One row per source is all that is ever ordered here.

    Of sources sorted by cap / weight, those before some k stand at their caps and the rest share what is left by
    weight: level_k = (total - caps before k) / (weights from k on). The true level is the greatest level_k that the
    k-th source can take without passing its cap.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("caps_before", F.sum("cap").over(before) - F.col("cap"))
        .withColumn("weights_before", F.sum("weight").over(before) - F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("all_weights", F.sum("weight").over(every))
        .withColumn("level", (F.col("total") - F.col("caps_before")) / (F.col("all_weights") - F.col("weights_before")))
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    )
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("water")))
    return filled.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted.

    A source takes floor(target / size) whole repetitions of every document, and of the rest of its target the
    documents of its first buckets in seeded order, the last of those buckets in part: a share of each document.
    """
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    sized = Table(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text_of(docs)).alias("size")), "sizes").df
    sized = sized.withColumn("bucket", F.pmod(bucket, F.lit(buckets)).cast("int"))
    filled = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sources = water_levels(filled.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s, b = sources.alias("s"), filled.withColumn("before", F.sum("bucket_size").over(upto) - F.col("bucket_size")).alias("b")
    parts = (
        b.join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
        .select("b.source", "b.bucket", "b.bucket_size", "b.before", "s.source_size", "s.target")
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size") - F.col("before"))
        .withColumn("part", F.when(F.col("bucket_size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rest") / F.col("bucket_size")))).otherwise(F.lit(0.0)))
        .alias("p")
    )
    taken = F.col("p.whole") * F.col("d.size") + F.floor(F.col("p.part") * F.col("d.size")).cast("long")
    return (
        sized.alias("d")
        .join(parts, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket")))
        .select("d.doc_id", "d.size", "p.source_size", "p.target", taken.alias("taken"))
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % 4096 AS bucket
  FROM {documents}),
filled AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS bucket_size FROM sized GROUP BY ALL),
sources AS (SELECT source, CAST(sum(bucket_size) AS BIGINT) AS source_size FROM filled GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
weighed AS (SELECT *, CAST([3, 1, 2][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2.0 AS DOUBLE) * source_size AS cap FROM ranked),
rated AS (SELECT *, cap / weight AS ratio FROM weighed),
summed AS (
  SELECT *, sum(cap) OVER w - cap AS caps_before, sum(weight) OVER w - weight AS weights_before,
         CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS all_weights
  FROM rated WINDOW w AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
levels AS (SELECT *, (total - caps_before) / (all_weights - weights_before) AS level FROM summed),
water AS (SELECT max(CASE WHEN level <= ratio THEN level END) AS water FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target
  FROM levels, water),
parts AS (
  SELECT b.source, b.bucket, b.bucket_size, s.source_size, s.target,
         CAST(sum(b.bucket_size) OVER (PARTITION BY b.source ORDER BY b.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - b.bucket_size AS before,
         CASE WHEN s.source_size > 0 THEN CAST(floor(s.target / s.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM filled b JOIN targets s ON b.source IS NOT DISTINCT FROM s.source),
shares AS (
  SELECT *, CASE WHEN bucket_size > 0 THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (target - whole * source_size - before) / bucket_size)) ELSE 0 END AS part
  FROM parts)
SELECT d.doc_id, d.size, p.source_size, p.target, p.whole * d.size + CAST(floor(p.part * d.size) AS BIGINT) AS taken
FROM sized d JOIN shares p ON d.source IS NOT DISTINCT FROM p.source AND d.bucket = p.bucket
"""
