"""Line dedup: hashes of lines, ranged and counted, decide per-document bitmaps of the lines to keep.

DataFrame code only. A line's hash (two 64-bit words) leaves its document once, is counted first in salted groups on
the map side, then range-partitioned: a line that every document has reaches its range as a few pre-summed rows. In
each range the first occurrence by (document, position) is streamed out with the count. What goes back to documents are
bitmaps, one 64-bit word for each run of 64 lines that loses any; runs that lose none have no word, which is the
compression. Text moves once, to meet its bitmap.

Defined results: a null or empty text is one empty line; lines that are empty after stripping are never dropped; a row
counts as a document, so a repeated row counts again; a document that loses all lines keeps the empty text; an empty
table gives an empty result; texts of any length are split whole; other columns are returned untouched, but for input
columns that are named as the results are (n_lines, n_dropped, kept), whose place these take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import SPACES, lower_az, text_of

LEAST_DOCUMENTS = 10
SALTS = 16
#: Lines of a text up to which expressions over its arrays do, which compare lines with lines. Longer texts are taken apart
#: into rows, one a line, so that time grows with their length.
MANY_LINES = 1000


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hashes(text: Column) -> Column:
    """Of each line: its position and the hash of its key, null where the key is empty."""

    def one(line: Column, at: Column) -> Column:
        key = F.btrim(line, F.lit(SPACES))
        low = F.xxhash64(key)
        return F.struct(at.cast("int").alias("pos"), F.when(key != "", low).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))

    return F.transform(_lines(lower_az(text)), one)


def is_long(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) >= MANY_LINES


def frequent_lines(rows: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """rows(doc_id, th, long, at: the lines' hashes) to (h1, h2, n, first) of lines found in `least` documents or more."""
    own = F.transform(F.filter("at", lambda x: x["h1"].isNotNull()), lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), *([x["pos"].alias("pos")] if keep_first else [])))
    if keep_first:  # the first position of a key in its document is the least
        lines = rows.select("doc_id", "th", F.explode(own).alias("x")).select("doc_id", "th", "x.*").groupBy("doc_id", "th", "h1", "h2").agg(F.min("pos").alias("pos"))
        more = [F.min(F.struct("doc_id", "th", "pos")).alias("first")]
    else:
        short = rows.filter("not long").select("doc_id", "th", F.explode(F.array_distinct(own)).alias("x"))
        long = rows.filter("long").withColumn("row", F.monotonically_increasing_id()).select("doc_id", "th", "row", F.explode(own).alias("x")).distinct()
        lines, more = short.unionByName(long.drop("row")).select("doc_id", "th", "x.*"), []
    salted = lines.groupBy("h1", "h2", F.pmod(F.col("th"), F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), *more)
    ranged = salted.repartitionByRange("h1", "h2")
    return ranged.groupBy("h1", "h2").agg(F.sum("n").alias("n"), *([F.min("first").alias("first")] if keep_first else [])).filter(F.col("n") >= least)


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), long, at."""
    text = text_of(docs)
    return docs.select("doc_id", F.xxhash64(text).alias("th"), is_long(text).alias("long"), _hashes(text).alias("at"))


def places(rows: DataFrame, found: DataFrame, keep_first: bool) -> DataFrame:
    """w.doc_id, w.th, w.pos of the lines that go."""
    where = rows.select("doc_id", "th", F.explode("at").alias("x")).select("doc_id", "th", "x.*").filter(F.col("h1").isNotNull()).alias("w")
    f = found.alias("f")
    hit = where.join(f, (F.col("w.h1") == F.col("f.h1")) & (F.col("w.h2") == F.col("f.h2")))
    if keep_first:
        hit = hit.filter(~(F.col("w.doc_id").eqNullSafe(F.col("f.first.doc_id")) & (F.col("w.th") == F.col("f.first.th")) & (F.col("w.pos") == F.col("f.first.pos"))))
    return hit


def bitmaps(hit: DataFrame) -> DataFrame:
    """doc_id, th, bits: map of 64-line run to the lines of it that go."""
    words = hit.groupBy("w.doc_id", "w.th", F.shiftright(F.col("w.pos"), 6).alias("run")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("w.pos").bitwiseAND(63))).alias("bits"))
    return words.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("run", "bits"))).alias("bits"))


def drop_bitmaps(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """doc_id, th (hash of the text), bits: map of 64-line run to the lines of it that go."""
    rows = line_hashes(docs)
    return bitmaps(places(rows, frequent_lines(rows, least, keep_first), keep_first))


def _long_texts(long: DataFrame, gone: DataFrame) -> DataFrame:
    """l_id, l_th, l_kept, l_n of each long text, of which lines at places (doc_id, th, pos) of gone go: a row a line."""
    texts = long.select("doc_id", F.xxhash64(text_of(long)).alias("th"), text_of(long).alias("text")).dropDuplicates(["doc_id", "th"])
    lines = texts.select("doc_id", "th", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).alias("d")
    g = gone.select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), F.col("pos").alias("g_pos")).distinct()
    met = lines.join(g, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("th") == F.col("g_th")) & (F.col("pos") == F.col("g_pos")), "left")
    stays = F.when(F.col("g_pos").isNull(), F.struct("pos", "line"))
    whole = met.groupBy(F.col("doc_id").alias("l_id"), F.col("th").alias("l_th")).agg(F.array_sort(F.collect_list(stays)).alias("left"), F.count(F.lit(1)).alias("l_n"))
    return whole.select("l_id", "l_th", "l_n", F.size("left").alias("l_left"), F.array_join(F.transform("left", lambda x: x["line"]), "\n").alias("l_kept"))


def dedup_lines(docs: DataFrame, *, least: int = LEAST_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """All columns of docs, and n_lines, n_dropped, kept: the text without the lines that go."""
    names = docs.columns
    text = text_of(docs)
    rows = line_hashes(docs)
    found = frequent_lines(rows, least, keep_first)
    b = bitmaps(places(rows.filter("not long"), found, keep_first)).alias("b")
    key = lambda df, t: df.select(F.struct("*").alias("row"), F.col("doc_id").alias("k_id"), F.xxhash64(t).alias("k_th")).alias("d")
    short = key(docs.filter(~is_long(text)), text)
    joined = short.join(b, F.col("d.k_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.k_th") == F.col("b.th")), "left").select("d.row", "b.bits")
    lines = _lines(F.coalesce(F.col("row.text").cast("string"), F.lit("")))

    def stays(line: Column, at: Column) -> Column:
        word = F.try_element_at(F.col("bits"), F.shiftright(at.cast("int"), 6))
        return F.coalesce(F.call_function("shiftright", word, at.cast("int").bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")), F.lit(0).cast("long")) == 0

    kept = F.when(F.col("bits").isNull(), lines).otherwise(F.filter(lines, stays))
    out = joined.select("row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
    out = out.select("row", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept"))
    long = docs.filter(is_long(text))
    gone = places(rows.filter("long"), found, keep_first).select("w.doc_id", "w.th", "w.pos")
    left = _long_texts(long, gone)
    met = key(long, text_of(long)).join(left, F.col("d.k_id").eqNullSafe(F.col("l_id")) & (F.col("d.k_th") == F.col("l_th")))
    out = out.unionByName(met.select("d.row", F.col("l_n").cast("long").alias("n_lines"), (F.col("l_n") - F.col("l_left")).cast("long").alias("n_dropped"), F.col("l_kept").alias("kept")))
    return out.select(*[F.col("row")[c].alias(c) for c in names if c not in ("n_lines", "n_dropped", "kept")], "n_lines", "n_dropped", "kept")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, l[pos] AS line, translate(trim(l[pos], e'\x20\x09\x0A\x0B\x0C\x0D'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(pos)),
gone AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN g.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON l.key = g.key
GROUP BY doc_id
"""
