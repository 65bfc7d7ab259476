"""Exact dedup against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a table of groups (digest, smallest doc_id, rows) that never changes, with one binary-fuse filter for each
bucket of its digests. An incoming batch is grouped by itself first. Its digests probe the filters; those that a filter
lets through join the snapshot's exact buckets, where the representatives' bytes are compared. Filters say no for nearly
all new digests, so the exact join and the byte check see only true repeats and about 1 in 256 others.

Defined results: a null text counts as empty; all empty or blank-only texts that normalise alike are equal; the row with
the smallest doc_id of a group stays, a null doc_id after all others; of rows that repeat one doc_id and text exactly one
stays; a text of any length is compared whole; an empty table gives an empty result; other columns are returned untouched
by dedup_documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import SPACE, Table, bit_table, bits_for, mix64, only_marked, text_of, without

#: Digests of a snapshot in a filter's bucket at most, about.
BUCKET_KEYS = 200_000
LEAST_BUCKETS = 64


class BinaryFuse:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints: 9 to 10 bits a key, no false negatives."""

    def __init__(self, seed: int, segment: int, slots: np.ndarray):
        self.seed, self.segment, self.slots = seed, segment, slots

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots of each key, in three neighbouring segments, and its fingerprint."""
        h = mix64(keys ^ np.uint64(seed))
        first = ((h >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
        mask = np.uint64(segment - 1)
        g = mix64(h + np.uint64(0x9E3779B97F4A7C15))
        at = np.stack([first * np.uint64(segment) + (g & mask), (first + np.uint64(1)) * np.uint64(segment) + ((g >> np.uint64(20)) & mask), (first + np.uint64(2)) * np.uint64(segment) + ((g >> np.uint64(40)) & mask)])
        return at.astype(np.int64), (h & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << int(max(2, min(18, np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        room = 1.125 if n > 100_000 else 1.125 + 0.875 * np.log(100_000 / max(n, 2)) / np.log(100_000) + 0.25
        starts = max(1, int(np.ceil(n * room / segment)))
        seed = 0
        while True:
            seed += 1
            at, prints = cls._places(keys, mixed := int(mix64(np.array([seed], np.uint64))[0]), segment, starts)
            if (order := cls._peel(at, (starts + 2) * segment)) is not None:
                break
            if seed % 20 == 0:
                starts += max(1, starts // 8)
        slots = np.zeros((starts + 2) * segment, np.uint8)
        for which, slot in reversed(order):
            others = slots[at[0, which]] ^ slots[at[1, which]] ^ slots[at[2, which]] ^ slots[slot]
            slots[slot] = prints[which] ^ others
        return cls(mixed, segment, slots)

    @staticmethod
    def _peel(at: np.ndarray, m: int) -> list | None:
        """Rounds of keys that have a slot to themselves once all earlier rounds are gone; None if some never do."""
        n = at.shape[1]
        count = np.bincount(at.ravel(), minlength=m)
        owner = np.zeros(m, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        left, order = n, []
        single = np.flatnonzero(count == 1)
        while len(single):
            which, pick = np.unique(owner[single], return_index=True)
            slot = single[pick]
            order.append((which, slot))
            left -= len(which)
            for row in at[:, which]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, which)
            touched = np.unique(at[:, which])
            single = touched[count[touched] == 1]
        return order if left == 0 else None

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._places(keys.astype(np.uint64), self.seed, self.segment, len(self.slots) // self.segment - 2)
        return (self.slots[at[0]] ^ self.slots[at[1]] ^ self.slots[at[2]]) == prints


def normal_text(docs: DataFrame) -> Column:
    return F.regexp_replace(text_of(docs), rf"[{SPACE}]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, uid (which tells repeated rows apart), th (a hash of the text as it is), digest: SHA-256 of the normalised text."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.xxhash64(text_of(docs)).alias("th"), F.unhex(F.sha2(normal_text(docs), 256)).alias("digest"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "th"))


def groups(batch: DataFrame) -> DataFrame:
    """digest, rows, first: of a batch by itself."""
    return batch.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), _first().alias("first"))


def _key() -> Column:
    """The digest's first 64 bits."""
    return F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")


def build_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """bucket, seed, segment, slots: a filter for each bucket of a snapshot's digests; hashes deal them evenly."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(part["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "seed": [np.array([made.seed], np.uint64).view(np.int64)[0]], "segment": [made.segment], "slots": [made.slots.tobytes()]})

    keyed = snapshot.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), _key().alias("key"))
    return keyed.groupBy("bucket").applyInPandas(build, "bucket int, seed long, segment int, slots binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The groups of incoming that the snapshot's filters don't rule out."""

    def probe(groups: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(groups) or not len(found):
            return pd.DataFrame({"digest": []})
        seed = np.array([found["seed"].iloc[0]], np.int64).view(np.uint64)[0]
        fuse = BinaryFuse(int(seed), int(found["segment"].iloc[0]), np.frombuffer(found["slots"].iloc[0], np.uint8))
        return groups.loc[fuse.holds(groups["key"].to_numpy(np.int64).view(np.uint64)), ["digest"]]

    keyed = incoming.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), _key().alias("key"), "digest")
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest binary")


def same_bytes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Digests of pairs(digest, a, b: doc_ids) whose two documents have the same normalised bytes. A bit table of their ids
    chooses the documents while they are read, so that no other text moves."""
    ids = Table(pairs.select("digest", F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).filter(F.col("id").isNotNull()), "ids").df
    bits = bits_for(ids.count())
    few = only_marked(docs.select("doc_id", text_of(docs).alias("text")), "doc_id", bit_table(ids.select("id"), bits), bits)
    read = few.select("doc_id", normal_text(few).alias("normal"))
    # merged at every size: a plan that broadcasts small inputs alone would say nothing about large ones
    met = read.join(ids.hint("merge"), F.col("doc_id") == F.col("id")).select("digest", "normal").filter(F.unhex(F.sha2("normal", 256)) == F.col("digest"))
    return met.groupBy("digest").agg((F.min("normal") == F.max("normal")).alias("same")).filter("same").select("digest")


def find_groups(docs: DataFrame, *, snapshot: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, uid, digest), (groups: digest, rows, first). snapshot: which rows form the earlier snapshot."""
    taken = snapshot if snapshot is not None else F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = Table(digests(docs).withColumn("old", F.coalesce(taken, F.lit(False))), "digests").df
    old = Table(groups(rows.filter("old")), "snapshot").df
    new = Table(groups(rows.filter("not old")), "batch").df
    buckets = max(LEAST_BUCKETS, -(-max(old.count(), new.count()) // BUCKET_KEYS))
    filters = Table(build_filters(old, buckets), "fuse").df
    maybe = screen(new, filters, buckets)
    pairs = maybe.join(new, "digest").select("digest", F.col("first.doc_id").alias("a"), "rows", "first")
    pairs = pairs.join(old.select("digest", F.col("first.doc_id").alias("b"), F.col("rows").alias("old_rows"), F.col("first").alias("old_first")), "digest")
    pairs = Table(pairs, "positives").df
    proven = same_bytes(docs, pairs)
    # a group whose documents have no id can't be looked up again; its SHA-256 stands alone
    proven = proven.unionByName(pairs.filter("a is null or b is null").select("digest")).distinct()
    both = pairs.join(proven, "digest", "left_semi").select("digest", (F.col("rows") + F.col("old_rows")).alias("rows"), F.least("first", "old_first").alias("first"))
    alone = old.unionByName(new).join(both, "digest", "left_anti")
    # written, so that what joins it starts from exchanges, which adaptive execution can split where a group is hot
    return rows, Table(alone.unionByName(both), "groups").df


def dedup_report(docs: DataFrame, *, snapshot: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, found = find_groups(docs, snapshot=snapshot)
    r, g = rows.alias("r"), found.alias("g")
    met = r.join(g, F.col("r.digest") == F.col("g.digest"))  # a hot group's rows are split by adaptive skew handling
    kept = F.col("r.doc_id").eqNullSafe(F.col("g.first.doc_id")) & (F.col("r.uid") == F.col("g.first.uid"))
    return met.select("r.doc_id", F.col("g.first.doc_id").alias("keep_id"), F.col("g.rows").alias("group_size"), kept.alias("kept"), F.lower(F.hex("r.digest")).alias("text_sha256"))


def dedup_documents(docs: DataFrame, *, snapshot: Column | None = None) -> DataFrame:
    """The rows of docs that stay, with all columns. Only ids and hashes of what goes move, if they are few."""
    rows, found = find_groups(docs, snapshot=snapshot)
    r, g = rows.alias("r"), found.alias("g")
    first = F.col("r.doc_id").eqNullSafe(F.col("g.first.doc_id")) & (F.col("r.th") == F.col("g.first.th"))
    met = Table(r.join(g, F.col("r.digest") == F.col("g.digest")).select("r.doc_id", "r.th", first.alias("stays")), "met").df
    # of rows that repeat both id and text one stays
    again = Table(met.filter("stays").groupBy("doc_id", "th").count().filter("count > 1").select("doc_id", "th"), "again").df
    alone = without(docs, Table(met.filter("not stays").select("doc_id", "th").unionByName(again).distinct(), "gone").df)
    if again.isEmpty():
        return alone
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k_id"), F.xxhash64(text_of(docs)).alias("k_th"))
    once = row.join(again, F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_th") == F.col("th")), "left_semi").groupBy("k_id", "k_th").agg(F.first("row").alias("row"))
    return alone.unionByName(once.select(*[F.col("row")[c].alias(c) for c in docs.columns]))


def build_snapshot(docs: DataFrame, path: str) -> None:
    """Writes a snapshot of docs(doc_id, text): its groups, and a filter for each bucket of their digests."""
    spark = docs.sparkSession
    groups(digests(docs)).write.parquet(f"{path}/groups")
    made = spark.read.parquet(f"{path}/groups")
    build_filters(made, max(LEAST_BUCKETS, -(-made.count() // BUCKET_KEYS))).write.parquet(f"{path}/filters")
    spark.createDataFrame([(max(LEAST_BUCKETS, -(-made.count() // BUCKET_KEYS)),)], "buckets int").write.parquet(f"{path}/buckets")


def dedup_against(batch: DataFrame, earlier: DataFrame, path: str) -> DataFrame:
    """doc_id, keep_id, known (an equal text is in the snapshot), kept, one row per row of the batch.

    earlier(doc_id, text): the snapshot's documents, of which only those that the filters point to are read whole. Ids of
    both tables are of one kind. Groups in the batch that the snapshot doesn't know keep their own first row.
    """
    spark = batch.sparkSession
    old, buckets = spark.read.parquet(f"{path}/groups"), spark.read.parquet(f"{path}/buckets").first()["buckets"]
    rows = Table(digests(batch), "digests").df
    new = Table(groups(rows), "batch").df
    maybe = screen(new, spark.read.parquet(f"{path}/filters"), buckets)
    pairs = maybe.join(new, "digest").select("digest", F.col("first.doc_id").alias("a")).join(old.select("digest", F.col("first.doc_id").alias("b")), "digest")
    pairs = Table(pairs, "positives").df
    texts = batch.select("doc_id", text_of(batch).alias("text")).unionByName(earlier.select("doc_id", text_of(earlier).alias("text")))
    proven = same_bytes(texts, pairs).unionByName(pairs.filter("a is null or b is null").select("digest")).distinct()
    known = pairs.join(proven, "digest", "left_semi").select("digest", F.col("b").alias("known_id"), F.lit(True).alias("known"))
    g = Table(new.join(known, "digest", "left").select("digest", "first", "known_id", F.coalesce("known", F.lit(False)).alias("known")), "groups").df.alias("g")
    met = rows.alias("r").join(g, F.col("r.digest") == F.col("g.digest"))
    return met.select("r.doc_id", F.when(F.col("g.known"), F.col("g.known_id")).otherwise(F.col("g.first.doc_id")).alias("keep_id"), "g.known", (~F.col("g.known") & (F.col("r.uid") == F.col("g.first.uid"))).alias("kept"))


ORACLE = r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM normal
"""
