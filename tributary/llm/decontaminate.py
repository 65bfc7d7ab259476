"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned for in all training windows.

Windows of a document are found by rolling hashes over a whole batch at once. A benchmark of up to PIECE_BYTES is broadcast
as arrays that are built once: hashes are looked up in the sorted set, and every hit is verified word by word. Of a larger
one a bit table of bounded size is broadcast, which the same single scan screens documents by; windows that it lets through
meet the benchmark's in a join on their words. Both give the same rows.

Defined results: a null text has no words; an item without words has no window; item rows with equal ids count once,
items with equal texts each by their own id, a null item_id not at all; an empty benchmark leaves all documents clean;
repeated document rows each give a row, also where the id is null; an empty documents table gives an empty result; texts
of any length are read whole; other columns, whatever their names, play no part, and clean_documents returns them as they
are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import Table, ascii_set, bit_table, bits_for, bytes_of, columns, give_back, lower_bytes, mix64, range_hashes, runs, slices, text_of, without

WINDOW = 13
#: Bytes of benchmark text whose windows are broadcast at most.
PIECE_BYTES = 2 << 20
#: Bytes of text whose words are held at once: some forty bytes of arrays stand for each.
SLICE = 1 << 20

IS_WORD = np.ones(256, bool)
IS_WORD[:128] = ascii_set("0123456789abcdefghijklmnopqrstuvwxyz")[:128]


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: where words begin and end, and how many words stand before each text."""
    a, b = runs(IS_WORD[data], starts)
    return a, b, np.searchsorted(a, starts)


def roll(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word hashes, in order."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    return mix64(out + np.uint64(n))


def window_starts(before: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, first words) of all windows of items, by length; before: words before each item, and of all."""
    count = np.diff(before)
    length = np.minimum(count, window)
    for n in np.unique(length[length > 0]).tolist():
        of = np.flatnonzero(length == n)
        many = count[of] - n + 1
        yield n, np.repeat(before[:-1][of] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())


class Windows:
    """Windows of items: by length, their sorted hashes and first words; the items' words, to verify hits by."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        self.items = [item for item, _ in items]
        data, starts = bytes_of(pa.array([text for _, text in items], pa.string()))
        data = lower_bytes(data)
        self.a, self.b, self.before = words_of(data, starts)
        self.raw = data.tobytes()
        h = range_hashes(data, self.a, self.b)
        self.by_length = []
        for n, first in window_starts(self.before, window):
            whole = roll(h, n)[first]
            order = np.argsort(whole, kind="stable")
            self.by_length.append((n, whole[order], first[order]))

    def words(self, first: int, n: int) -> list[bytes]:
        return [self.raw[x:y] for x, y in zip(self.a[first : first + n].tolist(), self.b[first : first + n].tolist())]

    def hits(self, h: np.ndarray, before: np.ndarray, word) -> Iterator[tuple[int, int, list]]:
        """(first word, length, items) of every verified occurrence within a text; word(i) gives the i-th word's bytes."""
        for n, whole, first in self.by_length:
            near, at = looked_up(h, n, before, whole)
            for i, k in zip(near.tolist(), at.tolist()):
                have = [word(i + j) for j in range(n)]
                end = int(np.searchsorted(whole, whole[k], "right"))  # windows whose hashes are equal stand side by side
                found = [int(x) for x in first[k:end] if self.words(int(x), n) == have]
                if found:
                    yield i, n, [self.items[int(np.searchsorted(self.before, x, "right")) - 1] for x in found]


def inside(h: np.ndarray, n: int, before: np.ndarray) -> np.ndarray:
    """First words of all runs of n words within one text; before: words before each text but the first."""
    first = np.arange(max(0, len(h) - n + 1))
    return first[np.searchsorted(before, first, "right") == np.searchsorted(before, first + n - 1, "right")]


def looked_up(h: np.ndarray, n: int, before: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of a text's runs of n words whose hash is in the sorted set, and where there."""
    rolled = roll(h, n)
    if not len(rolled):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(whole, rolled), len(whole) - 1)
    near = np.flatnonzero(whole[at] == rolled)
    near = near[np.searchsorted(before, near, "right") == np.searchsorted(before, near + n - 1, "right")]
    return near, at[near]


def _spans(hit: np.ndarray, before: np.ndarray, n: int) -> list[list[dict]]:
    """Of each text the runs of hit words; hit: how many more or fewer windows cover a word than the one before it."""
    first, last = runs(np.cumsum(hit[:-1]) > 0, before)
    owner = np.searchsorted(before[1:], first, "right")
    spans: list[list] = [[] for _ in range(n)]
    for d, x, y in zip(owner, first - before[owner], last - before[owner]):
        spans[d].append({"first": int(x), "last": int(y)})
    return spans


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of(docs).alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")


def _scan_broadcast(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()
    item_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    shared = docs.sparkSession.sparkContext.broadcast(Windows([(r[0], r[1]) for r in items.collect()], window))  # PIECE_BYTES at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = shared.value
        for batch in batches:
            for rows in slices(batch, most=SLICE):
                ids, ths, texts = columns(rows, "doc_id", "th", "text")
                data, starts = bytes_of(texts)
                data = lower_bytes(data)
                a, b, before = words_of(data, starts)
                hit = np.zeros(len(a) + 1, np.int32)
                found: list[set] = [set() for _ in range(len(ids))]
                for i, n, items in ways.hits(range_hashes(data, a, b), before[1:-1], lambda k: data[a[k] : b[k]].tobytes()):
                    hit[i] += 1
                    hit[i + n] -= 1
                    found[int(np.searchsorted(before[1:], i, "right"))].update(items)
                out = [ids, ths, pa.array(np.diff(before), pa.int64()), pa.array(_spans(hit, before, len(ids)), SPANS), pa.array([sorted(x, key=str) for x in found], pa.list_(item_type))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "th", "n_words", "spans", "items"])
        give_back()

    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {name}, th long, n_words long, spans array<struct<first:long,last:long>>, items array<{'long' if item_type == pa.int64() else 'string'}>")


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, n, h, words: each window of each item, its words joined by spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, most=SLICE):
                ids, texts = columns(rows, "item_id", "text")
                data, starts = bytes_of(texts)
                data = lower_bytes(data)
                a, b, before = words_of(data, starts)
                h = range_hashes(data, a, b)
                raw = data.tobytes()
                for n, first in window_starts(before, window):
                    joined = [b" ".join(raw[a[k] : b[k]] for k in range(x, x + n)).decode() for x in first.tolist()]
                    own = ids.take(pa.array(np.searchsorted(before, first, "right") - 1))
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.full(len(first), n, np.int32)), pa.array(roll(h, n)[first].view(np.int64)), pa.array(joined, pa.string())], ["item_id", "n", "h", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(cut, f"item_id {kind}, n int, h long, words string")


def _scan_joined(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    ways = Table(_item_windows(items, window).groupBy("n", "h", "words").agg(F.collect_set("item_id").alias("items")), "windows").df
    lengths = [r[0] for r in ways.select("n").distinct().collect()]  # `window` of them at most
    bits = bits_for(ways.count())
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(ways.select(F.shiftrightunsigned("h", 64 - bits).alias("h")), bits, hashed=True))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for rows in slices(batch, most=SLICE):
                uids, ids, ths, texts = columns(rows, "uid", "doc_id", "th", "text")
                data, starts = bytes_of(texts)
                data = lower_bytes(data)
                a, b, before = words_of(data, starts)
                h = range_hashes(data, a, b)
                raw = data.tobytes()
                found: list[list] = [[] for _ in range(len(ids))]
                for n in lengths:
                    first = inside(h, n, before[1:-1])
                    slot = (roll(h, n)[first] >> np.uint64(64 - bits)).astype(np.int64)
                    first = first[(marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
                    for x, d in zip(first.tolist(), (np.searchsorted(before, first, "right") - 1).tolist()):
                        found[d].append({"first": x - int(before[d]), "n": n, "words": b" ".join(raw[a[k] : b[k]] for k in range(x, x + n)).decode()})
                kind = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int32()), ("words", pa.string())]))
                yield pa.RecordBatch.from_arrays([uids, ids, ths, pa.array(np.diff(before), pa.int64()), pa.array(found, kind)], ["uid", "doc_id", "th", "n_words", "found"])

    name = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "th", "text").mapInArrow(screen, f"uid long, doc_id {name}, th long, n_words long, found array<struct<first:long,n:int,words:string>>")
    rows = Table(rows, "screened").df  # written, as uids must not change
    hits = rows.select("uid", F.explode("found").alias("w")).select("uid", "w.first", "w.n", "w.words").join(ways.select("n", "words", "items"), ["n", "words"])
    hits = Table(hits.select("uid", "first", (F.col("first") + F.col("n")).alias("last"), "items"), "hits").df
    spans = joined(hits).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    items = hits.select("uid", F.explode("items").alias("item")).groupBy("uid").agg(F.collect_set("item").alias("items"))
    met = rows.drop("found").join(spans, "uid", "left").join(items, "uid", "left")
    empty = lambda c: F.coalesce(c, F.expr(f"cast(array() as {items.schema['items'].dataType.simpleString() if c == 'items' else 'array<struct<first:bigint,last:bigint>>'})"))
    return met.select("doc_id", "th", "n_words", empty("spans").alias("spans"), empty("items").alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, piece: int = PIECE_BYTES) -> DataFrame:
    """doc_id, th, n_words, spans (array of first word, last word + 1 of hit runs), items (array of item_id)."""
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return (_scan_broadcast if size <= piece else _scan_joined)(_read(docs), items, window)


def joined(hits: DataFrame) -> DataFrame:
    """uid, first, last: the spans of each document, those that touch or overlap made one. They are read in order, none held
    with the others of its document."""
    by = Window.partitionBy("uid").orderBy("first", "last")
    apart = F.col("first") > F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    told = hits.select("uid", "first", "last").distinct().withColumn("new", F.coalesce(apart, F.lit(True)).cast("long"))
    return told.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("uid", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def judge(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, piece: int = PIECE_BYTES) -> DataFrame:
    """doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs, benchmark, window=window, piece=piece)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, piece: int = PIECE_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all columns."""
    bad = judge(docs, benchmark, window=window, piece=piece).filter("contaminated").select("doc_id", "th").distinct()
    return without(docs, Table(bad, "contaminated").df)


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first word, last word + 1) and what stands between those words."""
    data, starts = bytes_of(pa.array([text or ""], pa.string()))
    a, b, _ = words_of(lower_bytes(data), starts)
    raw, out, at = data.tobytes(), [], 0
    for x, y in spans:
        out.append(raw[at : a[x]])
        at = b[y - 1]
    return b"".join([*out, raw[at:]]).decode()


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(ws[k:k + n - 1], ' ') AS w FROM (SELECT *, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - n + 2)) AS r(k)),
lengths AS (SELECT DISTINCT n FROM i),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w FROM d, lengths, unnest(range(1, len(ws) - n + 2)) AS r(k)),
hits AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN i ON dw.n = i.n AND dw.w = i.w),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(k, k + n)) AS r(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
