"""What the corpus operators share: tables in the cluster's shared folder and byte-level text helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.cut import delete, written

#: [\x20\x09-\x0D], the white space of every contract, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

class Table:
    """A table written to the shared folder: it cuts lineage and survives the loss of any executor. By a column's values it
    lies in a folder each, `column=value`, that can be dropped alone."""

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = written(df, name, by)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self, part: str | None = None) -> None:
        """Only when no frame that reads it will run again; frames of what stays are to be read anew."""
        delete(self.spark, f"{self.path}/{part}" if part else self.path)


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def lower_az(c: Column) -> Column:
    """Lower-cases A-Z alone. lower() does just that where all is ASCII, and is far faster than translate()."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


#: Rows whose ids are broadcast at most; beyond that documents meet them in a join.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, gone: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs whose doc_id and hash of the text aren't among gone(doc_id, th), with all columns, nulls being
    equal. Few ids are broadcast, so that no text moves; many are shuffled to the documents."""
    side = gone.select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"))
    side = F.broadcast(side) if gone.count() <= most else side.hint("merge")
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("k_id"), F.xxhash64(text_of(docs)).alias("k_th"))
    left = row.join(side, F.col("k_id").eqNullSafe(F.col("g_id")) & (F.col("k_th") == F.col("g_th")), "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts together hold about `most` bytes, so that work arrays stay small."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    at = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cut = [0, *(np.flatnonzero(np.diff(at)) + 1), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more entry for the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_ODD = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """odd**0 ... odd**(n-1) modulo 2**64, or of its inverse."""
    key = "inverse" if inverse else "plain"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(_ODD, -1, 1 << 64) if inverse else _ODD
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = np.uint64(pow(base, done, 1 << 64))
            out[done : 2 * done] = out[:done] * step
            done *= 2
        if size > (8 << 20):
            return out[:n]
        have = _powers[key] = out
    return have[:n]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for every (s, e): a polynomial over mixed bytes, taken from prefix sums."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(n), out=total[1:])
    part = (total[ends] - total[starts]) * _power(n + 1, inverse=True)[starts]
    return mix64(part + (ends - starts).astype(np.uint64))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; bytes of other characters are never in that range."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def runs(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a text's end; starts: as bytes_of gives them."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    first = mask & ~before
    first[inner] = mask[inner]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    last = mask & ~after
    last[inner - 1] |= mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def ascii_set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


IS_SPACE = ascii_set(SPACES)


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, and allocators keep what large arrays left."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def power(n: int) -> int:
    return max(0, int(n - 1).bit_length())


#: Bits of a table of ids or hashes, at most: 128 MB.
MOST_ID_BITS = 30


def bit_table(values: DataFrame, bits: int, hashed: bool = False) -> bytes:
    """One bit for each of 2**bits hashes of the one column (or of its values, if they are such hashes): MOST_ID_BITS bound
    it, whatever the data. is_marked reads it by slot; if hashed, bits stand where the values say."""
    slot = F.col(values.columns[0]) + 1 if hashed else F.pmod(F.xxhash64(F.col(values.columns[0])), F.lit(1 << bits))
    rows = values.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    width = 4096
    out = bytearray((1 << bits) // 8 + width)
    for k, m in rows:
        at = (k - 1) * width if k > 0 else (1 << bits) // 8
        out[at : at + width] = m
    return bytes(out)


def bits_for(n: int) -> int:
    """So many that a sixteenth is set, or MOST_ID_BITS."""
    return min(MOST_ID_BITS, max(16, power(16 * n + 1)))


def is_marked(table: np.ndarray, slot: pa.Array) -> np.ndarray:
    s = slot.to_numpy(zero_copy_only=False).astype(np.int64)
    s = np.where(s > 0, s - 1, 8 * (len(table) - 4096))  # bit positions count from 1, 0 standing for itself
    return (table[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def slot_of(name: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(1 << bits)).alias("slot")


def only_marked(rows: DataFrame, name: str, table: bytes, bits: int) -> DataFrame:
    """The rows whose column's bit is set: all that the table was made of and a few others, without a shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            yield batch.drop_columns(["slot"]).filter(pa.array(is_marked(marks, batch.column("slot"))))

    return rows.select("*", slot_of(name, bits)).mapInArrow(work, rows.schema)
