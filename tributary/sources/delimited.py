"""Delimited extracts as frames of strings with row numbers.

`read_csv` is Spark's reader for well-formed input; it splits files where no cell holds a line break. `read_csv_exact`
follows spreadsheet exporters to the letter: a quote anywhere toggles, blank lines go before the header is chosen, of equal
headers the last counts. It reads a file in chunks of any cut: a first pass counts each chunk's quotes, whose sums say
whether a chunk begins within quotes; then each chunk gives the records that begin in it, the last of which may end in
the next.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tributary.functions.text import js_trim
from tributary.sources.files import listed, opened

FORMAT = "tributary_delimited"
#: Bytes of a file that are one task's.
CHUNK = 8 << 20
QUOTE, LF, CR = b'"'[0], b"\n"[0], b"\r"[0]
#: Rows that leave a task at once.
BATCH = 10_000

_JS_SPACE = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def parse_rows(text: str) -> tuple[list[str], list[list[str]]]:
    """(headers, rows) of one file's text; cells trimmed, short rows filled, long ones cut."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    table = [r for r in _fields(text) if any(c.strip(_JS_SPACE) for c in r)]
    if not table:
        return [], []
    heads = [h.strip(_JS_SPACE) for h in table[0]]
    last = {h: i for i, h in enumerate(heads)}
    names = list(dict.fromkeys(heads))
    cell = lambda r, i: r[i].strip(_JS_SPACE) if i < len(r) else ""
    return names, [[cell(r, last[h]) for h in names] for r in table[1:]]


def _fields(text: str) -> Iterator[list[str]]:
    """Records of raw cells. Stretches between quotes alternate; a doubled quote within one is a quote."""
    row, cell = [], []
    pieces = text.split('"')
    for i, piece in enumerate(pieces):
        if i % 2:  # within quotes; an empty stretch outside before the next one was a doubled quote
            cell.append(piece)
            continue
        if piece == "" and 0 < i < len(pieces) - 1:
            cell.append('"')
            continue
        lines = piece.split("\n")
        for j, line in enumerate(lines):
            first, *more = line.split(",")
            cell.append(first)
            for part in more:
                row.append("".join(cell))
                cell = [part]
            if j < len(lines) - 1:
                row.append("".join(cell))
                yield row
                row, cell = [], []
    row.append("".join(cell))
    yield row


def with_row_numbers(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Rows numbered from 0 in the order of partitions and of rows in them: a count for each partition, then numbers within
    each; rows are neither sorted nor brought together. Of one file that is its reading order."""
    at = df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    counts = at.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return at.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within).drop("_part", "_at", "_before")


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """multi_line: cells may hold line breaks, so that a file is one task; without them Spark splits large files."""
    raw = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False).csv(path)
    trimmed = raw.select(*[F.coalesce(js_trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in raw.columns])
    full = trimmed.filter(F.greatest(*[F.length(F.col(f"`{c}`")) for c in trimmed.columns], F.lit(0)) > 0)
    return with_row_numbers(full)


@dataclass
class Chunk(InputPartition):
    at: int
    start: int
    end: int
    quoted: bool

    def __init__(self, at: int, start: int, end: int, quoted: bool):
        self.at, self.start, self.end, self.quoted = at, start, end, quoted


def record_starts(data: bytes, quoted: bool) -> np.ndarray:
    """Places in data, but for its first, at which a record begins: behind a line break that stands in no quotes."""
    raw = np.frombuffer(data, np.uint8)
    outside = (np.cumsum(raw == QUOTE) + quoted) % 2 == 0
    after = np.append(raw[1:], 0)
    breaks = outside & ((raw == LF) | (raw == CR) & (after != LF))
    breaks[-1:] = False  # what follows the last byte isn't known
    return np.flatnonzero(breaks) + 1


def chunk_text(stream, size: int, chunk: Chunk, ahead: int = 1 << 16) -> str:
    """The text of the records that begin in a chunk; empty if none does."""
    first = max(chunk.start - 1, 0)

    def read(a: int, b: int) -> bytes:
        stream.seek(a)
        return stream.read(min(b, size) - a)

    data = read(first, chunk.end)
    before = chunk.quoted != (chunk.start > 0 and data[:1] == b'"')  # as of the byte before the chunk
    starts = record_starts(data, before) + first
    if chunk.start == 0:
        starts = np.append(0, starts)
    starts = starts[(starts >= chunk.start) & (starts < chunk.end)]
    if not len(starts):
        return ""
    quoted = (before + data[:-1].count(QUOTE)) % 2 == 1  # as of the byte before the chunk's end
    at, tail = max(chunk.end - 1, 0), []
    while True:  # on to the end of the last record
        more = read(at, at + ahead)
        found = record_starts(more, quoted)
        found = found[found + at >= chunk.end]
        if len(found) or at + len(more) >= size:
            tail.append(more[: found[0]] if len(found) else more)
            break
        tail.append(more[:-1])
        quoted = (quoted + more[:-1].count(QUOTE)) % 2 == 1
        at += len(more) - 1
    whole = data[int(starts[0]) - first : max(chunk.end - 1, 0) - first] + b"".join(tail)
    text = whole.decode("utf-8", "replace")
    return text.removeprefix("\ufeff") if starts[0] == 0 else text


def cells_of(text: str) -> Iterator[list[str]]:
    """Trimmed cells of each record that holds anything."""
    for row in _fields(text.replace("\r\n", "\n").replace("\r", "\n")):
        cells = [c.strip(_JS_SPACE) for c in row]
        if any(cells):
            yield cells


class Reader(DataSourceReader):
    """(at, odd): whether a chunk's quotes are odd in number; or (cells) of each record."""

    def __init__(self, path: str, chunk: int, odd: str | None):
        self.path, self.chunk, self.odd = path, chunk, odd

    def partitions(self) -> list[Chunk]:
        ((_, size),) = listed(self.path)
        starts = list(range(0, max(size, 1), self.chunk))
        odd = [c == "1" for c in self.odd] if self.odd is not None else [False] * len(starts)
        within = [False, *(n % 2 == 1 for n in accumulate(odd))]
        return [Chunk(k, a, min(a + self.chunk, size), within[k]) for k, a in enumerate(starts)]

    def read(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        with opened(self.path) as stream:
            if self.odd is None:
                stream.seek(chunk.start)
                odd = stream.read(chunk.end - chunk.start).count(QUOTE) % 2 == 1
                yield pa.RecordBatch.from_pydict({"at": pa.array([chunk.at], pa.int32()), "odd": [odd]})
                return
            rows: list[list[str]] = []
            for cells in cells_of(chunk_text(stream, stream.size(), chunk)):
                rows.append(cells)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pydict({"cells": pa.array(rows, pa.list_(pa.string()))})
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pydict({"cells": pa.array(rows, pa.list_(pa.string()))})


class DelimitedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "cells array<string>" if "odd" in self.options else "at int, odd boolean"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("chunk", CHUNK)), self.options.get("odd"))


def read_csv_exact(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """One file, by the exporters' rules. The driver sees a flag a chunk, and the header."""
    if len(listed(path)) != 1:
        raise ValueError(f"{path} is not one file")
    spark.dataSource.register(DelimitedSource)
    source = spark.read.format(FORMAT).options(path=path, chunk=chunk)
    odd = "".join("1" if r["odd"] else "0" for r in sorted(source.load().collect()))
    rows = spark.read.format(FORMAT).options(path=path, chunk=chunk, odd=odd).load()
    found = rows.take(1)
    heads = list(found[0]["cells"]) if found else []
    last = {h: i for i, h in enumerate(heads)}
    numbered = with_row_numbers(rows).filter("row_idx > 0")  # the first is the header
    cells = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(h) for h, i in last.items()]
    return numbered.select(*cells, (F.col("row_idx") - 1).alias("row_idx"))


def read_upload(spark: SparkSession, name: str, text: str | None = None, base64_data: str | None = None) -> DataFrame:
    """An upload: a workbook by its extension (base64 only), anything else as delimited text, plain or base64."""
    from tributary.sources.workbook import sheet_rows

    if name.lower().endswith((".xlsx", ".xls")):
        if base64_data is None:
            raise ValueError(f"{name}: a workbook needs its bytes")
        heads, rows = sheet_rows(base64.b64decode(base64_data))
    else:
        heads, rows = parse_rows(text if text is not None else base64.b64decode(base64_data or "").decode("utf-8"))
    return records(spark, heads, rows)


def records(spark: SparkSession, heads: list[str], rows: list[list[str]]) -> DataFrame:
    """An in-memory source."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*[StructField(h, StringType()) for h in heads], StructField("row_idx", LongType())])
    return spark.createDataFrame([[*r, i] for i, r in enumerate(rows)], schema)


def usable(sources: list[DataFrame]) -> list[DataFrame]:
    """Sources that have rows; none at all is an error."""
    kept = [s for s in sources if not s.isEmpty()]
    if not kept:
        raise ValueError("No usable rows")
    return kept
