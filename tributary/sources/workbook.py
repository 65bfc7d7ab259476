"""Workbooks (xlsx) as a data source: one partition a workbook, whose first sheet is read row by row.

Only the standard library parses. Cells come as they are stored, with date formats applied to serial days. A sheet's XML is
never held whole: rows are taken from the stream as they end; only the workbook's table of shared strings is kept.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from itertools import islice
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tributary.sources.files import listed, opened

FORMAT = "tributary_workbook"
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Number formats of the standard that show days.
DATE_FORMATS = frozenset((14, 15, 16, 17, 22))
#: Rows that leave a task at once.
BATCH = 5_000


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _shown(raw: str, is_day: bool) -> str:
    try:
        x = float(raw)
    except ValueError:
        return raw
    if is_day:
        return (datetime(1899, 12, 30) + timedelta(days=x)).strftime("%Y-%m-%d")
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _ended(stream: BinaryIO, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag as they end; what was read before them is let go."""
    root = None
    for event, element in ElementTree.iterparse(stream, ("start", "end")):
        root = element if root is None else root
        if event == "end" and element.tag == tag:
            yield element
            root.clear()


def _days(z: zipfile.ZipFile) -> list[bool]:
    """Of each cell style whether it shows a day."""
    if "xl/styles.xml" not in z.namelist():
        return []
    styles = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {f.get("numFmtId"): bool(re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")))) for f in styles.iter(f"{NS}numFmt")}
    xfs = styles.find(f"{NS}cellXfs")
    return [own.get(x.get("numFmtId"), int(x.get("numFmtId") or 0) in DATE_FORMATS) for x in (xfs if xfs is not None else [])]


def table(stream: BinaryIO) -> Iterator[dict[int, str]]:
    """The rows of the first sheet that hold anything, each with its cells by column."""
    with zipfile.ZipFile(stream) as z:
        names = set(z.namelist())
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall(f"{NS}sheets/{NS}sheet")
        if not sheets:
            return
        links = ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next((r.get("Target") for r in links if r.get("Id") == sheets[0].get(f"{REL}id")), "worksheets/sheet1.xml")
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in _ended(f, f"{NS}si")]
        days = _days(z)
        with z.open(path) as f:
            for row in _ended(f, f"{NS}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.findall(f"{NS}c")):
                    value, kind = c.find(f"{NS}v"), c.get("t")
                    raw = value.text or "" if value is not None else ""
                    if kind == "s":
                        raw = shared[int(raw)]
                    elif kind == "inlineStr":
                        raw = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                    elif kind == "b":
                        raw = "TRUE" if raw == "1" else "FALSE"
                    elif raw and kind in (None, "n"):
                        style = int(c.get("s") or 0)
                        raw = _shown(raw, style < len(days) and days[style])
                    cells[_column(c.get("r")) if c.get("r") else k] = raw.strip()
                if any(cells.values()):
                    yield cells


def rows_of(stream: BinaryIO) -> tuple[dict[int, str], Iterator[dict[int, str]]]:
    """(headers by column, the rows below them)."""
    rows = table(stream)
    return {i: h for i, h in sorted(next(rows, {}).items()) if h}, rows


def sheet_rows(data: bytes) -> tuple[list[str], list[list[str]]]:
    """(headers, rows) of the first sheet; an empty workbook has neither."""
    heads, rows = rows_of(io.BytesIO(data))
    return list(heads.values()), [[r.get(i, "") for i in heads] for r in rows]


def workbook_bytes(heads: list[str], rows: list[list[str]], sheet: str = "Directory") -> bytes:
    """A workbook of one sheet of inline strings."""
    ref = lambda i: (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)
    cell = lambda r, i, v: f'<c r="{ref(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    lines = "".join(f'<row r="{r}">{"".join(cell(r, i, v) for i, v in enumerate(vals))}</row>' for r, vals in enumerate([heads, *rows], 1))
    main, office = NS[1:-1], REL[1:-1]
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


@dataclass
class Workbook(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    """Rows of workbooks; with `headers`, only (file_name, at, head) of each."""

    def __init__(self, path: str, columns: list[str], headers: bool):
        self.path, self.columns, self.headers = path, columns, headers

    def partitions(self) -> list[Workbook]:
        return [Workbook(p) for p, _ in listed(self.path)] or [Workbook("")]

    def read(self, partition: Workbook) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as stream:
            heads, rows = rows_of(stream)
            if self.headers:
                yield pa.RecordBatch.from_pydict({"file_name": pa.array([partition.path] * len(heads), pa.string()), "at": pa.array(range(len(heads)), pa.int32()), "head": pa.array(heads.values(), pa.string())})
                return
            at = {h: i for i, h in heads.items()}
            done = 0
            while some := list(islice(rows, BATCH)):
                cells = [pa.array([r.get(at[c], "") if c in at else "" for r in some], pa.string()) for c in self.columns[:-2]]
                place = [pa.array([partition.path] * len(some), pa.string()), pa.array(range(done, done + len(some)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*cells, *place], self.columns)
                done += len(some)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        if self.options.get("headers") == "true":
            return "file_name string, at int, head string"
        raise ValueError("give the columns as a schema, or read the headers first")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema.fieldNames(), self.options.get("headers") == "true")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of all workbooks under a path: a column for each header, in the order of files and their columns,
    all strings, with file_name and row_idx. Executors open and parse; the driver sees the headers' names alone."""
    spark.dataSource.register(WorkbookSource)
    source = spark.read.format(FORMAT).option("path", path)
    first = source.option("headers", "true").load().groupBy("head").agg(F.min(F.struct("file_name", "at")).alias("first"))
    names = [r["head"] for r in first.orderBy("first").collect()]
    schema = StructType()
    for n in [*names, "file_name"]:
        schema.add(n, "string")
    return spark.read.format(FORMAT).option("path", path).schema(schema.add("row_idx", "long")).load()
