"""Retail workbooks (XLSX) and CSV landings as raw ledger rows.

``read_workbook`` streams a sheet's rows from the zip file: shared and inline strings, numbers as plain decimals, dates
as ISO local times.  Formulas, other columns, other headers and gaps between rows are errors.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import Decimal
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..schema import LEDGER, LEDGER_COLUMNS, SHEET, SHEET_HEADERS

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_EPOCH = datetime(1899, 12, 30)
#: Built-in number formats that show dates or times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
#: Rows of a workbook to a batch.
ROWS = 4096


class WorkbookError(ValueError):
    """A workbook isn't as the contract says."""


def _texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        out = []
        for _, item in ET.iterparse(f):
            if item.tag == f"{_MAIN}si":
                out.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
                item.clear()
        return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", "0")) for f in root.iter(f"{_MAIN}numFmt") if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
    cells = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", "0")) in _DATE_FORMATS | own}


def _sheet_path(book: zipfile.ZipFile, name: str) -> str:
    ids = {s.get("name"): s.get(_LINK) for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
    if name not in ids:
        raise WorkbookError(f"there is no sheet {name!r}")
    for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if r.get("Id") == ids[name]:
            return "xl/" + r.get("Target", "").removeprefix("/xl/")
    raise WorkbookError(f"the sheet {name!r} has no part")


def _plain(number: str) -> str:
    x = Decimal(number)
    return format(x.normalize() if x else Decimal(0), "f")


def _local_time(number: str) -> str:
    at = _EPOCH + timedelta(milliseconds=round(float(number) * 86_400_000))
    return at.isoformat(timespec="seconds" if at.second or at.microsecond else "minutes")


def _cells(row: ET.Element, texts: list[str], dates: set[int]) -> list[str]:
    out = [""] * len(SHEET_HEADERS)
    for cell in row.iter(f"{_MAIN}c"):
        letters = re.match(r"[A-Z]+", cell.get("r", ""))
        column = 0
        for c in letters[0] if letters else "":
            column = 26 * column + ord(c) - 64
        if not 1 <= column <= len(SHEET_HEADERS):
            raise WorkbookError(f"cell {cell.get('r')} is outside the {len(SHEET_HEADERS)} columns")
        if cell.find(f"{_MAIN}f") is not None:
            raise WorkbookError(f"cell {cell.get('r')} holds a formula")
        kind, value = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
        if kind == "inlineStr":
            out[column - 1] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
        elif value is not None:
            out[column - 1] = texts[int(value)] if kind == "s" else value if kind != "n" else _local_time(value) if int(cell.get("s", "0")) in dates else _plain(value)
    return out


def read_workbook(data: bytes, sheet: str = SHEET) -> Iterator[tuple[str, ...]]:
    """Rows of ``schema.LEDGER``; the header is row 1 and the others follow without a gap."""
    digest = hashlib.sha256(data).hexdigest()
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        path = _sheet_path(book, sheet)
        texts, dates, expected = _texts(book), _date_styles(book), 1
        with book.open(path) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r", "0"))
                if number != expected:
                    raise WorkbookError(f"row {expected} is missing")
                cells = _cells(row, texts, dates)
                row.clear()
                expected += 1
                if number == 1:
                    if tuple(cells) != SHEET_HEADERS:
                        raise WorkbookError(f"the headers are {cells}")
                    continue
                content = hashlib.sha256(json.dumps(cells, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
                yield hashlib.sha256(f"{digest}:{sheet}:{number}".encode()).hexdigest(), str(number), content, *cells


class _WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet

    def read(self, partition) -> Iterator[tuple[str, ...]]:
        return read_workbook(Path(self.path).read_bytes(), self.sheet)


class WorkbookSource(DataSource):
    """``spark.dataSource.register(WorkbookSource)``, then ``read.format("retail-workbook").load(path)``; a sheet is one task."""

    @classmethod
    def name(cls) -> str:
        return "retail-workbook"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in LEDGER_COLUMNS)

    def reader(self, schema) -> _WorkbookReader:
        return _WorkbookReader(self.options["path"], self.options.get("sheet", SHEET))


def stored_workbook(spark: SparkSession, url: str, sheet: str = SHEET) -> DataFrame:
    """Rows of ``schema.LEDGER``, in order, of a workbook on any filesystem that Spark reads.

    A workbook is one zip stream, so one task reads it: the file (2 GB at most) and its shared texts are held, rows are handed on
    by ``ROWS``.
    """
    names = [f.name for f in LEDGER]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = read_workbook(content.as_py(), sheet)
                while part := list(islice(found, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part, strict=True)], names=names)

    content = spark.read.format("binaryFile").load(url).select("content")
    return content.mapInArrow(rows, ", ".join(f"{c} string" for c in names))


#: How landings are written and read: quoted lines with a header, every column text.  Gzip files, which Spark reads as they are: such lines are several times as large.
_WRITTEN = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "header": "true", "escape": '"', "quoteAll": "true", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_READ = {"header": "true", "multiLine": "true", "escape": '"', "mode": "FAILFAST"}


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """A CSV landing: header, quoted lines, every column text; a malformed line fails the read."""
    return spark.read.schema(LEDGER).options(**_READ).csv(path)


def write_landing(rows: DataFrame, path: str) -> None:
    rows.select(*LEDGER_COLUMNS).write.mode("errorifexists").options(**_WRITTEN).csv(path)


@contextlib.contextmanager
def dealt_landing(rows: DataFrame, path: str, key: str, parts: int) -> Iterator[DataFrame]:
    """A landing with one more column, in buckets by it, as it is read again: what groups by that column finds its rows together.

    Rows that are dealt out by the column into as many parts are written where they are.  Spark knows the buckets by a
    table of the session's catalogue, which goes at the end; the files stay.
    """
    spark, name = rows.sparkSession, f"landing_{uuid.uuid4().hex}"
    rows.select(*LEDGER_COLUMNS, key).write.format("csv").mode("errorifexists").options(**_WRITTEN, **{k: v for k, v in _READ.items() if k not in _WRITTEN}).option("path", path).bucketBy(parts, key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def download(url: str, entry: str, target: Path, connect_s: int = 30, whole_s: int = 90) -> Path:
    """One entry of a zip file behind a URL, connected within ``connect_s`` seconds and here within ``whole_s``; the archive goes in any case."""
    import tempfile
    import time
    import urllib.request

    with tempfile.TemporaryFile() as archive:
        with urllib.request.urlopen(url, timeout=connect_s) as answer:
            if answer.status != 200:
                raise OSError(f"{url} answered {answer.status}")
            until = time.monotonic() + whole_s
            while block := answer.read1(1 << 20):
                if time.monotonic() > until:
                    raise TimeoutError(f"{url} took more than {whole_s} seconds")
                archive.write(block)
        with zipfile.ZipFile(archive) as z:
            target.write_bytes(z.read(entry))
    return target
