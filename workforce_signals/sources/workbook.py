"""Spreadsheet workbooks (zipped XML sheets) as tables.

Files are read by Spark, so they may lie wherever Spark reads from; each is one row of bytes that a task unpacks. By its
format a sheet has at most 2^20 rows, so a file is a bounded piece of work and a folder of workbooks is many tasks. Cells are
streamed; only a workbook's own shared strings are held.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from workforce_signals.plans.workers import importable

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# Fixed values of the format: built-in number formats that show dates or times, and the text of error cells.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
ERROR_TEXTS = ("#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!", "#GETTING_DATA")

# Rows of a sheet handed to Spark at once.
_ROWS = 10_000


def _text(node: ElementTree.Element) -> str:
    """The runs of a rich text, without its reading aids."""
    parts = [t.text or "" for child in node for t in ([child] if child.tag == f"{_MAIN}t" else child.findall(f"{_MAIN}t") if child.tag == f"{_MAIN}r" else [])]
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(parts))


def _column(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    n = 0
    for letter in reference:
        if not letter.isalpha():
            break
        n = 26 * n + ord(letter.upper()) - ord("A") + 1
    return n - 1


def _number(text: str) -> str:
    """Whole numbers without a point, others in the shortest form that reads back as the same double."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1 << 53 else repr(value)


class Workbook:
    """One workbook's parts that cells refer to."""

    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        book = self._parsed("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target") for r in self._parsed("xl/_rels/workbook.xml.rels").iter(f"{_PACKAGE}Relationship")}
        self.sheets = {s.get("name"): self._path(targets[s.get(_RELATION)]) for s in book.iter(f"{_MAIN}sheet")}
        properties = book.find(f"{_MAIN}workbookPr")
        since_1904 = properties is not None and properties.get("date1904") in ("1", "true")
        self.day_0 = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30)
        names = set(self.archive.namelist())
        self.strings = [_text(s) for s in self._parsed("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles(self._parsed("xl/styles.xml")) if "xl/styles.xml" in names else set()

    @staticmethod
    def _path(target: str) -> str:
        return target[1:] if target.startswith("/") else f"xl/{target}"

    def _parsed(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.archive.read(name))

    @staticmethod
    def _date_styles(styles: ElementTree.Element) -> set[int]:
        """Cell styles whose number format has a part of a date or time outside quotes and brackets."""
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
        bare = {k: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code).lower() for k, code in own.items()}
        dated = _DATE_FORMATS | {k for k, code in bare.items() if re.search("[ymdhs]", code) and "general" not in code}
        cells = styles.find(f"{_MAIN}cellXfs")
        return {i for i, x in enumerate(cells if cells is not None else ()) if int(x.get("numFmtId", 0)) in dated}

    def _value(self, cell: ElementTree.Element) -> str | None:
        kind, inline, node = cell.get("t", "n"), cell.find(f"{_MAIN}is"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            return (_text(inline) if inline is not None else "") or None
        value = node.text if node is not None else None
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(value)] or None
        if kind == "b":
            return "true" if value == "1" else "false"
        if kind in ("str", "d"):
            return value
        if int(cell.get("s", 0)) in self.dates:
            moment = self.day_0 + datetime.timedelta(seconds=round(float(value) * 86400))
            return moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(" ")
        return _number(value)

    def rows(self, sheet: str | int) -> Iterator[list[str | None]]:
        """The rows of a sheet that hold a value, by its name or place, each as long as its last cell."""
        names = list(self.sheets)
        if sheet not in self.sheets and not (isinstance(sheet, int) and sheet < len(names)):
            raise ValueError(f"no sheet {sheet!r} among {names}")
        with self.archive.open(self.sheets[sheet if sheet in self.sheets else names[sheet]]) as file:
            for _, node in ElementTree.iterparse(file):
                if node.tag != f"{_MAIN}row":
                    continue
                row: list[str | None] = []
                for cell in node.iter(f"{_MAIN}c"):
                    at = _column(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    row[at] = self._value(cell)
                node.clear()
                if any(v is not None for v in row):
                    yield row


def _headers(rows: Iterator[list[str | None]]) -> list[str]:
    """Column names from the first row, as many as the widest row has: a blank one tells its place, a repeated one its number."""
    header, names = next(rows, []), []
    header += [None] * (max(map(len, rows), default=0) - len(header))
    for i, name in enumerate(header):
        base, k = name if name is not None else f"Unnamed: {i}", 0
        while (name := f"{base}.{k}" if k else base) in names:
            k += 1
        names.append(name)
    return names


def _first_rows(sheet: str | int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(path, _headers(Workbook(content).rows(sheet))) for path, content in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(found, columns=["path", "names"])

    return run


def _all_rows(sheet: str | int, n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [str(i) for i in range(n)]
        for batch in batches:
            for content in batch["content"]:
                rows, part = Workbook(content).rows(sheet), []
                next(rows, None)
                for row in rows:
                    part.append((row + [None] * n)[:n])
                    if len(part) == _ROWS:
                        yield pd.DataFrame(part, columns=columns, dtype=object)
                        part = []
                if part:
                    yield pd.DataFrame(part, columns=columns, dtype=object)

    return run


def workbook_parts(spark: SparkSession, pattern: str, sheet: str | int = 0) -> list[DataFrame]:
    """The given sheet of every workbook of ``pattern`` as all-string tables, one for each distinct header.

    The first row that holds a value names the columns. Numbers are texts such as ``12`` or ``0.5``, dates ``2020-01-31``, truth values
    ``true`` and ``false``; empty cells, empty texts and errors are NULL, and rows without any value are left out.
    """
    importable(spark)
    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    found = files.mapInPandas(_first_rows(sheet), "path string, names array<string>").groupBy("names").agg(F.collect_list("path").alias("paths"))
    parts = []
    for header in sorted(found.collect(), key=lambda r: r["paths"]):  # a row for each distinct header
        if not header["names"]:
            continue
        names, content = header["names"], spark.read.format("binaryFile").load(sorted(header["paths"])).select("content")
        schema = StructType([StructField(str(i), StringType()) for i in range(len(names))])
        table = content.mapInPandas(_all_rows(sheet, len(names)), schema)
        parts.append(table.select(*(F.col(f"`{i}`").alias(name) for i, name in enumerate(names))))
    if not parts:
        raise FileNotFoundError(f"no workbook with a filled sheet {sheet!r} at {pattern}")
    return parts


def read_workbook(spark: SparkSession, pattern: str, sheet: str | int = 0) -> DataFrame:
    """``workbook_parts`` as one table, columns by name; those a workbook lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), workbook_parts(spark, pattern, sheet))
