"""XLSX workbooks as a distributed source.

Spark has no reader for the format. Spark lists and ships the files
(``binaryFile``); a task opens one workbook at a time and yields its first
sheet in batches. A sheet holds at most 1,048,576 rows by format, so one
workbook always fits in one task; many workbooks spread over the cluster.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_BATCH = 10_000


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date or time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    # fixed values: the built-in formats of dates and times
    dates = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
    for form in root.iter(_MAIN + "numFmt"):
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", form.get("formatCode", ""))
        if re.search(r"[ymdhs]", bare, re.I):
            dates.add(int(form.get("numFmtId")))
    styles = root.find(_MAIN + "cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in dates}


def _date_text(value: str, from_1904: bool) -> str:
    """A serial number as date, or date and time."""
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
    seconds = round(float(value) * 86_400)
    moment = start + datetime.timedelta(seconds=seconds)
    return moment.date().isoformat() if seconds % 86_400 == 0 else moment.isoformat(sep=" ")


def _cell_text(cell, shared: list[str], dates: set[int] = frozenset(), from_1904: bool = False) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
    value = cell.find(_MAIN + "v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind in (None, "n") and int(cell.get("s", -1)) in dates:
        return _date_text(value.text, from_1904)
    return value.text


def _first_sheet(book: zipfile.ZipFile) -> str:
    """Path of the sheet that the workbook lists first."""
    names = set(book.namelist())
    relation = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    if sheet is not None and "xl/_rels/workbook.xml.rels" in names:
        for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            if link.get("Id") == sheet.get(relation):
                target = link.get("Target").lstrip("/")
                return target if target.startswith("xl/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


def _sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_MAIN + "si"):
                shared.append("".join(t.text or "" for t in item.iter(_MAIN + "t")))
        dates = _date_styles(book)
        kind = ElementTree.fromstring(book.read("xl/workbook.xml")).find(_MAIN + "workbookPr")
        from_1904 = kind is not None and kind.get("date1904") in ("1", "true")
        with book.open(_first_sheet(book)) as sheet:
            for _, node in ElementTree.iterparse(sheet):
                if node.tag != _MAIN + "row":
                    continue
                cells: list[str | None] = []
                for place, cell in enumerate(node.findall(_MAIN + "c")):
                    column = _column_number(cell.get("r")) if cell.get("r") else place
                    cells += [None] * (column + 1 - len(cells))
                    cells[column] = _cell_text(cell, shared, dates, from_1904)
                yield cells
                node.clear()


def workbook_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of all matching workbooks, each at its earliest place (one distributed pass)."""

    def header(batches):
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                names = [str(c) for c in next(_sheet_rows(content), []) if c is not None]
                yield pd.DataFrame({"path": where, "place": range(len(names)), "name": names})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(header, "path string, place int, name string")
    first = found.groupBy("name").agg(F.min(F.struct("place", "path")).alias("at"))
    return [r["name"] for r in first.orderBy("at", "name").collect()]


def read_xlsx_dir(spark: SparkSession, glob: str, schema: StructType | str | None = None) -> DataFrame:
    """All rows of all workbooks that match ``glob``, plus ``source_path``.

    Cells are matched to columns by header name; a column a workbook lacks is
    null. Without a schema all columns are text.
    """
    if schema is None:
        schema = ", ".join(f"`{c}` string" for c in workbook_header(spark, glob))
    target = spark.createDataFrame([], schema).schema
    names = target.names

    def rows(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                lines = _sheet_rows(content)
                where = {name: i for i, name in enumerate(next(lines, []))}
                block: list[list[str | None]] = []

                def frame():
                    return pd.DataFrame(block, columns=["source_path", *names], dtype=object)

                for cells in lines:
                    picked = [cells[where[n]] if n in where and where[n] < len(cells) else None for n in names]
                    if any(p is not None for p in picked):
                        block.append([path, *picked])
                    if len(block) == _BATCH:
                        yield frame()
                        block = []
                if block:
                    yield frame()

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    text = "source_path string, " + ", ".join(f"`{n}` string" for n in names)
    read = files.mapInPandas(rows, text)
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in target.fields]
    return read.select(*typed, "source_path")


def read_workbook(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One workbook as a table; numeric columns are recognised without a schema."""
    if schema is not None:
        return read_xlsx_dir(spark, path, schema).drop("source_path")
    text = read_xlsx_dir(spark, path).drop("source_path")
    # one sheet is at most a million rows: one pass decides every column's type
    checks = []
    for c in text.columns:
        v = F.col(f"`{c}`")
        checks.append(F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(f"bad_{c}"))
        checks.append(F.count_if(v.isNotNull() & v.try_cast("long").isNull()).alias(f"frac_{c}"))
    seen = text.agg(*checks).first()
    out = []
    for c in text.columns:
        v = F.col(f"`{c}`")
        if seen[f"bad_{c}"] == 0:
            v = v.try_cast("long" if seen[f"frac_{c}"] == 0 else "double")
        out.append(v.alias(c))
    return text.select(*out)
