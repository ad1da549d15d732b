"""Workbooks (.xlsx) as a Python data source, and a writer that keeps the other sheets. Only the standard library: a workbook is a zip of XML parts."""

from __future__ import annotations

import io
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Names of the public workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Characters that XML can't hold.
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
REQUIRED = ("Notes", "Source", "Verifier", "Error")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_paths(z: zipfile.ZipFile) -> dict[str, str]:
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ET.fromstring(z.read("xl/workbook.xml"))
    return {s.get("name"): "xl/" + targets[s.get(f"{RELATION}id")].lstrip("/").removeprefix("xl/") for s in book.iter(f"{MAIN}sheet")}


def read_sheet(data: bytes, sheet: str) -> list[list[str | None]]:
    """The sheet's cells as text, ragged at the right; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        rows = []
        for row in ET.fromstring(z.read(_sheet_paths(z)[sheet])).iter(f"{MAIN}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                v, kind = c.find(f"{MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif v is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text
            rows.append(cells)
        return rows


HEAD = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
TAIL = "</sheetData></worksheet>"
#: Rows of a sheet, its header aside, that the format can hold.
MOST_ROWS = 1_048_575


def _row_xml(row: Iterable[str | None]) -> str:
    """A row without addresses: its place and its cells' are where they stand, and an empty cell holds its own."""
    return "<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(CONTROL.sub("", v))}</t></is></c>' for v in row) + "</row>"


def _new_book(sheet: str) -> dict[str, bytes]:
    """The parts around the one sheet of a new workbook."""
    return {
        "[Content_Types].xml": b'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": b'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": b'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/workbook.xml": f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>'.encode(),
    }


def write_sheet(old: str | None, sheet: str, header: list[str], parts: list[str], to: BinaryIO) -> None:
    """A workbook with the sheet replaced by a header and the rows in the files parts, and all other parts of the file old kept; a new workbook if there was none. No part is held whole."""
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        if old:
            with zipfile.ZipFile(old) as kept:
                paths = _sheet_paths(kept)
                if sheet not in paths:
                    raise KeyError(sheet)
                path = paths[sheet]
                for name in kept.namelist():
                    if name != path:
                        with kept.open(name) as f, z.open(name, "w") as out:
                            shutil.copyfileobj(f, out)
        else:
            path = "xl/worksheets/sheet1.xml"
            for name, part in _new_book(sheet).items():
                z.writestr(name, part)
        with z.open(path, "w", force_zip64=True) as out:
            out.write((HEAD + _row_xml(header)).encode())
            for part in parts:
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out)
            out.write(TAIL.encode())


class _Reader(DataSourceReader):
    def __init__(self, path: str, sheet: str, width: int):
        self.path, self.sheet, self.width = path, sheet, width

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        with open(self.path, "rb") as f:
            rows = read_sheet(f.read(), self.sheet)
        for i, row in enumerate(rows[1:]):
            yield (i, *(row + [None] * self.width)[: self.width])


@dataclass
class Part(WriterCommitMessage):
    """What one task staged."""

    number: int
    rows: int
    path: str


class _Writer(DataSourceWriter):
    """Tasks stage their rows as files in a folder beside the workbook; the commit joins them by partition and moves the new workbook over the old one.

    An attempt has a file of its own, and the commit reads only those of the attempts that Spark counts, so a repeated or killed task leaves no row twice.
    Whatever fails, before or in the commit, leaves the old workbook as it was and the folder removed.
    """

    def __init__(self, path: str, sheet: str, header: list[str]):
        self.path, self.sheet, self.header = os.path.abspath(path), sheet, header
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        os.makedirs(self.staged, exist_ok=True)
        task, n = TaskContext.get(), 0
        path = f"{self.staged}/part-{task.partitionId()}-{task.taskAttemptId()}"
        with open(path, "w", encoding="utf-8", newline="") as f:
            for row in iterator:
                f.write(_row_xml(None if row[c] is None else str(row[c]) for c in self.header))
                n += 1
        return Part(task.partitionId(), n, path)

    def commit(self, messages: list[Part | None]) -> None:
        try:
            parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
            if sum(m.rows for m in parts) > MOST_ROWS:
                raise ValueError(f"a sheet holds {MOST_ROWS} rows at most; write parts, or another format")
            os.makedirs(self.staged, exist_ok=True)
            whole = f"{self.staged}/whole"
            with open(whole, "wb") as f:
                write_sheet(self.path if os.path.exists(self.path) else None, self.sheet, self.header, [m.path for m in parts], f)
            os.replace(whole, self.path)
        finally:
            shutil.rmtree(self.staged, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class WorkbookSource(DataSource):
    """spark.read.format("workbook").option("sheet", ...).load(path): row_index and the header's columns, all text; df.write.format("workbook") puts a sheet in place.

    A cluster needs the path on a folder that the driver and all executors share.
    """

    @classmethod
    def name(cls):
        return "workbook"

    def _header(self) -> list[str]:
        with open(self.options["path"], "rb") as f:
            rows = read_sheet(f.read(), self.options.get("sheet", "Unfilled"))
        header = [h or f"column_{i}" for i, h in enumerate(rows[0])] if rows else []
        if lost := [c for c in REQUIRED if c not in header]:
            raise ValueError(f"the sheet lacks columns: {lost}")
        return header

    def schema(self):
        return "row_index long, " + ", ".join(f"`{h}` string" for h in self._header())

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("sheet", "Unfilled"), len(schema.fields) - 1)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("sheet", "Unfilled"), [f.name for f in schema.fields if f.name != "row_index"])


def load(spark: SparkSession, path: str, sheet: str = "Unfilled") -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").option("sheet", sheet).load(path)


def save(df: DataFrame, path: str, sheet: str = "Unfilled") -> None:
    """The sheet in order of row_index; null cells stay empty, other sheets stay as they are. More rows than the format holds are refused, none is dropped."""
    df.sparkSession.dataSource.register(WorkbookSource)
    df.orderBy("row_index").write.format("workbook").mode("overwrite").option("sheet", sheet).save(path)
