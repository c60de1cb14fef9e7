"""Workbooks as a Spark data source, read and written with the standard library's zip and XML.

``spark.read.format("xlsx").option("sheet", name).load(path)`` reads one sheet; without the option the first, with
``*`` all, each row with its sheet's name. One task reads one sheet of one file. Paths are of a file
system that all executors mount; other stores are read with ``workbook_rows`` over Spark's binaryFile.
"""

from __future__ import annotations

import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Names of sheets in order, with the parts that hold them."""
    rels = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    found = {}
    for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = rels[x.get(f"{_REL}id")]
        found[x.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in x.iter(f"{_MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def read_sheet(book: zipfile.ZipFile, name: str) -> Iterator[list[str | None]]:
    """Rows of text cells; rows are parsed one at a time and empty cells are None."""
    shared = _shared(book)
    with book.open(sheets(book)[name]) as part:
        for _, row in ElementTree.iterparse(part):
            if row.tag != f"{_MAIN}row":
                continue
            cells: dict[int, str | None] = {}
            for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(cell.get("r")) if cell.get("r") else i
                value = cell.find(f"{_MAIN}v")
                if cell.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
            yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
            row.clear()


def records(content: io.BufferedIOBase | str, sheet: str | None) -> Iterator[tuple[str, int, dict[str, str | None]]]:
    """(sheet, row number, cells by header) of the first, one or all ("*") sheets. Rows of empty cells are left out."""
    with zipfile.ZipFile(content) as book:
        names = list(sheets(book))
        for name in names if sheet == "*" else [sheet or names[0]]:
            rows = read_sheet(book, name)
            header = [str(x).strip() if x is not None else f"_{i}" for i, x in enumerate(next(rows, []))]
            for number, row in enumerate(rows):
                cells = dict(zip(header, [*row, *[None] * (len(header) - len(row))]))
                if any(x is not None for x in cells.values()):
                    yield name, number, cells


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str):
        super().__init__(0)
        self.path, self.sheet = path, sheet


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob.glob(f"{path}/*.xlsx")) if os.path.isdir(path) else sorted(glob.glob(path))


class XlsxReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options

    def partitions(self):
        parts = []
        for path in _files(self.options["path"]):
            with zipfile.ZipFile(path) as book:
                names = list(sheets(book))
            wanted = self.options.get("sheet")
            parts += [_Sheet(path, name) for name in (names if wanted == "*" else [wanted or names[0]]) if name in names]
        return parts

    def read(self, partition):
        if partition is None:
            return
        own = {"_sheet", "_row", "_file"}
        for sheet, number, cells in records(partition.path, partition.sheet):
            extra = {"_sheet": sheet, "_row": number, "_file": os.path.basename(partition.path)}
            yield tuple(extra[f.name] if f.name in own else cells.get(f.name) for f in self.schema.fields)


def _sheet_xml(rows: list[list[object]]) -> str:
    def cell(x: object) -> str:
        if x is None:
            return "<c/>"
        if isinstance(x, bool) or not isinstance(x, (int, float)):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(x)))}</t></is></c>'
        return f"<c><v>{x}</v></c>"

    body = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>'


def workbook(tables: dict[str, list[list[object]]]) -> bytes:
    """A workbook of named sheets; each is rows of cells with a header first."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        numbers = range(1, len(tables) + 1)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}"><Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(numbers, tables))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE[1:-1]}">{links}</Relationships>')
        for i, rows in zip(numbers, tables.values()):
            book.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(rows))
    return out.getvalue()


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class XlsxWriter(DataSourceWriter):
    """One workbook for each task, with one sheet; files appear when all tasks are done."""

    def __init__(self, schema, options):
        self.names, self.folder, self.sheet = [f.name for f in schema.fields], options["path"].removeprefix("file://"), options.get("sheet", "Sheet1")

    def write(self, iterator):
        from pyspark import TaskContext

        rows = [list(row) for row in iterator]
        if not rows:
            return _Written(None)
        os.makedirs(self.folder, exist_ok=True)
        task = TaskContext.get()
        path = f"{self.folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}.xlsx"
        with open(path, "wb") as file:
            file.write(workbook({self.sheet: [self.names, *rows]}))
        return _Written(path)

    def commit(self, messages):
        for message in messages:
            if message and message.path:
                folder, name = os.path.split(message.path)
                os.replace(message.path, f"{folder}/{name[1:].rsplit('-', 1)[0]}.xlsx")

    def abort(self, messages):
        for message in messages:
            if message and message.path and os.path.exists(message.path):
                os.remove(message.path)


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        """All header names of the wanted sheets as text, after the sheet's name and the row's number."""
        names: dict[str, None] = {}
        for path in _files(self.options["path"]):
            with zipfile.ZipFile(path) as book:
                wanted = self.options.get("sheet")
                for sheet in list(sheets(book)) if wanted == "*" else [wanted or next(iter(sheets(book)))]:
                    if sheet in sheets(book):
                        names |= dict.fromkeys(str(x).strip() for x in next(read_sheet(book, sheet), []) if x is not None)
        return "_sheet string, _row long, _file string" + "".join(f", `{name}` string" for name in names)

    def reader(self, schema):
        return XlsxReader(schema, self.options)

    def writer(self, schema, overwrite):
        return XlsxWriter(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxDataSource)


def workbook_rows(spark: SparkSession, path: str, columns: dict[str, str], sheet: str | None = None) -> DataFrame:
    """Rows of workbooks in any store that Spark reads: ``file, sheet, row`` and the columns by their headers."""
    names = list(columns.values())

    def rows(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = [{"file": file.rpartition("/")[2], "sheet": s, "row": n, **{columns[h]: cells.get(h) for h in columns}} for s, n, cells in records(io.BytesIO(content), sheet)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), *((n, pa.string()) for n in names)]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return files.select("path", "content").mapInArrow(rows, "file string, sheet string, row long" + "".join(f", `{n}` string" for n in names))
