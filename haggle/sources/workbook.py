"""Workbooks (XLSX) as a Spark data source: headings first, then rows, written by all tasks at once and committed as a whole.

A task streams its rows, some at a time, to a workbook of its own under a name that no reader looks at. Once every task is done the driver gives the workbooks their names and then
writes the mark of a whole export; of a failed or repeated task nothing remains. The path may be of any file system that Arrow can open.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from itertools import count, islice
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows that are written at once, and rows that fit on a sheet (a limit of the format, headings included).
BATCH, SHEET_ROWS = 100, 1 << 20
_DONE = "_SUCCESS"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML cannot hold, and what looks like their escape, are escaped as the format says: _xHHHH_.
_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _text(value: str) -> str:
    return escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", value))


def _cell(value) -> str:
    """Numbers up to 15 digits are numbers, truth values are such; all else is text, as a spreadsheet would round longer numbers."""
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) and abs(value) < 10**15:
        return f"<c><v>{value}</v></c>"
    if isinstance(value, float) and value - value == 0:
        return f"<c><v>{value!r}</v></c>"
    shown = value.isoformat(" ") if isinstance(value, datetime) else value.isoformat() if isinstance(value, date) else str(value)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_text(shown)}</t></is></c>'


def _row(values) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


def write_workbook(file, headings: list[str], rows: Iterator, batch: int = BATCH, sheet_rows: int = SHEET_ROWS) -> int:
    """Write a workbook to a binary file: a sheet, or more if one is full, each with the headings first. Memory holds one batch."""
    n, sheets = 0, 0
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as book:
        rows, more = iter(rows), True
        while more or not sheets:
            sheets += 1
            with book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{_row(headings)}'.encode())
                left = sheet_rows - 1
                while left and (some := list(islice(rows, min(batch, left)))):
                    sheet.write("".join(map(_row, some)).encode())
                    n, left = n + len(some), left - len(some)
                sheet.write(b"</sheetData></worksheet>")
            more = not left and (last := next(rows, None)) is not None
            if more:
                rows = iter_after(last, rows)
        numbers = range(1, sheets + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in numbers)
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="Sheet{k}" sheetId="{k}" r:id="rId{k}"/>' for k in numbers) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>")
    return n


def iter_after(first, rest: Iterator) -> Iterator:
    yield first
    yield from rest


def read_workbook(file) -> Iterator[list[str | None]]:
    """The rows of a workbook that write_workbook has made, as texts, without the headings."""
    with zipfile.ZipFile(file) as book:
        for k in count(1):
            if f"xl/worksheets/sheet{k}.xml" not in book.NameToInfo:
                return
            with book.open(f"xl/worksheets/sheet{k}.xml") as sheet:
                headings = True
                for _, element in iterparse(sheet):
                    if element.tag == f"{{{_MAIN}}}row":
                        if not headings:
                            yield [None if not len(c) else _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(c.itertext())) for c in element]
                        headings = False
                        element.clear()


def _typed(kind: T.DataType):
    """From a cell's text to a value of a type."""
    readers = {
        T.StringType: str, T.BooleanType: lambda x: x == "1", T.FloatType: float, T.DoubleType: float, T.DecimalType: Decimal, T.DateType: date.fromisoformat,
        T.TimestampType: datetime.fromisoformat, T.TimestampNTZType: datetime.fromisoformat, T.ByteType: int, T.ShortType: int, T.IntegerType: int, T.LongType: int,
    }
    if type(kind) not in readers:
        raise ValueError(f"a workbook holds no {kind.simpleString()}")
    return readers[type(kind)]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool, batch: int):
        self.path, self.headings, self.overwrite, self.batch = path, schema.fieldNames(), overwrite, batch
        for f in schema:
            _typed(f.dataType)

    def write(self, iterator) -> WriterCommitMessage:
        from uuid import uuid4

        from pyspark import TaskContext

        system, path = _place(self.path)
        system.create_dir(f"{path}/_temporary", recursive=True)
        # a name for each attempt: one that goes on after its task was given up writes over nothing
        name = f"part-{TaskContext.get().partitionId():05}-{uuid4().hex}.xlsx"
        try:
            with system.open_output_stream(f"{path}/_temporary/{name}") as file:
                n = write_workbook(file, self.headings, iterator, self.batch)
        except BaseException:
            system.delete_file(f"{path}/_temporary/{name}")
            raise
        return _Written(name, n)

    def commit(self, messages) -> None:
        system, path = _place(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            system.move(f"{path}/_temporary/{m.name}", f"{path}/{m.name}")
        for f in old:
            system.delete_file(f)
        if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary")
        with system.open_output_stream(f"{path}/{_DONE}") as mark:
            mark.write("".join(f"{m.name}\t{m.rows}\n" for m in messages).encode())

    def abort(self, messages) -> None:
        system, path = _place(self.path)
        if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary")
        left = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        if not left and system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


@dataclass
class _Book(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.read_as = path, [_typed(f.dataType) for f in schema]

    def partitions(self):
        system, path = _place(self.path)
        if system.get_file_info(f"{path}/{_DONE}").type != fs.FileType.File:
            raise ValueError(f"{self.path} holds no whole export")
        return [_Book(f.path) for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".xlsx")]

    def read(self, partition):
        if partition is None:
            return
        with _place(self.path)[0].open_input_file(partition.path) as file:
            for row in read_workbook(pa.PythonFile(file) if not hasattr(file, "seekable") else file):
                yield tuple(None if x is None else read(x) for read, x in zip(self.read_as, row, strict=True))


class Workbooks(DataSource):
    """format("workbook"): columns are numbers, texts, truth values, dates and times, under headings that are their names. Options: path; batch, the rows written at once.

    Reading needs the schema. Nulls are empty cells, an empty text is not null.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self):
        raise ValueError("give the schema of the workbooks")

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, overwrite, int(self.options.get("batch", BATCH)))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)
