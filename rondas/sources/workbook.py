"""Spreadsheet files (one sheet each) as a Spark data source: every task writes and reads its own.

    df.write.format("hojas").mode("append").save(path)
    spark.read.format("hojas").schema(schema).load(path)

Tasks stream rows into files of a folder of the job's own. When all tasks are done the files move into place; a failed job
removes that folder, so readers never see a part of an export. A failed attempt of a task leaves nothing that is moved.
A sheet has at most ``max_rows`` rows (an option; what a spreadsheet can hold by default), more rows are more files.
"""

from __future__ import annotations

import datetime as dt
import itertools
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "hojas"
SUFFIX = ".xlsx"
#: Fixed values of the file format: rows of a sheet with its header, day zero, names and parts.
MAX_ROWS = 1_048_575
DAY_ZERO = dt.date(1899, 12, 30)
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
SHEET = "xl/worksheets/sheet1.xml"
PARTS = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/>'
    f'<Override PartName="/{SHEET}" ContentType="{KIND}.worksheet+xml"/>'
    f'<Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships">'
    f'<Relationship Id="rId1" Type="{DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{DOCUMENT}">'
    '<sheets><sheet name="Hoja1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">'
    f'<Relationship Id="rId1" Type="{DOCUMENT}/worksheet" Target="worksheets/sheet1.xml"/>'
    f'<Relationship Id="rId2" Type="{DOCUMENT}/styles" Target="styles.xml"/></Relationships>',
    # Format 1 shows a number as a date.
    "xl/styles.xml": f'<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="2"><xf/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
}

#: Characters that XML cannot hold, and texts that look like an escaped one.
_ODD = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.date):
        return f'<c s="1"><v>{(value - DAY_ZERO).days}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value!r}</v></c>"
    text = escape(_ODD.sub(lambda m: f"_x{ord(m[0]):04X}_", value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_sheet(out, names: Sequence[str], rows: Iterator[Sequence], limit: int) -> int:
    """Stream a header and at most ``limit`` rows into a file; the number of rows."""
    count = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, text in PARTS.items():
            file.writestr(name, HEAD + text)
        with file.open(SHEET, "w", force_zip64=True) as sheet:
            sheet.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            sheet.write(f"<row>{''.join(map(_cell, names))}</row>".encode())
            for row in rows:
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                count += 1
                if count == limit:
                    break
            sheet.write(b"</sheetData></worksheet>")
    return count


def _value(cell: ElementTree.Element, kind: T.DataType):
    if cell.get("t") == "inlineStr":
        text = "".join(t.text or "" for t in cell.iter(f"{{{MAIN}}}t"))
        return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    found = cell.find(f"{{{MAIN}}}v")
    if found is None:
        return None
    if isinstance(kind, T.BooleanType):
        return found.text == "1"
    if isinstance(kind, T.DateType):
        return DAY_ZERO + dt.timedelta(int(found.text))
    return float(found.text) if isinstance(kind, (T.DoubleType, T.FloatType)) else int(found.text)


def read_sheet(source, schema: T.StructType) -> Iterator[tuple]:
    """The rows of a sheet, one at a time; the header must be that of the schema."""
    kinds = [f.dataType for f in schema.fields]
    with zipfile.ZipFile(source) as file, file.open(SHEET) as sheet:
        header = None
        for _, element in ElementTree.iterparse(sheet):
            if element.tag != f"{{{MAIN}}}row":
                continue
            if header is None:
                header = [_value(c, T.StringType()) for c in element]
                if header != schema.fieldNames():
                    raise ValueError(f"a sheet has the columns {header}")
            else:
                yield tuple(_value(c, k) for c, k in zip(element, kinds, strict=True))
            element.clear()


def _files(path: str):
    """The file system of a path and the path on it; tasks and driver reach both."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class Sheet(InputPartition):
    file: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, limit: int, overwrite: bool):
        self.path, self.names, self.limit, self.overwrite = path.rstrip("/"), schema.fieldNames(), limit, overwrite
        self.aside = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[T.Row]) -> Written:
        system, folder = _files(self.aside)
        system.create_dir(folder, recursive=True)
        files = []
        row = next(iterator, None)
        while row is not None:
            name = f"hoja-{uuid.uuid4().hex}{SUFFIX}"

            with system.open_output_stream(f"{folder}/{name}") as out:
                write_sheet(out, self.names, itertools.chain((row,), iterator), self.limit)
            files.append(name)
            row = next(iterator, None)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _files(self.path)
        _, aside = _files(self.aside)
        system.create_dir(folder, recursive=True)
        old = _listed(system, folder) if self.overwrite else []
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{aside}/{name}", f"{folder}/{name}")
        for name in old:
            system.delete_file(name)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove the job's folder, with what failed attempts left in it."""
        from pyarrow import fs

        system, aside = _files(self.aside)
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)


def _listed(system, folder: str) -> list[str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(folder, recursive=False))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX))


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Sheet]:
        return [Sheet(name) for name in _listed(*_files(self.path))]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        system, _ = _files(self.path)
        with system.open_input_file(partition.file) as source:
            yield from read_sheet(source, self.schema)


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        known = (T.StringType, T.BooleanType, T.DateType, T.IntegralType, T.FractionalType)
        odd = [f.name for f in schema.fields if not isinstance(f.dataType, known) or isinstance(f.dataType, T.DecimalType)]
        if odd:
            raise ValueError(f"a sheet cannot hold the columns {odd}")
        return _Writer(self.options["path"], schema, int(self.options.get("max_rows", MAX_ROWS)), overwrite)

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema)


def write_sheets(df: DataFrame, path: str, *, max_rows: int = MAX_ROWS) -> None:
    """Write ``df`` as sheets, one or more for each of its partitions."""
    df.sparkSession.dataSource.register(SheetSource)
    df.write.format(FORMAT).option("max_rows", max_rows).mode("append").save(path)


def read_sheets(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all sheets of a folder; a task reads one sheet."""
    spark.dataSource.register(SheetSource)
    return spark.read.format(FORMAT).schema(schema).load(path)
