"""Spreadsheets as a data source: workbooks are zipped XML, read by sheet and range of rows and written by task.

    register(spark)
    spark.read.format("workbook").load(path)                       # file, sheet, row, cells
    rows.write.format("workbook").mode("append").save(folder)     # a workbook for each task

Reading: every sheet of every workbook is split into ranges of rows, each of which a task reads as a stream. Writing: each task
writes a workbook of its own under a temporary name; only when all have ended are they renamed, and a run that fails
leaves none. Paths may be in any store that Arrow's file systems know."""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from marketloom.sources.catalog import ALIASES, resolve_headers

#: Rows of a sheet that one task reads, unless the option `rows` says otherwise; rows that a sheet can have; rows in which the header is looked for.
RANGE, MOST_ROWS, HEADER_ROWS = 100_000, 1_048_576, 30
SCHEMA = "file string, sheet string, row long, cells array<string>"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets in their order, and the members that hold them."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = [s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    full = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return [(s.get("name"), full(targets[s.get(f"{{{_OFFICE}}}id")])) for s in found]


def _shared(book: zipfile.ZipFile) -> list[str]:
    """The texts that cells refer to by number."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if _local(node.tag) == "si":
                out.append("".join(t.text or "" for t in node.iter() if _local(t.tag) == "t"))
                node.clear()
    return out


def _column(reference: str) -> int:
    """The number of a cell's column, from 0."""
    return reduce(lambda n, c: 26 * n + ord(c) - 64, re.match("[A-Z]+", reference)[0], 0) - 1


def _cell(node: ElementTree.Element, shared: list[str]) -> str | None:
    kind, parts = node.get("t"), {_local(x.tag): x for x in node}
    if kind == "inlineStr":
        return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")
    value = parts["v"].text if "v" in parts else None
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    return {"0": "FALSE", "1": "TRUE"}.get(value, value) if kind == "b" else value


def _rows(book: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[tuple[int, list]]:
    """Number and cells of each row, as a stream; a cell without a value is null."""
    number = 0
    with book.open(member) as stream:
        parents = []
        for event, node in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                parents.append(node)
                continue
            parents.pop()
            if _local(node.tag) == "row":
                number = int(node.get("r") or number + 1)
                cells: list = []
                for n, c in enumerate(x for x in node if _local(x.tag) == "c"):
                    at = _column(c.get("r")) if c.get("r") else n
                    cells.extend([None] * (at + 1 - len(cells)))
                    cells[at] = _cell(c, shared)
                yield number, cells
                parents[-1].clear()  # rows that have been given out are forgotten


@dataclass
class Range(InputPartition):
    path: str
    sheet: str
    member: str
    first: int
    last: int


class WorkbookReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.size = options["path"], int(options.get("rows", RANGE))

    def partitions(self) -> list[Range]:
        store, path = _store(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".xlsx") and not re.search(r"(^|/)[._]", f.path[len(path):])]
        out = []
        for file in sorted(f.path for f in files):
            with store.open_input_file(file) as source, zipfile.ZipFile(source) as book:
                for sheet, member in _sheets(book):
                    last = self._last_row(book, member)
                    out += [Range(file, sheet, member, at, min(at + self.size - 1, last)) for at in range(1, last + 1, self.size)]
        return out

    @staticmethod
    def _last_row(book: zipfile.ZipFile, member: str) -> int:
        """By the sheet's dimension if it states one, else all rows that there can be, as one range."""
        with book.open(member) as stream:
            head = stream.read(65_536).decode("utf-8", "replace")
        stated = re.search(r'<(?:\w+:)?dimension ref="[A-Z]+[0-9]+:[A-Z]+([0-9]+)"', head)
        return int(stated[1]) if stated else MOST_ROWS

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_file(partition.path) as source, zipfile.ZipFile(source) as book:
            for number, cells in _rows(book, partition.member, _shared(book)):
                if number > partition.last:
                    return
                if number >= partition.first:
                    yield partition.path, partition.sheet, number, cells


class WorkbookWriter(DataSourceWriter):
    """Rows (sheet, cells) in the order in which they come: a new sheet begins where the name changes or a sheet is full."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator) -> WriterCommitMessage:
        store, path = _store(self.path)
        store.create_dir(f"{path}/_temporary/{self.run}")
        name = f"{uuid.uuid4().hex}.xlsx"
        file, names, stream, now, n = f"{path}/_temporary/{self.run}/{name}", [], None, None, 0
        with store.open_output_stream(file) as target, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
            for sheet, cells in iterator:
                if stream is None or sheet != now or n == MOST_ROWS:
                    self._end(stream, n)
                    names.append(self._free(sheet, names))
                    stream, now, n = book.open(f"xl/worksheets/sheet{len(names)}.xml", "w"), sheet, 0
                    stream.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
                n += 1
                stream.write(f'<row r="{n}">{"".join(map(self._told, cells or []))}</row>'.encode())
            self._end(stream, n)
            if not names:  # a workbook has a sheet at least
                names = ["Sheet1"]
                book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData/></worksheet>')
            self._frame(book, names)
        return Written(name)

    @staticmethod
    def _told(cell: str | None) -> str:
        if cell is None:
            return "<c/>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub(" ", cell))}</t></is></c>'

    @staticmethod
    def _end(stream, n: int) -> None:
        if stream is not None:
            stream.write(b"</sheetData></worksheet>")
            stream.close()

    @staticmethod
    def _free(sheet: str | None, names: list[str]) -> str:
        """A name that a sheet can have, and none has yet."""
        plain = re.sub(r"[\[\]:*?/\\]", " ", sheet or "Sheet")[:31]
        found, n = plain, 1
        while found.lower() in {x.lower() for x in names}:
            n += 1
            found = f"{plain[: 31 - len(str(n)) - 3]} ({n})"
        return found

    @staticmethod
    def _frame(book: zipfile.ZipFile, names: list[str]) -> None:
        """The parts that name the sheets and their kinds."""
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        numbered = list(enumerate(names, 1))
        book.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
                      f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i, _ in numbered) + "</Types>")  # fmt: skip
        book.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in numbered)
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in numbered)
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')

    def commit(self, messages: list) -> None:
        store, path = _store(self.path)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path, recursive=False)):
                if old.is_file and old.path.endswith(".xlsx"):
                    store.delete_file(old.path)
        for n, m in enumerate(messages):
            store.move(f"{path}/_temporary/{self.run}/{m.name}", f"{path}/part-{n:05d}-{self.run}.xlsx")
        self._clear(store, path)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        if store.get_file_info(f"{path}/_temporary/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_temporary/{self.run}")


@dataclass
class Written(WriterCommitMessage):
    name: str


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbook)


def read_missions(spark: SparkSession, path: str, rows: int = RANGE) -> DataFrame:
    """Missions of a workbook's first sheet. The header is the first of its first rows that names a name, or an article and
    another field; what lies above it is left out."""
    register(spark)
    cells = spark.read.format("workbook").option("rows", rows).load(path)
    head = cells.filter(F.col("row") <= HEADER_ROWS).orderBy("file", "row").collect()  # 30 rows of each sheet
    known = {n for names in ALIASES.values() for n in names}
    for r in head:
        at = {(c or "").strip().lower(): i for i, c in enumerate(r.cells) if (c or "").strip().lower() in known}
        found = {k for k, names in ALIASES.items() if any(n in at for n in names)}
        if "name" in found or ("article" in found and len(found) >= 2):
            body = cells.filter((F.col("sheet") == r.sheet) & (F.col("row") > r.row))
            return resolve_headers(body.select(*[F.get("cells", F.lit(i)).alias(name) for name, i in at.items()]))
        if r.sheet != head[0].sheet:
            break
    raise ValueError(f"No column for a name in {path}")


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """One workbook with a sheet for each table: its column names, then its rows as texts in the order of their first columns.
    A report for readers: one task writes it as a stream, and a table with more rows than a sheet can have goes on in another."""
    def told(n: int, name: str, rows: DataFrame) -> DataFrame:
        body = rows.toDF(*[f"_c{i}" for i in range(len(rows.columns))])
        cells = F.array(*[F.col(c).cast("string") for c in body.columns])
        head = rows.sparkSession.range(1).select(F.lit(n).alias("n"), F.lit(0).alias("part"), F.lit(name).alias("sheet"), F.array(*[F.lit(c) for c in rows.columns]).alias("cells"))
        return head.unionByName(body.select(F.lit(n).alias("n"), F.lit(1).alias("part"), F.lit(name).alias("sheet"), cells.alias("cells")))

    rows = reduce(DataFrame.unionByName, [told(n, name, t) for n, (name, t) in enumerate(sheets.items())])
    register(rows.sparkSession)
    ordered = rows.repartition(1).sortWithinPartitions("n", "part", "cells")
    ordered.select("sheet", "cells").write.format("workbook").mode("overwrite").save(folder)
