"""XLSX workbooks as a Spark data source: a partition for each workbook, read by the task that has it.

    spark.dataSource.register(Workbooks)
    spark.read.format("workbook").load("s3://bucket/folder")

The path names a workbook, a folder of them or a pattern in a folder, in any store
that pyarrow opens. Of each workbook the first sheet counts, its first row names the
columns, and all cells are strings (null where empty). Without a schema the columns are
those of the first workbook; workbooks meet a schema by name, in any order, and
columns they lack are null.

A sheet is read as a stream of XML events, rows leave in batches of bounded size,
and of the shared strings, which cells name by number in any order, only their bytes
and ends are held: what a task needs is about the size of that part and of one batch,
not of the sheet.
"""

from __future__ import annotations

import fnmatch
import posixpath
import zipfile
from array import array
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows and bytes of text in a batch.
BATCH_ROWS, BATCH_BYTES = 4096, 1 << 20


class Strings:
    """Shared strings by number, held as bytes."""

    def __init__(self, source: IO[bytes] | None):
        self.text, self.ends = bytearray(), array("Q")
        if source is None:
            return
        for item in _elements(source, "si"):
            # Readings beside the text (rPh) are no part of it.
            for child in item:
                if child.tag == f"{MAIN}t":
                    self.text += (child.text or "").encode()
                elif child.tag == f"{MAIN}r":
                    self.text += "".join(t.text or "" for t in child.iter(f"{MAIN}t")).encode()
            self.ends.append(len(self.text))

    def __getitem__(self, n: int) -> str:
        return self.text[self.ends[n - 1] if n else 0 : self.ends[n]].decode()


def _elements(source: IO[bytes], name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; what was read is let go."""
    root = None
    for event, element in ElementTree.iterparse(source, ("start", "end")):
        if root is None:
            root = element
        if event == "end" and element.tag == f"{MAIN}{name}":
            yield element
            # Rows and strings stand one level below the root or within one of its children.
            element.clear()
            for child in root:
                if len(child) and child[-1] is element:
                    child.clear()
            if len(root) and root[-1] is element:
                root.clear()


def _column(reference: str) -> int:
    """Number (from 0) of a cell like AB12; -1 without letters."""
    n = 0
    for c in reference.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, strings: Strings) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t")) or None
    found = cell.find(f"{MAIN}v")
    if found is None or found.text is None:
        return None
    if kind == "s":
        return strings[int(found.text)] or None
    return {"1": "True", "0": "False"}.get(found.text, found.text) if kind == "b" else found.text


def _first_sheet(book: zipfile.ZipFile) -> str:
    """Its name in the archive, by the workbook's own order."""
    names = book.namelist()
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets/{MAIN}sheet")
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        if sheet is not None and (target := links.get(sheet.get(LINK))):
            name = posixpath.normpath(posixpath.join("xl", target)) if not target.startswith("/") else target[1:]
            if name in names:
                return name
    return min(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml"))


def rows(file: IO[bytes], most: int | None = None) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet, at most ``most``; cells that are left out are null."""
    with zipfile.ZipFile(file) as book:
        strings = Strings(book.open("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in book.namelist() else None)
        with book.open(_first_sheet(book)) as sheet:
            for n, row in enumerate(_elements(sheet, "row")):
                if n == most:
                    return
                cells: list[str | None] = []
                for cell in row.iter(f"{MAIN}c"):
                    at = _column(cell.get("r") or "")
                    cells += [None] * (at - len(cells))
                    cells.append(_value(cell, strings))
                yield cells


def _located(path: str) -> tuple[fs.FileSystem, list[str]]:
    """Where the workbooks are, in order of their names."""
    head, pattern = path, "*.xls[xm]"
    if any(c in posixpath.basename(path) for c in "*?["):
        head, pattern = posixpath.split(path)
    store, folder = fs.FileSystem.from_uri(head) if "://" in head else (fs.LocalFileSystem(), head.removeprefix("file:"))
    info = store.get_file_info(folder)
    if info.type == fs.FileType.File:
        return store, [folder]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = (f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File)
    return store, sorted(f for f in found if fnmatch.fnmatch(posixpath.basename(f), pattern) and not posixpath.basename(f).startswith("~$"))


class Workbook(InputPartition):
    def __init__(self, path: str, number: int):
        super().__init__((path, number))


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        """Of the first workbook's header, which is all that is read of it."""
        store, paths = _located(self.options["path"])
        if not paths:
            return T.StructType([])
        with store.open_input_file(paths[0]) as file:
            header = next(rows(file, 1), [])
        names = [h or f"_c{i}" for i, h in enumerate(header)]
        if len({n.lower() for n in names}) < len(names):
            raise ValueError(f"{paths[0]} names a column twice")
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options["path"], schema.names)


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        return [Workbook(self.path, n) for n in range(len(_located(self.path)[1]))] or [Workbook(self.path, -1)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, number = partition.value
        if number < 0:
            return
        store, paths = _located(path)
        with store.open_input_file(paths[number]) as file:
            told = rows(file)
            header = [h or f"_c{i}" for i, h in enumerate(next(told, []))]
            at = [header.index(n) if n in header else None for n in self.names]
            held: list[list[str | None]] = []
            size = 0
            for row in told:
                held.append([row[i] if i is not None and i < len(row) else None for i in at])
                size += sum(len(c) for c in held[-1] if c)
                if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)

    def _batch(self, held: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=self.names)


def read_xlsx(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The first sheets of the workbooks at ``path``; ``schema`` names the columns wanted, all of them strings."""
    spark.dataSource.register(Workbooks)
    reader = spark.read.format("workbook")
    return (reader.schema(schema) if schema else reader).load(path)
