"""Workbooks (XLSX) as a Spark data source on the standard library: a partition per file and sheet, rows streamed out of the XML.

``spark.dataSource.register(XlsxSource)``, then ``spark.read.format("xlsx").option("header_rows", 2).load(path)``. Paths are local or on
a file system that all machines mount; for other stores, ``workbook_rows`` gets the bytes by Spark's own file reader.
"""

from __future__ import annotations

import datetime
import glob
import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Day 0 of serial dates, with which 1900-03-01 and later come out right, and the built-in formats of dates.
EPOCH = datetime.datetime(1899, 12, 30)
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
_CELL = re.compile(r"([A-Z]+)(\d+)")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node) -> str:
    """The runs of a string; phonetic hints are no part of it."""
    return "".join(t.text or "" for part in node if _local(part.tag) in ("t", "r") for t in ([part] if _local(part.tag) == "t" else [x for x in part if _local(x.tag) == "t"]))


def _elements(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator:
    """Elements of one name, each forgotten when the next is asked for."""
    if name not in book.namelist():
        return
    with book.open(name) as stream:
        path = []
        for event, node in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                path.append(node)
                continue
            path.pop()
            if _local(node.tag) == wanted:
                yield node
                if path:
                    path[-1].remove(node)


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names to their parts, in the order of the workbook."""
    links = {r.get("Id"): r.get("Target") for r in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    out = {}
    for s in _elements(book, "xl/workbook.xml", "sheet"):
        target = links.get(next((v for k, v in s.attrib.items() if _local(k) == "id"), None))
        if target:
            out[s.get("name")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    own = {int(f.get("numFmtId")) for f in _elements(book, "xl/styles.xml", "numFmt") if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.IGNORECASE)}
    styles = next(_elements(book, "xl/styles.xml", "cellXfs"), None)
    return {i for i, x in enumerate(styles if styles is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None]]]:
    """Number from 1 and cells of each row; numbers as they are written, dates as ISO text, errors as null. Shared strings are read once."""
    shared = [_text(s) for s in _elements(book, "xl/sharedStrings.xml", "si")]
    dates = _date_styles(book)
    for at, row in enumerate(_elements(book, part, "row"), 1):
        cells: list[str | None] = []
        for c in row:
            place = _CELL.match(c.get("r") or "")
            column = _column(place[1]) if place else len(cells)
            cells += [None] * (column + 1 - len(cells))
            kind, value = c.get("t", "n"), next((v.text for v in c if _local(v.tag) == "v"), None)
            if kind == "inlineStr":
                cells[column] = next((_text(v) for v in c if _local(v.tag) == "is"), None)
            elif value is None or kind == "e":
                cells[column] = None
            elif kind == "s":
                cells[column] = shared[int(value)]
            elif kind == "b":
                cells[column] = "true" if value == "1" else "false"
            elif kind == "n" and int(c.get("s", -1)) in dates:
                moment = EPOCH + datetime.timedelta(seconds=round(float(value) * 86400))
                cells[column] = moment.date().isoformat() if moment.time() == datetime.time() else moment.isoformat(" ")
            else:
                cells[column] = value
        yield int(row.get("r") or at), cells


def headers(rows: list[list[str | None]]) -> list[str]:
    """A name for each column out of header rows on top of each other, joined by line ends; blank ones are c0, c1, ..., repeated ones numbered."""
    out: list[str] = []
    for i in range(max(map(len, rows), default=0)):
        name = "\n".join(str(r[i]) for r in rows if i < len(r) and r[i] not in (None, "")) or f"c{i}"
        out.append(name if name not in out else f"{name}_{i}")
    return out


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return sorted(glob.glob(os.path.join(path, "**", "*.xlsx"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))


@dataclass
class _Sheet(InputPartition):
    file: str
    part: str


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, sheet: str | None, skip: int) -> None:
        self.width, self.path, self.sheet, self.skip = len(schema), path, sheet, skip

    def partitions(self) -> list[_Sheet]:
        out = []
        for file in _files(self.path):
            with zipfile.ZipFile(file) as book:
                out += [_Sheet(file, part) for name, part in sheets(book).items() if self.sheet in (None, name)]
        return out

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.file) as book:
            for number, cells in sheet_rows(book, partition.part):
                if number > self.skip and any(c not in (None, "") for c in cells):
                    yield tuple([*cells, *[None] * self.width][: self.width])


class XlsxSource(DataSource):
    """Columns of text, named by ``header_rows`` (1) rows of the first sheet, or of ``sheet``; all sheets are read, or that one. Blank rows are left out."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _skip(self) -> int:
        return int(self.options.get("header_rows", 1))

    def schema(self) -> StructType:
        found = _files(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        with zipfile.ZipFile(found[0]) as book:
            all_ = sheets(book)
            part = all_[self.options["sheet"]] if "sheet" in self.options else next(iter(all_.values()))
            head, width = [], 0
            for number, cells in sheet_rows(book, part):
                width = max(width, len(cells))
                if number > self._skip():
                    break
                head.append(cells)
        return StructType([StructField(n, StringType()) for n in headers([*head, [None] * width])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"], self.options.get("sheet"), self._skip())


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row_number, cells of all sheets of the workbooks at ``path``, in any store that Spark reads; a file's bytes lie in one row."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    for name, part in sheets(book).items():
                        held: list[tuple] = []
                        for number, cells in sheet_rows(book, part):
                            held.append((file, name, number, cells))
                            if len(held) == 10_000:
                                yield pd.DataFrame(held, columns=["path", "sheet", "row_number", "cells"])
                                held = []
                        yield pd.DataFrame(held, columns=["path", "sheet", "row_number", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, sheet string, row_number int, cells array<string>")
