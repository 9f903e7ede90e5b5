"""XLSX workbooks as a data source of Spark: rows of cells, dealt by files and sheets.

    spark.dataSource.register(Workbooks)
    spark.read.format("workbooks").load("file:///folder")
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import iterparse
from zipfile import BadZipFile, ZipFile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of files that one task reads, unless option taskBytes says otherwise; a larger file is dealt by its sheets.
TASK_BYTES = 32 << 20
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass
class Part(InputPartition):
    #: Files, and the one sheet of a single file (none: all).
    paths: list[str]
    sheet: str | None = None


def _archive(stream) -> ZipFile | None:
    try:
        return ZipFile(stream)
    except (BadZipFile, ValueError):  # a short file can't be sought in from its end
        return None


def _elements(archive: ZipFile, name: str, tag: str) -> Iterator:
    """Elements of a part, one held at a time; none if the archive lacks the part."""
    if name not in archive.namelist():
        return
    with archive.open(name) as stream:
        within = []
        for event, e in iterparse(stream, ("start", "end")):
            if event == "start":
                within.append(e)
                continue
            within.pop()
            if e.tag == tag:
                yield e
                # What was read leaves the tree, so that a sheet of a million rows isn't held.
                if within:
                    within[-1].remove(e)


def _sheets(archive: ZipFile) -> list[tuple[str, str]]:
    """Name and part of each sheet, in the workbook's order."""
    targets = {e.get("Id"): e.get("Target", "") for e in _elements(archive, "xl/_rels/workbook.xml.rels", "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship")}
    found = [(e.get("name", ""), targets.get(e.get(RELATION), "")) for e in _elements(archive, "xl/workbook.xml", MAIN + "sheet")]
    return [(name, t.lstrip("/") if t.startswith("/") else "xl/" + t) for name, t in found]


def _column(ref: str | None, after: int) -> int:
    letters = re.match("[A-Z]+", ref or "")
    if not letters:
        return after
    at = 0
    for c in letters[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter(MAIN + "t"))


def _rows(archive: ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    last = 0
    for row in _elements(archive, part, MAIN + "row"):
        last = int(row.get("r") or last + 1)
        cells: list[str | None] = []
        for c in row.iter(MAIN + "c"):
            at, kind = _column(c.get("r"), len(cells)), c.get("t")
            value = c.find(MAIN + "v")
            told = _text(c) if kind == "inlineStr" else value.text if value is not None else None
            if kind == "s" and told is not None:
                told = shared[int(told)] if told.strip().isdigit() and int(told) < len(shared) else None
            cells += [None] * (at + 1 - len(cells))
            cells[at] = told
        yield last, cells


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int) -> None:
        self.path, self.task_bytes = path, task_bytes

    def _open(self, path: str):
        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(path)
        return fs.open_input_file(inner)

    def partitions(self) -> list[Part]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, inner = FileSystem.from_uri(self.path)
        found = [fs.get_file_info(inner)]
        if found[0].type == FileType.Directory:
            found = fs.get_file_info(FileSelector(inner, recursive=True))
        head = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        parts, now, size = [], [], 0
        for f in sorted((f for f in found if f.type == FileType.File and f.path.lower().endswith(".xlsx")), key=lambda f: f.path):
            path = head + f.path
            if f.size > self.task_bytes:
                with self._open(path) as stream:
                    archive = _archive(stream)
                    parts += [Part([path], part) for _, part in _sheets(archive)] if archive else []
                continue
            if now and size + f.size > self.task_bytes:
                parts.append(Part(now))
                now, size = [], 0
            now, size = [*now, path], size + f.size
        return parts + ([Part(now)] if now else []) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.paths:
            with self._open(path) as stream:
                if not (archive := _archive(stream)):
                    continue
                shared = [_text(e) for e in _elements(archive, "xl/sharedStrings.xml", MAIN + "si")]
                for name, part in _sheets(archive):
                    if partition.sheet in (None, part):
                        for row_no, cells in _rows(archive, part, shared):
                            yield path, name, row_no, cells


class Workbooks(DataSource):
    """path, sheet, row_no (as the sheet numbers it) and cells (text as stored; null where a row has none before its last). Dates and formats aren't
    applied. Files that are no archives have no rows; a workbook's shared strings are held by the tasks that read it."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return "path string, sheet string, row_no long, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], int(self.options.get("taskBytes", TASK_BYTES)))


def workbook_texts(rows: DataFrame) -> DataFrame:
    """path and text: its sheets' rows in order, cells joined by a space, as upload classification reads them. A workbook is one document."""
    cells = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    lines = rows.select("path", "sheet", "row_no", F.array_join(cells, " ").alias("line")).where("line <> ''")
    sheets = lines.groupBy("path", "sheet").agg(F.concat_ws("\n", "sheet", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]), "\n")).alias("said"))
    return sheets.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "said"))), lambda x: x["said"]), "\n").alias("text"))
