"""Workbooks row by row: a reader over the packed parts, and a Spark data source with a partition per sheet.

Sheets are parsed as they are unpacked, and a row's elements are dropped once it is read, so memory holds a row and the
book's shared strings, however long the sheets are.
"""

from __future__ import annotations

import datetime
import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: The number formats of spreadsheets that show dates or times without being written out in a file.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _date_styles(styles) -> set[int]:
    """Positions of the cell styles that show dates or times."""
    dates = set(_DATE_FORMATS)
    for f in styles.iter(f"{M}numFmt"):
        # Literal parts and colours say nothing; what is left of a date format has a day, month, year, hour or second.
        code = re.sub(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", (f.get("formatCode") or "").lower()).split(";")[0]
        if re.search("[ymdhs]", code) and "general" not in code:
            dates.add(int(f.get("numFmtId")))
    used = styles.find(f"{M}cellXfs")
    return {i for i, x in enumerate(used if used is not None else []) if int(x.get("numFmtId") or 0) in dates}


def _date_text(serial: float, from_1904: bool) -> str:
    """A date cell's number as text: a time alone below one day, else date and time."""
    seconds = datetime.timedelta(seconds=round(serial * 86400))
    if 0 <= serial < 1 and not from_1904:
        return str((datetime.datetime.min + seconds).time())
    if from_1904:
        return str(datetime.datetime(1904, 1, 1) + seconds)
    # The usual calendar counts a 29 February 1900 that never was.
    return str(datetime.datetime(1899, 12, 31 if serial < 60 else 30) + seconds)


def _column(reference: str | None) -> int:
    """Column of a cell reference such as ``AB12``, from 0; -1 without one."""
    index = 0
    for letter in (reference or "").rstrip("0123456789"):
        index = index * 26 + ord(letter) - 64
    return index - 1


class Book:
    """A packed workbook: ``sheets`` are (name, part) in order, :meth:`rows` yields a sheet's rows."""

    def __init__(self, file):
        self.package = zipfile.ZipFile(file)
        targets = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        workbook = self._tree("xl/workbook.xml")
        parts = [(s.get("name"), targets[s.get(_REL)].lstrip("/")) for s in workbook.find(f"{M}sheets")]
        self.sheets = [(name, part if part.startswith("xl/") else f"xl/{part}") for name, part in parts]
        calendar = workbook.find(f"{M}workbookPr")
        self.from_1904 = calendar is not None and calendar.get("date1904") in ("1", "true")
        self._shared: list[str] | None = None
        self._dated: set[int] | None = None

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *error) -> None:
        self.package.close()

    def _tree(self, part: str):
        return ElementTree.fromstring(self.package.read(part))

    def _read_shared(self) -> None:
        names, self._shared, self._dated = set(self.package.namelist()), [], set()
        if "xl/sharedStrings.xml" in names:
            self._shared = ["".join(t.text or "" for t in si.iter(f"{M}t")) for si in self._elements("xl/sharedStrings.xml", "si")]
        if "xl/styles.xml" in names:
            self._dated = _date_styles(self._tree("xl/styles.xml"))

    def _elements(self, part: str, name: str) -> Iterator:
        """A part's elements of a name as they are unpacked; each is emptied when the next one is asked for."""
        with self.package.open(part) as stream:
            root = None
            for event, node in ElementTree.iterparse(stream, ("start", "end")):
                if root is None:
                    root = node
                if event == "end" and node.tag == f"{M}{name}":
                    yield node
                    node.clear()
                    # The emptied elements themselves would add up, in the root or in its only large child.
                    for parent in (root, *root[-1:]):
                        if len(parent) and parent[0] is node:
                            parent.clear()

    def rows(self, part: str) -> Iterator[list[str | None]]:
        if self._shared is None:
            self._read_shared()
        for row in self._elements(part, "row"):
            cells: list[str | None] = []
            for cell in row.findall(f"{M}c"):
                cells.extend([None] * (_column(cell.get("r")) - len(cells)))
                cells.append(self._value(cell))
            yield cells

    def _value(self, cell) -> str | None:
        kind, v = cell.get("t"), cell.find(f"{M}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{M}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self._shared[int(v.text)]
        if kind == "b":
            return str(v.text == "1")
        if kind in ("str", "e"):
            return v.text
        if kind == "d":
            return v.text.replace("T", " ")
        if int(cell.get("s") or 0) in self._dated:
            return _date_text(float(v.text), self.from_1904)
        return v.text if v.text.lstrip("-").isdigit() else repr(float(v.text))


class SheetPart(InputPartition):
    def __init__(self, path: str, sheet: str, part: str):
        super().__init__((path, sheet, part))


class BookReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern.removeprefix("file://").removeprefix("file:")

    def partitions(self) -> list[InputPartition]:
        """One per sheet.  Only the lists of sheets are read here."""
        places = os.path.join(self.pattern, "*.xlsx") if os.path.isdir(self.pattern) else self.pattern
        found: list[InputPartition] = []
        for path in sorted(glob.glob(places)):
            with Book(path) as book:
                found += [SheetPart(path, name, part) for name, part in book.sheets]
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        path, sheet, part = partition.value
        with Book(path) as book:
            for number, cells in enumerate(book.rows(part), 1):
                yield (path, sheet, number, cells)


class BookSource(DataSource):
    """``spark.read.format("xlsx").load(folder or pattern)``: ``path, sheet, row, cells``.

    The path must be on a file system that driver and executors mount.  A file that is no workbook is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "path string, sheet string, row bigint, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return BookReader(self.options["path"])
