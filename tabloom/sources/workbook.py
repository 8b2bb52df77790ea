"""XLSX sheets, read with the standard library from any store that Spark reads."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import functions as F

from ..plans.result import Err, Ok, Result
from ..table import ORD, Table, new, session, unique_names
from .encrypted import MAGIC, decrypted

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _bytes(path: str) -> bytes:
    found = session().read.format("binaryFile").load(path).select("content").first()
    if found is None:
        raise FileNotFoundError(path)
    return bytes(found[0])


def _opened(data: bytes, password: str | None) -> bytes:
    if data[:8] != MAGIC:
        return data
    if not password:
        raise ValueError("excel: the workbook is encrypted and needs a password")
    return decrypted(data, password)


def sheet_parts(data: bytes) -> list[tuple[str, str]]:
    """(name, part) of all sheets in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in book.iter(f"{_MAIN}sheet"):
        target = rels[s.get(f"{_REL}id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes, part: str) -> Iterator[list[str]]:
    """The rows of a sheet as text; gaps are empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
        at = 0
        with z.open(part) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r", at + 1))
                for _ in range(at + 1, number):
                    yield []
                at, cells = number, []
                for c in row.iter(f"{_MAIN}c"):
                    i = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (i - len(cells))
                    kind, v = c.get("t"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
                    else:
                        text = v.text or "" if v is not None else ""
                        cells.append(shared[int(text)] if kind == "s" and text else ("TRUE" if text == "1" else "FALSE") if kind == "b" else text)
                yield cells
                row.clear()


@dataclass(frozen=True)
class ExcelReader:
    header: bool = True
    names: tuple[str, ...] | None = None
    sheet: str | None = None
    sheet_index: int = 0
    password: str | None = None

    def _rows(self, path: str | bytes) -> Iterator[list[str]]:
        data = _opened(path if isinstance(path, bytes) else _bytes(path), self.password)
        parts = sheet_parts(data)
        if self.sheet is not None:
            found = [p for n, p in parts if n == self.sheet]
            if not found:
                raise ValueError(f'excel: sheet "{self.sheet}" not found')
            return sheet_rows(data, found[0])
        if not 0 <= self.sheet_index < len(parts):
            raise ValueError(f"excel: sheet index {self.sheet_index} out of range")
        return sheet_rows(data, parts[self.sheet_index][1])

    def read_file(self, path: str | bytes) -> Result:
        """One sheet of one workbook; all rows, the header too, padded to the widest."""
        try:
            rows = list(self._rows(path))
        except Exception as error:  # a missing file or sheet is a value here
            return Err(error)
        width = max(map(len, rows), default=0)
        rows = [r + [""] * (width - len(r)) for r in rows]
        if self.header and self.names is None:
            table = new(rows[0], rows[1:]) if rows else new([], [])
        else:
            table = new(list(self.names or (f"col_{i}" for i in range(width))), rows)
        return Ok(table if isinstance(path, bytes) else table.with_source(os.path.basename(path)))

    def read(self, source) -> Result:
        """An open binary file."""
        return self.read_file(source.read())

    def read_bytes(self, data: bytes) -> Result:
        return self.read_file(data)

    def read_folder(self, pattern: str, names: list[str]) -> Table:
        """The sheet of the index of many plain workbooks, a workbook a task, under given column names; header rows are skipped."""
        if self.password:
            raise ValueError("excel: encrypted workbooks are read one at a time")
        index, skip, width = self.sheet_index, 1 if self.header else 0, len(names)

        def rows(content) -> list[list[str]]:
            data = bytes(content)
            found = list(sheet_rows(data, sheet_parts(data)[index][1]))[skip:]
            return [(r + [""] * width)[:width] for r in found]

        read = session().read.format("binaryFile").load(pattern)
        df = read.select("path", F.posexplode(F.udf(rows, "array<array<string>>")("content")).alias("i", "r"))
        return Table(df.select(*(F.get("r", i).alias(n) for i, n in enumerate(unique_names(names))), F.struct("path", "i").alias(ORD)))

    def read_stream(self, source, chunk_size: int = 1000) -> Iterator[Table]:
        """As read_file_stream, of an open binary file."""
        yield from self.read_file_stream(source.read(), chunk_size)

    def read_file_stream(self, path: str | bytes, chunk_size: int = 1000) -> Iterator[Table]:
        """Tables of at most chunk_size rows; rows are padded or cut to the header's width."""
        rows = self._rows(path)
        first = next(rows, None)
        if first is None:
            return
        names = first if self.header and self.names is None else list(self.names or (f"col_{i}" for i in range(len(first))))
        held = [] if self.header and self.names is None else [first]
        size = chunk_size if chunk_size > 0 else 1000
        for r in rows:
            held.append(r)
            if len(held) == size:
                yield new(names, held)
                held = []
        if held:
            yield new(names, held)


def sheet_names(path, password: str | None = None) -> list[str]:
    """Of a path, bytes or an open binary file."""
    path = path.read() if hasattr(path, "read") else path
    return [n for n, _ in sheet_parts(_opened(path if isinstance(path, bytes) else _bytes(path), password))]
