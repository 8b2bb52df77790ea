"""JSON arrays and streams of objects, in and out; numbers are kept as written."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import quoted
from ..operators import jsontext
from ..plans.result import Err, Ok, Result
from ..storage import open_output
from ..table import ORD, Table, session, unique_names


@dataclass(frozen=True)
class JSONReader:
    """An array of objects, or with ndjson a stream of them; columns as first seen unless sorted."""

    ndjson: bool = False
    sorted_headers: bool = False
    flatten: bool = False
    max_depth: int = 0
    separator: str = "."
    mapping: dict[str, str] | None = None

    def _check(self):
        if self.flatten and self.mapping:
            raise ValueError("flatten and a field mapping exclude each other")
        if self.max_depth < 0:
            raise ValueError("max depth must not be negative")
        return {n: jsontext.parse_path(p) for n, p in sorted((self.mapping or {}).items())}

    def _fields(self, value, paths) -> list[tuple[str, str]]:
        if not isinstance(value, dict):
            raise ValueError("record is not an object")
        if paths:
            return [(n, jsontext.text(jsontext.follow(value, p))) for n, p in paths.items()]
        if self.flatten:
            return list(dict(jsontext.flatten(value, "", self.separator, self.max_depth)).items())
        return [(k, jsontext.text(v)) for k, v in value.items()]

    def _objects(self, text: str) -> Iterator:
        """All values of a text."""
        text = text.lstrip("﻿").strip(" \t\r\n")
        if not text:
            return
        if not self.ndjson:
            found = jsontext.decode(text)
            if not isinstance(found, list):
                raise ValueError("top level is not an array")
            yield from found
            return
        decoder, at = json.JSONDecoder(parse_float=jsontext._Number, parse_int=jsontext._Number), 0
        while at < len(text):
            value, at = decoder.raw_decode(text, at)
            yield value
            while at < len(text) and text[at] in " \t\r\n":
                at += 1

    def read_file(self, path: str, lines: bool = False) -> Result:
        """A table of a file, a folder or a pattern, a task a file; with lines (ndjson, an object a line) files are split."""
        try:
            paths = self._check()
            spark = session()
            source = spark.read.text(path, wholetext=not (lines and self.ndjson))
            order = F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
            return Ok(self._table(source.select(F.col("value"), order.alias("__f")), paths, os.path.basename(path)))
        except Exception as error:  # a bad file or option is a value here
            return Err(error)

    def read_string(self, text: str) -> Result:
        try:
            spark = session()
            source = spark.createDataFrame([(text, 0)], "value string, i long").select("value", F.struct(F.lit("").alias("f"), F.col("i")).alias("__f"))
            return Ok(self._table(source, self._check(), ""))
        except Exception as error:
            return Err(error)

    def read(self, source) -> Result:
        """An open text or binary file."""
        data = source.read()
        return self.read_bytes(data) if isinstance(data, bytes) else self.read_string(data)

    def read_bytes(self, data: bytes) -> Result:
        return self.read_string(data.decode())

    def _table(self, source: DataFrame, paths, name: str) -> Table:
        def parse(text: str):
            return [[{"k": k, "v": v} for k, v in self._fields(x, paths)] for x in self._objects(text)]

        rows = source.select("__f", F.posexplode(F.udf(parse, "array<array<struct<k:string,v:string>>>", useArrow=True)("value")).alias("__n", "__x"))
        rows = rows.select(F.struct("__f", "__n").alias(ORD), "__x")
        if paths:
            keys = list(paths)
        else:
            seen = rows.select(ORD, F.posexplode("__x").alias("p", "e")).groupBy("e.k").agg(F.min(F.struct(ORD, "p")).alias("o"))
            keys = [r["k"] for r in seen.orderBy("o").collect()]
        if self.sorted_headers:
            keys = sorted(keys, key=lambda k: k.encode())
        held = rows.withColumn("__m", F.map_from_entries("__x"))
        cells = [F.coalesce(F.try_element_at("__m", F.lit(k)), F.lit("")).alias(n) for k, n in zip(keys, unique_names(keys), strict=True)]
        return Table(held.select(*cells, ORD), source=name)


@dataclass(frozen=True)
class JSONWriter:
    """Every cell a JSON string, keys sorted."""

    ndjson: bool = False
    indent: str | None = None

    def _rows(self, table: Table) -> Iterator[dict]:
        names = sorted(table.headers, key=lambda n: n.encode())
        for r in table.df.select(*map(quoted, names)).toLocalIterator():
            yield dict(zip(names, r, strict=True))

    def write(self, out, table: Table) -> None:
        """The objects in order to an open text file, one at a time."""
        separators = (",", ": ") if self.indent else (",", ":")
        one = lambda r: json.dumps(r, ensure_ascii=False, indent=self.indent, separators=separators)
        if self.ndjson:
            for r in self._rows(table):
                out.write(json.dumps(r, ensure_ascii=False, separators=(",", ":")) + "\n")
            return
        lead = "\n" + self.indent if self.indent else ""
        some = False
        for r in self._rows(table):
            out.write(("," if some else "[") + lead + one(r).replace("\n", lead or "\n"))
            some = True
        out.write(("\n" if self.indent else "") + "]" if some else "[]")

    def to_string(self, table: Table) -> str:
        out = io.StringIO()
        self.write(out, table)
        return out.getvalue()

    def write_file(self, path: str, table: Table) -> None:
        """One file at any path that Spark writes to."""
        with open_output(path, text=True) as out:
            self.write(out, table)

    def write_folder(self, path: str, table: Table) -> None:
        """Objects, one a line, in part files written in parallel."""
        names = sorted(table.headers, key=lambda n: n.encode())
        table.df.select(F.to_json(F.struct(*map(quoted, names)))).write.mode("overwrite").text(path)


def to_string(table: Table) -> str:
    return JSONWriter().to_string(table)
