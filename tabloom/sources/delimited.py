"""CSV in and out."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.result import Err, Ok, Result
from ..storage import open_output
from ..table import ORD, Table, new, session, unique_names

#: A text that no cell holds, so that empty cells aren't read as nulls.
_NO_NULL = "\x00null\x00"


@dataclass(frozen=True)
class CSVReader:
    """header, separator, names; multiline False lets Spark split files (no line breaks within cells)."""

    header: bool = True
    separator: str = ","
    names: tuple[str, ...] | None = None
    multiline: bool = True

    def with_header_names(self, *names: str) -> CSVReader:
        return replace(self, names=names, header=False)

    def _options(self, reader):
        return reader.option("sep", self.separator).option("quote", '"').option("escape", '"').option("multiLine", self.multiline).option("nullValue", _NO_NULL).option("emptyValue", "").option("header", False)

    def read_file(self, path: str) -> Result:
        """A lazy table of a file, a folder or a pattern; malformed records fail when they are read."""
        try:
            spark = session()
            first = self._options(spark.read).option("mode", "PERMISSIVE").csv(path).limit(1).collect()
        except Exception as error:  # an unreadable path is a value here
            return Err(error)
        cells = [c or "" for c in first[0]] if first else []
        width = len(cells)
        if not width:
            return Ok(new(list(self.names or ()), []).with_source(os.path.basename(path)))
        names = unique_names(cells if self.header else self.names or [f"col_{i}" for i in range(width)])
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
        df = self._options(spark.read).option("mode", "FAILFAST").option("header", self.header).option("enforceSchema", True).schema(schema).csv(path)
        order = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        picked = [F.coalesce(F.col(f"c{i}"), F.lit("")) if i < width else F.lit("") for i in range(len(names))]
        return Ok(Table(df.select(*(c.alias(n) for c, n in zip(picked, names, strict=False)), order.alias(ORD)), source=os.path.basename(path)))

    def read_string(self, text: str) -> Result:
        """A small text, parsed on the driver; records of unequal width fail."""
        try:
            rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=self.separator, strict=True) if r]
        except csv.Error as error:
            return Err(error)
        if not rows:
            return Ok(new(list(self.names or ()), []))
        uneven = next((i for i, r in enumerate(rows) if len(r) != len(rows[0])), None)
        if uneven is not None:
            return Err(ValueError(f"record {uneven + 1}: wrong number of fields"))
        if self.header:
            return Ok(new(rows[0], rows[1:]))
        return Ok(new(list(self.names or (f"col_{i}" for i in range(len(rows[0])))), rows))

    def read(self, source) -> Result:
        """An open text or binary file of a small text, parsed on the driver."""
        data = source.read()
        return self.read_string(data.decode() if isinstance(data, bytes) else data)

    def read_stream(self, source, chunk_size: int = 1000) -> Iterator[Table]:
        """Tables of at most chunk_size rows of an open text file, parsed as they are asked for; rows are padded or cut to the first one's width."""
        size, held, names = chunk_size if chunk_size > 0 else 1000, [], None
        for r in csv.reader(source, delimiter=self.separator, strict=True):
            if not r:
                continue
            if names is None:
                names = r if self.header else list(self.names or (f"col_{i}" for i in range(len(r))))
                if self.header:
                    continue
            held.append(r)
            if len(held) == size:
                yield new(names, held)
                held = []
        if held:
            yield new(names, held)

    def read_file_stream(self, path: str, chunk_size: int = 1000) -> Iterator[Table]:
        """Tables of at most chunk_size rows, read as they are asked for."""
        from ..streaming.chunks import chunked

        yield from chunked(self.read_file(path).unwrap(), chunk_size)


@dataclass(frozen=True)
class CSVWriter:
    header: bool = True
    separator: str = ","

    def write_file(self, path: str, table: Table) -> None:
        """One file at any path that Spark writes to, streamed row by row in order."""
        with open_output(path, text=True) as out:
            self.write(out, table)

    def write(self, out, table: Table) -> None:
        """The rows in order to an open text file."""
        w = csv.writer(out, delimiter=self.separator, lineterminator="\n")
        if self.header:
            w.writerow(table.headers)
        for r in table.df.toLocalIterator():
            w.writerow(list(r))

    def write_folder(self, path: str, table: Table) -> None:
        """Part files written in parallel, in row order from part to part."""
        table.df.write.mode("overwrite").option("header", self.header).option("sep", self.separator).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)

    def to_string(self, table: Table) -> str:
        out = io.StringIO()
        self.write(out, table)
        return out.getvalue()


def to_string(table: Table) -> str:
    return CSVWriter().to_string(table)


