"""Bounded chunks of a table, and file streams that run a table step for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..table import Table, from_frame, new, session


def chunked(table: Table, size: int = 1000) -> Iterator[Table]:
    """Tables of at most size rows in order, a partition at a time on the driver."""
    size = size if size > 0 else 1000
    held = []
    for r in table.df.toLocalIterator():
        held.append(list(r))
        if len(held) == size:
            yield new(table.headers, held)
            held = []
    if held:
        yield new(table.headers, held)


def file_stream(path: str, schema: str, fmt: str = "parquet", max_files: int = 16, **options) -> DataFrame:
    """A stream of the files of a folder."""
    reader = session().readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def for_each_batch(stream: DataFrame, step: Callable[[Table], Table], sink: Callable[[Table, int], None], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Run step over each micro-batch as a table and hand the result and the batch's number to sink."""

    def run(batch: DataFrame, number: int) -> None:
        sink(step(from_frame(batch, order)), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """Rows a window of event time and value of a column, for rows at most `late` behind."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
