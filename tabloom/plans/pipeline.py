"""Pipelines of table steps: a value or an error, an optional log of rejected rows, an optional trace."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import quoted
from ..operators import ordered
from ..storage import materialise
from ..table import ORD, MutableTable, Row, Table, concat, new
from .result import Err, Ok, Result


#: Rejected rows that the driver takes at most.
ENTRIES = 1_000_000


@dataclass(frozen=True)
class StepRecord:
    """A named step: rows before and after, and seconds (plan and count)."""

    name: str
    input_rows: int
    output_rows: int
    seconds: float


class Trace(list):
    """Step records, and the frame that the last step made with its number of rows."""

    last: tuple[DataFrame, int] | None = None


@dataclass(frozen=True)
class ErrorEntry:
    source: str
    step: str
    row: int
    error: str
    original: dict[str, str]


class ErrorLog:
    """Rejected rows. They stay frames until they are asked for."""

    def __init__(self):
        self._parts: list[tuple[str, str, list[str], DataFrame]] = []

    def add(self, source: str, step: str, names: list[str], rejected: DataFrame) -> None:
        """rejected: the original columns, __i (row number) and __error."""
        self._parts.append((source, step, names, rejected))

    def entries(self) -> list[ErrorEntry]:
        """All rejected rows, ENTRIES at most; to_table takes any number."""
        if self.len() > ENTRIES:
            raise ValueError(f"more than {ENTRIES} rejected rows; use to_table")
        out = []
        for source, step, names, df in self._parts:
            out += [ErrorEntry(source, step, r["__i"], r["__error"], {n: r[n] for n in names}) for r in df.orderBy("__i").collect()]
        return out

    def has_errors(self) -> bool:
        return any(df.limit(1).count() for *_, df in self._parts)

    def len(self) -> int:
        return sum(df.count() for *_, df in self._parts)

    def to_table(self) -> Table:
        """_source, _step, _row, _error and all original columns by name."""
        meta = ["_source", "_step", "_row", "_error"]
        if not self._parts:
            return new(meta, [])
        names = sorted({n for _, _, own, _ in self._parts for n in own}, key=lambda n: n.encode())
        frames = []
        for k, (source, step, own, df) in enumerate(self._parts):
            cells = [F.lit(source), F.lit(step), F.col("__i").cast("string"), F.col("__error"), *(quoted(n) if n in own else F.lit("") for n in names)]
            order = F.struct(F.lit(k).alias("k"), F.col("__i").alias("i")).alias(ORD)
            frames.append(df.select(*(c.alias(n) for c, n in zip(cells, [*meta, *names], strict=True)), order))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return Table(out)


def _lax(table: Table, fn: Callable, col: str | None, step: str, log: ErrorLog) -> Table:
    """Good rows go on, bad rows with their number in this step's input go to the log; both from one evaluation."""
    numbered = type(table)(table._indexed(), table._errs, table._source, True)
    held = Table(numbered._df.drop("__i"), stable=True)
    tried = materialise(ordered.dense_index(held._attempt(fn, col), ORD))
    bad = tried.filter(F.col("__try.e").isNotNull()).select(*map(quoted, held.headers), "__i", F.col("__try.e").alias("__error"))
    log.add(table.source(), step, held.headers, bad)
    return table._new(held._applied(tried.filter(F.col("__try.e").isNull()), col), True)


@dataclass(frozen=True)
class Pipeline:
    """Steps over an immutable table; after an error the steps are skipped."""

    held: Result
    log: ErrorLog | None = None
    records: list[StepRecord] | None = field(default=None, compare=False)

    def _next(self, result: Result) -> Pipeline:
        return type(self)(result, self.log, self.records)

    def with_error_log(self, log: ErrorLog) -> Pipeline:
        return type(self)(self.held, log, self.records)

    def then(self, fn: Callable[[Table], Table]) -> Pipeline:
        return self._next(Ok(fn(self.held.value)) if isinstance(self.held, Ok) else self.held)

    def then_err(self, fn: Callable[[Table], Result]) -> Pipeline:
        return self._next(self.held.then(fn))

    def try_map(self, col: str, fn: Callable[[str], str]) -> Pipeline:
        if self.log is None:
            return self.then_err(lambda t: t.try_map(col, fn))
        step = f"TryMap({col})"

        def run(t: Table) -> Result:
            if col not in t.headers:
                return Err(ValueError(f'{step}: unknown column "{col}"'))
            return Ok(_lax(t, fn, col, step, self.log))

        return self.then_err(run)

    def try_transform(self, fn: Callable[[Row], dict[str, str]]) -> Pipeline:
        if self.log is None:
            return self.then_err(lambda t: t.try_transform(fn))
        return self.then_err(lambda t: Ok(_lax(t, fn, None, "TryTransform", self.log)))

    def apply_schema(self, schema) -> Pipeline:
        return self.then_err(schema.apply)

    def apply_schema_strict(self, schema) -> Pipeline:
        return self.then_err(schema.apply_strict)

    def assert_columns(self, *cols: str) -> Pipeline:
        return self.then_err(lambda t: Err(e) if (e := Table.assert_columns(t, *cols)) else Ok(t))

    def assert_no_empty(self, *cols: str) -> Pipeline:
        return self.then_err(lambda t: Err(e) if (e := t.assert_no_empty(*cols)) else Ok(t))

    def peek(self, fn: Callable[[Table], Any]) -> Pipeline:
        if isinstance(self.held, Ok):
            fn(self.held.value)
        return self

    def if_then(self, cond: bool, fn: Callable[[Table], Table]) -> Pipeline:
        return self.then(fn) if cond else self

    def if_then_err(self, cond: bool, fn: Callable[[Table], Result]) -> Pipeline:
        return self.then_err(fn) if cond else self

    def recover_with(self, fallback: Table) -> Pipeline:
        return self if self.is_ok() else self._next(Ok(fallback))

    def on_error(self, fn: Callable[[Exception], Table]) -> Pipeline:
        """fn's table, or what fn raises as the new error."""
        return self if self.is_ok() else self._next(Ok(self.held.error).then(fn))

    def map_err(self, fn: Callable[[Exception], Exception]) -> Pipeline:
        return self if self.is_ok() else self._next(Err(fn(self.held.error)))

    def fan_out(self, *fns: Callable[[Table], Table]) -> list[Pipeline]:
        """A pipeline for each function; the branches are planned side by side."""
        if not fns:
            return []
        with ThreadPoolExecutor(len(fns)) as pool:
            return list(pool.map(self.then, fns))

    def concat_with(self, other: Pipeline) -> Pipeline:
        return concat_pipelines(self, other)

    def group_by(self, col: str) -> dict[str, Pipeline]:
        """A pipeline for each value; an error stands under the empty key."""
        if isinstance(self.held, Err):
            return {"": self}
        return {k: self._next(Ok(t)) for k, t in self.held.value.group_by(col).items()}

    def partition(self, fn) -> tuple[Pipeline, Pipeline]:
        if isinstance(self.held, Err):
            return self, self
        a, b = self.held.value.partition(fn)
        return self._next(Ok(a)), self._next(Ok(b))

    def chunk(self, n: int) -> list[Pipeline]:
        return [self] if isinstance(self.held, Err) else [self._next(Ok(t)) for t in self.held.value.chunk(n)]

    def with_tracing(self) -> Pipeline:
        return type(self)(self.held, self.log, Trace())

    def _traced(self, name: str, run: Callable[[], Pipeline]) -> Pipeline:
        if self.records is None or not self.is_ok():
            return run()
        # the rows a step starts from are those the step before it ended with, counted once
        last = getattr(self.records, "last", None)
        before = last[1] if last is not None and last[0] is self.held.value._df else self.held.value.len()
        began = time.monotonic()
        out = run()
        after = out.held.value.len() if out.is_ok() else 0
        self.records.append(StepRecord(name, before, after, time.monotonic() - began))
        self.records.last = (out.held.value._df, after) if out.is_ok() else None
        return out

    def step(self, name: str, fn: Callable[[Table], Table]) -> Pipeline:
        return self._traced(name, lambda: self.then(fn))

    def apply(self, transform: Transform) -> Pipeline:
        return self._traced(transform.name, lambda: transform.fn(self))

    def trace(self) -> list[StepRecord] | None:
        return None if self.records is None else list(self.records)

    def result(self) -> Result:
        return self.held

    def unwrap(self) -> Table:
        return self.held.unwrap()

    def is_ok(self) -> bool:
        return self.held.is_ok()

    def is_err(self) -> bool:
        return self.held.is_err()


class MutablePipeline(Pipeline):
    """Steps over a mutable table; branches get copies."""

    def fan_out(self, *fns):
        copies = [self._next(Ok(MutableTable(self.held.value.freeze())) if isinstance(self.held, Ok) else self.held) for _ in fns]
        return [p.then(fn) for p, fn in zip(copies, fns, strict=True)]

    def frozen(self) -> Pipeline:
        return Pipeline(Ok(self.held.value.freeze()) if isinstance(self.held, Ok) else self.held, self.log, self.records)


@dataclass(frozen=True)
class Transform:
    """A named function from pipeline to pipeline."""

    name: str
    fn: Callable[[Pipeline], Pipeline]


def from_table(table: Table) -> Pipeline:
    return Pipeline(Ok(table.freeze() if table.mutable else table))


def from_result(result: Result) -> Pipeline:
    return Pipeline(result)


def from_mutable(table: MutableTable) -> MutablePipeline:
    return MutablePipeline(Ok(table))


def concat_pipelines(*pipelines: Pipeline) -> Pipeline:
    """All tables one after the other; the first error wins."""
    for p in pipelines:
        if p.is_err():
            return p
    return Pipeline(Ok(concat(*(p.held.value for p in pipelines))))


def compose(*fns: Callable[[Table], Table]) -> Callable[[Table], Table]:
    """fns from left to right as one function."""

    def run(table: Table) -> Table:
        for fn in fns:
            table = fn(table)
        return table

    return run
