"""Table: string cells, a row order, accumulated errors, over a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import predicates
from .functions.aggregates import Agg
from .functions.expr import RAW, Env, Expr, build, quoted
from .functions.values import fixed, integer, number, present, printed, shortest
from .operators import jsontext, ordered, reshape
from .operators.relational import blank
from .plans.result import Err, Ok, Result
from .storage import materialise

ORD = "__ord"
#: Columns that cells or rows may become at most.
NAMES = 10_000
_STRICT = False


def set_strict(on: bool) -> None:
    """Structural errors raise instead of being gathered."""
    global _STRICT
    _STRICT = on


def session() -> SparkSession:
    found = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return found


def unique_name(name: str, taken: Iterable[str]) -> str:
    taken = set(taken)
    if name not in taken:
        return name
    k = 2
    while f"{name}_{k}" in taken:
        k += 1
    return f"{name}_{k}"


def unique_names(names: Iterable[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        out.append(unique_name(name, out))
    return out


class Row:
    """A row seen from Python: names and cells."""

    __slots__ = ("_names", "_cells")

    def __init__(self, names: list[str], cells: list[str]):
        self._names, self._cells = list(names), list(cells)

    def get(self, name: str, default: str | None = None) -> str | None:
        return self._cells[self._names.index(name)] if name in self._names and self._names.index(name) < len(self._cells) else default

    def at(self, i: int) -> str | None:
        return self._cells[i] if 0 <= i < len(self._cells) else None

    def __getitem__(self, name: str) -> str:
        return self.get(name, "")

    def headers(self) -> list[str]:
        return list(self._names)

    def values(self) -> list[str]:
        return list(self._cells)

    def to_map(self) -> dict[str, str]:
        return dict(zip(self._names, self._cells, strict=False))


def _text(value: Any) -> str:
    """What a Python function gives for a cell, as Spark makes it a string."""
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _number(value: Any, kind: str) -> Any:
    """What a Python function gives for a number, as Arrow takes it."""
    if value is None or type(value) is (int if kind == "bigint" else float):
        return value
    import pyarrow as pa

    return pa.array([value], pa.int64() if kind == "bigint" else pa.float64())[0].as_py()


@dataclass(frozen=True)
class _Run:
    """Python functions of rows that follow each other: one UDF evaluates them in turn.

    A UDF of its own for each would start a worker of its own for each in every task.
    steps: what to do ("string", "bigint" and "double" add a column), the column, the function.
    made: the columns that the steps change or add, and their kinds; raws: those whose column of the source is kept."""

    base: DataFrame
    given: tuple[str, ...]
    raws: tuple[str, ...]
    steps: tuple[tuple[str, str, Callable], ...] = ()
    made: tuple[tuple[str, str], ...] = ()

    def headers(self) -> list[str]:
        return [*self.given, *(n for n, _ in self.made if n not in self.given)]

    def then(self, do: str, name: str, fn: Callable) -> _Run:
        kind = do if do in ("bigint", "double") else "string"
        made = dict(self.made) | {n: kind for n in ([name] if do != "transform" else self.headers())}
        return _Run(self.base, self.given, tuple(n for n in self.raws if n not in made and do != "transform"), (*self.steps, (do, name, fn)), tuple(made.items()))

    def _in_turn(self) -> Callable:
        given, steps, made = list(self.given), self.steps, self.made

        def run(r):
            names, cells, numbers = list(given), list(r), {}
            for do, name, fn in steps:
                if do == "map":
                    at = names.index(name)
                    cells[at] = _text(fn(cells[at]))
                elif do == "transform":
                    for k, v in (fn(Row(names, cells)) or {}).items():
                        if v is not None and _text(k) in names:
                            cells[names.index(_text(k))] = str(v)
                else:
                    value = fn(Row(names, cells))
                    if do != "string":
                        value = numbers[name] = _number(value, do)
                    names.append(name)
                    cells.append(printed(value) if do == "double" and value is not None else _text(value))
            now = dict(zip(names, cells, strict=True))
            was = dict(zip(given, r, strict=True))
            return (*(None if n in was and now[n] == was[n] else now[n] for n, _ in made), *(numbers[n] for n, kind in made if kind != "string"))

        return run

    def frame(self) -> DataFrame:
        numbers = [(n, kind) for n, kind in self.made if kind != "string"]
        fields = [f"m{i}: string" for i in range(len(self.made))] + [f"x{i}: {kind}" for i, (_, kind) in enumerate(numbers)]
        udf = F.udf(self._in_turn(), f"struct<{', '.join(fields)}>", useArrow=True)
        held = self.base.withColumn("__made", udf(F.struct(*(quoted(n).alias(f"c{i}") for i, n in enumerate(self.given)))))
        cells = {n: quoted(n) for n in self.given}
        cells |= {n: F.coalesce(f"__made.m{i}", cells.get(n, F.lit(""))) for i, (n, _) in enumerate(self.made)}
        raws = [quoted(RAW + n) for n in self.raws] + [F.col(f"__made.x{i}").alias(RAW + n) for i, (n, _) in enumerate(numbers)]
        return held.select(*(c.alias(n) for n, c in cells.items()), *raws, ORD)


#: Frames that a run has made, and which goes on where the next step is a Python function too.
_RUNS: WeakKeyDictionary[DataFrame, _Run] = WeakKeyDictionary()


@dataclass(frozen=True)
class SortKey:
    col: str
    ascending: bool = True


def asc(col: str) -> SortKey:
    return SortKey(col, True)


def desc(col: str) -> SortKey:
    return SortKey(col, False)


@dataclass(frozen=True)
class Case:
    when: Any
    then: Any


@dataclass(frozen=True)
class BinDef:
    max: float
    label: str


@dataclass(frozen=True)
class JSONOptions:
    flatten: bool = False
    max_depth: int = 0
    separator: str = "."
    mapping: dict[str, str] | None = None
    sorted_headers: bool = False


class Table:
    """An immutable table.

    The DataFrame has the visible columns, strings without nulls, and ``__ord``, any
    orderable value that is unique and gives the row order.  ``stable`` says that it
    is a long that comes out the same whenever the frame is computed again.
    """

    mutable = False

    def __init__(self, df: DataFrame, errs: Iterable[Exception] = (), source: str = "", stable: bool = False):
        self._df, self._errs, self._source, self._stable = df, list(errs), source, stable
        self._dense = False  # whether __ord is 0, 1, 2, ...
        self._known: tuple[DataFrame, dict[str, Column]] | None = None
        self.held: dict = {}  # statistics of this frame's columns, once worked out

    # -- state ---------------------------------------------------------------------------------

    @property
    def headers(self) -> list[str]:
        return [c for c in self._df.columns if c != ORD and not c.startswith(RAW)]

    @property
    def df(self) -> DataFrame:
        """The rows in order, without the order's column."""
        return self._df.orderBy(ORD).select(*map(quoted, self.headers))

    def errs(self) -> list[Exception]:
        return list(self._errs)

    def has_errs(self) -> bool:
        return bool(self._errs)

    def source(self) -> str:
        return self._source

    def with_source(self, name: str) -> Table:
        return type(self)(self._df, self._errs, name, self._stable)

    def copy_errs_from(self, other: Table) -> Table:
        return type(self)(self._df, [*other._errs, *self._errs], self._source, self._stable)

    def col_index(self, name: str) -> int:
        return self.headers.index(name) if name in self.headers else -1

    def len(self) -> int:
        return self._df.count()

    def shape(self) -> tuple[int, int]:
        return self.len(), len(self.headers)

    def freeze(self) -> Table:
        return Table(self._df, self._errs, self._source, self._stable)

    def thaw(self) -> MutableTable:
        return MutableTable(self)

    def rows(self) -> list[Row]:
        names = self.headers
        return [Row(names, list(r)) for r in self.df.collect()]

    def row(self, i: int) -> Row | None:
        found = self._indexed().filter(F.col("__i") == i).select(*map(quoted, self.headers)).first()
        return Row(self.headers, list(found)) if found is not None else None

    def records(self) -> list[list[str]]:
        return [list(r) for r in self.df.collect()]

    def col(self, name: str) -> list[str]:
        return [r[0] for r in self._df.orderBy(ORD).select(quoted(name)).collect()] if name in self.headers else []

    def col_as(self, name: str, parse: Callable[[str], Any]) -> list[Any]:
        out = []
        for cell in self.col(name):
            try:
                out.append(parse(cell))
            except Exception:  # cells that don't parse are skipped
                continue
        return out

    def map_col_to(self, name: str, fn: Callable[[str], Any]) -> list[Any]:
        return [fn(c) for c in self.col(name)]

    def for_each(self, fn: Callable[[int, Row], None]) -> None:
        names = self.headers
        for i, r in enumerate(self.df.toLocalIterator()):
            fn(i, Row(names, list(r)))

    # -- helpers -------------------------------------------------------------------------------

    def _env(self) -> Env:
        raws = {c.removeprefix(RAW): "text" if kind == "string" else "number" for c, kind in self._df.dtypes if c.startswith(RAW)}
        return Env(self.headers, raws)

    def _new(self, df: DataFrame, stable: bool | None = None) -> Table:
        return type(self)(df, self._errs, self._source, self._stable if stable is None else stable)

    def _fail(self, op: str, what: str) -> Table:
        message = f"{op}: {what}"
        error = ValueError(f"[{self._source}] {message}" if self._source else message)
        if _STRICT:
            raise error
        return type(self)(self._df, [*self._errs, error], self._source, self._stable)

    def _unknown(self, op: str, name: str) -> Table:
        return self._fail(op, f'unknown column "{name}"')

    def _pick(self, cols: dict[str, Column], stable: bool | None = None) -> Table:
        """A table with these columns, named as given; what is unchanged keeps the source's column too."""
        cells = self._cells()
        raws = [RAW + n for n, c in cols.items() if c is cells.get(n) and RAW + n in self._df.columns]
        return self._new(self._df.select(*(c.alias(n) for n, c in cols.items()), *map(quoted, raws), ORD), stable)

    def _cells(self) -> dict[str, Column]:
        if self._known is None or self._known[0] is not self._df:
            self._known = (self._df, {n: quoted(n) for n in self.headers})
        return dict(self._known[1])

    def _long(self) -> DataFrame:
        """The frame with a stable long order."""
        if self._stable:
            return self._df
        numbered = self._df.select(*map(quoted, self.headers), ORD).orderBy(ORD).withColumn(ORD, F.monotonically_increasing_id())
        self._df, self._stable = materialise(numbered), True
        return self._df

    def _indexed(self) -> DataFrame:
        """The frame with __i: the number of each row from 0."""
        if self._dense:
            return self._df.withColumn("__i", F.col(ORD))
        return ordered.dense_index(self._long(), ORD)

    def _numbered(self, df: DataFrame, *cols: Column) -> Table:
        """A table of a frame with __i: all rows, and their numbers as the order."""
        out = self._new(df.select(*map(quoted, self.headers), *cols, F.col("__i").alias(ORD)), True)
        out._dense = True
        return out

    def _python(self, fn: Callable, kind: str, whole_row: bool = True) -> Callable[..., Column]:
        """An Arrow UDF of a Python function of a row or a cell."""
        names = self.headers
        if not whole_row:
            return F.udf(fn, kind, useArrow=True)
        made = F.udf(lambda r: fn(Row(names, list(r))), kind, useArrow=True)
        return lambda: made(F.struct(*(quoted(n).alias(f"c{i}") for i, n in enumerate(names))))

    def _ran(self, do: str, name: str, fn: Callable) -> Table:
        """A table with what a Python function of a row, or of a cell to map, makes of each row."""
        raws = tuple(c.removeprefix(RAW) for c in self._df.columns if c.startswith(RAW))
        run = (_RUNS.get(self._df) or _Run(self._df, tuple(self.headers), raws)).then(do, name, fn)
        made = self._new(run.frame())
        _RUNS[made._df] = run
        return made

    def _of_row(self, fn, kind: str) -> Column:
        found = build(fn, self._env())
        return found if found is not None else self._python(fn, kind)()

    def _test(self, fn) -> Column:
        return F.coalesce(self._of_row(fn, "boolean"), F.lit(False))

    def _with(self, name: str, value: Column) -> Table:
        return self._pick(self._cells() | {unique_name(name, self.headers): value})

    # -- projections ---------------------------------------------------------------------------

    def select(self, *cols: str) -> Table:
        out = self
        for c in cols:
            if c not in self.headers:
                out = out._unknown("Select", c)
        kept = [c for c in cols if c in self.headers]
        return out._new(self._df.select(*(quoted(c).alias(n) for c, n in zip(kept, unique_names(kept), strict=True)), ORD))

    def drop(self, *cols: str) -> Table:
        return self._pick({n: c for n, c in self._cells().items() if n not in cols})

    def rename(self, old: str, new: str) -> Table:
        if old not in self.headers:
            return self._unknown("Rename", old)
        return self._renamed([new if n == old else n for n in self.headers])

    def rename_many(self, names: dict[str, str]) -> Table:
        return self._renamed([names.get(n, n) for n in self.headers])

    def _renamed(self, names: list[str]) -> Table:
        return self._pick(dict(zip(unique_names(names), self._cells().values(), strict=True)))

    def map(self, col: str, fn) -> Table:
        """fn: a function of a cell's Column (an Expr or Column), or a Python function of a cell."""
        if col not in self.headers:
            return self._unknown("Map", col)
        found = build(fn, self._env())
        if found is None:
            return self._ran("map", col, fn)
        return self._pick(self._cells() | {col: blank(found.cast("string"))})

    map_parallel = map

    def map_expr(self, col: str, fn: Callable[[Column], Column]) -> Table:
        """fn turns the column's Column into another, evaluated in the JVM."""
        return self.map(col, fn(quoted(col))) if col in self.headers else self._unknown("Map", col)

    def add_col(self, name: str, fn) -> Table:
        found = build(fn, self._env())
        if found is None:
            return self._ran("string", unique_name(name, self.headers), fn)
        return self._with(name, blank(found.cast("string")))

    def add_col_float(self, name: str, fn) -> Table:
        found = build(fn, self._env())
        if found is None:
            return self._ran("double", unique_name(name, self.headers), fn)
        return self._with_number(name, found.cast("double"), shortest)

    def add_col_int(self, name: str, fn) -> Table:
        found = build(fn, self._env())
        if found is None:
            return self._ran("bigint", unique_name(name, self.headers), fn)
        return self._with_number(name, found.cast("bigint"), lambda x: x.cast("string"))

    def _with_number(self, name: str, value: Column, text: Callable[[Column], Column]) -> Table:
        """A new column of numbers, as cells and as it is."""
        name = unique_name(name, self.headers)
        raws = [quoted(c) for c in self._df.columns if c.startswith(RAW)]
        held = self._df.withColumn("__x", value)
        return self._new(held.select(*map(quoted, self.headers), blank(text(F.col("__x"))).alias(name), *raws, F.col("__x").alias(RAW + name), ORD))

    def add_col_of(self, name: str, fn: Callable[[Row], Any], stringify: Callable[[Any], str]) -> Table:
        return self.add_col(name, lambda r: stringify(fn(r)))

    def add_col_switch(self, name: str, cases: list[Case], otherwise=None) -> Table:
        value = blank(self._of_row(otherwise, "string").cast("string")) if otherwise is not None else F.lit("")
        for case in reversed(cases):
            value = F.when(self._test(case.when), blank(self._of_row(case.then, "string").cast("string"))).otherwise(value)
        return self._with(name, value)

    def transform(self, fn: Callable[[Row], dict[str, str]] | dict[str, Any]) -> Table:
        """fn: a Python function of a row to new cells, or expressions by column; other names are ignored."""
        if isinstance(fn, dict):
            return self._pick(self._cells() | {n: blank(self._of_row(f, "string").cast("string")) for n, f in fn.items() if n in self.headers})
        return self._ran("transform", "", fn) if self.headers else self._new(self._df.select(ORD))

    transform_parallel = transform

    def add_row_index(self, name: str) -> Table:
        taken = unique_names([name, *self.headers])
        df = self._indexed()
        return self._new(df.select(F.col("__i").cast("string").alias(taken[0]), *(quoted(h).alias(n) for h, n in zip(self.headers, taken[1:], strict=True)), ORD))

    def fill_empty(self, col: str, val: str) -> Table:
        if col not in self.headers:
            return self._unknown("FillEmpty", col)
        return self._pick(self._cells() | {col: F.when(quoted(col) == "", F.lit(val)).otherwise(quoted(col))})

    def format_col(self, col: str, precision: int) -> Table:
        if col not in self.headers:
            return self._unknown("FormatCol", col)
        return self._pick(self._cells() | {col: F.coalesce(fixed(self._env().number(col), precision), quoted(col))})

    def coalesce(self, name: str, *cols: str) -> Table:
        env = self._env()
        return self._with(name, F.coalesce(*(present(env.cell(c)) for c in cols), F.lit("")))

    def bin(self, col: str, name: str, bins: list[BinDef]) -> Table:
        if col not in self.headers:
            return self._unknown("Bin", col)
        x = self._env().number(col)
        label = F.lit(bins[-1].label if bins else "")
        for b in reversed(bins):
            label = F.when(x < F.lit(float(b.max)), F.lit(b.label)).otherwise(label)
        return self._with(name, F.when(x.isNull(), "").otherwise(label))

    # -- filters -------------------------------------------------------------------------------

    def where(self, fn) -> Table:
        return self._new(self._df.filter(self._of_row(fn, "boolean")))

    def drop_empty(self, *cols: str) -> Table:
        missing = [c for c in cols if c not in self.headers]
        if missing and self.mutable:
            return self._unknown("DropEmpty", missing[0])
        tested = [c for c in cols if c in self.headers] if cols else self.headers
        return self._new(self._df.filter(reduce(lambda a, b: a & b, [predicates.ne(c, "").build(self._env()) for c in tested], F.lit(True))))

    def partition(self, fn) -> tuple[Table, Table]:
        test = self._test(fn)
        return self._new(self._df.filter(test)), self._new(self._df.filter(~test))

    def eq(self, col: str, val: str) -> Expr:
        return predicates.eq(col, val)

    def ne(self, col: str, val: str) -> Expr:
        return predicates.ne(col, val)

    def contains(self, col: str, sub: str) -> Expr:
        return predicates.contains(col, sub)

    def prefix(self, col: str, start: str) -> Expr:
        return predicates.prefix(col, start)

    def suffix(self, col: str, end: str) -> Expr:
        return predicates.suffix(col, end)

    def matches(self, col: str, pattern: str) -> Expr:
        return predicates.matches(col, pattern)

    def empty(self, col: str) -> Expr:
        return predicates.empty(col)

    def not_empty(self, col: str) -> Expr:
        return predicates.not_empty(col)

    # -- joins ---------------------------------------------------------------------------------

    def _sides(self, op: str, other: Table, left: str, right: str):
        out = self
        if left not in self.headers:
            out = out._unknown(op, left)
        if right not in other.headers:
            out = out._unknown(op, right)
        if out is not self:
            return out, None, None, None
        extra = [h for h in other.headers if h != right]
        names = unique_names([*self.headers, *extra])
        a = self._df.select(*(quoted(h).alias(n) for h, n in zip(self.headers, names, strict=False)), F.col(ORD).alias("__l"))
        b = other._df.select(quoted(right).alias("__k"), *(quoted(h).alias(n) for h, n in zip(extra, names[len(self.headers) :], strict=True)), F.col(ORD).alias("__r"))
        return None, a, b, names

    def _joined(self, op: str, how: str, other: Table, left: str, right: str) -> Table:
        bad, a, b, names = self._sides(op, other, left, right)
        if bad is not None:
            return bad
        both = a.join(b, quoted(left) == F.col("__k"), how)
        order = {
            "right": F.struct("__r", "__l"),
            "full": F.struct(F.col("__l").isNull().alias("only"), F.col("__l"), F.col("__r")),
        }.get(how, F.struct("__l", "__r"))
        key = F.coalesce(quoted(left), F.col("__k")) if how in ("right", "full") else quoted(left)
        return self._new(both.select(*((key if n == left else blank(quoted(n))).alias(n) for n in names), order.alias(ORD)), False)

    def join(self, other: Table, left: str, right: str) -> Table:
        return self._joined("Join", "inner", other, left, right)

    def left_join(self, other: Table, left: str, right: str) -> Table:
        return self._joined("LeftJoin", "left", other, left, right)

    def right_join(self, other: Table, left: str, right: str) -> Table:
        return self._joined("RightJoin", "right", other, left, right)

    def outer_join(self, other: Table, left: str, right: str) -> Table:
        return self._joined("OuterJoin", "full", other, left, right)

    def anti_join(self, other: Table, left: str, right: str) -> Table:
        bad, a, b, _ = self._sides("AntiJoin", other, left, right)
        if bad is not None:
            return bad
        kept = a.join(b.select("__k"), quoted(left) == F.col("__k"), "left_anti")
        return self._new(kept.withColumnRenamed("__l", ORD))

    def lookup(self, col: str, out_col: str, table: Table, key_col: str, val_col: str) -> Table:
        for name, known in ((col, self.headers), (key_col, table.headers), (val_col, table.headers)):
            if name not in known:
                return self._unknown("Lookup", name)
        held = table._df.groupBy(quoted(key_col).alias("__k")).agg(F.max_by(quoted(val_col), F.col(ORD)).alias("__v"))
        both = self._df.join(held, quoted(col) == F.col("__k"), "left")
        return self._new(both.select(*map(quoted, self.headers), blank(F.col("__v")).alias(unique_name(out_col, self.headers)), ORD))

    # -- aggregation ---------------------------------------------------------------------------

    def group_by_agg(self, group_cols: list[str], aggs: list[tuple[str, Agg]]) -> Table:
        """aggs: (output name, aggregate). Groups come in the order in which they are first seen."""
        for c in group_cols:
            if c not in self.headers:
                out = self._unknown("GroupByAgg", c)
                return out._new(out._df.limit(0)) if self.mutable else out
        env = self._env()
        keys = [quoted(c).alias(f"__k{i}") for i, c in enumerate(group_cols)]
        made = [a.grouped(env, F.col(ORD)).alias(f"__a{i}") for i, (_, a) in enumerate(aggs)]
        grouped = self._df.groupBy(*keys).agg(*made, F.min(ORD).alias(ORD)).filter(F.col(ORD).isNotNull())
        names = unique_names([*group_cols, *(n for n, _ in aggs)])
        cols = [F.col(f"__k{i}") for i in range(len(keys))] + [a.text(F.col(f"__a{i}")) for i, (_, a) in enumerate(aggs)]
        return self._new(grouped.select(*(c.alias(n) for c, n in zip(cols, names, strict=True)), ORD))

    def value_counts(self, col: str) -> Table:
        if col not in self.headers:
            return self._unknown("ValueCounts", col)
        n = self._df.groupBy(quoted(col).alias("value")).agg(F.count("*").alias("n"), F.min(ORD).alias("__first"))
        return self._new(n.select("value", F.col("n").cast("string").alias("count"), F.struct((-F.col("n")).alias("n"), "__first").alias(ORD)), False)

    # -- row order -----------------------------------------------------------------------------

    def _shifted(self, op: str, col: str, out_col: str, n: int, way: str) -> Table:
        if col not in self.headers:
            return self._unknown(op, col)
        n = max(n, 0)
        df = self._indexed()
        name = unique_name(out_col, self.headers)
        fn = F.lag if way == "lag" else F.lead
        if n:
            df = ordered.over_rows(df, "__i", n if way == "lag" else 0, n if way == "lead" else 0, lambda w: {name: fn(quoted(col), n, "").over(w)})
        else:
            df = df.withColumn(name, quoted(col))
        return self._numbered(df, quoted(name))

    def lag(self, col: str, out_col: str, n: int) -> Table:
        return self._shifted("Lag", col, out_col, n, "lag")

    def lead(self, col: str, out_col: str, n: int) -> Table:
        return self._shifted("Lead", col, out_col, n, "lead")

    def cum_sum(self, col: str, out_col: str) -> Table:
        if col not in self.headers:
            return self._unknown("CumSum", col)
        cell = quoted(col)
        whole, real = integer(cell), number(cell)
        df = ordered.running_sums(self._long(), ORD, {
            "__whole": F.when(whole.isNotNull(), whole.cast("decimal(38,0)")),
            "__real": F.when(whole.isNull(), real),
            "__reals": F.when(whole.isNull() & real.isNotNull(), 1),
        })
        df = df.withColumn("__sum", F.col("__whole").cast("double") + F.col("__real"))
        text = F.when(F.col("__reals") == 0, F.col("__whole").cast("string")).otherwise(shortest(F.col("__sum")))
        return self._new(df.select(*map(quoted, self.headers), text.alias(unique_name(out_col, self.headers)), ORD))

    def rank(self, col: str, out_col: str, ascending: bool = True) -> Table:
        if col not in self.headers:
            return self._unknown("Rank", col)
        name = unique_name(out_col, self.headers)
        df = ordered.dense_rank(self._df.withColumn("__x", self._env().number(col)), "__x", "__rank", ascending)
        return self._new(df.select(*map(quoted, self.headers), blank(F.col("__rank").cast("string")).alias(name), ORD))

    def rolling_agg(self, out_col: str, size: int, agg: Agg) -> Table:
        size = max(size, 1)
        env, name = self._env(), unique_name(out_col, self.headers)
        df = ordered.over_rows(self._indexed(), "__i", size - 1, 0, lambda w: {"__x": agg.rolling(env, w.rowsBetween(-(size - 1), 0))})
        return self._numbered(df, agg.text(F.col("__x")).alias(name))

    def _filled(self, op: str, col: str, forward: bool) -> Table:
        if col not in self.headers:
            return self._unknown(op, col)
        df = ordered.fill(self._long(), ORD, present(quoted(col)), "__filled", forward)
        return self._new(df.select(*((blank(F.col("__filled")) if h == col else quoted(h)).alias(h) for h in self.headers), ORD))

    def fill_forward(self, col: str) -> Table:
        return self._filled("FillForward", col, True)

    def fill_backward(self, col: str) -> Table:
        return self._filled("FillBackward", col, False)

    def sort(self, col: str, ascending: bool = True) -> Table:
        if col not in self.headers:
            return self._unknown("Sort", col)
        return self.sort_multi(SortKey(col, ascending))

    def sort_multi(self, *keys: SortKey) -> Table:
        out = self
        for k in keys:
            if k.col not in self.headers:
                out = out._unknown("SortMulti", k.col)
        by = [quoted(k.col).asc() if k.ascending else quoted(k.col).desc() for k in keys if k.col in self.headers]
        if not by:
            return out
        return out._new(self._df.orderBy(*by, ORD).withColumn(ORD, F.monotonically_increasing_id()), False)

    def head(self, n: int) -> Table:
        return self._new(ordered.head(self._df, ORD, n))

    def tail(self, n: int) -> Table:
        return self._new(ordered.tail(self._df, ORD, n))

    def sample(self, n: int, seed: int | None = None) -> Table:
        """n rows without replacement; the mutable table shuffles where n covers all rows."""
        total = self.len()
        if n >= total and not self.mutable:
            return self
        by = F.rand(seed) if seed is not None else F.rand()
        drawn = self._df.withColumn("__u", by) if n >= total else ordered.drawn(self._df, ORD, by, max(n, 0), total)
        return self._new(drawn.withColumn(ORD, F.struct("__u", ORD)).drop("__u"), False)

    def sample_frac(self, f: float, seed: int | None = None) -> Table:
        return self.sample(int(self.len() * f), seed)

    def chunk(self, n: int) -> list[Table]:
        if n <= 0:
            return [self]
        df = self._indexed()
        total = df.count()
        df = materialise(df) if total > n else df
        return [self._new(df.filter((F.col("__i") >= at) & (F.col("__i") < at + n)).drop("__i")) for at in range(0, total, n)]

    # -- sets ----------------------------------------------------------------------------------

    def distinct(self, *cols: str) -> Table:
        out = self
        for c in cols:
            if c not in self.headers:
                if self.mutable:
                    return self._unknown("Distinct", c)
                out = out._unknown("Distinct", c)
        keys = [c for c in cols if c in self.headers] if cols else self.headers
        if not keys:
            return out._new(ordered.head(self._df, ORD, 1)) if cols else out
        rest = [h for h in self.headers if h not in keys]
        least = F.min(F.struct(F.col(ORD).alias("o"), *(quoted(h).alias(f"c{i}") for i, h in enumerate(rest)))).alias("__f")
        found = self._df.groupBy(*(quoted(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(least)
        at = {k: F.col(f"__k{i}") for i, k in enumerate(keys)} | {h: F.col(f"__f.c{i}") for i, h in enumerate(rest)}
        return out._new(found.select(*(at[h].alias(h) for h in self.headers), F.col("__f.o").alias(ORD)))

    def append(self, other: Table) -> Table:
        """other's rows after this table's, by name; what other lacks is empty, what only other has goes."""
        if dict(self._df.dtypes)[ORD] != dict(other._df.dtypes)[ORD]:
            return self._new(self._long(), True).append(type(self)(other._long(), stable=True))
        have = set(other.headers)
        a = self._df.select(*map(quoted, self.headers), F.struct(F.lit(0).alias("side"), F.col(ORD).alias("o")).alias(ORD))
        b = other._df.select(*((quoted(h) if h in have else F.lit("")).alias(h) for h in self.headers), F.struct(F.lit(1).alias("side"), F.col(ORD).alias("o")).alias(ORD))
        return self._new(a.unionByName(b), False)

    append_mutable = append

    def intersect(self, other: Table, *cols: str) -> Table:
        """Rows (copies included) whose cells in cols (all) other has as well."""
        out = self
        for c in cols:
            if c not in self.headers or c not in other.headers:
                out = out._unknown("Intersect", c)
        keys = [c for c in (cols or self.headers) if c in self.headers and c in other.headers]
        if cols and out is not self:
            return out
        if not keys:
            return out._new(self._df.limit(0))
        held = other._df.select(*(quoted(k).alias(f"__k{i}") for i, k in enumerate(keys))).distinct()
        same = reduce(lambda a, b: a & b, [quoted(k) == F.col(f"__k{i}") for i, k in enumerate(keys)])
        return out._new(self._df.join(held, same, "left_semi"))

    # -- reshape -------------------------------------------------------------------------------

    def explode(self, col: str, sep: str) -> Table:
        if col not in self.headers:
            return self._unknown("Explode", col)
        df = self._df.select("*", F.posexplode(reshape.parts(quoted(col), sep)).alias("__p", "__c"))
        return self._new(df.select(*((F.col("__c") if h == col else quoted(h)).alias(h) for h in self.headers), F.struct(F.col(ORD).alias("o"), F.col("__p")).alias(ORD)), False)

    def melt(self, id_cols: list[str], var_name: str, val_name: str) -> Table:
        ids = [(c, quoted(c) if c in self.headers else F.lit("") if self.mutable or not self.headers else quoted(self.headers[0])) for c in id_cols]
        rest = [h for h in self.headers if h not in id_cols]
        names = unique_names([*id_cols, var_name, val_name])
        df = self._df.select("*", F.explode(reshape.melted(rest, quoted, "__var", "__val")).alias("__m")) if rest else self._df.limit(0).withColumn("__m", F.struct(F.lit(0).alias("__p"), F.lit("").alias("__var"), F.lit("").alias("__val")))
        cells = [*(c for _, c in ids), F.col("__m.__var"), F.col("__m.__val")]
        return self._new(df.select(*(c.alias(n) for c, n in zip(cells, names, strict=True)), F.struct(F.col(ORD).alias("o"), F.col("__m.__p").alias("p")).alias(ORD)), False)

    def _first_seen(self, value: Column) -> list[str]:
        """Distinct cells in the order in which they are first seen; they become names, NAMES at most."""
        found = self._df.groupBy(value.alias("v")).agg(F.min(ORD).alias("o")).orderBy("o").limit(NAMES + 1).collect()
        if len(found) > NAMES:
            raise ValueError(f"more than {NAMES} different cells can't become columns or tables")
        return [r["v"] for r in found]

    def pivot(self, index: str, col: str, val: str) -> Table:
        out = self
        for c in (index, col, val):
            if c not in self.headers:
                out = out._unknown("Pivot", c)
        if out is not self:
            return out
        seen = self._first_seen(quoted(col))
        made = [F.max_by(F.when(quoted(col) == F.lit(v), quoted(val)), F.when(quoted(col) == F.lit(v), F.col(ORD))).alias(f"__p{i}") for i, v in enumerate(seen)]
        df = self._df.groupBy(quoted(index).alias("__index")).agg(F.min(ORD).alias(ORD), *made)
        names = unique_names([index, *seen])
        cells = [F.col("__index"), *(blank(F.col(f"__p{i}")) for i in range(len(seen)))]
        return self._new(df.select(*(c.alias(n) for c, n in zip(cells, names, strict=True)), ORD))

    def transpose(self) -> Table:
        """Columns become rows, named by `column`, and rows (NAMES at most) columns 0, 1, ..."""
        df = self._indexed()
        n = df.count()
        if n > NAMES:
            raise ValueError(f"more than {NAMES} rows can't become columns")
        long = df.select("__i", F.explode(reshape.melted(self.headers, quoted, "column", "__val")).alias("__m")).select("__i", "__m.*")
        made = [F.max(F.when(F.col("__i") == i, F.col("__val"))).alias(str(i)) for i in range(n)]
        wide = long.groupBy("__p", "column").agg(F.count("*").alias("__n"), *made)
        return self._new(wide.select("column", *(quoted(str(i)) for i in range(n)), F.col("__p").cast("long").alias(ORD)), True)

    def group_by(self, col: str) -> dict[str, Table]:
        if col not in self.headers:
            if self.mutable:
                self._errs = self._unknown("GroupBy", col)._errs
            return {}
        return {v: type(self)(self._df.filter(quoted(col) == F.lit(v)), stable=self._stable) for v in self._first_seen(quoted(col))}

    # -- JSON ----------------------------------------------------------------------------------

    def expand_json(self, col: str, options: JSONOptions = JSONOptions()) -> Table:
        if col not in self.headers:
            return self._unknown("ExpandJSON", col)
        paths = {}
        for name, path in sorted((options.mapping or {}).items()):
            try:
                paths[name] = jsontext.parse_path(path)
            except jsontext.PathError as error:
                return self._fail("ExpandJSON", str(error))

        def fields(cell: str) -> list[tuple[str, str]]:
            try:
                value = jsontext.decode(cell)
            except ValueError:
                return []
            if paths:
                return [(n, jsontext.text(jsontext.follow(value, p))) for n, p in paths.items()]
            found = jsontext.flatten(value, col, options.separator, options.max_depth) if options.flatten else jsontext.top_level(value, col)
            return list(dict(found).items())

        pairs = F.udf(lambda cell: [{"k": k, "v": v} for k, v in fields(cell)], "array<struct<k:string,v:string>>", useArrow=True)
        df = self._df.withColumn("__json", pairs(quoted(col)))
        if paths:
            keys = list(paths)
        else:
            df = materialise(df)  # read for its keys and for its cells, parsed once
            seen = df.select(ORD, F.posexplode("__json").alias("p", "f")).groupBy("f.k").agg(F.min(F.struct(ORD, "p")).alias("o"))
            keys = [r["k"] for r in seen.orderBy("o").collect()]
        if options.sorted_headers:
            keys = sorted(keys, key=lambda k: k.encode())
        rest = [h for h in self.headers if h != col]
        names = unique_names([*rest, *keys])
        held = df.withColumn("__map", F.map_from_entries("__json"))
        cells = [*map(quoted, rest), *(blank(F.try_element_at("__map", F.lit(k))) for k in keys)]
        return self._new(held.select(*(c.alias(n) for c, n in zip(cells, names, strict=True)), ORD))

    def _json_mapper(self, path: str | None, mapping: dict[str, str] | None, strict: bool):
        """A Python function of a cell, or None where nothing is asked for."""
        if path:
            steps = jsontext.parse_path(path)
            make = lambda v: jsontext.text(jsontext.follow(v, steps))
        elif mapping:
            all_steps = {}
            for name, p in mapping.items():
                try:
                    all_steps[name] = jsontext.parse_path(p)
                except jsontext.PathError:
                    if strict:
                        raise
            if not all_steps:
                return None
            make = lambda v: jsontext.compact({n: x for n, s in all_steps.items() if (x := jsontext.follow(v, s)) is not None})
        else:
            return None

        def mapped(cell: str) -> str:
            value = jsontext.decode(cell)
            if not isinstance(value, dict):
                raise ValueError("not a JSON object")
            return make(value)

        return mapped

    def map_json(self, col: str, path: str | None = None, mapping: dict[str, str] | None = None) -> Table:
        """The cell's value at a path, or an object rebuilt from a mapping; cells that are no object stay."""
        if col not in self.headers:
            return self._unknown("MapJSON", col)
        try:
            fn = self._json_mapper(path, mapping, False)
        except jsontext.PathError:
            return self
        if fn is None:
            return self

        def lenient(cell: str) -> str:
            try:
                return fn(cell)
            except ValueError:
                return cell

        return self.map(col, lenient)

    def try_map_json(self, col: str, path: str | None = None, mapping: dict[str, str] | None = None) -> Result:
        if col not in self.headers:
            return self._tried(Err(ValueError(f'TryMapJSON: unknown column "{col}"')))
        try:
            fn = self._json_mapper(path, mapping, True)
        except jsontext.PathError as error:
            return self._tried(Err(error))
        return Ok(self) if fn is None else self.try_map(col, fn)

    # -- fallible steps ------------------------------------------------------------------------

    def _attempt(self, fn: Callable, col: str | None) -> DataFrame:
        """The frame with __try: struct of the new value and the error's text."""
        kind = "struct<v:string,e:string>" if col else "struct<v:map<string,string>,e:string>"

        def run(x):
            try:
                got = fn(x)
            except Exception as error:  # a row's failure is data here
                return {"v": None, "e": str(error)}
            return {"v": str(got) if col else {k: str(v) for k, v in (got or {}).items()}, "e": None}

        made = self._python(run, kind, False)(quoted(col)) if col else self._python(run, kind)()
        return self._df.withColumn("__try", made)

    def _applied(self, tried: DataFrame, col: str | None) -> DataFrame:
        if col:
            return tried.select(*((F.col("__try.v") if h == col else quoted(h)).alias(h) for h in self.headers), ORD)
        return tried.select(*(F.coalesce(F.try_element_at("__try.v", F.lit(h)), quoted(h)).alias(h) for h in self.headers), ORD)

    def _tried(self, result: Result) -> Result:
        if self.mutable and isinstance(result, Err):
            return Ok(type(self)(self._df, [*self._errs, result.error], self._source, self._stable))
        return result

    def _try(self, fn: Callable, col: str | None, op: str) -> Result:
        if col is not None and col not in self.headers:
            return self._tried(Err(ValueError(f'{op}: unknown column "{col}"')))
        tried = materialise(self._attempt(fn, col))
        first = tried.filter(F.col("__try.e").isNotNull()).orderBy(ORD).select("__try.e").first()
        if first is not None:
            return self._tried(Err(ValueError(first[0])))
        return Ok(self._new(self._applied(tried, col)))

    def try_map(self, col: str, fn: Callable[[str], str]) -> Result:
        return self._try(fn, col, "TryMap")

    def try_transform(self, fn: Callable[[Row], dict[str, str]]) -> Result:
        return self._try(fn, None, "TryTransform")

    def assert_columns(self, *cols: str) -> Exception | None:
        missing = [c for c in cols if c not in self.headers]
        return ValueError(f'AssertColumns: unknown column "{missing[0]}"') if missing else None

    def assert_no_empty(self, *cols: str) -> Exception | None:
        """The first empty cell, row by row."""
        for c in cols:
            if c not in self.headers:
                return ValueError(f'AssertNoEmpty: unknown column "{c}"')
        tested = list(cols) or self.headers
        if not tested:
            return None
        bad = self._indexed().filter(reduce(lambda a, b: a | b, [quoted(c) == "" for c in tested])).orderBy("__i").first()
        if bad is None:
            return None
        return ValueError(f'row {bad["__i"]}: column "{next(c for c in tested if bad[c] == "")}" is empty')


class MutableTable(Table):
    """The same operators; each changes this table and returns it."""

    mutable = True

    def __init__(self, table: Table | DataFrame, errs: Iterable[Exception] = (), source: str = "", stable: bool = False):
        if isinstance(table, Table):
            super().__init__(table._df, table._errs, table._source, table._stable)
            self._dense = table._dense
        else:
            super().__init__(table, errs, source, stable)

    def _become(self, other: Table) -> MutableTable:
        self._df, self._errs, self._source, self._stable, self._dense = other._df, list(other._errs), other._source, other._stable, other._dense
        return self

    def reset_errs(self) -> None:
        self._errs = []

    def table(self) -> Table:
        return self.freeze()

    #: Frames don't alias; views are copies of the state at the call.
    freeze_view = Table.freeze

    def assert_columns(self, *cols: str) -> MutableTable:
        for c in cols:
            if c not in self.headers:
                self._errs = self._unknown("AssertColumns", c)._errs
        return self

    def set(self, row: int, col: str, val: str) -> MutableTable:
        if col not in self.headers:
            return self._become(self._unknown("Set", col))
        if row < 0 or row >= self.len():
            return self._become(self._fail("Set", f"row {row} is out of range"))
        df = self._indexed()
        return self._become(self._new(df.select(*((F.when(F.col("__i") == row, F.lit(val)).otherwise(quoted(h)) if h == col else quoted(h)).alias(h) for h in self.headers), ORD)))

    def append_row(self, values: list[str]) -> MutableTable:
        return self._become(Table.append(self, new(self.headers, [values])))


def _in_place(name: str):
    operate = getattr(Table, name)

    def run(self, *args, **kwargs):
        before = MutableTable(self)
        made = operate(before, *args, **kwargs)
        if isinstance(made, Ok):
            self._become(made.value)
            return Ok(self)
        return self._become(made)

    run.__name__, run.__doc__ = name, operate.__doc__
    return run


OPERATORS = (
    "select", "drop", "rename", "rename_many", "map", "map_parallel", "map_expr", "add_col", "add_col_float", "add_col_int", "add_col_of", "add_col_switch", "transform", "transform_parallel", "add_row_index",
    "fill_empty", "format_col", "coalesce", "bin", "where", "drop_empty", "join", "left_join", "right_join", "outer_join", "anti_join", "lookup", "group_by_agg", "value_counts", "lag", "lead", "cum_sum", "rank",
    "rolling_agg", "fill_forward", "fill_backward", "sort", "sort_multi", "head", "tail", "sample", "sample_frac", "distinct", "append", "append_mutable", "intersect", "explode", "melt", "pivot", "transpose",
    "expand_json", "map_json", "with_source",
)
for _name in (*OPERATORS, "try_map", "try_transform", "try_map_json"):
    setattr(MutableTable, _name, _in_place(_name))


def new(headers: list[str], records: Iterable[Iterable[str]]) -> Table:
    """A table from records: names made unique, short records padded, long ones cut."""
    names = unique_names(headers)
    rows = [tuple(("" if v is None else str(v)) for v in (list(r) + [""] * len(names))[: len(names)]) + (i,) for i, r in enumerate(records)]
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField(ORD, T.LongType())])
    return Table(session().createDataFrame(rows, schema), stable=True)


def new_from_rows(headers: list[str], rows: Iterable[Row]) -> Table:
    return new(headers, [r.values() for r in rows])


def new_mutable(headers: list[str], records: Iterable[Iterable[str]]) -> MutableTable:
    return MutableTable(new(headers, records))


def from_frame(df: DataFrame, order: str | None = None) -> Table:
    """A table of a typed frame: cells as text, nulls empty; order names a unique long column that gives the row order."""
    names = unique_names(df.columns)
    cells = [(shortest(quoted(f.name)) if isinstance(f.dataType, T.DoubleType | T.FloatType) else quoted(f.name).cast("string")) for f in df.schema]
    kept = T.StringType | T.ByteType | T.ShortType | T.IntegerType | T.LongType | T.DoubleType
    raws = [quoted(f.name).alias(RAW + n) for f, n in zip(df.schema, names, strict=True) if isinstance(f.dataType, kept)]
    number_ = quoted(order).cast("long") if order else F.monotonically_increasing_id()
    return Table(df.select(*(blank(c).alias(n) for c, n in zip(cells, names, strict=True)), *raws, number_.alias(ORD)), stable=order is not None)


def concat(*tables: Table) -> Table:
    return reduce(lambda a, b: a.append(b), tables) if tables else new([], [])


def union(a: Table, b: Table, *cols: str) -> Table:
    return a.append(b).distinct(*cols)


def cartesian_product(a: Table, b: Table) -> Table:
    """All pairs, the first table's order first."""
    names = unique_names([*a.headers, *b.headers])
    left = a._df.select(*(quoted(h).alias(n) for h, n in zip(a.headers, names, strict=False)), F.col(ORD).alias("__l"))
    right = b._df.select(*(quoted(h).alias(n) for h, n in zip(b.headers, names[len(a.headers) :], strict=True)), F.col(ORD).alias("__r"))
    return Table(left.crossJoin(right).select(*map(quoted, names), F.struct("__l", "__r").alias(ORD)))


