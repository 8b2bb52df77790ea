"""Types of string columns: inference, normal forms, statistics."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import predicates
from .functions.expr import quoted
from .functions.values import integer, moment, number, present, shortest, trimmed, truth
from .operators import ordered
from .plans.result import Err, Ok, Result
from .storage import materialise
from .table import ORD, Row, Table, new, session


#: Slices of rows whose types one task puts together.
SLICES = 4096
#: Different values that freq_map hands to the driver at most.
VALUES = 1_000_000


class ColType(IntEnum):
    INT, FLOAT, BOOL, DATE, STRING = range(5)


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def _fits(c: Column) -> list[Column]:
    """Whether a cell is an int, a float (commas allowed), a truth value, a date."""
    return [integer(c).isNotNull(), number(_plain(c)).isNotNull(), truth(c).isNotNull(), moment(c).isNotNull()]


class Schema:
    """Column types by name; a column without one is a string."""

    def __init__(self, types: dict[str, ColType]):
        self._types = dict(types)

    def col(self, name: str) -> ColType:
        return self._types.get(name, ColType.STRING)

    def cast(self, name: str, kind: ColType) -> Schema:
        return Schema(self._types | {name: kind})

    def cols(self) -> dict[str, ColType]:
        return dict(self._types)

    def apply(self, table: Table) -> Result:
        """Non-empty cells in their type's normal form; the first that has none is an error."""
        return self._apply(table, False)

    def apply_strict(self, table: Table) -> Result:
        """As apply; an empty cell outside string columns is an error too."""
        return self._apply(table, True)

    def _apply(self, table: Table, strict: bool) -> Result:
        typed = [h for h in table.headers if self.col(h) != ColType.STRING]
        new = {h: F.when(quoted(h) == "", F.lit(None if strict else "")).otherwise(normal_form(quoted(h), self.col(h))) if h in typed else quoted(h) for h in table.headers}
        df = table._indexed().select(*(c.alias(f"n{i}") for i, c in enumerate(new.values())), *(quoted(h) for h in table.headers), "__i", ORD)
        if typed:
            df = materialise(df)
            at = {h: i for i, h in enumerate(table.headers)}
            worst = F.least(*(F.when(F.col(f"n{at[h]}").isNull(), F.struct(F.lit(at[h]).alias("c"), F.col("__i").alias("i"), quoted(h).alias("v"))) for h in typed), F.lit(None))
            bad = df.agg(F.min(worst).alias("bad")).first()["bad"]
            if bad is not None:
                name = table.headers[bad["c"]]
                return Err(ValueError(f'column "{name}" row {bad["i"]}: cannot parse "{bad["v"]}" as {self.col(name).name.lower()}'))
        return Ok(Table(df.select(*(F.col(f"n{i}").alias(h) for i, h in enumerate(table.headers)), ORD), stable=table._stable))


def normal_form(c: Column, kind: ColType) -> Column:
    """The cell's canonical text, or null where it isn't of the type."""
    if kind == ColType.INT:
        return integer(c).cast("string")
    if kind == ColType.FLOAT:
        return shortest(number(_plain(c)))
    if kind == ColType.BOOL:
        return truth(c).cast("string")
    if kind == ColType.DATE:
        return F.date_format(moment(c), "yyyy-MM-dd")
    return trimmed(c)


def infer(table: Table) -> Schema:
    """The narrowest type of each column, cells read in row order and types only ever given up.

    A cell maps each type to the type that is left after it.  Such maps of a slice of
    rows are composed in order, a slice's map within a task and the slices' maps last.
    """
    names = table.headers
    if not names:
        return Schema({})
    types = range(len(ColType))

    def step(i: int, c: Column) -> Column:
        to = [F.lit(int(ColType.STRING))]
        for k in (3, 2, 1, 0):
            to.insert(0, F.when(F.col(f"f{i}_{k}"), k).otherwise(to[0]))
        return F.when(c != "", F.array(*to))

    # columns of their own, so that a cell is tested once for each type
    df = table._long().withColumns({f"f{i}_{k}": fit for i, n in enumerate(names) for k, fit in enumerate(_fits(quoted(n)))})
    df = df.select(ORD, *(step(i, quoted(n)).alias(f"m{i}") for i, n in enumerate(names)))
    whole = F.array(*map(F.lit, types))
    compose = lambda a, m: F.transform(a, lambda k: F.get(m, k))

    def composed(i: int) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col(f"m{i}").isNotNull(), F.struct(F.col(ORD).alias("o"), F.col(f"m{i}").alias("m")))))
        return F.aggregate(kept, whole, lambda a, x: compose(a, x["m"])).alias(f"m{i}")

    every = [composed(i) for i in range(len(names))]
    df = df.groupBy(F.shiftright(ORD, 12).alias("s")).agg(*every).withColumnRenamed("s", ORD)
    while (n := (df := materialise(df)).count()) > SLICES:  # ranges of slices, until their maps fit in a task
        cut = df.repartitionByRange(-(-n // SLICES), ORD)
        df = cut.groupBy(F.spark_partition_id().alias("s")).agg(*every).withColumnRenamed("s", ORD)
    df = df.agg(*every)
    found = df.first()
    empty = _all_empty(table)
    return Schema({n: ColType.STRING if empty[n] else ColType(found[f"m{i}"][0]) for i, n in enumerate(names)})


def _all_empty(table: Table) -> dict[str, bool]:
    row = table._df.agg(*(F.count(present(quoted(n))).alias(f"c{i}") for i, n in enumerate(table.headers))).first()
    return {n: row[f"c{i}"] == 0 for i, n in enumerate(table.headers)}


# -- typed access to a row in Python --------------------------------------------------------------


def int_(row: Row, col: str) -> int | None:
    try:
        found = int(row.get(col, "").strip())
        return found if -(1 << 63) <= found < 1 << 63 else None
    except ValueError:
        return None


def float_(row: Row, col: str) -> float | None:
    try:
        return float(row.get(col, "").strip())
    except ValueError:
        return None


def bool_(row: Row, col: str) -> bool | None:
    return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(row.get(col, "").strip().lower())


def time_(row: Row, col: str, layout: str | None = None):
    """A datetime by a strptime layout, or by the layouts of inference."""
    import datetime

    text = row.get(col, "").strip()
    tried = [layout] if layout else ["%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d %b %Y", "%b %d, %Y"]
    for fmt in tried:
        try:
            return datetime.datetime.strptime(text, fmt)
        except ValueError:
            continue
    return None


# -- statistics -----------------------------------------------------------------------------------


def _stats(table: Table, col: str):
    """count, sum, avg, min, max, std, filled, and two values about the middle, of one column; worked out once a frame."""
    if table.held.get("frame") is not table._df:
        table.held = {"frame": table._df}
    if col not in table.held:
        x = table._env().number(col)
        table.held[col] = table._df.agg(*_measures(x), F.count(present(quoted(col))).alias("filled")).first()
    return table.held[col]


def _measures(x: Column) -> list[Column]:
    return [F.count(x).alias("n"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_pop(x).alias("std"), ordered.around_middle(x).alias("middle")]


def _one(table: Table, col: str, name: str, default):
    if col not in table.headers:
        return default
    found = _stats(table, col)[name]
    return default if found is None else found


def sum_col(table: Table, col: str) -> float:
    return _one(table, col, "sum", 0.0)


def mean_col(table: Table, col: str) -> float:
    return _one(table, col, "mean", 0.0)


def min_col(table: Table, col: str) -> float:
    return _one(table, col, "lo", 0.0)


def max_col(table: Table, col: str) -> float:
    return _one(table, col, "hi", 0.0)


def median_col(table: Table, col: str) -> float:
    if col not in table.headers:
        return 0.0
    row = _stats(table, col)
    found = ordered.medians(table._df, {col: table._env().number(col)}, {col: (row["n"], row["middle"])})[col]
    return 0.0 if found is None else found


def std_dev_col(table: Table, col: str) -> float:
    """Of the population; 0 for fewer than two numbers."""
    return _one(table, col, "std", 0.0)


def count_col(table: Table, col: str) -> int:
    return _one(table, col, "filled", 0)


def count_where(table: Table, col: str, val: str) -> int:
    return table.where(predicates.eq(col, val)).len() if col in table.headers else 0


def freq_map(table: Table, col: str) -> dict[str, int]:
    """How often each cell stands; VALUES different ones at most, value_counts takes any number."""
    if col not in table.headers:
        return {}
    found = table._df.groupBy(quoted(col).alias("v")).agg(F.count("*").alias("n")).limit(VALUES + 1).collect()
    if len(found) > VALUES:
        raise ValueError(f"more than {VALUES} different cells; use value_counts")
    return {r["v"]: r["n"] for r in found}


def describe(table: Table) -> Table:
    """column, count, min, max, mean, std, median: one row a column; one pass, and one for the middles."""
    names = ["column", "count", "min", "max", "mean", "std", "median"]
    heads = table.headers
    if not heads:
        return new(names, [])
    env = table._env()
    numbers = {h: env.number(h) for h in heads}
    row = table._df.agg(*(F.struct(*_measures(x)).alias(f"s{i}") for i, x in enumerate(numbers.values()))).first()
    found = {h: row[f"s{i}"] for i, h in enumerate(heads)}
    middle = ordered.medians(table._df, numbers, {h: (r["n"], r["middle"]) for h, r in found.items()})
    rows = [(h, r["n"], r["lo"], r["hi"], r["mean"], r["std"], middle[h], i) for i, (h, r) in enumerate(found.items())]
    made = session().createDataFrame(rows, "column string, count long, min double, max double, mean double, std double, median double, i long")
    cells = [F.col("column"), F.col("count").cast("string"), *(F.coalesce(shortest(F.col(k)), F.lit("")) for k in names[2:])]
    return Table(made.select(*(c.alias(n) for c, n in zip(cells, names, strict=True)), F.col("i").alias(ORD)), stable=True)


def min_max_norm(table: Table, col: str) -> Table:
    """Numbers scaled to 0 .. 1; a constant column stays, as do cells that aren't numbers."""
    low, high = min_col(table, col), max_col(table, col)
    if high == low or col not in table.headers:
        return table
    x = table._env().number(col)
    return table.map(col, F.coalesce(shortest((x - F.lit(low)) / F.lit(high - low)), quoted(col)))
