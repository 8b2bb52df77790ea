"""Aggregates over string cells, grouped or over a rolling frame of rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .expr import Env
from .values import present, shortest


@dataclass(frozen=True)
class Agg:
    """kind, column, separator; order is the row order's column when a group's rows must be told apart."""

    kind: str
    col: str
    sep: str = ""

    def raw(self, env: Env) -> Column:
        """The aggregate itself (of "join": the list of cells), in the order of the rows where that counts."""
        c = env.cell(self.col)
        return {"sum": lambda: F.sum(env.number(self.col)), "mean": lambda: F.avg(env.number(self.col)), "count": lambda: F.count(present(c)), "join": lambda: F.collect_list(present(c)), "first": lambda: F.first(c), "last": lambda: F.last(c)}[self.kind]()

    def grouped(self, env: Env, order: Column) -> Column:
        """As raw, for groups whose rows come in no order: order tells them apart."""
        c = env.cell(self.col)
        if self.kind == "join":
            kept = F.array_sort(F.collect_list(F.when(c != "", F.struct(order.alias("o"), c.alias("v")))))
            return F.transform(kept, lambda s: s["v"])
        return {"first": F.min_by, "last": F.max_by}[self.kind](c, order) if self.kind in ("first", "last") else self.raw(env)

    def rolling(self, env: Env, w: WindowSpec) -> Column:
        return self.raw(env).over(w)

    def text(self, x: Column) -> Column:
        """The aggregate as a cell."""
        if self.kind == "sum":
            return shortest(F.coalesce(x, F.lit(0.0)))
        if self.kind == "mean":
            return F.coalesce(shortest(x), F.lit(""))
        return x.cast("string") if self.kind == "count" else F.array_join(x, self.sep) if self.kind == "join" else x


def Sum(col: str) -> Agg:
    return Agg("sum", col)


def Mean(col: str) -> Agg:
    return Agg("mean", col)


def Count(col: str) -> Agg:
    return Agg("count", col)


def StringJoin(col: str, sep: str) -> Agg:
    return Agg("join", col, sep)


def First(col: str) -> Agg:
    return Agg("first", col)


def Last(col: str) -> Agg:
    return Agg("last", col)
